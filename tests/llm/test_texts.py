import base64
import random

import numpy as np
import pytest

from talaan.llm import packing, residue, tokenizer

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "aabbeeehtinosr .,!=-_~\t\n0123456789éñ₱漢字👩‍⚕️'sl"


def test_encoding_equals_plain_merging(plain):
    t, rng = tokenizer.Transducer(), random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 900, "=" * 2000 + "a", " " * 700, "<|endoftext|> x", "\ud800 lone"[1:], "I'LL don't've"]
    for x in texts:
        assert t.encode(x) == plain.encode_ordinary(x)
        assert tokenizer.decode(t.token, t.encode(x)) == x


def test_emptied_tables_change_nothing(plain, monkeypatch):
    monkeypatch.setattr(tokenizer, "MAX_STATES", 50)
    monkeypatch.setattr(tokenizer, "MAX_WORDS", 10)
    t, rng = tokenizer.Transducer(), random.Random(9)
    for n in (5, 40, 900):
        x = "".join(rng.choice("abcdefgh xyz") for _ in range(n)) + "q" * 600
        assert t.encode(x) == plain.encode_ordinary(x)


def test_the_decoder_is_a_utf8_machine():
    rng = random.Random(1)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0]) for _ in range(rng.randint(0, 9)))
        m = tokenizer.Utf8()
        assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.end() == data.decode("utf-8", "replace")


def test_ids_of_rows(spark, plain):
    df = spark.createDataFrame([(1, "Hello ₱99", 5), (2, None, 5), (3, "", 5), (3, "", 5)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in tokenizer.encode(df).collect())
    assert got == [(1, plain.encode_ordinary("Hello ₱99")), (2, []), (3, []), (3, [])]
    assert tokenizer.encode(df.limit(0)).count() == 0


def test_placement_minimises_squares():
    rng = random.Random(3)
    sizes = [rng.randint(1, 20) for _ in range(400)]
    boxes = packing.place(sizes, 20)
    fills: list[int] = []
    for s, b in zip(sizes, boxes):
        counts = [fills.count(h) for h in range(21)]

        def squares(h):
            c = counts[:]
            if h:
                c[h] -= 1
            if h + s < 20:
                c[h + s] += 1
            return sum(x * x for x in c[:20])

        choices = [h for h in range(0, 21 - s) if h == 0 or counts[h]]
        at = fills[b] if b < len(fills) else 0
        assert squares(at) == min(map(squares, choices))
        if b == len(fills):
            fills.append(0)
        fills[b] += s
    assert max(fills) <= 20


def test_packing_loses_and_splits_nothing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, 30, 99, 100, 101, 250, 1000])) for i in range(900)] + [(901, None), (5, 30), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, n int").withColumnRenamed("n", "size_")
    got = packing.pack(df, "doc_id", "size_", capacity=100, block=200).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    fill: dict = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 100
    whole = [r for r in got if r.piece_no == 0 and r.n_tokens < 100]
    pieces = {(r.doc_id, r.piece_no): r for r in got}
    assert all((r.doc_id, 1) not in pieces for r in whole)
    assert sum(fill.values()) / (100 * len(fill)) > 0.9
    assert packing.pack(df.limit(0), "doc_id", "size_").count() == 0


BAD = [
    "Welcome to {{ city }}! We are open.", "Our rates start at ₱NaN.", "Hi |*FIRST_NAME*|, thanks", "Visit us at <address goes here>.", "Open [Opening Hours]. Call us.",
    "We sell bread. " * 20 + "Lorem ipsum dolor sit amet felis.", "Good coffee. This is placeholder copy. Replace it with your own words.",
    "Home | About | Services | Contact\n404 Page not found\nSearch this site", "Tiyil Supply\nScripting must be active. Allow it to view our store.", "Error 500: Internal Server Error",
    "Just a moment… Ray 118faf668d6", "Hindi nahanap ang pahina (404) Bumalik sa unang pahina.", "Kindly unblock Javascript to continue.", "Paumanhin, tinanggal na ang pahinang hinahanap mo.",
    "Your request wsa blocked. Access denied", "Access deneid", "Fobidden (403)", "Hirdi nahanap ang pahna",
]
GOOD = [
    "Find us in Room 404, fourth floor; yes, the page number on the old directory was 404 as well.", "Null Tide Diving is next door, their sign reads NULL TIDE.", "a tag such as {name} is swapped for the name",
    "Notice: parts of this site need JavaScript. Please enable it to use the booking form. We are open daily and bake bread.", "<|endoftext|> We bake bread.", "Take 20% off, then another 10% off for % lovers of our 100% cotton line.",
    'Hours: [Mon-Fri] 10am. {"@type": "LocalBusiness", "name": "X"} write to hello [at] x [dot] example', "Lorem's Cafe is our neighbor.", "TODO list of the branch for Tuesday: repaint gate",
    "We'd never ask you to verify that you are human, just say hello!", "Access denied doors, alarms and locks: we install them all.", "", "   ", None, "Your name here? We engrave mugs.",
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(BAD + GOOD)], "doc_id bigint, text string, slot boolean")
    got = {r.doc_id for r in residue.residue(df).where("excluded").collect()}
    assert got == set(range(len(BAD)))
    assert residue.residue(df.limit(0)).count() == 0


def test_long_texts_are_read_whole():
    text = "We bake bread every day. " * 20_000 + "Visit us at null."
    assert residue.judge(text)[0]
    assert np.isclose(residue.judge("x" * 500_000)[2], 0)


@pytest.mark.parametrize("text", [
    "Not Found Cafe, San Juan", "Oops! Nail Salon Makati", "Loading dock repair, Cebu", "The value was null and void", "We use null pointers in C and undefined behaviour.",
    "The lease is null and void after May. Call 0917 123 4567.", "In Python a missing value is not null but None.", "Access control and gate repair, Pasig",
])
def test_content_that_reads_like_residue_stays(text):
    slot, filler, share = residue.judge(text)
    assert not slot and not filler and share < residue.COVERED


@pytest.mark.parametrize("text", [
    "Hello *|FNAME|*", "Dear {{ user.first_name }}", "Hi [FIRST_NAME]", "Hello {customerName}", "<%= user.name %>", "Excepteur sint occaecat cupidatat non proident", "You're being rate limited.",
    "Seite nicht gefunden", "Page introuvable", "Welcome to undefined", "Dear null, thanks", "{{#if name}}x{{/if}}", "Une erreur est survenue. Veuillez réessayer plus tard.", "Hi {FIRST_NAME},", "404 Not Found",
])
def test_residue_in_other_notations_and_languages(text):
    slot, filler, share = residue.judge(text)
    assert slot or filler or share >= residue.COVERED
