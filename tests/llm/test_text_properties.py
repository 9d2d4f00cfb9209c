from hypothesis import given, settings
from hypothesis import strategies as st

from talaan.llm import history, packing, residue, tokenizer


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoding_loses_nothing(text):
    t = tokenizer.transducer()
    assert tokenizer.decode(t.token, t.encode(text)) == text


@given(st.lists(st.integers(1, 64), max_size=80))
def test_containers_are_never_overfull(sizes):
    fill: dict = {}
    for s, b in zip(sizes, packing.place(sizes, 64)):
        fill[b] = fill.get(b, 0) + s
    assert sum(fill.values()) == sum(sizes) and max(fill.values(), default=0) <= 64


@given(st.text(max_size=200), st.text(max_size=50))
def test_an_added_line_keeps_the_other_chunks(text, line):
    assert set(history.chunks(text)) <= set(history.chunks(line.replace("\n", " ") + "\n" + text)) | set(history.chunks(text + "\n")) 


@given(st.text(max_size=200))
def test_any_text_is_judged(text):
    slot, filler, share = residue.judge(text)
    assert 0 <= share <= 1
