"""What runs for every record or pair is compiled and made once; the results stay what a plain reading gives."""

import random
import re

from pyspark.sql import functions as F

from talaan.llm import business, groups, history, linkage

LEXICON = business.Lexicon({"cafe": "cafe", "shop": None, "st": None, "s": "spa"})


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_kinds_are_found_without_lambdas(spark):
    rng = random.Random(3)
    rows = [" ".join(rng.choices(["cafe", "shop", "st", "s", "bora", "cafes", "stop", "b"], k=rng.randint(1, 5))) for _ in range(200)] + ["", "bora bora cafe", "cafe shop"]
    df = business.named(spark.createDataFrame([(w, None if i % 3 else "gym") for i, w in enumerate(rows)], "words string, label string").withColumn("w", F.col("words")), LEXICON)
    assert "lambda" not in plan(df)
    for i, r in enumerate(df.collect()):
        words = rows[i].split(" ")
        assert r.name == (" ".join(w for w in words if w not in LEXICON.kinds) or rows[i])
        assert r.kind == ("gym" if i % 3 == 0 else next((LEXICON.kinds[w] for w in words if LEXICON.kinds.get(w)), None))


def test_a_single_contact_is_read_like_one_of_several(spark):
    numbers = ["0917 123 4567", "+63 (2) 8123-4567", "00639171234567", "63", "0000", "", "639171234567 loc. 12", "123", "0917 123 4567 / 8123-4567", "a;b", "63063 9171 2345"]
    mails = ["MAILTO:A@b.ph", "a@b.ph; c@d.ph", "none", "", ";", "a@b.ph,a@b.ph"]
    rows = [([a], [b]) for a in numbers for b in mails] + [([], []), (["0917 123 4567", "8123-4567"], ["a@b.ph", "A@B.ph"])]
    df = spark.createDataFrame(rows, "p array<string>, m array<string>")
    got = df.select(business.phones(F.col("p")).alias("p"), business.emails(F.col("m")).alias("m"), history.hexes(F.col("p")).alias("x")).collect()
    texts = sorted({d for p, m in rows for d in (*_phones(p), *_mails(m))})
    hashes = dict(spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.hash("t")).collect())
    for (p, m), r in zip(rows, got):
        assert (r.p, r.m) == ([hashes[x] for x in _phones(p)], [hashes[x] for x in _mails(m)])
        assert r.x == "\n".join(x.encode().hex().upper() for x in p)


def _phones(values):
    plain = re.sub(r"(loc|ext|local)\.?\s*\d+", "", ";".join(values), flags=re.I)
    each = re.sub("[,/|]", ";", re.sub("[^0-9;,/|]+", "", plain)).split(";")
    return list(dict.fromkeys(x for e in each if len(x := re.sub("^(?:63)?0*", "", e)) >= 8))


def _mails(values):
    each = re.sub(r"[;,|\s]+", ";", ";".join(values).lower().replace("mailto:", "")).split(";")
    return list(dict.fromkeys(e for e in each if "@" in e))


def test_votes_are_written_with_their_pattern(spark):
    raw = spark.createDataFrame([(1, "Bora Gym", 14.0), (2, "Bora Gim", 14.0)], "id bigint, words string, lat double")
    none = {"phones": "array()", "mails": "array()", "web": "null", "fb": "null"}
    one = raw.selectExpr("id", "words", "cast(null as string) label", "lat", "lat + 100 lon", *(f"cast({v} as array<int>) {k}" if k[-1] == "s" else f"cast({v} as int) {k}" for k, v in none.items()), *(f"cast(null as string) {c}" for c in ("num", "street", "city")))
    pairs = spark.createDataFrame([(1, 2)], "id_a bigint, id_b bigint")
    r = linkage.voted(business.named(one, LEXICON), pairs).first()
    assert r.pattern == sum((r[c] - linkage.LOWEST) * linkage.LEVELS**i for i, c in enumerate(linkage.VOTES))


def test_hooking_takes_the_smallest_edge_without_sorting(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    df = groups._hook(spark.createDataFrame(sorted(edges), "u bigint, v bigint"))
    assert "struct(u" not in plan(df).replace("named_", "")
    best = {c: min(e for e in edges if c in e) for e in edges for c in e}
    to = {c: e[1] if e[0] == c else e[0] for c, e in best.items()}
    assert {tuple(r) for r in df.collect()} == {(c, c if to[p] == c and c < p else p) for c, p in to.items()}
