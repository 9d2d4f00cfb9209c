import random

import pytest

from talaan.llm.groups import components, lead_groups
from talaan.llm.survivors import golden, survivors


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(2)
    name = {i: f"n{rng.random():.9f}" for i in range(300)}
    edges = {
        "random": [(name[rng.randrange(300)], name[rng.randrange(300)]) for _ in range(220)] + [(None, name[0]), (name[1], name[1])],
        "chain": [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)],
        "star": [(f"s{i:03}", "hub") for i in range(200)] * 2,
        "empty": [],
    }[shape]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "a string, b string, c int")
    got = {r.node: r.group_id for r in components(df, "a", "b").collect()}
    assert got == union_find(edges)


def test_ids_are_read_without_case_and_space(spark):
    rows = [("L-0a0000000002", " l-0A0000000001\t"), ("L-0A0000000002", "L-0a0000000003"), ("", "L-0a0000000009"), ("L-0a0000000008 ", "l-0a0000000008")]
    got = {tuple(r) for r in lead_groups(spark.createDataFrame(rows, "lead_id_a string, lead_id_b string")).collect()}
    assert got == {(f"L-0a000000000{i}", "L-0a0000000001") for i in (1, 2, 3)}


RECORDS = "group_no bigint, lead_id string, sources array<string>, phone string, website string, email string, updated_at string, trust string"
TRUST = "source string, description string, trust int"


def test_each_field_comes_from_the_record_that_deserves_it(spark):
    trust = spark.createDataFrame([("website", "", 5), ("osm", "", 3)], TRUST)
    rows = [
        (1, "L-b", [" OSM "], "+639171234567", "http://none", "a@b.ph", "2026-01-01T00:00:00+00:00", "x"),
        (1, "L-a", ["nope"], "+639999999999", "https://x.ph", "@", "2026-01-02", "x"),
        (1, "L-a", ["nope"], "+639999999999", "https://x.ph", "@", "2026-01-02", "x"),
        (1, "L-c", ["osm", "website"], "+639171234568", None, "a b@c.ph", "yesterday", "x"),
        (2, "L-d", None, "0917", "https://localhost", "n/a", None, "x"),
        (3, "L-f", [], "+639170000001", "www.x.ph", None, "2026-05-01T08:00:00+08:00", "x"),
        (3, "L-e", [], "+639170000002", None, None, "2026-05-01T00:00:01", "x"),
        (3, "L-g", [], "+639170000003", None, None, "2066-05-01T00:00:01Z", "x"),
        (4, "L-h", [], "+639170000004", None, None, None, None),
        (4, "L-i", [], "+639170000005", None, None, "0000-00-00", None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = {(r.group_no, r.field_name, r.lead_id) for r in survivors(df, trust).collect()}
    assert got == {(1, "phone", "L-c"), (1, "website", "L-a"), (1, "email", "L-b"), (3, "phone", "L-e"), (4, "phone", "L-h")}
    built = {r.group_no: r for r in golden(df, trust).collect()}
    assert built[2].phone is None and built[1].n_records == 4 and built[1].website == "https://x.ph"
    assert survivors(df.limit(0), trust).count() == 0
