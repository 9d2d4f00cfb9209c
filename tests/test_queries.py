import ast
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import oracle
from talaan.plans import catalog

data = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the driver's tables")


@data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert oracle.differs(spark, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


@data
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    df = catalog.queries()[name](spark, oracle.DATA)
    assert df.count() >= 0 and len(df.columns) == len(set(df.columns))


def test_nothing_in_the_core_imports_the_optional_subpackage():
    root = Path(__file__).resolve().parent.parent / "talaan"
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("talaan.llm") for n in names), f


@data
def test_greedy_pairs_equal_the_ordered_choice(spark):
    from pyspark.sql import functions as F
    from talaan.operators import resolve
    from talaan.runtime import table

    leads = resolve.slim(table(spark, oracle.DATA, "leads"))
    p = resolve.by_place_and_name(leads, leads).select(F.col("a.lead_id").alias("x"), F.col("b.lead_id").alias("y"))
    near: dict = {}
    for r in p.collect():
        near.setdefault(r.x, set()).add(r.y)
    age = {r.lead_id: (r.first_seen_at, r.lead_id) for r in leads.collect()}
    taken, want = set(), set()
    for k in sorted(near, key=age.get):
        if k not in taken:
            free = [o for o in sorted(near[k], key=age.get) if o not in taken]
            if free:
                want.add((k, free[0]))
                taken |= {k, free[0]}
    assert {tuple(r) for r in resolve.greedy_pairs(leads).collect()} == want


def test_streams_and_batches_agree(spark, tmp_path):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F
    from talaan.streaming.monitor import first_seen, run_available, windowed

    t = datetime(2026, 1, 1)
    rows = [(i, t + timedelta(minutes=7 * i), i % 3, "k", float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run_available(windowed(stream, "1 hour", "1 hour").select("user_id", "n"), str(tmp_path / "out"), str(tmp_path / "ck"))
    closed = spark.read.parquet(str(tmp_path / "out"))
    whole = windowed(df, "1 hour", None)
    assert 0 < closed.count() <= whole.count() and whole.agg(F.sum("n")).first()[0] == 60
    seen = first_seen(stream.withColumn("fetched_at", F.col("ts")), ["user_id"])
    run_available(seen.select("user_id"), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 3 == first_seen(df, ["user_id"]).count()
