import time

from pyspark.sql import functions as F

from talaan import runtime
from talaan.llm import history, linkage


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}


def test_a_written_table_gives_its_shuffle_files_back(spark):
    before, was = _shuffle_files(spark), spark.conf.get(runtime._CLEANUP, None)
    out = runtime.cut(spark.range(200_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.max("id").alias("top")))
    for _ in range(20):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert (out.count(), out.agg(F.sum("top")).first()[0]) == (1000, sum(range(199_000, 200_000)))
    assert spark.conf.get(runtime._CLEANUP, None) == was


def test_candidates_are_written_before_they_are_compared(spark, monkeypatch):
    """The key rows' exchange is over when the listings are shuffled to the pairs."""
    seen = []
    monkeypatch.setattr(linkage, "candidates", lambda x: spark.createDataFrame([(0, 1)], "id_a bigint, id_b bigint"))
    monkeypatch.setattr(linkage, "cut", lambda df, after=None: seen.append((df.columns[:2], bool(after))) or df)
    monkeypatch.setattr(linkage, "voted", lambda listings, pairs: pairs.selectExpr("*", *(f"cast(0 as tinyint) {v}" for v in linkage.VOTES)))
    assert linkage.judged(None).count() == 1
    assert seen == [(["id_a", "id_b"], False), (["id_a", "id_b"], True)]


def test_the_history_gives_shuffle_files_back(spark, tmp_path):
    before = _shuffle_files(spark)
    rows = spark.range(50_000).select(F.col("id").cast("string").alias("key")).distinct()
    history.History(spark, str(tmp_path))._write(rows, "keys", "000000")
    for _ in range(20):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.read.parquet(f"{tmp_path}/keys/000000").count() == 50_000


def test_long_generated_methods_are_split_where_tables_are_written(spark, tmp_path):
    """The JVM doesn't compile methods over 8,000 bytes; Spark's own limit is eight times that."""
    def limit():
        return spark.conf.get("spark.sql.codegen.hugeMethodLimit")

    before = limit()
    with runtime.writing(spark):
        assert int(limit()) <= 8_000
    assert limit() == before
