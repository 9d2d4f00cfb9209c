"""Session helpers: where lineage is cut, and how tables are read."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so that Python stages can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="talaan-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; file pruning and pushdown stay with Spark."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A folder of our own is set only where none is configured."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="talaan-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


_SCRATCH: dict = {}


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared checkpoint folder; it is removed when the program ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{checkpoint_dir(spark)}/talaan-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended already
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# What is written gives its shuffle files back as soon as it is written; they would stay until the driver collects its garbage.
# A stage whose generated method is longer than the JVM compiles (8,000 bytes) would be interpreted; Spark then uses split methods.
_WRITING = {_CLEANUP: "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings under which tables in the shared folder are written."""
    was = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, after: list[DataFrame] | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    A lost executor then costs no recomputation, and later plans see the table's true size: a plain
    checkpoint keeps the estimates of its plan, which multiply from join to join in iterative work.
    Tables in ``after`` are removed once this one is written.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    for old in after or []:
        drop(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._talaan_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the table behind a result of ``cut`` that nothing will read again."""
    if path := getattr(df, "_talaan_path", None):
        _remove(df.sparkSession, path)


BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (of a few numbers each); beyond that Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-bound Python stages: the session's shuffle partitions, at least its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))
