"""Helpers shared by the training-data operators: tables, the shared folder, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_own: dict[str, str] = {}
_open: list[list[str]] = []

#: Rows of an Arrow batch handed to Python; whole texts are long, so fewer than Spark's default.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='spillway-')}"
    return _own[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage, and nothing is evaluated twice.

    Within scratch(), the table is listed there, for discard() after its last reader.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths of the tables that materialize() writes in the block."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.pop()  # blocks end in the reverse order of their beginnings


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of scratch() that nothing reads any more; the list is emptied."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ranked(df: DataFrame, keys: list[str], order: list, bucket, name: str = "rank") -> DataFrame:
    """A gapless number from 0 within keys, dealt by (keys, bucket) so that one hot key is spread over many tasks.

    bucket is an integer column that must not decrease along the order when the order matters across buckets.
    Only the counts per (keys, bucket) meet in a window by keys; they have at most one row per bucket.
    """
    df = df.withColumn("_bucket", bucket)
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = df.withColumn("_place", F.row_number().over(within) - 1)
    on = [out[k].eqNullSafe(counts[k]) for k in [*keys, "_bucket"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    kept = [out[c] for c in out.columns if c not in ("_place", "_bucket")]
    return out.join(counts, cond).select(*kept, (F.col("_before") + F.col("_place")).cast("long").alias(name))
