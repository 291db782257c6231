"""What the operators of this subpackage share: reading tables, shared scratch tables, prefix sums, words."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.session import ship

#: A word: a run of characters other than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512, megabytes: int = 6) -> None:
    """Arrow batches of few rows and bytes: rows hold whole texts, some of them long. The session keeps these
    settings, since results are computed later. Also ships the package, which every Arrow function here needs."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", megabytes << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        spark.conf.set(key, most)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset (tests on one
    machine) a temporary folder is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("TABULON_LOCAL_SHARED")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tabulon-")
        os.environ["TABULON_LOCAL_SHARED"] = at
    return at.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        try:
            fs, p = _filesystem(self.spark, self.path(name) if name else self.at)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans it
            return


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now rather than at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def range_bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most parts - 1 ascending cuts of a numeric key; a list of fixed length whatever the rows."""
    if parts < 2:
        return []
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(cuts or []))


def block_of(key: Column, cuts: list) -> Column:
    """The number of cuts that are smaller than the key: rows of a block lie between two cuts."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.lit(cuts), lambda c: c < key)), F.lit(0))


def blocks_for(spark: SparkSession, df: DataFrame | None = None) -> int:
    """As many key ranges as a shuffle has partitions, times two, so that none is large."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_start(df: DataFrame, key: list[str], value: str, block: str, out: str, group: list[str] | None = None) -> DataFrame:
    """Adds out: the sum of value over all rows before this one in the order (block, key), within group.

    Two levels: sums by block, a few rows, are summed up over blocks; rows are summed up inside their block.
    No task sees more than a block."""
    from pyspark.sql import Window

    group = group or []
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, block, F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*group, block).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [rows[c].eqNullSafe(starts[c]) for c in group] + [rows[block] == starts[block]]
    joined = rows.join(starts, on) if group else rows.join(starts, block)
    return joined.select(*(rows[c] for c in df.columns), (F.col("__start") + F.col("__in")).cast("long").alias(out))


def schema(**fields: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items()))
