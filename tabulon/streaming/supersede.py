"""Supersession as a stream: files arrive, the latest value of each key is kept. An extension."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.shared import folder


def keep_latest(state: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The row with the greatest order of each key, of the state and a batch: a map-side aggregate."""
    both = batch if state is None else state.unionByName(batch)
    return both.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in [*order, value]))


def run(stream: DataFrame, keys: list[str], order: list[str], value: str, folder: str) -> DataFrame:
    """Runs a stream over what has arrived. Each batch writes its state under its own number and reads that of the one before,
    so a batch that is repeated after a failure writes the same again."""
    spark = stream.sparkSession
    last: dict[str, str] = {}

    def step(batch: DataFrame, n: int) -> None:
        old = spark.read.parquet(last["at"]) if last else None
        at = f"{folder}/state-{n}"
        keep_latest(old, batch, keys, order, value).write.mode("overwrite").parquet(at)
        last["at"] = at

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(last["at"])


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders*.parquet").parquet(sf_dir)
    rows = stream.select(F.col("o_orderpriority").alias("row_label"), F.year("o_orderdate").alias("year"), F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice").alias("value"))
    out = run(rows, ["row_label", "year"], ["o_orderdate", "o_orderkey"], "value", os.path.join(shared, f"supersede-{uuid.uuid4().hex}"))
    return out.select("row_label", "year", "value")


def windowed(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts by window and type; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
