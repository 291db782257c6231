"""Results as JSON: details a line each, in the order of a key, and a summary of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(details: DataFrame, summary: DataFrame, folder: str, key: str = "uid") -> None:
    """Details are range-sorted, so files follow one another in the key's order; the summary, an aggregate, is one file."""
    details.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/details")
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/summary")


def read_results(details_of: DataFrame, folder: str) -> DataFrame:
    """Details, with the columns that another table of details has."""
    return details_of.sparkSession.read.schema(details_of.schema).json(f"{folder}/details")
