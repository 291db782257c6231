"""Connected components of a table of links, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.util import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label: the smallest node that links (u, v) reach, for every node of a link; in the scratch folder.

    Each round a node takes the least label among its neighbours and itself, then the label of its label, so a chain
    is halved each round. Rounds end when no label changes. Joins read written tables, so that Spark can split the
    links of a hot node over tasks; least labels are taken map-side first."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = scratch.write(both.where("u <> v").distinct(), f"{name}-edges")
    labels = scratch.write(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")).select("node", "label"), f"{name}-0")
    n = 0
    while True:
        n += 1
        near = edges.join(labels, edges["v"] == labels["node"]).select(F.col("u").alias("node"), "label")
        least = scratch.write(near.unionByName(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label")), f"{name}-{n}-least")
        top = least.select(F.col("node").alias("at"), F.col("label").alias("up"))
        jumped = scratch.write(least.join(top, F.col("label") == F.col("at")).select("node", F.least("label", "up").alias("label")), f"{name}-{n}")
        before = labels.select(F.col("node").alias("at"), F.col("label").alias("was"))
        changed = jumped.join(before, F.col("node") == F.col("at")).where("label <> was").limit(1).count()
        scratch.drop(f"{name}-{n}-least")
        scratch.drop(f"{name}-{n - 1}")
        labels = jumped
        if not changed:
            return labels
