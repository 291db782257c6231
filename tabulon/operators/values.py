"""A reverse index of numbers: where in a ledger a value stands, at any of a few scales and within a tolerance, without a
page to look at. Cells are keyed by sign and by the step of their logarithm; a value looks at its step and the two beside it, under
each scale, so only cells of about its size meet it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.evaluation import SCALES


def _step(value: Column, width: float) -> Column:
    """Zero has a step of its own; no number and no finite value has none."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.when(value == 0, F.lit(-(2**40))).otherwise(F.floor(F.ln(F.abs(value)) / width)))


def places(gold: DataFrame, cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """uid, table_id, row_id, col_id, scale, off: every cell within a relative tolerance of a value times a scale; off is how far."""
    if not 0 < tolerance < 0.5:
        raise ValueError("the tolerance is a share between 0 and a half")
    width = -math.log1p(-tolerance) * 1.01  # a little wider than the tolerance, so that two steps beside it never matter
    asked = gold.select("uid", F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), (F.col("value") * s).alias("v")) for s in SCALES))).alias("x")).select("uid", "x.scale", "x.v")
    asked = asked.withColumn("step", _step(F.col("v"), width)).where("step is not null")
    asked = asked.withColumn("sign", F.signum("v").cast("int")).withColumn("step", F.explode(F.when(F.col("v") == 0, F.array("step")).otherwise(F.array(F.col("step") - 1, "step", F.col("step") + 1))))
    held = cells.select("table_id", "row_id", "col_id", F.col("numeric_value").alias("w")).withColumn("step", _step(F.col("w"), width)).where("step is not null").withColumn("sign", F.signum("w").cast("int"))
    off = F.abs(F.col("w") - F.col("v"))
    hit = asked.join(held, ["sign", "step"]).where(off <= F.abs("v") * tolerance)
    return hit.select("uid", "table_id", "row_id", "col_id", "scale", F.coalesce(F.try_divide(off, F.abs("v")), F.lit(0.0)).alias("off"))


def summed(gold: DataFrame, found: DataFrame) -> DataFrame:
    """uid, n_cells, n_tables, places (none, one, several tables), and the cell that is nearest."""
    key = F.struct("table_id", "row_id", "col_id")
    near = F.min(F.struct(F.round("off", 12).alias("off"), "table_id", "row_id", "col_id", "scale")).alias("near")
    s = found.groupBy("uid").agg(F.count_distinct(key).alias("n_cells"), F.count_distinct("table_id").alias("n_tables"), near)
    name = F.when(F.col("n_tables").isNull(), "none").when(F.col("n_tables") == 1, "one").otherwise("several")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return gold.select("uid").join(s, "uid", "left").select("uid", count("n_cells"), count("n_tables"), name.alias("places"), "near.table_id", "near.row_id", "near.col_id", "near.scale")


def reachable(gold: DataFrame, found: DataFrame, tables: DataFrame) -> DataFrame:
    """question, n_values, n_found, and whether any and all of its values (uid, file, page) stand in their file and on their page."""
    where = found.select("uid", "table_id").distinct().join(tables, "table_id")
    at = lambda keys, out: where.select(*keys).distinct().withColumn(out, F.lit(True))
    j = gold
    for keys, out in ((["uid"], "found"), (["uid", "file"], "in_file"), (["uid", "file", "page"], "on_page")):
        j = j.join(at(keys, out), keys, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    both = [f(yes(c)).alias(f"{name}_{kind}") for c, name in (("in_file", "file"), ("on_page", "page")) for f, kind in ((F.bool_or, "any"), (F.bool_and, "all"))]
    return j.groupBy("question").agg(F.count("*").alias("n_values"), F.count_if(yes("found")).alias("n_found"), *both)
