"""Requests for values: their checks, the cells that they need, and answers for a whole table of requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import numbers
from tabulon.operators import layers, stats

REQUEST = "uid string, request string, title string, row_hint string, granularity string, years array<int>, month int, computation string, unit string"


def problems(r: DataFrame) -> DataFrame:
    """uid, request and the codes of what is wrong with a request."""
    hint = F.coalesce("row_hint", F.lit(""))
    codes = F.array(
        F.when(hint == "", "EMPTY"), F.when(F.size(F.split(F.trim(hint), r"\s+")) > 8, "LONG_ROW_HINT"), F.when(F.lower(hint).rlike(r"\b(excluding|including|such as|aggregates?)\b"), "DESCRIPTIVE"),
        F.when(F.coalesce(F.size("years"), F.lit(0)) <= 0, "MISSING_YEARS"), F.when(F.coalesce(F.exists("years", lambda y: ~y.between(1800, 2039)), F.lit(False)), "BAD_YEAR"), F.when((F.col("granularity") == "specific_month") & F.col("month").isNull(), "MISSING_MONTH"),
    )
    return r.select("uid", "request", F.filter(codes, lambda c: c.isNotNull()).alias("codes"))


def needed(r: DataFrame) -> DataFrame:
    """A row a cell: the months or years that a request's granularity stands for, in order."""
    months = F.sequence(F.lit(1), F.lit(12))
    of_year = lambda y: F.when(F.col("granularity").isin("monthly_all", "continuous_monthly", "annual", "multi_year_annual"), F.transform(months, lambda m: F.struct(y.alias("year"), m.alias("month")))).otherwise(F.array(F.struct(y.alias("year"), F.col("month").alias("month"))))
    cells = F.flatten(F.transform(F.array_sort("years"), of_year))
    return r.select("uid", "request", "title", "row_hint", "granularity", "computation", "unit", F.posexplode(cells).alias("pos", "c")).select("*", "c.year", "c.month").drop("c")


def resolved(r: DataFrame, facts: DataFrame) -> DataFrame:
    """Needed cells with the latest published value, its unit and a status. Requests are few, so they are the broadcast side of
    a table read once."""
    f = layers.canonical(facts).select(F.lower("title").alias("t"), F.lower("row_path").alias("p"), "data_year", "data_month", "numeric_value", F.col("unit").alias("source_unit"), "row_id")
    n = needed(r)
    on = (F.lower("title") == F.col("t")) & (F.lower(F.trim("row_hint")) == F.col("p")) & (F.col("year") == F.col("data_year")) & F.col("month").eqNullSafe(F.col("data_month"))
    status = F.when(F.col("row_id").isNull(), "label_miss").when(F.col("numeric_value").isNull(), "null_numeric").otherwise("ok")
    return f.join(n, on, "right").select(*n.columns, F.col("numeric_value").alias("value"), "source_unit", status.alias("status"))


def series(cells: DataFrame) -> DataFrame:
    """A request's values: whole years as sums where annual figures are asked for, months as they are; incomplete ones are marked
    and give no value."""
    annual = F.col("granularity").isin("annual", "multi_year_annual")
    key = ["uid", "request", "computation", "unit", "source_unit"]
    step = cells.withColumn("source_unit", F.coalesce("source_unit", F.lit("dollars"))).groupBy(*key, F.when(annual, F.col("year")).otherwise(F.col("pos")).alias("at"), annual.alias("annual")).agg(F.sum("value").alias("v"), F.count_if(F.col("status") == "ok").alias("found"))
    whole = F.when(F.col("annual"), F.col("found") == 12).otherwise(F.col("found") == 1)
    return step.select(*key, "at", F.when(whole, F.col("v")).alias("v"))


def answers(s: DataFrame) -> DataFrame:
    """uid, value, unit: the named operation of each request's values, converted once, and a status."""
    op = stats.single(F.col("v"), F.col("at"))
    names = [k for k in op if k not in ("argmax", "argmin")]
    agg = s.groupBy("uid", "request", "computation", "unit").agg(*(op[k].alias(f"_{k}") for k in names), F.count("*").alias("n"), F.count("v").alias("found"))
    value: Column = F.lit(None).cast("double")
    for k in names:
        value = F.when(F.col("computation") == k, F.col(f"_{k}").cast("double")).otherwise(value)
    status = F.when(F.col("found") < 0.8 * F.col("n"), "incomplete").when(value.isNull(), "no_value").otherwise("ok")
    raw = F.when(status == "ok", value)
    scaled = F.when(F.col("computation").isin("count", "coefficient_of_variation", "skewness", "kurtosis"), raw).otherwise(raw / F.coalesce(numbers.multiplier(F.col("unit")), F.lit(1.0)))
    return agg.select("uid", "request", scaled.alias("value"), "unit", status.alias("status"))
