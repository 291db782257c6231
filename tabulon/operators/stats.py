"""Named statistics over grouped series. Every one is an aggregate, so partial sums are made map-side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: op name -> the name it stands for. Fixed values.
ALIASES = {"mean": "average", "stdev": "stdev_sample", "std": "stdev_sample", "variance": "variance_sample", "growth": "percent_change", "cv": "coefficient_of_variation", "correlation": "pearson_correlation", "gini_coefficient": "gini", "theil": "theil_index"}


def single(v: Column, pos: Column) -> dict[str, Column]:
    """Aggregates of one series; where an operation has no value the result is null."""
    plus = F.when(v > 0, v)
    return {
        "direct": F.min_by(v, pos), "sum": F.sum(v), "average": F.avg(v), "median": F.median(v), "max": F.max(v), "min": F.min(v), "count": F.count(v), "geometric_mean": F.exp(F.avg(F.ln(plus))), "harmonic_mean": F.try_divide(F.count(plus), F.sum(F.try_divide(F.lit(1.0), plus))),
        "stdev_sample": F.when(F.count(v) >= 2, F.stddev_samp(v)), "stdev_population": F.stddev_pop(v), "variance_sample": F.when(F.count(v) >= 2, F.var_samp(v)), "variance_population": F.var_pop(v), "coefficient_of_variation": F.try_divide(F.stddev_samp(v), F.avg(v)),
        "argmax": F.max_by(pos, F.struct(v, -pos)), "argmin": F.min_by(pos, F.struct(v, pos)), "skewness": F.when(F.count(v) >= 3, F.skewness(v)), "kurtosis": F.when(F.count(v) >= 4, F.kurtosis(v)), "regr_slope": F.regr_slope(v, pos), "regr_intercept": F.regr_intercept(v, pos),
    }


def paired(a: Column, b: Column) -> dict[str, Column]:
    """Row expressions of two values; difference is second less first."""
    return {"difference": b - a, "abs_difference": F.abs(b - a), "percent_change": F.try_divide((b - a) * 100, a), "abs_percent_change": F.abs(F.try_divide((b - a) * 100, a)), "ratio": F.try_divide(a, b), "percent_of": F.try_divide(a * 100, b), "tool_difference": a - b, "tool_percent_change": F.try_divide((b - a) * 100, F.abs(a))}


def cagr(start: Column, end: Column, years: Column) -> Column:
    return F.when((start > 0) & (years > 0), (F.pow(end / start, F.lit(1.0) / years) - 1) * 100)


def gini(df: DataFrame, key: str, value: str) -> DataFrame:
    """0 where the total is 0. Places come from a window by key; the sums are aggregates."""
    placed = df.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(value)))
    n, total = F.count("*"), F.sum(value)
    return placed.groupBy(key).agg(F.coalesce(F.try_divide(2 * F.sum(F.col("i") * F.col(value)), n * total) - (n + 1) / n, F.lit(0.0)).alias("gini"))


def theil(df: DataFrame, key: str, value: str) -> DataFrame:
    """Positive values only: mean of v/m ln(v/m), from sums alone."""
    v = F.when(F.col(value) > 0, F.col(value))
    mean = F.avg(v)
    return df.groupBy(key).agg((F.avg(v * F.ln(v)) / mean - F.ln(mean)).alias("theil_index"))


def kl_divergence(p: Column, q: Column) -> Column:
    """Aggregate over pairs with both positive, not normalised."""
    return F.sum(F.when((p > 0) & (q > 0), p * F.ln(p / q)))


def box_cox(v: Column, power: float) -> Column:
    return (F.pow(v, F.lit(power)) - 1) / power


def normal_quantile(p: float) -> float:
    """By bisection of the error function; a parameter is turned on the driver, not a row."""
    low, high = -12.0, 12.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (low, mid)
    return (low + high) / 2


def parametric_var(v: Column, confidence: float) -> Column:
    return F.avg(v) + normal_quantile(confidence) * F.stddev_samp(v)
