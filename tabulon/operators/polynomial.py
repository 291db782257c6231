"""Polynomial fits and p-norms of grouped series, from sums of powers: one mergeable aggregate of fixed size a group, and a small linear system
solved by expressions.

Powers are those of a place between -1 and 1 (the middle and half the width of a group's positions come from an aggregate of their own),
since sums of powers of years would lose all digits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 6  # degrees beyond lose digits


def polynomial(df: DataFrame, key: str, x: str, y: str, degree: int) -> DataFrame:
    """key, n, coefficients (of x ** 0, 1, ..), by least squares. Rows with a null in x or y don't count; a group with no more distinct positions than
    the degree has no fit: null."""
    if not 0 <= degree <= MOST:
        raise ValueError(f"a degree is from 0 to {MOST}")
    rows = df.select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    span = rows.groupBy("_k").agg(((F.min("_x") + F.max("_x")) / 2).alias("_mid"), F.greatest((F.max("_x") - F.min("_x")) / 2, F.lit(1e-300)).alias("_half"), F.count_distinct("_x").alias("_d"))
    placed = rows.join(span.withColumnRenamed("_k", "_s"), F.col("_k").eqNullSafe(F.col("_s"))).withColumn("_t", (F.col("_x") - F.col("_mid")) / F.col("_half"))
    power = lambda k: F.pow("_t", F.lit(float(k))) if k else F.lit(1.0)
    sums = [F.sum(power(k)).alias(f"_p{k}") for k in range(2 * degree + 1)] + [F.sum(power(k) * F.col("_y")).alias(f"_q{k}") for k in range(degree + 1)]
    s = placed.groupBy("_k").agg(F.first("_mid").alias("_mid"), F.first("_half").alias("_half"), F.first("_d").alias("_d"), F.count("*").alias("n"), *sums)
    n = degree + 1
    s = s.select("*", *(F.col(f"_p{i + j}").alias(f"_a{i}_{j}") for i in range(n) for j in range(n)), *(F.col(f"_q{i}").alias(f"_a{i}_{n}") for i in range(n)))
    for k in range(n):  # elimination, a projection a step; the matrix is positive definite, so its diagonal serves
        step = {f"_a{i}_{j}": F.col(f"_a{i}_{j}") - F.try_divide(F.col(f"_a{i}_{k}"), F.col(f"_a{k}_{k}")) * F.col(f"_a{k}_{j}") for i in range(n) if i != k for j in range(k + 1, n + 1)}
        s = s.withColumns(step)
    b = [F.try_divide(F.col(f"_a{i}_{n}"), F.col(f"_a{i}_{i}")) for i in range(n)]
    s = s.withColumns({f"_b{i}": c for i, c in enumerate(b)})
    # sum of b[i] * ((x - mid) / half) ** i, by powers of x
    out = [sum((F.col(f"_b{i}") * math.comb(i, k) * F.pow(-F.col("_mid"), F.lit(float(i - k))) / F.pow("_half", F.lit(float(i))) for i in range(k, n)), F.lit(0.0)) for k in range(n)]
    return s.select(F.col("_k").alias(key), "n", F.when(F.col("_d") > degree, F.array(*out)).alias("coefficients"))


def at(coefficients: Column, x: Column) -> Column:
    """A polynomial's value."""
    return F.reduce(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)


def p_norm(v: Column, p: float) -> Column:
    """Aggregate: the p-norm; infinity gives the greatest size."""
    if p == math.inf:
        return F.max(F.abs(v))
    if p < 1:
        raise ValueError("p is 1 or more")
    return F.pow(F.sum(F.pow(F.abs(v), F.lit(float(p)))), F.lit(1.0 / p))


def shares(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds each value over its group's sum; as it is where that is 0. Sums are an aggregate that is joined back."""
    total = df.groupBy(F.col(key).alias("_g")).agg(F.sum(value).alias("_total"))
    j = df.join(total, F.col(key).eqNullSafe(F.col("_g")))
    return j.select(*(df[c] for c in df.columns), F.when(F.col("_total") != 0, F.col(value) / F.col("_total")).otherwise(F.col(value)).alias(out))
