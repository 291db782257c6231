"""Fits, norms and shares against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import polynomial as P


@pytest.mark.parametrize("degree", [0, 1, 2, 4])
def test_fits(spark, degree):
    rng = random.Random(degree)
    rows = []
    for k in ("a", "b", None):
        rows += [(k, x, 3.0 + 0.5 * (x - 1990) - 0.02 * (x - 1990) ** 2 + rng.gauss(0, 1)) for x in rng.choices(range(1960, 2020), k=80)]
    rows += [("one", 1990, 5.0)] * 3 + [("a", None, 1.0), ("a", 1999, None)]
    df = spark.createDataFrame(rows, "k string, x int, y double")
    got = {r["k"]: r for r in P.polynomial(df, "k", "x", "y", degree).withColumn("v", P.at(F.col("coefficients"), F.lit(2005.0))).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k in ("a", "b", None):
        own = [(x, y) for g, x, y in rows if g == k and x is not None and y is not None]
        c = np.polyfit([x - 1990 for x, _ in own], [y for _, y in own], degree)
        assert got[k]["n"] == len(own) and len(got[k]["coefficients"]) == degree + 1
        assert got[k]["v"] == pytest.approx(np.polyval(c, 15), rel=1e-4, abs=1e-3)
    assert (got["one"]["coefficients"] is None) == (degree > 0)


def test_norms_and_shares(spark):
    v = [3.0, -4.0, None, 12.0]
    df = spark.createDataFrame([("a", x) for x in v] + [("z", 1.0), ("z", -1.0)], "k string, v double")
    row = df.where("k = 'a'").agg(*(P.p_norm(F.col("v"), p).alias(n) for n, p in (("one", 1), ("two", 2), ("top", float("inf"))))).first()
    assert tuple(row) == pytest.approx((19.0, 13.0, 12.0))
    got = sorted((r["k"], r["v"], r["s"]) for r in P.shares(df, "k", "v", "s").where("v is not null").collect())
    assert got == [("a", -4.0, pytest.approx(-4 / 11)), ("a", 3.0, pytest.approx(3 / 11)), ("a", 12.0, pytest.approx(12 / 11)), ("z", -1.0, -1.0), ("z", 1.0, 1.0)]
    with pytest.raises(ValueError):
        P.p_norm(F.col("v"), 0.5)
