"""Similarity join of hints and labels by the token-set ratio, with no loss and without comparing every hint with every label.

The ratio is the greatest of three: the shared words against all words of either text, and the two texts written with the
shared words first. A pair reaches it in one of two ways, and each has its index:

- The shared words make up enough of one text. That text's rarest words, up to where the rest can't be enough, must hold one of the
  other's words.
- The texts share enough characters, counted with repeats. The rarest characters of both, up to where the rest can't be
  enough, must have one in common, and the lengths must be near.

What meets is held against bounds in expressions: the first two ratios are exact there, the third is at most what the shared
characters allow. Only a pair whose third ratio can decide is aligned.

Hints and labels are distinct texts, compared in lower case; what carries them is joined to the pairs. Null or blank
texts are like nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tabulon.operators import fuzzy
from tabulon.session import ship
from tabulon.sources.shared import written

_EPS = 1e-9


@pandas_udf(T.LongType())
def _aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fuzzy.lcs_length(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int64")


def _joined(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


def _texts(df: DataFrame, name: str, share: float) -> DataFrame:
    """Each distinct text with its distinct words, its length with words once, its characters told apart by occurrence, and how many
    of its rarest characters (near) one must be among."""
    words = F.array_distinct(F.filter(F.split(F.lower(name), r"(?U)\s+"), lambda w: w != ""))
    out = df.select(name).distinct().withColumn("words", words).where(F.size("words") > 0).withColumn("_all", F.split(_joined(F.col("words")), ""))
    nth = lambda c, i: F.size(F.filter(F.slice("_all", F.lit(1), i + 1), lambda x: x == c))
    out = out.withColumn("chars", F.transform("_all", lambda c, i: F.concat(c, nth(c, i).cast("string")))).drop("_all").withColumn("n", F.size("chars"))
    return out.withColumn("near", (F.col("n") - F.ceil(share * F.col("n") - _EPS) + 1).cast("int"))


def _often(labels: DataFrame, grams: str) -> DataFrame:
    return labels.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("often"))


def _ranked(df: DataFrame, name: str, grams: str, often: DataFrame) -> DataFrame:
    """name, n, near, ranked: a text's own grams, rarest first."""
    each = df.select(name, "n", "near", F.explode(grams).alias("g")).join(often, "g", "left")
    found = each.groupBy(name, "n", "near").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g"))).alias("ranked"))
    return found.withColumn("ranked", F.transform("ranked", lambda x: x["g"]))


def _rare_words(df: DataFrame, name: str, often: DataFrame, share: float) -> DataFrame:
    """name, g: the rarest words, up to where those that are left can't make up the share of the text."""
    weigh = lambda ws: F.aggregate(ws, F.lit(0), lambda s, w: s + F.length(w) + 1)
    rest = lambda i: weigh(F.slice("ranked", i + 1, F.size("ranked") - i))
    kept = F.filter("ranked", lambda w, i: rest(i) >= share * F.col("n") + 1 - _EPS)
    return _ranked(df, name, "words", often).select(name, F.explode(kept).alias("g"))


def _rare_chars(df: DataFrame, name: str, often: DataFrame) -> DataFrame:
    return _ranked(df, name, "chars", often).select(name, "n", F.explode(F.slice("ranked", F.lit(1), F.col("near"))).alias("g"))


def candidates(hints: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(hint, label) that may reach the ratio, with what the bounds need."""
    share = least / (200.0 - least)  # of either text, that is shared at least
    h, v = written(_texts(hints, "hint", share)), written(_texts(labels, "label", share))  # each is read in several steps
    words, chars = _often(v, "words"), _often(v, "chars")
    posted = lambda df, name: df.select(name, F.explode("words").alias("g"))
    arms = _rare_words(h, "hint", words, share).join(posted(v, "label"), "g").select("hint", "label")
    arms = arms.union(posted(h, "hint").join(_rare_words(v, "label", words, share), "g").select("hint", "label"))
    near = _rare_chars(v, "label", chars).withColumnRenamed("n", "m")
    close = (F.col("m") >= share * F.col("n") - _EPS) & (F.col("n") >= share * F.col("m") - _EPS)
    arms = arms.union(_rare_chars(h, "hint", chars).join(near, "g").where(close).select("hint", "label"))
    return arms.distinct().join(h.select("hint", F.col("words").alias("w"), F.col("chars").alias("c"), "n"), "hint").join(v.select("label", F.col("words").alias("x"), F.col("chars").alias("d"), F.col("n").alias("m")), "label")


def bounded(hints: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """hint, label, left, right, n, m, head, known, bound of pairs that can reach the ratio: known is the greater of the exact ratios,
    bound what the third can be at most."""
    c = candidates(hints, labels, least).withColumn("both", F.array_intersect("w", "x"))
    c = c.withColumn("head", F.length(_joined(F.col("both")))).withColumn("left", _joined(F.array_except("w", "x"))).withColumn("right", _joined(F.array_except("x", "w")))
    part = lambda whole: 200.0 * F.col("head") / (F.col("head") + F.col(whole))
    known = F.when(F.col("head") == 0, F.lit(0.0)).when((F.col("left") == "") | (F.col("right") == ""), F.lit(100.0)).otherwise(F.greatest(part("n"), part("m")))
    out = c.withColumn("known", known).withColumn("bound", 200.0 * F.size(F.array_intersect("c", "d")) / (F.col("n") + F.col("m")))
    return out.where(F.greatest("known", "bound") >= least - _EPS).select("hint", "label", "left", "right", "n", "m", "head", "known", "bound")


def undecided(pairs: DataFrame) -> Column:
    """Whether the third ratio can be more than what is known."""
    return pairs["bound"] > pairs["known"] + _EPS


def alike(hints: DataFrame, labels: DataFrame, least: float = 60.0) -> DataFrame:
    """(hint, label, likeness): all pairs with a token-set ratio of least or more, which must be above 0."""
    ship(hints.sparkSession)
    pairs = bounded(hints, labels, least)
    third = F.when(F.col("open"), 200.0 * (F.when(F.col("head") > 0, F.col("head") + 1).otherwise(0) + F.col("aligned")) / (F.col("n") + F.col("m")))
    asked = pairs.withColumn("open", undecided(pairs)).withColumn("aligned", _aligned(*(F.when(F.col("open"), F.col(c)) for c in ("left", "right"))))
    out = asked.withColumn("likeness", F.greatest("known", third))
    return out.where(F.col("likeness") >= least - _EPS).select("hint", "label", "likeness")


def nearest(hints: DataFrame, labels: DataFrame, most: int = 100, least: float = 60.0) -> DataFrame:
    """alike with the most like labels of each hint only; place counts from 1, of equals the label that sorts first."""
    place = F.row_number().over(Window.partitionBy("hint").orderBy(F.desc(F.round("likeness", 9)), "label"))
    return alike(hints, labels, least).withColumn("place", place).where(F.col("place") <= most)
