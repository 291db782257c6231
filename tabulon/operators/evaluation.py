"""Evaluation: ranks, percentiles, attribution of misses, reachability, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALES = (1.0, 1e3, 1e-3, 1e6, 1e-6)


def retrieval(ranks: DataFrame) -> DataFrame:
    """One row of recall at 1, 5, 10, mean reciprocal rank and buckets from a column rank (null: not found)."""
    at = lambda k: F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int"))
    return ranks.agg(at(1).alias("recall_1"), at(5).alias("recall_5"), at(10).alias("recall_10"), F.round(F.sum(1.0 / F.col("rank")) / F.count("*"), 6).alias("mrr"), F.count_if(F.col("rank") <= 5).alias("top_5"), F.count_if(F.col("rank").between(6, 20)).alias("top_20"), F.count_if(F.coalesce(F.col("rank") > 20, F.lit(True))).alias("beyond"))


def nearest_rank(df: DataFrame, group: str, value: str, tie: str, shares: dict[str, float]) -> DataFrame:
    w = Window.partitionBy(group)
    placed = df.select(group, value, F.row_number().over(w.orderBy(value, tie)).alias("k"), F.count("*").over(w).alias("n"))
    return placed.groupBy(group).agg(*(F.max(F.when(F.col("k") == F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))), F.col(value))).alias(name) for name, p in shares.items()))


def first_hits(found: DataFrame, gold: DataFrame) -> DataFrame:
    """question, rank: the best rank at which a right (file, page) was found; null where none was."""
    hit = found.join(gold.select("question", "file", "page"), ["question", "file", "page"]).groupBy("question").agg(F.min("rank").alias("rank"))
    return gold.select("question").distinct().join(hit, "question", "left")


def attribution(pool: Column, row: Column, chosen: Column) -> Column:
    """Where a question was lost, from the ranks at three stages (null: lost there)."""
    return F.when(pool.isNull(), "not_in_pool").when(row.isNull(), "row_miss").when(chosen.isNull() | (chosen > 1), "table_selection").otherwise("ok")


def miss_bucket(pool: Column, title_ok: Column, row_ok: Column) -> Column:
    return F.when(pool.isNull(), "not_in_pool").when(~title_ok, "ingest_title_bad").when(~row_ok, "decompose_row_miss").otherwise("ranker_mis_scored")


def good_title(title: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (F.length(t) >= 4) & ~t.isin("untitled", "table", "continued", "none")


def present(cells: DataFrame, gold: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """question, found: whether a cell of the right page holds the value within a tolerance at one of five scales. The join is by
    page; scales are a fixed array of the gold rows, so no pair outside a page arises."""
    scaled = gold.select("question", "file", "page", F.explode(F.array(*(F.col("value") * s for s in SCALES))).alias("v"))
    near = F.abs(F.col("numeric_value") - F.col("v")) <= F.abs(F.col("v")) * tolerance
    hit = scaled.join(cells, ["file", "page"]).where(near).select("question").distinct().withColumn("found", F.lit(True))
    return gold.select("question").distinct().join(hit, "question", "left").select("question", F.coalesce("found", F.lit(False)).alias("found"))


def compared(base: DataFrame, head: DataFrame) -> DataFrame:
    """uid, delta of two runs' ranks, and what became of the question."""
    j = base.select("uid", F.col("rank").alias("a")).join(head.select("uid", F.col("rank").alias("b")), "uid")
    change = F.when(F.col("a").isNull() & F.col("b").isNotNull(), "gained").when(F.col("a").isNotNull() & F.col("b").isNull(), "lost").when(F.col("a") > F.col("b"), "up").when(F.col("a") < F.col("b"), "down").otherwise("same")
    return j.select("uid", (F.col("b") - F.col("a")).alias("delta"), change.alias("change"))


def covering(entries: DataFrame, key: str) -> DataFrame:
    """Greedy promotion: in rank order an entry that brings a year not yet covered comes first. A year is covered by its first
    entry, so the promoted ones are those that are first for some year; no loop is needed."""
    year = entries.select(key, "rank", F.explode("years").alias("year"))
    first = year.groupBy(key, "year").agg(F.min("rank").alias("rank")).select(key, "rank").distinct().withColumn("promoted", F.lit(1))
    out = entries.join(first, [key, "rank"], "left").withColumn("promoted", F.coalesce("promoted", F.lit(0)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("promoted"), "rank")))


def budgeted(entries: DataFrame, key: str, chars: int, least: int = 500) -> DataFrame:
    """Texts in rank order up to a budget of characters; the last one is cut if enough room is left for it. Only lengths are put in
    order; texts are read again where their rank, unique in its key, fits."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = entries.select(key, "rank", F.length("text").alias("n")).withColumn("room", F.lit(chars) - before).where((F.col("room") >= F.col("n")) | (F.col("room") > least))
    out = entries.join(room.select(F.col(key).alias("_key"), F.col("rank").alias("_rank"), "room"), F.col(key).eqNullSafe(F.col("_key")) & F.col("rank").eqNullSafe(F.col("_rank")))
    return out.select(*(F.left("text", F.least("room", F.length("text")).cast("int")).alias("text") if c == "text" else entries[c] for c in entries.columns))


def by_match(entries: DataFrame, key: str, section: str, years: list[int], tie: str) -> DataFrame:
    """Adds place: entries whose title or section holds a text first, then those that share years with the question, most first,
    then the others by their distance from these years."""
    asked = F.array(*(F.lit(y) for y in years)) if years else F.array().cast("array<int>")
    holds = F.lower(F.coalesce("title", F.lit(""))).contains(section) | F.lower(F.coalesce("section", F.lit(""))).contains(section) if section else F.lit(False)
    shared = F.size(F.array_intersect(asked, F.coalesce("years", F.array().cast("array<int>"))))
    far = F.coalesce(F.array_min(F.transform(asked, lambda y: F.abs(F.coalesce("file_year", F.lit(0)) - y))), F.lit(9999))
    order = Window.partitionBy(key).orderBy(F.when(holds, 0).otherwise(1), F.when(shared > 0, 0).otherwise(1), F.when(shared > 0, -shared).otherwise(far), tie)
    return entries.withColumn("place", F.row_number().over(order))
