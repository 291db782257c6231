"""Full-text search over postings: tokens, BM25 with field weights, label browsing, progressive stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; diacritics of Latin letters are folded away."""
    plain = F.translate(F.lower(text), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def hint_tokens(text: Column, stop: list[str], most: int) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'\-]{2,}"), F.lit(0)), lambda t: F.lower(t))
    return F.slice(F.array_distinct(F.array_except(found, F.lit(stop).cast("array<string>"))), 1, most)


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, term, tf), one shuffle: a document's tokens are counted map-side first."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.coalesce(f, F.lit(""))).alias("terms")) for f in fields)))
    return docs.select(F.col(id_col).alias("id"), each.alias("e")).select("id", "e.field", F.explode("e.terms").alias("term")).groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    size = reduce(lambda a, b: a + b, (F.size(tokens(F.coalesce(f, F.lit("")))) for f in fields))
    return docs.select(F.col(id_col).alias("id"), size.alias("n_tokens"))


def bm25(docs: DataFrame, id_col: str, weights: dict[str, float], query: list[str], match_all: bool = False) -> DataFrame:
    """(id, score), lower is better. Postings are cut to the query's terms where texts are read, so only matching terms are
    shuffled; corpus statistics are one row."""
    wanted = sorted(set(query))
    fields = list(weights)
    # tokens are made once, in a projection of their own; the rest reads the arrays
    split = docs.select(F.col(id_col).alias("id"), *(tokens(F.coalesce(f, F.lit(""))).alias(f) for f in fields))
    hit = lambda f: F.filter(F.col(f), lambda t: t.isin(*wanted))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), hit(f).alias("terms")) for f in fields)))
    size = reduce(lambda a, b: a + b, (F.size(f) for f in fields))
    rows = split.select("id", size.alias("n_tokens"), *fields)
    stats = rows.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"))
    weight = reduce(lambda w, f: w.when(F.col("field") == f, F.lit(weights[f])), fields[1:], F.when(F.col("field") == fields[0], F.lit(weights[fields[0]])))
    found = rows.select("id", "n_tokens", each.alias("e")).select("id", "n_tokens", "e.field", F.explode("e.terms").alias("term")).groupBy("id", "n_tokens", "term").agg(F.sum(weight).alias("f"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    joined = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # at most a row a query term, and one row
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    scored = joined.groupBy("id").agg((-F.sum(part)).alias("score"), F.count("*").alias("n_terms"))
    return (scored.where(F.col("n_terms") == len(wanted)) if match_all else scored).select("id", "score")


def contains_all(label: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.lower(label).contains(t.lower()) for t in terms))


def contains_any(label: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(label).contains(t.lower()) for t in terms))


def whole_word(label: Column, word: str) -> Column:
    return F.concat(F.lit(" "), F.lower(label), F.lit(" ")).contains(f" {word.lower()} ")


def token_subset(label: Column, hint: Column) -> Column:
    """The hint's tokens are all among the label's."""
    return F.size(F.array_except(tokens(hint), tokens(label))) == 0


def token_near(label: Column, hint: Column) -> Column:
    """All but one of the hint's tokens are."""
    return F.size(F.array_intersect(tokens(hint), tokens(label))) >= F.size(F.array_distinct(tokens(hint))) - 1


def slug_hits(rows: DataFrame, terms: list[str], match_all: bool, exact: str | None = None) -> DataFrame:
    """Tables by hits: -(rows that match + 5 where one equals the exact text, else the terms)."""
    cond = contains_all(F.col("metric_slug"), terms) if match_all else contains_any(F.col("metric_slug"), terms)
    same = (F.col("metric_slug") == (exact or " ".join(terms))).cast("int")
    return rows.where(cond).groupBy("table_id").agg((-(F.count("*") + 5 * F.max(same))).cast("double").alias("score"))


def progressive(spark: SparkSession, stages: list[Callable[[], DataFrame]], threshold: int, most: int) -> DataFrame:
    """Stages of (id, score), each tried only while no earlier one had threshold hits and fewer than most ids are in; an id keeps
    its first stage. A later stage isn't run at all once the pool is full: of each at most threshold + most rows, both
    fixed, come to the driver."""
    pool: dict[int, tuple[int, float]] = {}
    for n, stage in enumerate(stages):
        best = stage().orderBy("score", "id").limit(threshold + most).collect()
        for r in best:
            if r["id"] not in pool and len(pool) < most:
                pool[r["id"]] = (n, float(r["score"]))
        if len(best) >= threshold or len(pool) >= most:
            break
    return spark.createDataFrame([(i, *x) for i, x in pool.items()], "id long, stage int, score double")


def merge_lists(lists: DataFrame, most: int) -> DataFrame:
    """Rows (id, list_no, pos): each id at its first place, cut."""
    first = lists.groupBy("id").agg(F.min(F.struct("list_no", "pos")).alias("p"))
    return first.orderBy("p.list_no", "p.pos", "id").limit(most).select("id", "p.list_no", "p.pos")


def file_year_bonus(mode: Column, offset: Column, month: Column, covers: Column) -> Column:
    """How well an issue's year fits the years asked for; offset: issue year less the latest year asked. Fixed values."""
    table = {"calendar": (2.0, 6.0, 3.5, 2.5, 1.5, 1.5), "fiscal": (6.0, 3.5, 2.5, 2.0, 1.0, 1.5), "unknown": (5.0, 4.5, 3.0, 2.5, 1.5, 2.0)}

    def base(v: tuple) -> Column:
        return F.when(offset == 0, v[0]).when(offset == 1, v[1]).when(offset == 2, v[2]).when(offset == 3, v[3]).when(offset.between(4, 6), v[4]).when((offset < 0) & covers, v[5]).otherwise(0.0)

    by_mode = F.when(mode == "calendar", base(table["calendar"])).when(mode == "fiscal", base(table["fiscal"])).otherwise(base(table["unknown"]))
    calendar = F.when((offset == 1) & (month <= 3), 2.0).when((offset == 1) & (month <= 6), 1.0).when((offset == 0) & (month >= 6), 0.5).otherwise(0.0)
    fiscal = F.when((offset == 0) & month.between(7, 10), 2.0).when((offset == 0) & (month >= 7), 1.0).otherwise(0.0)
    unknown = F.when((offset == 0) & (month >= 6), 0.5).otherwise(0.0)
    extra = F.when(mode == "calendar", calendar).when(mode == "fiscal", fiscal).otherwise(unknown)
    return by_mode + F.when(by_mode > 0, extra).otherwise(0.0)


def period_delta(asked: Column, has: Column) -> Column:
    return F.when(asked.isNull() | has.isNull() | (asked == "unknown") | (has == "unknown"), 0.0).when(asked == has, 0.5).otherwise(-0.3)


def normalized(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Adds -score over the best one under a new name, for each of the scores. The best ones are a row of their own, sent to every task."""
    best = df.agg(*(F.max(-F.col(c)).alias(f"_{c}") for c in scores))
    share = lambda c: F.coalesce(F.try_divide(-F.col(c), F.col(f"_{c}")), F.lit(0.0))
    return df.crossJoin(F.broadcast(best)).select(*df.columns, *(share(c).alias(out) for c, out in scores.items()))  # one row


def capped(ranked: DataFrame, group: str, cap: int, most: int) -> DataFrame:
    """The best rows by score with at most cap of a group."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap).orderBy(F.desc("score"), "id").limit(most)


def soft_filter(df: DataFrame, cond: Column, k: int) -> DataFrame:
    """Keeps the rows that meet a condition if enough do, else all. Whether enough do is one row, sent to every task."""
    need = max(min(k, 50), 10)
    enough = df.agg((F.count_if(cond) >= need).alias("_enough"))
    return df.crossJoin(F.broadcast(enough)).where(cond | ~F.col("_enough")).drop("_enough")  # one row


def without_aggregates(df: DataFrame, key: str, label: str) -> DataFrame:
    """Drops totals and remainders of each key, unless nothing else would be left."""
    from tabulon.functions.labels import aggregate

    plain = ~aggregate(F.col(label))
    return df.withColumn("_some", F.max(plain).over(Window.partitionBy(key))).where(plain | ~F.col("_some")).drop("_some")


def latest(tables: DataFrame, most: int, overfetch: int | None = None) -> DataFrame:
    """The latest table of each signature, latest first. With overfetch only the latest most * overfetch tables are looked at, so
    fewer than most may be left; without it the cut comes last."""
    order = [F.desc("file_year"), F.desc("file_month"), F.desc("id")]
    pool = tables.orderBy(*order).limit(most * overfetch) if overfetch else tables
    first = pool.withColumn("_n", F.row_number().over(Window.partitionBy("signature").orderBy(*order))).where(F.col("_n") == 1).drop("_n")
    return first if overfetch else first.orderBy(*order).limit(most)


def best_per(hits: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Adds place. Of the best max(10 * most, 200) hits by score the best of each key, then the best most of these; ties to the
    earlier issue."""
    order = ["score", "file_year", "file_month", "id"]
    pool = hits.orderBy("score", "id").limit(max(10 * most, 200))
    first = pool.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")
    return first.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most most rows


def prepended(first: DataFrame, rest: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first list, then those of the other that aren't in it; list_no tells which."""
    return first.withColumn("list_no", F.lit(0)).unionByName(rest.join(first, keys, "left_anti").withColumn("list_no", F.lit(1)))
