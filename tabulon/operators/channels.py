"""Channels of retrieval: row labels in stages, prose and footnotes, and what they add to a list of entries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import hints, index, layers, search
from tabulon.sources.corpus import Ingested
from tabulon.sources.ledger import Ledger

ENOUGH = 100  #: fixed value: hits of a stage from which no later one is tried
MOST_TERMS = 10  #: fixed value: words of a hint that count


def terms_of(text: str, stop: frozenset[str] = frozenset()) -> list[str]:
    words = (w for w in re.findall(r"[a-z][a-z'\-]{2,}", text.lower()) if w not in stop)
    return list(dict.fromkeys(words))[:MOST_TERMS]


def with_years(ledger: Ledger, years: list[int], monthly: bool) -> DataFrame:
    """table_id of tables that have a row or column of one of the years, with a month where months are asked for."""
    cond = F.col("year_extracted").isin(*years)
    cond = cond & F.col("month_extracted").isNotNull() if monthly else cond
    return ledger.rows.where(cond).select("table_id").union(ledger.columns.where(cond).select("table_id")).distinct()


def metric_stages(ledger: Ledger, hint: str, metric: str, years: list[int], monthly: bool) -> list[tuple[str, object]]:
    """(name, stage) in the order of trial: all words, all words of the hint's variants, any word; each first with the years.
    No stage where the hint describes rather than names."""
    asked = " ".join(f"{hint} {metric}".split()).lower()
    if not terms_of(asked) or hints.descriptive(hint or metric, bool(hint)):
        return []
    labels = layers.row_labels(ledger)
    other = [v for v in (" ".join(f"{v} {metric}".split()).lower() for v in hints.variants(hint)[1:]) if v != asked]

    def found(texts: list[str], every: bool, dated: bool):
        def run() -> DataFrame:
            pool = labels.join(with_years(ledger, years, monthly), "table_id", "left_semi") if dated else labels
            hits = [search.slug_hits(pool, terms_of(t), every, exact=t) for t in texts if terms_of(t)]
            return reduce(DataFrame.unionByName, hits).groupBy(F.col("table_id").alias("id")).agg(F.min("score").alias("score"))

        return run

    out = []
    for name, texts, every in (("primary", [asked], True), ("synonym", other, True), ("partial", [asked, *other], False)):
        if texts:
            out += [(f"{name}_year", found(texts, every, True))] if years else []
            out.append((name, found(texts, every, False)))
    return out


def metric_channel(spark: SparkSession, ledger: Ledger, hint: str, metric: str = "", column: str = "", years: list[int] | None = None, monthly: bool = False, most: int = 1000, enough: int = ENOUGH) -> DataFrame:
    """(id, stage, score) of data tables by their row labels. A column hint keeps the tables that have such a column, if any has."""
    stages = metric_stages(ledger, hint, metric, years or [], monthly)
    found = search.progressive(spark, [run for _, run in stages], enough, most)  # at most most rows, a driver's list
    found = found.withColumn("stage", F.element_at(F.array(*(F.lit(n) for n, _ in stages)), F.col("stage") + 1)) if stages else found.withColumn("stage", F.col("stage").cast("string"))
    if not column:
        return found
    has = ledger.columns.where(F.lower("col_leaf").contains(column.lower())).select(F.col("table_id").alias("id"))
    narrow = found.join(has, "id", "left_semi")
    return narrow if narrow.limit(1).count() else found


def prose_channel(spark: SparkSession, i: Ingested, key: tuple, words: list[str], years: list[int], most: int = 50, after: int = 4) -> DataFrame:
    """Prose and footnotes that hold all the words, of issues from the first year to some after the last: file, element_seq,
    page_id, file_year, file_month, section, content, table_id, source, score; the best by BM25. Indexes are stored under key."""
    parts = []
    for name, df, weights, table in (("prose", i.prose, {"content": 2.0, "section": 1.5, "title": 1.5}, "near_table_id"), ("footnote", i.footnotes, {"content": 2.0}, "attached_to_table_id")):
        docs = df.withColumn("id", F.concat_ws(":", "file", "element_seq"))
        hits = index.match(index.index(spark, (*key, name), docs, "id", list(weights)), weights, words, True)
        inside = docs.where(F.col("file_year").between(min(years), max(years) + after)) if years else docs
        section = F.coalesce("section", F.lit("")) if name == "prose" else F.lit("")
        found = inside.join(hits, "id").select("file", "element_seq", "page_id", "file_year", "file_month", section.alias("section"), "content", F.col(table).alias("table_id"), F.lit(name).alias("source"), "score")
        parts.append(found.orderBy("score", "file", "element_seq").limit(most))
    return parts[0].unionByName(parts[1]).orderBy("score", "file", "element_seq").limit(most)


def appended(entries: DataFrame, prose: DataFrame, years: list[int], mode: str, most: int = 3) -> DataFrame:
    """Entries (file, element_seq, ..) and the best pieces of prose that aren't among them; with years, only pieces of issues
    that earn a bonus for them. strategy tells where a row is from."""
    new = prose.join(entries, ["file", "element_seq"], "left_anti")
    if years:
        covers = F.lit(min(years)) <= F.col("file_year")
        new = new.where(search.file_year_bonus(F.lit(mode), F.col("file_year") - max(years), F.col("file_month"), covers) != 0)
    new = new.orderBy("score", "file", "element_seq").limit(most).withColumn("strategy", F.concat(F.lit("prose_footnote:"), "source"))
    return entries.unionByName(new.select("file", "element_seq", "page_id", "file_year", "content", "strategy"), allowMissingColumns=True)
