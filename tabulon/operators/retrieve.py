"""Finding tables for a request: families, their issues, channels, compatibility, the weighted rank and the entries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators import layers, search
from tabulon.sources.ledger import Ledger


@dataclass(frozen=True)
class Request:
    years: list[int]
    row_terms: list[str]
    column_terms: list[str] = field(default_factory=list)
    must: list[str] = field(default_factory=list)
    avoid: list[str] = field(default_factory=list)
    mode: str = "unknown"
    period: str | None = None
    monthly: bool = False


def candidate_families(f: DataFrame, ledger: Ledger, r: Request, many: int = 100) -> DataFrame:
    """Families that have a target year; if there are many, those with a column term, where enough of them have one."""
    own = layers.family_years(f)
    own = (own.where(F.col("year").isin(*r.years)) if r.years else own).select("family_id").distinct()
    terms = sorted(r.column_terms)[:3]
    if not terms:
        return own
    hit = layers.family_columns(ledger).where(search.contains_any(F.col("col_leaf_lower"), terms)).select("family_id").distinct().withColumn("hit", F.lit(1))
    marked = own.join(hit, "family_id", "left")
    marked = marked.crossJoin(F.broadcast(marked.agg(F.count("*").alias("n"), F.count("hit").alias("hits"))))  # one row
    narrow = (F.col("n") > many) & (F.col("hits") >= F.greatest(F.lit(10), F.col("n") / 4))
    return marked.where(~narrow | F.col("hit").isNotNull()).select("family_id")


def instances(ledger: Ledger, families: DataFrame, r: Request, each: int = 12) -> DataFrame:
    """The issues of each family nearest to the first year asked for, or the latest ones."""
    t = ledger.tables.withColumn("family_id", F.lower(F.trim("title"))).join(families, "family_id", "left_semi")
    near = F.abs(F.col("file_year") - min(r.years)) if r.years else -F.col("file_year")
    w = Window.partitionBy("family_id").orderBy(near, F.desc("file_month"), "id")
    return t.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= each).drop("nth")


def text_channel(ledger: Ledger, ids: DataFrame, r: Request) -> DataFrame:
    """BM25 of titles, columns and rows; statistics are those of all tables, scores only of the candidates."""
    paths = lambda df, col, out: df.groupBy(F.col("table_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(col)), " | ").alias(out))
    docs = ledger.tables.select("id", "title").join(paths(ledger.rows, "row_path", "rows"), "id", "left").join(paths(ledger.columns, "col_path", "columns"), "id", "left")
    return search.bm25(docs, "id", {"title": 2.0, "columns": 2.0, "rows": 2.5}, r.row_terms or [""]).join(ids.select("id"), "id", "left_semi")


def compatibility(f: DataFrame, r: Request) -> DataFrame:
    """For each table: target years that it has, matching rows and the best row's cells, matching columns, months."""
    row = search.contains_all(F.col("row_path"), r.row_terms) if r.row_terms else F.lit(False)
    col = search.contains_any(F.col("col_path"), r.column_terms) if r.column_terms else F.lit(False)
    in_years = F.col("data_year").isin(*r.years) if r.years else F.lit(True)
    each = f.groupBy("table_id", "row_id").agg(F.max(row).alias("hit"), F.count_if(in_years & F.col("numeric_value").isNotNull()).alias("cells"))
    rows = each.where("hit").groupBy("table_id").agg(F.count("*").alias("n_rows"), F.max("cells").alias("best_cells"))
    whole = f.groupBy("table_id").agg(F.count_distinct(F.when(in_years, F.col("data_year"))).alias("n_years"), F.count_distinct(F.when(col, F.col("col_path"))).alias("n_columns"), F.count_distinct("data_month").alias("n_months"))
    return whole.join(rows, "table_id", "left").select(F.col("table_id").alias("id"), "n_years", "n_columns", "n_months", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("best_cells", F.lit(0)).alias("best_cells"))


def _phrases(text: Column, words: list[str], gain: float, loss: float) -> Column:
    out = F.lit(0.0)
    for w in words:
        out = out + F.when(F.lower(text).contains(w.lower()), gain).otherwise(loss)
    return out


def ranked(candidates: DataFrame, text: DataFrame, slugs: DataFrame, fit: DataFrame, r: Request) -> DataFrame:
    """id, title, file, score of candidates: a weighted sum of what is known of each."""
    j = candidates.join(text.withColumnRenamed("score", "text_score"), "id", "left").join(slugs.select(F.col("table_id").alias("id"), F.col("score").alias("slug_score")), "id", "left").join(fit, "id", "left").fillna(0, ["n_years", "n_columns", "n_months", "n_rows", "best_cells"])
    j = search.normalized(j.fillna(0.0, ["text_score", "slug_score"]), {"text_score": "text_n", "slug_score": "slug_n"})
    j = j.crossJoin(F.broadcast(fit.agg(F.max("best_cells").alias("most"))))  # one row
    last = max(r.years) if r.years else None
    year = search.file_year_bonus(F.lit(r.mode), F.col("file_year") - last, F.col("file_month"), F.lit(min(r.years)) <= F.col("file_year")) if r.years else F.lit(0.0)
    found = F.when(F.col("n_rows") > 0, 5 * F.try_divide(F.col("best_cells"), F.col("most")) - 0.05 * F.least(F.col("n_rows") - 1, F.lit(8))).otherwise(0.0)
    hits = F.lit(0)
    for w in r.row_terms:
        hits = hits + F.lower("title").contains(w.lower()).cast("int")
    score = (
        0.75 * F.col("text_n") + 0.25 * F.col("slug_n") + F.coalesce(found, F.lit(0.0)) + (2 * F.col("n_years") / len(r.years) if r.years else F.lit(0.0)) + F.when(F.col("n_columns") > 0, 0.45 + 0.10 * F.least("n_columns", F.lit(3))).otherwise(0.0)
        + (F.when(F.col("n_months") >= 10, 0.35).otherwise(-0.25) if r.monthly else F.lit(0.0)) + 0.25 * F.least(hits, F.lit(3)) + _phrases(F.col("title"), r.must, 0.60, -0.20) + _phrases(F.col("title"), r.avoid, -0.40, 0.0) + 0.12 * year + 0.2 * search.period_delta(F.lit(r.period), F.col("period"))
    )
    return j.select("id", "title", "file", "file_year", F.round(score, 6).alias("score"))


def retrieve(ledger: Ledger, r: Request, most: int = 30, per_file: int = 2) -> DataFrame:
    f = layers.facts(ledger)
    ids = instances(ledger, candidate_families(f, ledger, r), r)
    fit = compatibility(f.join(ids.select(F.col("id").alias("table_id")), "table_id", "left_semi"), r)
    slugs = search.slug_hits(ledger.rows, r.row_terms, True)
    return search.capped(ranked(ids, text_channel(ledger, ids, r), slugs, fit, r), "file", per_file, most)
