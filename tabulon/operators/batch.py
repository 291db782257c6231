"""Retrieval for a table of requests. Every step is keyed by the request (q), so a plan's size and its number of jobs don't
depend on how many requests there are, and no step looks at a request alone.

Requests: q, years, hints (row hints), columns (column hints), titles (phrases of titles), must, avoid (phrases), mode (calendar, fiscal,
unknown), monthly, files (files that are named outright).

Steps: families that have a year asked for, cut by column words where enough have one; the issues of each family nearest to
the first year; full text and slugs of these candidates only; what fits of each candidate (years, months, columns, rows and their
cells), by which the candidates are cut where enough are left; a weighted sum; the best of each file and request.

What is kept of a ledger (``kept``): postings of five fields by bucket of their term, how many tables have a term, and the small
tables that the steps join to. Postings are cut to the terms asked for and to the candidates before anything is scored; statistics
are those of all tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.operators import containment, fuzzy, index, layers, search
from tabulon.session import ship
from tabulon.sources.ledger import Ledger
from tabulon.sources.shared import stored, written

WEIGHTS = {"title": 2.0, "section": 1.5, "caption": 1.5, "columns": 2.0, "rows": 2.5}  # fixed values
#: What the stage of the first hit is worth.
SLUG_BONUS = {"primary": 0.80, "synonym": 0.50, "partial": 0.20}
ENOUGH = 100  # hits of a stage from which no later one is tried
REQUESTS = "q long, years array<int>, hints array<string>, columns array<string>, titles array<string>, must array<string>, avoid array<string>, mode string, monthly boolean, files array<string>"


@dataclass(frozen=True)
class Kept:
    tables: DataFrame  # id, file, file_year, file_month, title, head (title and caption, lower case), period, family_id, has_months
    postings: DataFrame  # bucket, term, id, field, tf, n_tokens
    terms: DataFrame  # term, df
    stats: DataFrame  # n, mean: one row
    rows: DataFrame  # table_id, row_id, row_index, label (path, lower case), slug
    cells: DataFrame  # table_id, row_id, year, n: cells that hold a number
    columns: DataFrame  # table_id, label (path and leaf, lower case), leaf
    coverage: DataFrame  # table_id, year, monthly (whether a row or column of the year has a month)
    family_years: DataFrame  # family_id, year


def _texts(ledger: Ledger) -> DataFrame:
    paths = lambda df, col, out: df.groupBy(F.col("table_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(col)), " | ").alias(out))  # noqa: E731  a table's own labels
    own = ["id", *(c for c in ("title", "section", "caption") if c in ledger.tables.columns)]
    docs = ledger.tables.where("table_kind = 'data'").select(*own)
    return docs.join(paths(ledger.columns, "col_path", "columns"), "id", "left").join(paths(ledger.rows, "row_path", "rows"), "id", "left")


def kept(spark: SparkSession, ledger: Ledger, key: tuple, stem: bool = True) -> Kept:
    """Written once for a key, from which the ledger's inputs can be told."""

    def make() -> dict:
        ship(spark)
        docs = _texts(ledger)
        text = index.make(docs, "id", [f for f in WEIGHTS if f in docs.columns], stem)
        f = layers.facts(ledger)
        family = F.lower(F.trim("title")).alias("family_id")
        months = ledger.columns.where("month_extracted is not null").select("table_id").union(ledger.rows.where("month_extracted is not null").select("table_id")).distinct()
        head = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "caption") if c in ledger.tables.columns))
        tables = ledger.tables.where("table_kind = 'data'").select("id", "file", "file_year", "file_month", "title", F.lower(head).alias("head"), "period", family)
        marked = tables.join(months.select(F.col("table_id").alias("id"), F.lit(True).alias("has_months")), "id", "left").fillna(False, ["has_months"])
        dated = lambda df: df.where("year_extracted is not null").select("table_id", F.col("year_extracted").alias("year"), F.col("month_extracted").isNotNull().alias("monthly"))
        covered = dated(ledger.columns).union(dated(ledger.rows)).groupBy("table_id", "year").agg(F.max("monthly").alias("monthly"))
        return {
            "tables": (marked, []), "postings": text["postings"], "stats": text["stats"], "terms": (text["postings"][0].select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df")), []),
            "rows": (ledger.rows.where("is_section_header = 0").select("table_id", F.col("id").alias("row_id"), "row_index", F.lower("row_path").alias("label"), F.col("metric_slug").alias("slug")), []),
            "cells": (f.where("numeric_value is not null").groupBy("table_id", "row_id", F.col("data_year").alias("year")).agg(F.count("*").alias("n")), []),
            "columns": (ledger.columns.select("table_id", F.lower(F.concat_ws(" ", "col_path", "col_leaf")).alias("label"), F.lower("col_leaf").alias("leaf")), []),
            "coverage": (covered, []), "family_years": (layers.family_years(f).select("family_id", "year").distinct(), []),
        }

    t = stored(spark, ("retrieval", stem, *key), make)
    return Kept(**{f.name: t[f.name] for f in fields(Kept)})


def soft(df: DataFrame, key: str, conditions: list[Column], need: int) -> DataFrame:
    """Cuts each key's rows by one condition after the other, each only where enough rows are left. Counts for all combinations
    come from one aggregation, whose rows are joined back; no window sees a key's rows."""
    named = df.select("*", *(F.coalesce(c, F.lit(False)).alias(f"_c{k}") for k, c in enumerate(conditions)))
    every = range(1 << len(conditions))
    holds = lambda mask: reduce(lambda a, b: a & b, (F.col(f"_c{k}") for k in range(len(conditions)) if mask >> k & 1), F.lit(True))
    counts = named.groupBy(key).agg(F.array(*(F.count_if(holds(m)) for m in every)).alias("_n"))
    mask: Column = F.lit(0)
    for k in range(len(conditions)):
        more = mask.bitwiseOR(F.lit(1 << k))
        mask = F.when(F.get("_n", more) >= need, more).otherwise(mask)
    chosen = counts.select(key, mask.alias("_mask"))
    stays = reduce(lambda a, b: a & b, (F.col(f"_c{k}") | (F.col("_mask").bitwiseAND(F.lit(1 << k)) == 0) for k in range(len(conditions))), F.lit(True))
    return named.join(chosen, key).where(stays).select(*df.columns)


def relative(df: DataFrame, key: str, scores: dict[str, str]) -> DataFrame:
    """Adds each score, under its new name, over the key's greatest one."""
    top = df.groupBy(key).agg(*(F.max(c).alias(f"_{c}") for c in scores))
    share = lambda c: F.coalesce(F.try_divide(c, F.when(F.col(f"_{c}") != 0, F.col(f"_{c}")).otherwise(1.0)), F.lit(0.0))
    return df.join(top, key).select(*df.columns, *(share(c).alias(out) for c, out in scores.items()))


def candidates(k: Kept, r: DataFrame, each: int = 12, many: int = 100) -> DataFrame:
    """(q, id): the issues nearest to the first year asked for of each family that has a year asked for. Of many families those with a column
    word stay, where enough have one. Requests without years have no funnel and no rows here."""
    own = r.select("q", F.explode("years").alias("year")).join(k.family_years, "year").select("q", "family_id").distinct()
    words = r.select("q", F.explode(F.slice(F.array_sort("columns"), 1, 3)).alias("hint"))
    families = k.tables.select(F.col("id").alias("table_id"), "family_id")
    leaves = k.columns.join(families, "table_id").select("family_id", F.col("leaf").alias("label")).distinct()
    hit = words.join(containment.by_tokens(words, leaves), "hint").join(leaves, "label").select("q", "family_id").distinct().withColumn("hit", F.lit(True))
    marked = own.join(hit, ["q", "family_id"], "left")
    n = marked.groupBy("q").agg(((F.count("*") > many) & (F.count("hit") >= F.greatest(F.lit(10), F.count("*") / 4))).alias("narrow"))
    chosen = marked.join(n, "q").where(~F.col("narrow") | F.col("hit").isNotNull()).select("q", "family_id")
    first = r.select("q", F.array_min("years").alias("first"))
    issues = chosen.join(first, "q").join(k.tables.select("id", "family_id", "file_year", "file_month"), "family_id")
    w = Window.partitionBy("q", "family_id").orderBy(F.abs(F.col("file_year") - F.col("first")), F.desc("file_month"), "id")  # a family's issues
    return issues.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= each).select("q", "id")


def asked_terms(r: DataFrame, texts: Column, stem: bool) -> DataFrame:
    """(q, term): the distinct terms of texts, an array."""
    words = r.select("q", F.explode(F.array_distinct(F.flatten(F.transform(texts, search.tokens)))).alias("word"))
    if not stem:
        return words.select("q", F.col("word").alias("term")).distinct()
    roots = words.select("word").distinct().withColumn("term", F.get(fuzzy.stems(F.array("word")), F.lit(0)))
    return words.join(roots, "word").select("q", "term").distinct()


def text_scores(k: Kept, terms: DataFrame, among: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(q, id, score), higher is better: BM25 with a weight for each field. among: (q, id) to which scores are limited; postings are
    then cut to these tables before they meet the terms. every: all terms of a request have to match."""
    asked = terms.withColumn("bucket", index.bucket(F.col("term")))
    hits = k.postings.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    hits = hits.join(among.select("id").distinct(), "id", "left_semi") if among is not None else hits
    weight = reduce(lambda w, f: w.when(F.col("field") == f, F.lit(WEIGHTS[f])), list(WEIGHTS)[1:], F.when(F.col("field") == "title", F.lit(WEIGHTS["title"])))
    f = hits.groupBy("term", "id", "n_tokens").agg(F.sum(weight * F.col("tf")).alias("f"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("f") * (search.K1 + 1) / (F.col("f") + search.K1 * (1 - search.B + search.B * F.col("n_tokens") / F.col("mean")))
    parts = f.join(k.terms, "term").crossJoin(F.broadcast(k.stats)).select("term", "id", part.alias("part"))  # one row
    rows = parts.join(terms, "term")
    rows = rows.join(among.select("q", "id"), ["q", "id"], "left_semi") if among is not None else rows
    out = rows.groupBy("q", "id").agg(F.sum("part").alias("score"), F.count("*").alias("_n"))
    if every:
        n = terms.groupBy("q").agg(F.count("*").alias("_all"))
        out = out.join(n, "q").where(F.col("_n") == F.col("_all"))
    return out.select("q", "id", "score")


#: Stages of the text search, in the order in which they are tried.
STAGES = ("exact_year_strict", "synonym_year_strict", "exact_year_window", "exact_unrestricted", "synonym_year_window", "synonym_unrestricted", "year_shifted")


def staged(k: Kept, r: DataFrame, synonyms: Callable[[Column], Column] | None = None, stem: bool = True, enough: int = ENOUGH, most: int = 1000) -> DataFrame:
    """(q, place, id, stage, score) over all tables: all of a request's words (exact), or any of them and of what stands for them (synonym);
    in tables that have a year asked for, in issues of a window of years, anywhere, in later issues. A stage counts only where
    no earlier one has enough tables; a table keeps its first stage. Each index is read twice, whatever the number of stages."""
    hints = F.coalesce("hints", F.array())
    other = F.flatten(F.transform(hints, synonyms)) if synonyms else F.array().cast("array<string>")
    exact = text_scores(k, asked_terms(r, hints, stem), every=True).withColumn("exact", F.lit(True))
    broad = text_scores(k, asked_terms(r, F.concat(hints, other), stem)).withColumn("exact", F.lit(False))
    asked = r.select("q", F.array_min("years").alias("first"), F.array_max("years").alias("last"))
    years = r.select("q", "monthly", F.explode(F.array_distinct("years")).alias("year"))
    strict = k.coverage.select(F.col("table_id").alias("id"), "year", F.col("monthly").alias("has")).join(years, "year").where("has or not monthly").select("q", "id").distinct().withColumn("strict", F.lit(True))
    j = exact.unionByName(broad).join(asked, "q").join(k.tables.select("id", "file_year"), "id").join(strict, ["q", "id"], "left")
    own, year = F.coalesce("strict", F.lit(False)), F.col("file_year")
    window, later = year.between(F.col("first"), F.col("last") + 5), year.between(F.col("first") + 5, F.col("last") + 10)
    on = {0: F.col("exact") & own, 1: ~F.col("exact") & own, 2: F.col("exact") & window, 3: F.col("exact"), 4: ~F.col("exact") & window, 5: ~F.col("exact"), 6: ~F.col("exact") & own & later}
    rows = j.select("q", "id", "score", F.explode(F.filter(F.array(*(F.when(c, n) for n, c in on.items())), lambda x: x.isNotNull())).alias("stage"))
    by = lambda *keys: Window.partitionBy(*keys[0]).orderBy(*keys[1:], F.desc("score"), "id")
    rows = rows.withColumn("nth", F.row_number().over(by(["q", "stage"]))).where(F.col("nth") <= most)
    sizes = rows.groupBy("q", "stage").agg(F.count("*").alias("n")).where(F.col("n") >= enough).groupBy("q").agg(F.min("stage").alias("end"))
    tried = rows.join(sizes, "q", "left").where(F.col("end").isNull() | (F.col("stage") <= F.col("end")))
    first = tried.groupBy("q", "id").agg(F.min(F.struct("stage", "score")).alias("s")).select("q", "id", F.col("s.stage").alias("stage"), F.col("s.score").alias("score"))
    placed = first.withColumn("place", F.row_number().over(by(["q"], "stage"))).where(F.col("place") <= most)
    return placed.select("q", "place", "id", F.get(F.array(*(F.lit(x) for x in STAGES)), F.col("stage")).alias("stage"), "score")


def slug_scores(k: Kept, r: DataFrame, synonyms: Callable[[Column], Column] | None = None, among: DataFrame | None = None, enough: int = ENOUGH) -> DataFrame:
    """(q, id, stage, score), higher is better: tables by row slugs that hold all words of a hint (primary), of what stands for it (synonym),
    or any word (partial). A table keeps its first stage; a later stage counts only where no earlier one has enough tables. score is the rows that match, and 5
    more where one is the hint itself."""
    base = r.select("q", F.explode("hints").alias("hint")).withColumn("hint", F.lower("hint")).distinct()
    other = base.select("q", F.explode(synonyms(F.col("hint"))).alias("hint")).distinct() if synonyms else base.limit(0)
    labels = k.rows.select(F.col("slug").alias("label")).distinct()
    rows = k.rows if among is None else k.rows.join(among.select(F.col("id").alias("table_id")).distinct(), "table_id", "left_semi")
    number = {s: n for n, s in enumerate(SLUG_BONUS)}
    pairs = [h.join(containment.by_tokens(h, labels), "hint").select("q", "hint", "label", F.lit(number[s]).alias("stage")) for s, h in (("primary", base), ("synonym", other))]
    both = base.unionByName(other).distinct()
    word = both.select("q", F.col("hint").alias("whole"), F.explode(F.array_distinct(search.tokens(F.col("hint")))).alias("hint"))
    pairs.append(word.join(containment.by_tokens(word, labels), "hint").select("q", F.col("whole").alias("hint"), "label", F.lit(number["partial"]).alias("stage")).distinct())
    hits = reduce(DataFrame.unionByName, pairs).join(rows.select("table_id", "slug", "row_id"), F.col("label") == F.col("slug"))
    scored = hits.groupBy("q", "stage", "hint", F.col("table_id").alias("id")).agg((F.count("*") + 5 * F.max((F.col("hint") == F.col("slug")).cast("int"))).cast("double").alias("score"))
    best = scored.groupBy("q", "stage", "id").agg(F.max("score").alias("score"))
    best = best.join(among.select("q", "id"), ["q", "id"], "left_semi") if among is not None else best
    sizes = best.groupBy("q").agg(F.array(*(F.count_if(F.col("stage") == n) for n in range(len(number)))).alias("_sizes"))
    reached = F.coalesce(F.array_position(F.transform("_sizes", lambda n: n >= enough), F.lit(True)), F.lit(0))  # 1 for the first stage that has enough
    tried = best.join(sizes, "q").where((reached == 0) | (F.col("stage") < reached))
    first = tried.groupBy("q", "id").agg(F.min(F.struct("stage", (-F.col("score")).alias("minus"))).alias("s"))
    names = F.array(*(F.lit(s) for s in number))
    return first.select("q", "id", F.get(names, F.col("s.stage")).alias("stage"), (-F.col("s.minus")).alias("score"))


def fits(k: Kept, r: DataFrame, among: DataFrame) -> DataFrame:
    """(q, id) with n_years asked for that a table has, n_columns (words of a column hint in one column, all or all but one), n_rows that have a
    hint's words (all, or all but one of three or more), best_cells: the most cells with a number, in the years asked for, of such a row."""
    years = r.select("q", F.explode(F.array_distinct("years")).alias("year"))
    ids = among.select("q", "id")
    here = among.select(F.col("id").alias("table_id")).distinct()
    n_years = ids.join(k.coverage.withColumnRenamed("table_id", "id"), "id").join(years, ["q", "year"]).groupBy("q", "id").agg(F.count("*").alias("n_years"))
    asked = r.select("q", F.explode("columns").alias("hint"))
    columns = k.columns.join(here, "table_id", "left_semi").select(F.col("table_id").alias("id"), "label").distinct()
    pairs = containment.by_tokens(asked, columns, F.when(F.col("n_tokens") >= 2, 1).otherwise(0))
    n_columns = asked.join(pairs, "hint").join(columns, "label").join(ids, ["q", "id"], "left_semi").groupBy("q", "id").agg(F.max("n_shared").alias("n_columns"))
    hints = r.select("q", F.explode("hints").alias("hint"))
    rows = k.rows.join(here, "table_id", "left_semi").select(F.col("table_id").alias("id"), "row_id", "label")
    found = containment.by_tokens(hints, rows, F.when(F.col("n_tokens") >= 3, 1).otherwise(0))
    own = hints.join(found, "hint").join(rows, "label").join(ids, ["q", "id"], "left_semi").select("q", "id", "row_id").distinct()
    cells = k.cells.join(here, "table_id", "left_semi").withColumnRenamed("table_id", "id")
    undated = r.where(F.coalesce(F.size("years"), F.lit(0)) <= 0).select("q", F.lit(True).alias("undated"))
    held = own.join(cells, ["id", "row_id"]).join(years.withColumn("dated", F.lit(True)), ["q", "year"], "left").join(undated, "q", "left").where("dated or undated").groupBy("q", "id", "row_id").agg(F.sum("n").alias("cells"))
    probe = own.join(held, ["q", "id", "row_id"], "left").groupBy("q", "id").agg(F.count("*").alias("n_rows"), F.coalesce(F.max("cells"), F.lit(0)).alias("best_cells"))
    out = ids
    for part in (n_years, n_columns, probe):
        out = out.join(part, ["q", "id"], "left")
    return out.fillna(0, ["n_years", "n_columns", "n_rows", "best_cells"])


def _phrases(phrases: str, text: str, gain: float, loss: float) -> Column:
    one = lambda p: F.when(F.contains(F.col(text), F.lower(p)), gain).otherwise(loss)
    return F.coalesce(F.reduce(phrases, F.lit(0.0).cast("double"), lambda s, p: s + one(p)), F.lit(0.0))


def ranked(k: Kept, r: DataFrame, found: DataFrame, need: int) -> DataFrame:
    """Adds the weighted score to candidates (q, id, text, slug, stage) that stay after the soft cuts."""
    j = written(fits(k, r, found)).join(found, ["q", "id"]).join(k.tables, "id").join(r, "q")
    dated = F.coalesce(F.size("years"), F.lit(0)) > 0
    j = soft(j, "q", [~dated | (F.col("n_years") > 0), ~F.col("monthly") | F.col("has_months"), (F.coalesce(F.size("columns"), F.lit(0)) <= 0) | (F.col("n_columns") > 0)], need)
    j = relative(written(j), "q", {"text": "text_n", "slug": "slug_n", "best_cells": "cells_n"})
    some = r.where((F.size("must") > 0) | (F.size("avoid") > 0)).select("q")
    wanted = j.join(some, "q", "left_semi").select(F.col("id").alias("table_id")).distinct()
    labels = k.rows.where("row_index <= 40").join(wanted, "table_id", "left_semi").groupBy(F.col("table_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("label")), " ").alias("labels"))  # at most 40 labels a table
    j = j.join(labels, "id", "left").withColumn("hay", F.concat_ws(" ", "head", "labels"))
    stage = reduce(lambda c, s: c.when(F.col("stage") == s, SLUG_BONUS[s]), list(SLUG_BONUS)[1:], F.when(F.col("stage") == "primary", SLUG_BONUS["primary"])).otherwise(0.0)
    rows = F.when(F.col("n_rows") > 0, 5 * F.col("cells_n") - F.when(F.col("best_cells") > 0, 0.05 * F.least(F.col("n_rows") - 1, F.lit(8))).otherwise(0.0)).otherwise(0.0)
    years = F.when(dated, 2 * F.col("n_years") / F.size("years")).otherwise(0.0)
    columns = F.when(F.col("n_columns") > 0, 0.45 + 0.10 * F.least("n_columns", F.lit(3))).otherwise(0.0)
    monthly = F.when(F.col("monthly"), F.when(F.col("has_months"), 0.35 + 0.20).otherwise(-0.25)).otherwise(0.20)
    titles = 0.25 * F.least(F.size(F.filter(F.coalesce("titles", F.array()), lambda t: F.contains(F.col("head"), F.lower(t)))), F.lit(3))
    covers = F.array_min("years") <= F.col("file_year")
    year = F.when(dated, search.file_year_bonus(F.col("mode"), F.col("file_year") - F.array_max("years"), F.col("file_month"), covers)).otherwise(0.0)
    named = F.when(F.array_contains(F.coalesce("files", F.array()), F.col("file")), 5.0).otherwise(0.0)
    score = 0.75 * F.col("text_n") + 0.25 * F.col("slug_n") + stage + rows + years + columns + monthly + titles + _phrases("must", "hay", 0.60, -0.20) + _phrases("avoid", "hay", -0.40, 0.0) + 0.12 * year + 0.2 * search.period_delta(F.col("mode"), F.col("period")) + named
    return j.select("q", "id", "file", "file_year", "title", "stage", "n_rows", "best_cells", F.round(score, 6).alias("score"))


def retrieve(k: Kept, r: DataFrame, most: int = 10, per_file: int = 2, stem: bool = True, synonyms: Callable[[Column], Column] | None = None, enough: int = ENOUGH) -> DataFrame:
    """q, place, id, file, file_year, title, stage, n_rows, best_cells, score: the best tables of each request, at most per_file of a file.

    A request with years looks at its candidates only, and at all of them where neither text nor slugs tell any; one without looks at what its words find."""
    r = written(r.select(*(f.split()[0] for f in REQUESTS.split(", "))))
    own = written(candidates(k, r))
    dated = F.coalesce(F.size("years"), F.lit(0)) > 0
    words = F.concat(F.coalesce("hints", F.array()), F.coalesce("titles", F.array()))
    parts = []
    for some, among in ((r.where(dated), own), (r.where(~dated), None)):
        text = written(text_scores(k, asked_terms(some, words, stem), among).withColumnRenamed("score", "text"))
        slug = written(slug_scores(k, some, synonyms, among, enough).withColumnRenamed("score", "slug"))
        both = text.join(slug, ["q", "id"], "full")
        if among is not None:  # nothing found: every candidate
            both = both.unionByName(own.join(text.select("q").distinct(), "q", "left_anti").join(slug.select("q", "id"), ["q", "id"], "left_anti").select("q", "id"), allowMissingColumns=True)
        parts.append(both.fillna(0.0, ["text", "slug"]))
    found = written(parts[0].unionByName(parts[1]).join(k.tables.select("id"), "id", "left_semi"))
    best = ranked(k, r, found, max(min(most, 50), 10))
    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    capped = best.withColumn("nth", F.row_number().over(by("q", "file"))).where(F.col("nth") <= per_file)
    return capped.withColumn("place", F.row_number().over(by("q"))).where(F.col("place") <= most).drop("nth")
