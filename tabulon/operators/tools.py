"""Look-ups over the ledger: labels of an issue window, a metric's values in a year, tables that mention words, a vocabulary
menu, and rows and columns found from below. Tables are joined by id; the optimizer broadcasts them only where they are small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators import fuzzy, layers, search
from tabulon.session import ship
from tabulon.sources.ledger import Ledger


def _any_word(label: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (search.whole_word(label, w) for w in words))


def _window(ledger: Ledger, first: int | None, last: int | None) -> DataFrame:
    t = ledger.tables
    t = t.where(F.col("file_year") >= first) if first is not None else t
    return t.where(F.col("file_year") <= last) if last is not None else t


def browse(ledger: Ledger, f: DataFrame, words: list[str], first: int | None = None, last: int | None = None, data_year: int | None = None, most: int = 100) -> DataFrame:
    """Row slugs and column leaves with any of the words as whole words, in issues of a window of years, which a data year
    gives where it isn't given; earliest issues first. filter tells how to ask for the label's values."""
    if data_year is not None:
        first, last = data_year if first is None else first, data_year + 5 if last is None else last
    if first is None and last is None:
        raise ValueError("a data year or a window of issues is needed")
    best = layers.family_years(f).select(F.col("best_table_id").alias("table_id"), "family_id")
    t = _window(ledger, first, last).select(F.col("id").alias("table_id"), "title", "file_year").join(best, "table_id", "left")
    found = lambda df, col, source: df.where(F.col(col).isNotNull() & _any_word(F.col(col), words)).select("table_id", F.col(col).alias("label"), F.lit(source).alias("source"))
    hits = found(ledger.rows, "metric_slug", "row").unionByName(found(ledger.columns, "col_leaf", "col"))
    g = hits.join(t, "table_id").groupBy("label", "source").agg(F.countDistinct("table_id").alias("n_tables"), F.min("file_year").alias("first_year"), F.max("file_year").alias("last_year"), F.min("title").alias("title"), F.min("family_id").alias("family_id"))
    hint = F.when(F.col("source") == "row", F.concat(F.lit("metric_slug = '"), "label", F.lit("'"))).otherwise(F.concat(F.lit("col_path LIKE '%"), "label", F.lit("%'")))
    return g.withColumn("filter", hint).orderBy("first_year", F.desc("n_tables"), "label", "source").limit(most)


def mentions(ledger: Ledger, words: list[str]) -> DataFrame:
    """table_id of tables whose title, row paths and column paths together hold all the words."""
    wanted = sorted({w.lower() for w in words})
    hit = lambda df, key, col: df.select(F.col(key).alias("table_id"), F.explode(F.array_intersect(search.tokens(F.coalesce(col, F.lit(""))), F.lit(wanted))).alias("w"))
    all_ = hit(ledger.tables, "id", "title").unionByName(hit(ledger.rows, "table_id", "row_path")).unionByName(hit(ledger.columns, "table_id", "col_path"))
    return all_.groupBy("table_id").agg(F.countDistinct("w").alias("n")).where(F.col("n") == len(wanted)).select("table_id")


def lookup(ledger: Ledger, f: DataFrame, words: list[str], year: int, first: int, last: int, most: int = 100) -> DataFrame:
    """A metric's values in a year from issues of a window: annual values and sums of months, by row slug and by column path;
    of each table the candidate with most months, then the greatest value. note tells what twelve months mean."""
    t = _window(ledger, first, last).select(F.col("id").alias("table_id"), "title", "file", "file_year")
    m = layers.metrics(f).where((F.col("data_year") == year) & F.col("value").isNotNull()).join(t.join(mentions(ledger, words), "table_id", "left_semi"), "table_id")
    phrase = " ".join(words)
    by, keys = {"row": "metric_slug", "col": "col_path"}, ["table_id", "title", "file", "file_year"]
    arms = []
    for kind, col in by.items():
        hit = m.where(F.lower(col).contains(phrase.lower())).withColumn("label", F.col(col))
        arms.append(hit.where("data_month is null").select(*keys, "label", F.lit(f"{kind}_annual").alias("match_field"), "value", F.lit(0).cast("long").alias("n_months")))
        arms.append(hit.where("data_month is not null").groupBy(*keys, "label").agg(F.sum("value").alias("value"), F.count("*").alias("n_months")).select(*keys, "label", F.lit(f"{kind}_monthly_sum").alias("match_field"), "value", "n_months"))
    order = Window.partitionBy("table_id").orderBy(F.desc("n_months"), F.desc("value"), "label", "match_field")
    best = reduce(DataFrame.unionByName, arms).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    whole = F.col("n_months") == 12
    note = F.when(whole & (F.col("file_year") > year), "CY_complete").when(whole, "FY_likely").when(F.col("n_months") > 0, "partial")
    return best.withColumn("note", note).orderBy(F.desc("n_months"), "file_year", "table_id").limit(most)


def search_tables(ledger: Ledger, words: list[str], first: int | None = None, last: int | None = None, most: int = 50) -> DataFrame:
    """Tables that mention the words, latest issues first; with years, only those that have a row or column of one of them."""
    out = ledger.tables.join(mentions(ledger, words).withColumnRenamed("table_id", "id"), "id", "left_semi")
    if first is not None:
        at = lambda df: df.where(F.col("year_extracted").between(first, last if last is not None else first)).select(F.col("table_id").alias("id"))
        out = out.join(at(ledger.rows).union(at(ledger.columns)), "id", "left_semi")
    return out.orderBy(F.desc("file_year"), F.desc("file_month"), "id").limit(most)


def vocabulary(ledger: Ledger, f: DataFrame, words: list[str], years: list[int], few: int = 10) -> DataFrame:
    """Labels to choose from, with how many tables have them: of tables with all the words and a year; where these are fewer
    than few, of tables with any word and a year; else of tables with a year. channel tells which."""
    t = f.where(F.col("data_year").isin(*years)).select("table_id").distinct()
    some = lambda match_all: search.slug_hits(ledger.rows, words, match_all).select("table_id")
    pools = [t.join(some(True), "table_id", "left_semi"), t.join(some(False), "table_id", "left_semi"), t]
    for n, pool in enumerate(pools):
        if n == len(pools) - 1 or pool.limit(few).count() >= few:
            rows = ledger.rows.where("is_section_header = 0").join(pool, "table_id", "left_semi")
            return rows.groupBy("metric_slug").agg(F.countDistinct("table_id").alias("n_tables")).withColumn("channel", F.lit(n))
    raise AssertionError


def bottom_up(ledger: Ledger, hint: str, years: list[int], topic: list[str], most: int, close: float = 60.0, slugs: int = 100) -> DataFrame:
    """From cells to tables: the row slugs most like a hint (scored once a distinct slug), the tables that have them, those of a
    target year (else with a column path that names one), those that mention a topic's words (else all), the latest of each
    signature; n_cells counts the cells of matching rows in target years."""
    ship(ledger.rows.sparkSession)
    near = ledger.rows.where("is_section_header = 0 and metric_slug <> ''").select("metric_slug").distinct().withColumn("likeness", fuzzy.token_set_ratio(F.col("metric_slug"), F.lit(hint)))
    near = near.where(F.col("likeness") >= close).orderBy(F.desc("likeness"), "metric_slug").limit(slugs)
    rows = ledger.rows.join(near, "metric_slug").select("table_id", F.col("id").alias("row_id"), "likeness")
    dated = F.col("year_extracted").isin(*years) if years else F.lit(True)
    named = reduce(lambda a, b: a | b, (F.col("col_path").contains(str(y)) for y in years)) if years else F.lit(True)
    own = ledger.rows.where(dated).select("table_id").union(ledger.columns.where(dated | named).select("table_id"))
    hits = rows.join(own, "table_id", "left_semi")
    if topic:
        told = mentions(ledger, topic)
        narrow = hits.join(told, "table_id", "left_semi")
        hits = narrow if narrow.limit(1).count() else hits
    at = ledger.columns.where(dated | named).select("table_id", F.col("id").alias("col_id"))
    cells = ledger.cells.where("numeric_value is not null").join(hits.select("table_id", "row_id"), ["table_id", "row_id"], "left_semi").join(at, ["table_id", "col_id"], "left_semi").groupBy("table_id").agg(F.count("*").alias("n_cells"))
    score = hits.groupBy("table_id").agg(F.max("likeness").alias("likeness"))
    t = ledger.tables.join(score.join(cells, "table_id").withColumnRenamed("table_id", "id"), "id")
    return search.latest(t, most)


def bottom_up_requests(ledger: Ledger, requests: list[dict], most: int) -> DataFrame:
    """bottom_up of each request (hint, keyword, label, years, topic); request_no tells whose a table is. A request without a
    hint takes its keyword, then its label."""
    lists = []
    for n, r in enumerate(requests):
        hint = next((x.strip()[:120] for x in (r.get("hint"), r.get("keyword"), r.get("label")) if (x or "").strip()), "")
        lists.append(bottom_up(ledger, hint, r.get("years") or [], r.get("topic") or [], most).withColumn("request_no", F.lit(n)))
    return reduce(DataFrame.unionByName, lists)
