"""From cells to tables for a table of requests: one plan, whatever their number.

Requests: q, hint, topic (texts), years (array). A hint's probes come in stages, each tried for requests that the ones before found
nothing for: the hint; the topic; the topic's words and neighbouring pairs of words. One similarity join serves the probes of
all requests. A null or empty list of years asks for all years; a blank hint and topic find nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators import search, similarity
from tabulon.sources.ledger import Ledger
from tabulon.sources.shared import written

#: Least likeness and most slugs of a probe that is the hint, the topic, a word or a pair of words of the topic.
HINT, TOPIC, WORD, PAIR = (60.0, 100), (55.0, 80), (55.0, 40), (55.0, 30)


def probes(r: DataFrame) -> DataFrame:
    """q, stage, hint, least, most: the texts to look for, in lower case."""
    clean = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    words = search.tokens(F.coalesce("topic", F.lit("")))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    one = lambda stage, text, limits: F.struct(F.lit(stage).alias("stage"), text.alias("hint"), F.lit(limits[0]).alias("least"), F.lit(limits[1]).alias("most"))
    each = F.concat(F.array(one(0, clean("hint"), HINT), one(1, clean(F.left("topic", F.lit(240))), TOPIC)), F.transform(words, lambda w: one(2, w, WORD)), F.transform(pairs, lambda w: one(2, w, PAIR)))
    return r.select("q", F.explode(each).alias("x")).select("q", "x.*").where("hint <> ''").distinct()


def slugs(ledger: Ledger, r: DataFrame) -> DataFrame:
    """q, metric_slug, likeness: row slugs of the first stage that finds any."""
    asked = written(probes(r))
    labels = ledger.rows.where("is_section_header = 0 and trim(metric_slug) <> ''").select(F.col("metric_slug").alias("label")).distinct()
    least, most = (f(x[i] for x in (HINT, TOPIC, WORD, PAIR)) for i, f in ((0, min), (1, max)))
    near = similarity.nearest(asked.select("hint"), labels, most, least)
    found = asked.join(near, "hint").where((F.col("likeness") >= F.col("least") - 1e-9) & (F.col("place") <= F.col("most")))
    best = found.groupBy("q", "stage", F.col("label").alias("metric_slug")).agg(F.max("likeness").alias("likeness"))
    first = best.groupBy("q").agg(F.min("stage").alias("stage"))
    return best.join(first, ["q", "stage"]).drop("stage")


def _told(ledger: Ledger, topics: DataFrame, pool: DataFrame) -> DataFrame:
    """(q, table_id) of a pool whose tables' title, row paths and column paths together hold all words of the topic; the texts
    are cut to the pool's tables and the words asked for before they meet."""
    words = topics.select("q", F.explode(F.array_distinct(search.tokens(F.col("topic")))).alias("w"))
    n = words.groupBy("q").agg(F.count("*").alias("n_words"))
    ids = pool.select("table_id").distinct()
    texts = [(ledger.tables, "id", "title"), (ledger.rows, "table_id", "row_path"), (ledger.columns, "table_id", "col_path")]
    tokens = reduce(DataFrame.union, (df.select(F.col(key).alias("table_id"), F.explode(search.tokens(F.coalesce(c, F.lit("")))).alias("w")).join(ids, "table_id", "left_semi") for df, key, c in texts))
    held = tokens.join(words.select("w").distinct(), "w", "left_semi").distinct()
    hits = pool.select("q", "table_id").distinct().join(words, "q").join(held, ["table_id", "w"])
    return hits.groupBy("q", "table_id").agg(F.count("*").alias("n")).join(n, "q").where("n = n_words").select("q", "table_id")


def retrieve(ledger: Ledger, requests: DataFrame, most: int = 20) -> DataFrame:
    """q, place and the tables' columns with likeness and n_cells, the number of cells of matching rows in years asked for; of the tables of a
    signature the latest, and of each request the latest most.

    Tables have a row or column of a year asked for, or a column path that names one. Where tables with all words of the topic are
    among a request's, the others go."""
    r = written(requests.select("q", "hint", "topic", F.coalesce("years", F.array().cast("array<int>")).alias("years")))
    rows = ledger.rows.where("is_section_header = 0").select("table_id", F.col("id").alias("row_id"), "metric_slug", F.col("year_extracted").alias("row_year"))
    near = written(slugs(ledger, r).join(rows, "metric_slug").select("q", "table_id", "row_id", "likeness"))
    asked = r.select("q", F.explode("years").alias("year")).distinct()
    free = r.where(F.size("years") == 0).select("q")

    named = F.transform(F.regexp_extract_all("col_path", F.lit(r"(?=(\d{4}))"), F.lit(1)), lambda y: y.cast("int"))
    years = F.array_distinct(F.concat(F.array_compact(F.array(F.col("year_extracted"))), F.coalesce(named, F.array().cast("array<int>"))))
    columns = ledger.columns.select("table_id", F.col("id").alias("col_id"), F.explode(years).alias("year"))
    ids = near.select("q", "table_id").distinct()
    in_years = ids.join(asked, "q").join(columns, ["table_id", "year"]).select("q", "table_id", "col_id").distinct()
    any_year = ids.join(free, "q").join(ledger.columns.select("table_id", F.col("id").alias("col_id")), "table_id").select("q", "table_id", "col_id")
    at = written(in_years.union(any_year))  # steps that later ones read several times
    dated = ledger.rows.where("year_extracted is not null").select("table_id", F.col("year_extracted").alias("year")).distinct()
    own = at.select("q", "table_id").union(ids.join(asked, "q").join(dated, ["table_id", "year"]).select("q", "table_id")).union(ids.join(free, "q").select("q", "table_id")).distinct()

    pool = written(near.join(own, ["q", "table_id"], "left_semi"))
    told = _told(ledger, r.where(F.coalesce("topic", F.lit("")) != ""), pool).withColumn("told", F.lit(True))
    told = written(told)
    some = told.select("q").distinct().withColumn("narrow", F.lit(True))
    hits = written(pool.join(told, ["q", "table_id"], "left").join(some, "q", "left").where("narrow is null or told"))
    numbers = ledger.cells.where("numeric_value is not null").select("table_id", "row_id", "col_id")
    cells = hits.select("q", "table_id", "row_id").join(numbers, ["table_id", "row_id"]).join(at, ["q", "table_id", "col_id"], "left_semi").groupBy("q", "table_id").agg(F.count("*").alias("n_cells"))
    score = hits.groupBy("q", "table_id").agg(F.max("likeness").alias("likeness")).join(cells, ["q", "table_id"])
    out = ledger.tables.join(score.withColumnRenamed("table_id", "id"), "id")
    order = [F.desc("file_year"), F.desc("file_month"), F.desc("id")]
    newest = out.withColumn("_n", F.row_number().over(Window.partitionBy("q", "signature").orderBy(*order))).where("_n = 1").drop("_n")
    return newest.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("place") <= most)
