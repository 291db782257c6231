"""Series for a table of requests, from ledgers whose months stand in columns or in rows: each request and year takes the best of three ways
in one pass, with a status that says what was missing.

Requests: q, hint (a row's or a column's words), years, granularity (annual or monthly), title (words of the table's title; none: any).

Ways, best first: ``columns`` (a row that has the hint, its cells by month), ``rows`` (a column that has the hint, its cells in rows of months), both
where at least ``MONTHS`` months of the year have a number; ``annual`` (a cell of the year without a month, in a row or column that has the hint). All
ways are looked at together: each gives a row a table, line and year, and the best one is an aggregate.

Statuses, in the order in which they are told: label_miss (no row or column has the hint), table_miss (none in a table of that title), year_miss (none
has the year), null_numeric (the year's cells hold no number), incomplete (fewer months than wanted and no annual cell), ok."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators import containment, search
from tabulon.sources.shared import written

MONTHS = 10  #: fixed value: months of a year from which a series counts
WAYS = ("columns", "rows", "annual")
STATUSES = ("label_miss", "table_miss", "year_miss", "null_numeric", "incomplete", "ok")


def lines(f: DataFrame) -> DataFrame:
    """A row for each cell and axis: label (the other axis's path), month, year, value. A cell of a month in a column belongs to its row's line; one of a
    month in a row to its column's; one without a month to both."""
    data = f.where("table_kind = 'data' and is_section_header = 0")
    keys = ["table_id", "title", "file_year", "file_month", F.col("data_year").alias("year"), F.col("numeric_value").alias("value")]
    in_column = F.coalesce("col_month", F.lit(0)) > 0
    in_row = F.coalesce("row_month", F.lit(0)) > 0
    by_row = data.where(~in_row).select(*keys, F.when(in_column, "columns").otherwise("annual").alias("way"), F.lower("row_path").alias("label"), F.col("row_id").alias("line"), F.col("col_month").alias("month"))
    by_column = data.where(~in_column).select(*keys, F.when(in_row, "rows").otherwise("annual").alias("way"), F.lower("col_path").alias("label"), F.col("col_id").alias("line"), F.col("row_month").alias("month"))
    return by_row.unionByName(by_column)


def with_axes(f: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Facts with row_month and col_month: on which axis a month stands."""
    r = rows.select("table_id", F.col("id").alias("row_id"), F.col("month_extracted").alias("row_month"))
    c = columns.select("table_id", F.col("id").alias("col_id"), F.col("month_extracted").alias("col_month"))
    return f.join(r, ["table_id", "row_id"]).join(c, ["table_id", "col_id"])


def resolved(requests: DataFrame, f: DataFrame, months: int = MONTHS) -> DataFrame:
    """q, year, status, way, table_id, line, n (months, or 1), value (the months' sum, or the annual value) and series (month and value, where monthly
    values are asked for) for each request and year. f: facts with_axes.

    Of the ways of a year the complete ones come first, then those in the order of WAYS, then more months, then later issues, then the smaller table and line. Of
    several cells of a month in a line the greatest counts."""
    r = written(requests.select("q", F.lower("hint").alias("hint"), F.array_distinct("years").alias("years"), "granularity", F.lower(F.coalesce("title", F.lit(""))).alias("title")))
    cells = written(lines(f))
    pairs = containment.by_tokens(r.select("hint"), cells.select("label")).select("hint", "label")
    titles = containment.by_tokens(r.where("title <> ''").select(F.col("title").alias("hint")), cells.select(F.lower("title").alias("label"))).select(F.col("hint").alias("title"), F.col("label").alias("t"))
    asked = r.select("q", "hint", "title").join(pairs, "hint")
    named = asked.where("title = ''").select("q", "label", F.lit(None).cast("string").alias("t")).unionByName(asked.join(titles, "title").select("q", "label", "t"))
    hits = written(cells.join(named, "label").where(F.col("t").isNull() | (F.col("t") == F.lower(cells["title"]))).select("q", "table_id", "file_year", "file_month", "year", "value", "way", "line", "month"))

    years = r.select("q", "granularity", F.explode("years").alias("year"))
    own = hits.join(years, ["q", "year"])
    month = own.groupBy("q", "year", "granularity", "way", "table_id", "line", "file_year", "file_month", "month").agg(F.max("value").alias("v"))
    line = month.groupBy("q", "year", "granularity", "way", "table_id", "line", "file_year", "file_month").agg(F.count("v").alias("n"), F.sum("v").alias("value"), F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("month", F.col("v").alias("value"))))).alias("series"))  # at most 12 months
    dated = F.col("way") != "annual"
    fits = F.when(dated, F.col("n") >= months).otherwise((F.col("n") > 0) & (F.col("granularity") != "monthly"))
    order = F.struct(fits.alias("fits"), (-F.array_position(F.array(*(F.lit(w) for w in WAYS)), F.col("way"))).alias("by_way"), "n", "file_year", "file_month", (-F.col("table_id")).alias("t"), (-F.col("line")).alias("l"))
    best = line.withColumn("fits", fits).groupBy("q", "year").agg(F.max_by(F.struct("fits", "way", "table_id", "line", "n", "value", "series"), order).alias("b"))

    some = lambda df, keys, out: df.select(*keys).distinct().withColumn(out, F.lit(True))
    labelled = some(asked, ["q"], "has_label")
    tabled = some(hits, ["q"], "has_table")
    j = years.join(labelled, "q", "left").join(tabled, "q", "left").join(best, ["q", "year"], "left")
    status = F.when(F.col("has_label").isNull(), "label_miss").when(F.col("has_table").isNull(), "table_miss").when(F.col("b").isNull(), "year_miss").when(F.col("b.n") == 0, "null_numeric").when(~F.col("b.fits"), "incomplete").otherwise("ok")
    given = status.isin("ok", "incomplete")
    show = lambda c: F.when(given, F.col(f"b.{c}")).alias(c)  # noqa: E731  an incomplete series is given as far as it goes
    return j.select("q", "year", status.alias("status"), show("way"), show("table_id"), show("line"), show("n"), show("value"), F.when(given & (F.col("granularity") == "monthly") & (F.col("b.way") != "annual"), F.col("b.series")).alias("series"))


def nearest_labels(missed: DataFrame, f: DataFrame, most: int = 3) -> DataFrame:
    """q, label, n_shared: for requests (q, hint) whose hint no label has, the labels that share most of its words, as something to ask for
    instead; ties to the shorter label, then by text. Labels that share nothing aren't looked at."""
    labels = lines(f).select("label").distinct()
    word = missed.select("q", F.explode(F.array_distinct(search.tokens(F.lower("hint")))).alias("hint")).distinct()
    shared = word.join(containment.by_tokens(word, labels), "hint").groupBy("q", "label").agg(F.count("*").alias("n_shared"))
    from pyspark.sql import Window

    order = Window.partitionBy("q").orderBy(F.desc("n_shared"), F.length("label"), "label")
    return shared.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
