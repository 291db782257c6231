"""Sequence operators over document elements: latched context, captions, neighbours, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(keys: list[str], order: str, end: int = 0):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, end)


def latched(df: DataFrame, keys: list[str], order: str, kind: str, content: str, value: str, out: str) -> DataFrame:
    """The last non-empty content of a kind, carried forward until replaced."""
    own = F.when((F.col(kind) == value) & (F.col(content) != ""), F.col(content))
    return df.withColumn(out, F.last(own, ignorenulls=True).over(_upto(keys, order)))


def captions(df: DataFrame) -> DataFrame:
    """Elements (file, seq, page, kind, content) -> tables with the caption that belongs to them: the last caption since the
    table before, unless an element of another kind on another page came between."""
    seg = F.sum(F.when(F.col("kind") == "table", 1).otherwise(0)).over(_upto(["file"], "seq", -1))
    rows = df.withColumn("seg", F.coalesce(seg, F.lit(0)))
    within = _upto(["file", "seg"], "seq", -1)
    mark = F.when(F.col("kind") == "caption", F.struct("seq", "page", "content"))
    rows = rows.withColumn("cap", F.last(mark, ignorenulls=True).over(within))
    # what came since that caption: the least and greatest page of other elements tell whether one stands elsewhere
    since = _upto(["file", "seg", "run"], "seq", -1)
    rows = rows.withColumn("run", F.count(mark).over(_upto(["file", "seg"], "seq")))
    other = ~F.col("kind").isin("caption", "title", "section_header", "table")
    rows = rows.withColumn("low", F.min(F.when(other, F.col("page"))).over(since)).withColumn("high", F.max(F.when(other, F.col("page"))).over(since)).withColumn("pageless", F.coalesce(F.max((other & F.col("page").isNull()).cast("int")).over(since), F.lit(0)) == 1)
    away = F.col("low").isNotNull() & ~(F.col("low").eqNullSafe(F.col("cap.page")) & F.col("high").eqNullSafe(F.col("cap.page")))
    broken = away | (F.col("pageless") & F.col("cap.page").isNotNull())
    fits = F.col("cap").isNotNull() & (F.col("cap.content") != "") & F.col("cap.page").eqNullSafe(F.col("page")) & ~broken
    return rows.where("kind = 'table'").select("file", "seq", "page", F.when(fits, F.col("cap.content")).alias("caption"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """For each left row the right row of the same keys within reach places: the nearest, the earlier one of equals. Bands of
    reach places keep the join an equi-join whatever a page holds."""
    band = F.floor(F.col("seq") / reach)
    l = left.select(*keys, F.col("seq").alias("l_seq"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    r = right.select(*keys, F.col("seq").alias("r_seq"), band.alias("band"))
    pairs = l.join(r, [*keys, "band"]).where(F.abs(F.col("l_seq") - F.col("r_seq")) <= reach)
    best = pairs.groupBy(*keys, "l_seq").agg(F.min(F.struct(F.abs(F.col("l_seq") - F.col("r_seq")).alias("d"), "r_seq")).alias("b"))
    return left.select(*keys, F.col("seq").alias("l_seq")).join(best, [*keys, "l_seq"], "left").select(*keys, "l_seq", F.col("b.r_seq").alias("r_seq"))


def prior(df: DataFrame, keys: list[str], order: str, cond: Column, out: str) -> DataFrame:
    """As-of: the last earlier row of the same keys that meets a condition."""
    return df.withColumn(out, F.last(F.when(cond, F.col(order)), ignorenulls=True).over(_upto(keys, order, -1)))


def continued(tables: DataFrame) -> DataFrame:
    """A table continues the one just before if it has its signature and stands on the next page."""
    w = Window.partitionBy("file").orderBy("element_seq")
    same = (F.lag("signature").over(w) == F.col("signature")) & (F.lag("page_id").over(w) + 1 == F.col("page_id"))
    return tables.withColumn("continues_from", F.when(same, F.lag("id").over(w)))


def year_propagated(rows: DataFrame) -> DataFrame:
    """Rows (table_id, row_index, year, month, is_section): a bare month takes the last year since the last section."""
    group = rows.withColumn("g", F.sum("is_section").over(_upto(["table_id"], "row_index")))
    before = _upto(["table_id", "g"], "row_index", -1)
    last = F.last(F.when(F.col("is_section") == 0, F.col("year")), ignorenulls=True).over(before)
    filled = F.when((F.col("is_section") == 0) & F.col("year").isNull() & F.col("month").isNotNull(), last).otherwise(F.col("year"))
    return group.withColumn("year", filled).drop("g")


def dated_months(labels: DataFrame) -> DataFrame:
    """Rows (key, pos, label): bare months after 'YYYY-Month' get their year; a new year begins after December; a bare year
    ends the run."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec"
    full = F.regexp_extract("label", rf"^(\d{{4}})-({months})\b", 1)
    bare = F.col("label").rlike(rf"^({months})\.?$")
    bare_year = F.col("label").rlike(r"^\d{4}$")
    reset = (bare_year | (full != "")).cast("int")
    g = labels.withColumn("g", F.sum(reset).over(_upto(["key"], "pos")))
    in_run = _upto(["key", "g"], "pos")
    year = F.last(F.when(full != "", full.cast("int")), ignorenulls=True).over(in_run)
    december = F.sum(F.col("label").rlike(r"(^|-)Dec").cast("int")).over(_upto(["key", "g"], "pos", -1))
    return g.select("key", "pos", F.when(bare & year.isNotNull(), F.concat((year + F.coalesce(december, F.lit(0))).cast("string"), F.lit("-"), F.col("label"))).otherwise(F.col("label")).alias("label"))


def title_months(columns: DataFrame, titles: DataFrame) -> DataFrame:
    """Columns (table_id, col_index, year, month) whose years a title tells, such as 'January 1940 to March 1941': columns
    with a month only take the title's months in order, until the first that doesn't fit."""
    from tabulon.functions import labels

    pattern = labels.MONTH[2:-2] + r"\.?,?\s+(1[89]\d{2}|20[0-3]\d)"
    found = F.regexp_extract_all("title", F.lit(f"(?i)\\b{pattern}\\b"), F.lit(0))
    at = lambda x: labels.year_of(x) * 12 + labels.month_of(x) - 1
    span = titles.select("table_id", found.alias("f")).where(F.size("f") >= 2).select("table_id", at(F.get("f", F.lit(0))).alias("lo"), at(F.get("f", F.size("f") - 1)).alias("hi")).where("hi - lo between 1 and 24")
    only = F.col("year").isNull() & F.col("month").isNotNull()
    rows = columns.join(span, "table_id", "left").withColumn("n", F.sum(only.cast("int")).over(_upto(["table_id"], "col_index")))
    due = F.col("lo") + F.col("n") - 1
    fits = F.coalesce(~only | ((due <= F.col("hi")) & (F.pmod(due, F.lit(12)) + 1 == F.col("month"))), F.lit(False))
    kept = F.min(fits.cast("int")).over(_upto(["table_id"], "col_index")) == 1
    return rows.select("table_id", "col_index", F.when(only & kept, F.floor(due / 12).cast("int")).otherwise(F.col("year")).alias("year"), "month")


def adjacent(tables: DataFrame, content: DataFrame) -> DataFrame:
    """Tables (file, seq, page) with what stands on their page: near, joined in order, and how many. content: file, page and a
    struct c that is ordered and ends with a field content."""
    found = tables.join(content, ["file", "page"], "left").groupBy("file", "seq").agg(F.array_sort(F.collect_list("c")).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["content"]), " | ")
    return found.select("file", "seq", F.when(F.size("c") > 0, joined).alias("near"), F.size("c").cast("long").alias("n"))
