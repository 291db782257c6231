"""Queries over elements, labels, series and answers, written into the order tables' values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import answers, labels, numbers
from tabulon.operators import context, evaluation, search, series, stats
from tabulon.plans.registry import query
from tabulon.sources.shared import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(k: Column, *values) -> Column:
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), k.cast("int") + 1)


# --- elements ---------------------------------------------------------------------------------------------

_ELEMENTS = """WITH n AS (SELECT o_custkey AS file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS seq, o_orderkey AS k, o_orderpriority AS p FROM orders),
    e AS (SELECT file, seq, CAST(seq // 3 AS INTEGER) AS page, ['table', 'caption', 'title', 'paragraph', 'caption'][CAST((k * 7 + k // 11) % 5 + 1 AS INTEGER)] AS kind, p || ' ' || k AS content FROM n)"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the elements of a file, three a page."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    n = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("seq"), k, "o_orderpriority")
    kind = _pick((k * 7 + F.floor(k / 11)) % 5, "table", "caption", "title", "paragraph", "caption")
    return n.select("file", "seq", F.floor(F.col("seq") / 3).cast("int").alias("page"), kind.alias("kind"), F.concat_ws(" ", "o_orderpriority", k.cast("string")).alias("content"))


@query(
    _ELEMENTS
    + """, t AS (SELECT file, seq, page, coalesce(lag(seq) OVER (PARTITION BY file ORDER BY seq), -1) AS after FROM e WHERE kind = 'table'),
    c AS (SELECT t.file, t.seq, t.page, max(e.seq) AS at FROM t LEFT JOIN e ON e.file = t.file AND e.kind = 'caption' AND e.seq > t.after AND e.seq < t.seq GROUP BY ALL)
    SELECT c.file, c.seq, c.page, CASE WHEN k.page = c.page AND NOT EXISTS (SELECT 1 FROM e WHERE e.file = c.file AND e.kind = 'paragraph' AND e.seq > c.at AND e.seq < c.seq AND e.page <> k.page) THEN k.content END AS caption
    FROM c LEFT JOIN e k ON k.file = c.file AND k.seq = c.at"""
)
def attached_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.captions(_elements(spark, sf_dir))


@query(
    """WITH t AS (SELECT o_custkey AS file, o_orderkey AS id, o_orderstatus AS signature, o_orderkey % 4 AS page_id FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY id) AS k FROM t)
    SELECT b.id, CASE WHEN a.signature = b.signature AND a.page_id + 1 = b.page_id THEN a.id END AS continues_from FROM n b LEFT JOIN n a ON a.file = b.file AND a.k = b.k - 1"""
)
def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return context.continued(o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("element_seq"), F.col("o_orderstatus").alias("signature"), (F.col("o_orderkey") % 4).alias("page_id"))).select("id", "continues_from")


@query(
    """WITH o AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, min(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS y FROM orders)
    SELECT key, CAST(pos AS INTEGER) AS pos, CAST(y + (pos - 1) // 12 AS VARCHAR) || '-' || monthname(make_date(2000, CAST((pos - 1) % 12 + 1 AS INTEGER), 1)) AS label FROM o"""
)
def month_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of month labels of which only the first tells its year."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.row_number().over(w.orderBy("o_orderkey")).alias("pos"), F.min(F.year("o_orderdate")).over(w).alias("y"))
    month = F.date_format(F.make_date(F.lit(2000), (F.col("pos") - 1) % 12 + 1, F.lit(1)), "MMMM")
    return context.dated_months(o.select("key", "pos", F.when(F.col("pos") == 1, F.concat_ws("-", F.col("y").cast("string"), month)).otherwise(month).alias("label")))


@query(
    """SELECT p_partkey AS table_id, CAST(i AS INTEGER) AS col_index, CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1900 + p_size + (i - 1) // 12 END AS INTEGER) AS year, CAST((i - 1) % 12 + 1 AS INTEGER) AS month FROM part, range(1, 16) r(i)"""
)
def titled_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month columns whose years only the title tells, for two titles of three."""
    p = spread(_read(spark, sf_dir, "part"), "p_partkey")  # by table, before its columns are made
    year = F.lit(1900) + F.col("p_size")
    title = F.when(F.col("p_partkey") % 3 == 0, "Receipts by month").otherwise(F.format_string("Receipts, January %d to Mar. %d", year, year + 1))
    columns = p.select(F.col("p_partkey").alias("table_id"), F.explode(F.sequence(F.lit(1), F.lit(15))).alias("col_index")).select("table_id", "col_index", F.lit(None).cast("int").alias("year"), ((F.col("col_index") - 1) % 12 + 1).cast("int").alias("month"))
    return context.title_months(columns, p.select(F.col("p_partkey").alias("table_id"), title.alias("title")))


@query(
    _ELEMENTS
    + """, a AS (SELECT file, page, content, 0 AS kind, seq FROM e WHERE kind = 'paragraph' UNION ALL SELECT file, page, content, 1, seq FROM e WHERE kind = 'title')
    SELECT t.file, t.seq, string_agg(a.content, ' | ' ORDER BY a.kind, a.seq) AS near, count(a.content) AS n FROM e t LEFT JOIN a ON a.file = t.file AND a.page = t.page WHERE t.kind = 'table' GROUP BY 1, 2"""
)
def adjacent_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands on a table's page: prose first, then footnotes."""
    e = _elements(spark, sf_dir)
    kinds = lambda kind, name, n: e.where(F.col("kind") == kind).select("file", "page", F.struct(F.lit(n).alias("k"), "seq", "content").alias("c"))
    return context.adjacent(e.where("kind = 'table'").select("file", "seq", "page"), kinds("paragraph", "prose", 0).unionByName(kinds("title", "footnote", 1)))


# --- labels -----------------------------------------------------------------------------------------------

_MONTHS = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"


@query(
    """SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN m END AS leading, CASE WHEN k = 3 THEN NULL ELSE m END AS loose, CASE WHEN k IN (0, 1) THEN x || ' (month ' || m || ')' ELSE x END AS annotated
    FROM (SELECT o_orderkey, k, m, CASE k WHEN 0 THEN monthname(d) || ' 3' WHEN 1 THEN left(monthname(d), 3) || '. total' WHEN 2 THEN left(monthname(d), 3) || 'xyz' ELSE 'Total for ' || monthname(d) END AS x FROM (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 4 AS k, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders))"""
)
def month_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, short = F.date_format("o_orderdate", "MMMM"), F.date_format("o_orderdate", "MMM")
    x = _pick(F.col("o_orderkey") % 4, F.concat(name, F.lit(" 3")), F.concat(short, F.lit(". total")), F.concat(short, F.lit("xyz")), F.concat(F.lit("Total for "), name))
    return _read(spark, sf_dir, "orders").select("o_orderkey", labels.leading_month(x).alias("leading"), labels.loose_month(x).alias("loose"), labels.annotated_month(x).alias("annotated"))


@query(
    """SELECT o_orderkey, array_to_string(CASE k WHEN 0 THEN [y] WHEN 1 THEN range(y, y + 4) WHEN 2 THEN range(y - y % 10, y - y % 10 + 10) ELSE [y - 1, y] END, ',') AS years FROM (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)"""
)
def question_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    x = _pick(F.col("o_orderkey") % 4, F.format_string("receipts of %d?", y), F.format_string("from %d to %d", y, y + 3), F.format_string("in the %ds", y - y % 10), F.format_string("%d, and less than %d", y, y - 1))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(labels.years_in(x).cast("array<string>"), ",").alias("years"))


@query(
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || ',' || (o_orderkey % 90) AS pages, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(month(o_orderdate) AS INTEGER) END AS month FROM orders"""
)
def gold_pages_and_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.format_string("https://example.org/a?page=%d and https://example.org/b?x=1&page=%d#top", "o_custkey", (F.col("o_orderkey") % 90).cast("int"))
    name = F.when(F.col("o_orderkey") % 5 == 0, "issue_undated.json").otherwise(F.concat(F.lit("issue_"), F.date_format("o_orderdate", "yyyy_MM"), F.lit(".json")))
    p = labels.file_period(name)
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(labels.pages_of(url).cast("array<string>"), ",").alias("pages"), p["year"].alias("year"), p["month"].alias("month"))


@query(
    """SELECT o_orderkey, CAST(CASE WHEN y < 1976 OR (y = 1976 AND m < 7) THEN y + CAST(m >= 7 AS INTEGER) WHEN y = 1976 AND m < 10 THEN NULL ELSE y + CAST(m >= 10 AS INTEGER) END AS INTEGER) AS fiscal FROM (SELECT o_orderkey, year(o_orderdate) - 19 AS y, month(o_orderdate) AS m FROM orders)"""
)
def fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates moved back by 19 years, so that they lie around the change of 1976."""
    return _read(spark, sf_dir, "orders").select("o_orderkey", labels.fiscal_year(F.year("o_orderdate") - 19, F.month("o_orderdate")).alias("fiscal"))


@query(
    """SELECT p_partkey, [p_size || '/', '**', '†', NULL][k + 1] AS marker, CASE WHEN k = 3 THEN 'toc' ELSE 'data' END AS kind, k = 1 AS total, k IN (0, 2) AS whole_year FROM (SELECT p_partkey, p_size, p_partkey % 4 AS k FROM part)"""
)
def label_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("p_partkey") % 4, F.lit(None).cast("string")
    note = _pick(k, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("/ Revised.")), "** Estimate.", "†See text.", "Revised 3/ here.")
    title = _pick(k, "Receipts", "Outlays", "Debt", "Table of Contents, part 2")
    row = _pick(k, "1940", "Total receipts", "Fiscal year 1941 to date", "1940-41")
    return _read(spark, sf_dir, "part").select("p_partkey", labels.footnote_marker(note).alias("marker"), labels.kind_of(title, none, none).alias("kind"), labels.aggregate(row).alias("total"), answers.year_total(row).alias("whole_year"))


_T = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"


@query(
    f"""SELECT p_partkey, len(list_filter(h, lambda t: NOT list_contains(l, t))) = 0 AS all_there, len(list_filter(list_distinct(h), lambda t: list_contains(l, t))) >= len(list_distinct(h)) - 1 AS nearly
    FROM (SELECT p_partkey, {_T.format("p_name || ' ' || p_type")} AS l, {_T.format("p_type || ' ' || substr(p_brand, 1, 5 + CAST(p_partkey % 2 AS INTEGER))")} AS h FROM part)"""
)
def token_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat_ws(" ", "p_name", "p_type")
    hint = F.concat_ws(" ", "p_type", F.substring(F.col("p_brand"), F.lit(1), 5 + F.col("p_partkey") % 2))
    return _read(spark, sf_dir, "part").select("p_partkey", search.token_subset(label, hint).alias("all_there"), search.token_near(label, hint).alias("nearly"))


@query(
    """SELECT p_partkey, ['October > Outlays', 'Total', 'Receipts > Net', ''][p_partkey % 4 + 1] AS path, p_partkey % 3 <> 2 AS cycle, CASE WHEN p_partkey % 2 = 0 THEN left(trim(p_name), 120) WHEN p_partkey % 3 = 0 THEN p_type ELSE left(repeat(p_brand, 30), 120) END AS hint FROM part"""
)
def header_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = _pick(k % 4, "Unnamed: 0_level_0 > October > Outlays", "Total > nan", "Receipts > Unnamed: 3 > Net", "NaN > Unnamed: 1")
    months = lambda *m: F.array(*map(F.lit, m))
    names = F.when(k % 3 == 0, months("Oct.", "Nov.", "Dec.", "Jan.", "Total")).when(k % 3 == 1, months("January", "February", "March", "April", "May")).otherwise(months("March", "April", "June", "July", "August"))
    hint, keyword = F.when(k % 2 == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise("   "), F.when(k % 3 == 0, F.col("p_type"))
    return _read(spark, sf_dir, "part").select("p_partkey", answers.header_parts(path).alias("path"), answers.month_cycle(names).alias("cycle"), answers.chosen_hint(hint, keyword, F.repeat("p_brand", 30)).alias("hint"))


# --- numbers and answers ----------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN -v WHEN 3 THEN NULL ELSE v END AS clean, CASE k WHEN 0 THEN -v WHEN 3 THEN NULL WHEN 1 THEN v ELSE v END AS loose, CASE k WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE v END AS answer
    FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice, 2) AS DOUBLE) AS v, (l_orderkey + l_linenumber) % 4 AS k FROM lineitem)"""
)
def number_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in brackets, with a footnote, with a dollar sign, and a missing one, as the three parsers read them."""
    v, k = F.format_number(F.round("l_extendedprice", 2), 2), (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    x = _pick(k, F.concat(F.lit("("), v, F.lit(")")), F.concat(v, F.lit(" 3/")), F.concat(F.lit("$"), v), "n.a.")
    l = _read(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", numbers.clean_value(x).alias("clean"), numbers.loose_number(F.when(k == 1, F.concat(F.lit("3/ "), v)).otherwise(x)).alias("loose"), numbers.answer_number(x).alias("answer"))


@query(
    """SELECT p_partkey, CASE k WHEN 3 THEN NULL WHEN 2 THEN 'plain ' || p_size ELSE 'about ' || p_size END AS answer FROM (SELECT p_partkey, p_size, p_partkey % 4 AS k FROM part)"""
)
def answer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    x = _pick(F.col("p_partkey") % 4, F.concat(F.lit("so <FINAL_ANSWER> about "), size, F.lit("\n</FINAL_ANSWER> done")), F.concat(F.lit("<final_answer>about "), size, F.lit("</Final_Answer>")), F.concat(F.lit("plain "), size), "<FINAL_ANSWER>  </FINAL_ANSWER>")
    return _read(spark, sf_dir, "part").select("p_partkey", answers.tagged(x).alias("answer"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN format('{:,}', q * 1000) WHEN 1 THEN CASE WHEN q % 1000 = 0 THEN CAST(q // 1000 AS VARCHAR) ELSE rtrim(format('{:.3f}', q / 1000.0), '0') END END AS fixed
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, (l_orderkey + l_linenumber) % 4 AS k FROM lineitem)"""
)
def unit_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities said in billions and asked in millions, said in thousands and asked in millions, alike, and unknown."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    said, asked = _pick(k, "billions", "thousands", "millions", "index"), F.lit("millions")
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answers.unit_fixed(F.col("l_quantity").cast("long").cast("string"), said, asked).alias("fixed"))


@query(
    """SELECT o_orderkey, (p = 'calendar' AND l = 0) OR (p = 'fiscal' AND l = 1) AS confused FROM (SELECT o_orderkey, ['calendar', 'fiscal', 'unknown'][o_orderkey % 3 + 1] AS p, o_custkey % 4 AS l FROM orders)"""
)
def period_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = F.col("o_custkey") % 4
    names = F.when(l == 0, F.array(F.lit("Fiscal  year 1990"), F.lit("Jan"))).when(l == 1, F.array(F.lit("CY 1990"))).when(l == 2, F.array(F.lit("FY 1990 and CY 1991"))).otherwise(F.array().cast("array<string>"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", answers.period_confused(_pick(F.col("o_orderkey") % 3, "calendar", "fiscal", "unknown"), names).alias("confused"))


@query(
    """WITH v AS (SELECT l_orderkey AS k, list(CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber) AS x FROM lineitem GROUP BY 1), c AS (SELECT k, x, CASE k % 4 WHEN 0 THEN list_sum(x) WHEN 1 THEN list_sum(x) / len(x) WHEN 2 THEN CASE WHEN len(x) = 2 THEN (x[2] - x[1]) / x[1] * 100 END END AS want, list_sum(x) + CASE WHEN k % 3 = 0 THEN 100 ELSE 0 END AS said FROM v)
    SELECT k AS l_orderkey, coalesce(abs(want - said) > greatest(abs(want) * 0.01, 0.01), false) AS fails FROM c"""
)
def submission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's quantities submitted with their sum, in a third of the cases with 100 more, as the result of an operation. Lines of
    one number stay in the table's order."""
    place = F.struct("l_linenumber", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("l_quantity").cast("double").alias("q"))
    pairs = F.array_sort(F.collect_list(place))
    v = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(pairs, lambda p: p["q"]).alias("x"))
    said = F.aggregate("x", F.lit(0.0), lambda a, b: a + b) + F.when(F.col("l_orderkey") % 3 == 0, 100.0).otherwise(0.0)
    return v.select("l_orderkey", answers.submission_fails(said.cast("string"), F.col("x"), _pick(F.col("l_orderkey") % 4, "sum", "mean", "percent_change", "other")).alias("fails"))


@query(
    """SELECT l_returnflag, round(sum(CASE WHEN l_tax > 0 AND l_discount > 0 THEN l_tax * ln(l_tax / l_discount) END), 4) AS kl, round(avg(l_quantity) + 1.6448536269514722 * stddev_samp(l_quantity), 4) AS var_95 FROM lineitem GROUP BY 1"""
)
def divergence_and_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(stats.kl_divergence(d("l_tax"), d("l_discount")), 4).alias("kl"), F.round(stats.parametric_var(d("l_quantity"), 0.95), 4).alias("var_95"))


# --- series -----------------------------------------------------------------------------------------------

_LEVELS = """WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, month(o_orderdate) AS month, CAST(count(*) AS DOUBLE) AS level FROM orders GROUP BY 1, 2), a AS (SELECT year, round(avg(level), 1) AS level FROM m GROUP BY 1),
    l AS (SELECT coalesce(s.year, a.year) AS year, coalesce(s.level, a.level) AS level FROM a FULL JOIN (VALUES (1995, 77.7), (2020, 258.8)) s(year, level) ON a.year = s.year)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a month as a price level, with two stated annual ones."""
    monthly = _read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").cast("double").alias("level"))
    return series.annual(monthly, spark.createDataFrame([(1995, 77.7), (2020, 258.8)], "year int, level double"))


@query(_LEVELS + " SELECT year, level FROM l")
def annual_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


@query(_LEVELS + " SELECT o_orderkey, round(t.level / f.level, 6) AS factor, round(round(o_totalprice * (t.level / f.level), 4), 2) AS adjusted FROM orders LEFT JOIN l f ON f.year = year(o_orderdate) LEFT JOIN l t ON t.year = 2015 + o_orderkey % 6")
def cpi_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices at the level of a year between 2015 and 2020, of which one has a level."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("v"), F.year("o_orderdate").alias("y"), (2015 + F.col("o_orderkey") % 6).cast("int").alias("t"))
    return series.price_adjusted(o, _levels(spark, sf_dir), "v", "y", "t").select("o_orderkey", "factor", F.round("adjusted", 2).alias("adjusted"))


@query(_LEVELS + " SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * t.level / f.level, 2) ELSE CAST(o_totalprice AS DOUBLE) END AS adjusted FROM orders JOIN l f ON f.year = year(o_orderdate), (SELECT level FROM l WHERE year = 2020) t")
def cpi_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that speak of constant dollars of 2020, of dollars of 2020 only, and of neither."""
    q = _pick(F.col("o_orderkey") % 3, "Total, in 2020 dollars, Adjusted for inflation?", "Total in 2020 dollars?", "Total in constant dollars?")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", q.alias("q"), F.col("o_totalprice").cast("double").alias("v"), F.year("o_orderdate").alias("y"))
    return series.adjusted_by_question(o, _levels(spark, sf_dir), "q", "v", "y").select("o_orderkey", "adjusted")


@query(
    """WITH r AS (SELECT ['jpy', 'gbp', 'cad'][o_custkey % 3 + 1] AS quote, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(min(o_totalprice) AS DOUBLE) AS rate FROM orders GROUP BY ALL),
    q AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) ELSE 1 END AS m, CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) ELSE 1 END AS d, CASE o_orderkey % 3 WHEN 0 THEN ['jpy'] WHEN 1 THEN ['gbp', 'cad'] ELSE [] END AS quotes FROM orders),
    w AS (SELECT id, y, m, d, unnest(quotes) AS quote, unnest(range(len(quotes))) AS place FROM q),
    f AS (SELECT w.id, place, coalesce(a.rate, b.rate) AS rate FROM w LEFT JOIN r a ON a.quote = w.quote AND a.y = w.y AND a.m = w.m AND a.d = w.d LEFT JOIN r b ON b.quote = w.quote AND b.y = w.y AND b.m = w.m AND b.d = 1)
    SELECT q.id, (SELECT arg_min(rate, place) FROM f WHERE f.id = q.id AND rate IS NOT NULL) AS rate FROM q"""
)
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by currency and day out of orders; requests that name a currency or two, with a day or without."""
    o = _read(spark, sf_dir, "orders")
    d = "o_orderdate"
    rates = o.groupBy(_pick(F.col("o_custkey") % 3, "jpy", "gbp", "cad").alias("quote"), F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day")).agg(F.min("o_totalprice").cast("double").alias("rate"))
    text = F.concat(_pick(F.col("o_orderkey") % 3, "yen rate", "Pound sterling or Canadian rate", "peso rate"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" on "), F.date_format(d, "MMMM d"))).otherwise(""))
    return series.exchange_rate(o.select(F.col("o_orderkey").alias("id"), text.alias("text"), F.year(d).alias("year"), F.lit(None).cast("int").alias("month")), rates)


# --- evaluation and ranking -------------------------------------------------------------------------------

_RANKS = "SELECT o_orderkey AS uid, nullif(o_orderkey % 7, 0) AS a, nullif(o_custkey % 5, 0) AS b, nullif(o_orderkey % 3, 0) AS c FROM orders"


@query(
    f"""SELECT uid, CASE WHEN a IS NULL THEN 'not_in_pool' WHEN b IS NULL THEN 'row_miss' WHEN c = 1 THEN 'ok' ELSE 'table_selection' END AS stage, CASE WHEN a IS NULL THEN 'not_in_pool' WHEN b < 2 OR b IS NULL THEN 'ingest_title_bad' WHEN c IS NULL THEN 'decompose_row_miss' ELSE 'ranker_mis_scored' END AS bucket,
    b - a AS delta, CASE WHEN a IS NULL AND b IS NULL THEN 'same' WHEN a IS NULL THEN 'gained' WHEN b IS NULL THEN 'lost' WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'same' END AS change FROM ({_RANKS})"""
)
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where questions were lost, in what way, and how two runs' ranks differ."""
    o = _read(spark, sf_dir, "orders")
    rank = lambda c, n: F.nullif(F.col(c) % n, F.lit(0).cast("long"))
    r = o.select(F.col("o_orderkey").alias("uid"), rank("o_orderkey", 7).alias("a"), rank("o_custkey", 5).alias("b"), rank("o_orderkey", 3).alias("c"))
    title = F.when(F.coalesce("b", F.lit(0).cast("long")) < 2, " Table ").otherwise("Receipts")
    told = r.select("uid", evaluation.attribution(F.col("a"), F.col("b"), F.col("c")).alias("stage"), evaluation.miss_bucket(F.col("a"), evaluation.good_title(title), F.col("c").isNotNull()).alias("bucket"))
    return told.join(evaluation.compared(r.select("uid", F.col("a").alias("rank")), r.select("uid", F.col("b").alias("rank"))), "uid")


@query(
    """WITH g AS (SELECT o_orderkey AS question, o_orderkey AS file, 1 AS page, CAST(o_custkey % 60 AS DOUBLE) + 1 AS v FROM orders), c AS (SELECT l_orderkey AS file, l_linenumber AS page, CAST(l_quantity AS DOUBLE) * CASE WHEN l_partkey % 2 = 0 THEN 1000 ELSE 1 END AS x FROM lineitem)
    SELECT question, EXISTS (SELECT 1 FROM c, (VALUES (1.0), (1e3), (1e-3), (1e6), (1e-6)) s(s) WHERE c.file = g.file AND c.page = g.page AND abs(x - v * s) <= abs(v * s) * 0.01) AS found FROM g"""
)
def gold_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"), F.col("o_orderkey").alias("file"), F.lit(1).alias("page"), ((F.col("o_custkey") % 60).cast("double") + 1).alias("value"))
    cells = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("page"), (F.col("l_quantity").cast("double") * F.when(F.col("l_partkey") % 2 == 0, 1000).otherwise(1)).alias("numeric_value"))
    return evaluation.present(cells, gold)


@query(
    """WITH f AS (SELECT o_custkey % 100 AS question, o_orderkey AS file, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS rank FROM orders), g AS (SELECT DISTINCT o_custkey % 100 AS question, max(o_orderkey) OVER (PARTITION BY o_custkey % 100) - 7 * (o_custkey % 2) AS file FROM orders)
    SELECT g.question, CAST(min(f.rank) AS INTEGER) AS rank FROM g LEFT JOIN f USING (question, file) GROUP BY 1"""
)
def gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("question")
    o = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("question"), F.col("o_orderkey").alias("file"), F.lit(1).alias("page"), "o_custkey")
    found = o.select("question", "file", "page", F.row_number().over(w.orderBy("file")).alias("rank"))
    gold = o.select("question", (F.max("file").over(w) - 7 * (F.col("o_custkey") % 2)).alias("file"), "page").distinct()
    return evaluation.first_hits(found, gold)


@query(
    """WITH e AS (SELECT o_custkey AS key, o_orderkey AS rank, [year(o_orderdate), year(o_orderdate) + o_orderkey % 2] AS years FROM orders), u AS (SELECT key, rank, unnest(years) AS y FROM e), f AS (SELECT DISTINCT key, min(rank) OVER (PARTITION BY key, y) AS rank FROM u)
    SELECT e.key, e.rank, CAST(row_number() OVER (PARTITION BY e.key ORDER BY CASE WHEN f.rank IS NULL THEN 1 ELSE 0 END, e.rank) AS INTEGER) AS place FROM e LEFT JOIN f ON f.key = e.key AND f.rank = e.rank"""
)
def covering_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate").cast("long")
    e = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("rank"), F.array(y, y + F.col("o_orderkey") % 2).alias("years"))
    return evaluation.covering(e, "key").select("key", "rank", "place")


@query(
    """WITH t AS (SELECT source AS key, doc_id AS rank, coalesce(text, '') AS text, 60000 - coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM documents)
    SELECT key, rank, CAST(least(room, length(text)) AS INTEGER) AS n FROM t WHERE room >= length(text) OR room > 500"""
)
def budgeted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    return evaluation.budgeted(d, "key", 60000).select("key", "rank", F.length("text").alias("n"))


@query(
    """SELECT p_partkey, round(coalesce(s / nullif(max(s) OVER (), 0), 0), 6) AS norm, CAST(CASE WHEN a = 'unknown' OR b = 'unknown' OR b IS NULL THEN 0.0 WHEN a = b THEN 0.5 ELSE -0.3 END AS DOUBLE) AS delta
    FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS s, ['calendar', 'fiscal', 'unknown'][p_partkey % 3 + 1] AS a, ['calendar', 'fiscal', 'unknown', NULL][p_size % 4 + 1] AS b FROM part)"""
)
def score_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pick(F.col("p_partkey") % 3, "calendar", "fiscal", "unknown"), _pick(F.col("p_size") % 4, "calendar", "fiscal", "unknown", F.lit(None).cast("string"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", (-F.col("p_retailprice").cast("double")).alias("score"), search.period_delta(a, b).alias("delta"))
    return search.normalized(rows, {"score": "norm"}).select("p_partkey", F.round("norm", 6).alias("norm"), "delta")


@query(
    """WITH r AS (SELECT p_brand AS key, p_partkey, ['Total receipts', 'Other outlays', 'Net debt'][CASE WHEN p_brand < 'Brand#3' THEN p_partkey % 2 + 1 ELSE p_partkey % 3 + 1 END] AS label FROM part)
    SELECT key, p_partkey, label FROM r WHERE label = 'Net debt' OR NOT EXISTS (SELECT 1 FROM r x WHERE x.key = r.key AND x.label = 'Net debt')"""
)
def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without totals and remainders, but for keys that have nothing else."""
    k = F.when(F.col("p_brand") < "Brand#3", F.col("p_partkey") % 2).otherwise(F.col("p_partkey") % 3)
    rows = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), "p_partkey", _pick(k, "Total receipts", "Other outlays", "Net debt").alias("label"))
    return search.without_aggregates(rows, "key", "label").select("key", "p_partkey", "label")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 UNION ALL SELECT -o_orderkey FROM orders")
def soft_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that enough rows meet, and one that none meets."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return search.soft_filter(o, F.col("y") == 1995, 20).select("o_orderkey").union(search.soft_filter(o, F.col("y") == 1895, 20).select(-F.col("o_orderkey")))


@query(
    """SELECT o_custkey AS key, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 0 ELSE 1 END, CASE WHEN year(o_orderdate) BETWEEN 1994 AND 1995 THEN 0 ELSE 1 END, CASE WHEN year(o_orderdate) BETWEEN 1994 AND 1995 THEN -1 ELSE least(abs(year(o_orderdate) - 1994), abs(year(o_orderdate) - 1995)) END, o_orderkey) AS INTEGER) AS place FROM orders"""
)
def sorted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by section match, years in common, and distance from the years asked for."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("section"), F.year("o_orderdate").alias("file_year"), F.array(F.year("o_orderdate")).alias("years"))
    return evaluation.by_match(o, "key", "urgent", [1994, 1995], "id").select("key", "id", "place")


@query(
    """WITH t AS (SELECT o_orderkey AS id, o_custkey AS signature, year(o_orderdate) * 12 + month(o_orderdate) AS ym FROM orders), a AS (SELECT * FROM t ORDER BY ym DESC, id DESC LIMIT 800)
    SELECT id, 'before' AS mode FROM (SELECT id, ym, row_number() OVER (PARTITION BY signature ORDER BY ym DESC, id DESC) AS k FROM a) WHERE k = 1
    UNION ALL SELECT id, 'after' FROM (SELECT id FROM (SELECT id, ym, row_number() OVER (PARTITION BY signature ORDER BY ym DESC, id DESC) AS k FROM t) WHERE k = 1 ORDER BY ym DESC, id DESC LIMIT 100)"""
)
def latest_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest table of each signature: cut to a pool before, and to the answer's length after."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("signature"), F.year("o_orderdate").alias("file_year"), F.month("o_orderdate").alias("file_month"))
    return search.latest(o, 100, 8).select("id", F.lit("before").alias("mode")).union(search.latest(o, 100).select("id", F.lit("after").alias("mode")))


@query(
    """WITH t AS (SELECT o_orderkey AS id, o_orderpriority || o_custkey % 40 AS k, -round(CAST(o_totalprice AS DOUBLE), 0) AS score, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), p AS (SELECT * FROM t ORDER BY score, id LIMIT 500), d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score, y, m, id) AS n FROM p)
    SELECT id, CAST(row_number() OVER (ORDER BY score, y, m, id) AS INTEGER) AS place FROM d WHERE n = 1 ORDER BY place LIMIT 50"""
)
def find_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each section, title and file in a pool of the best hits."""
    o = _read(spark, sf_dir, "orders")
    hits = o.select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("k"), (-F.round(F.col("o_totalprice").cast("double"), 0)).alias("score"), F.year("o_orderdate").alias("file_year"), F.month("o_orderdate").alias("file_month"))
    return search.best_per(hits, ["k"], 50).select("id", "place")


@query(
    """WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders), b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders)
    SELECT id, 0 AS list_no FROM a WHERE pos <= 30 UNION ALL SELECT id, 1 FROM b WHERE pos <= 40 AND id NOT IN (SELECT id FROM a WHERE pos <= 30)"""
)
def merged_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-up hits first, then the others that aren't among them."""
    o = _read(spark, sf_dir, "orders")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select(F.col("o_orderkey").alias("id"))
    rest = o.orderBy("o_orderkey").limit(40).select(F.col("o_orderkey").alias("id"))
    return search.prepended(top, rest, ["id"])
