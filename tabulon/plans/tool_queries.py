"""Queries of the look-up tools, over the demonstration ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import channels, grid, layers, sections, tools
from tabulon.plans.registry import query
from tabulon.sources.ledger import LEDGER_SQL, demo_ledger, read
from tabulon.sources.shared import spread, stored

L = LEDGER_SQL
#: The tables that hold a word in their title, rows or columns.
_TOLD = "(SELECT id FROM tables WHERE list_contains(regexp_split_to_array(lower(title), '[^a-z0-9]+'), '{0}') UNION SELECT table_id FROM rws WHERE list_contains(regexp_split_to_array(lower(row_path), '[^a-z0-9]+'), '{0}') UNION SELECT table_id FROM cols WHERE list_contains(regexp_split_to_array(lower(col_path), '[^a-z0-9]+'), '{0}'))"


@query(
    L
    + """, best AS (SELECT lower(trim(title)) AS family_id, arg_max(table_id, file_year * 100 + file_month) AS table_id FROM facts GROUP BY lower(trim(title)), data_year),
    hits AS (SELECT table_id, metric_slug AS label, 'row' AS source FROM rws WHERE ' ' || lower(metric_slug) || ' ' LIKE '% america %' OR ' ' || lower(metric_slug) || ' ' LIKE '% east %' OR ' ' || lower(metric_slug) || ' ' LIKE '% 6 %'
      UNION ALL SELECT table_id, col_leaf, 'col' FROM cols WHERE col_leaf IN ('america', 'east', '6'))
    SELECT label, source, count(DISTINCT t.id) AS n_tables, CAST(min(file_year) AS INTEGER) AS first_year, CAST(max(file_year) AS INTEGER) AS last_year, min(title) AS title, min(family_id) AS family_id,
      CASE source WHEN 'row' THEN 'metric_slug = ''' || label || '''' ELSE 'col_path LIKE ''%' || label || '%''' END AS filter
    FROM hits h JOIN tables t ON t.id = h.table_id LEFT JOIN best b ON b.table_id = t.id WHERE file_year BETWEEN 1996 AND 2001 GROUP BY label, source"""
)
def browse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row slugs and column leaves of the issues of 1996 to 2001."""
    ledger = demo_ledger(spark, sf_dir)
    return tools.browse(ledger, layers.facts(ledger), ["america", "east", "6"], data_year=1996)


@query(
    L
    + f""", m AS (SELECT table_id, metric_slug, col_path, data_year, data_month, numeric_value AS value FROM metrics_base UNION ALL SELECT table_id, metric_slug, 'CY total (synthesized)', data_year, NULL, value FROM cy),
    c AS (SELECT m.*, t.file_year, t.title FROM m JOIN tables t ON t.id = m.table_id WHERE data_year = 1998 AND value IS NOT NULL AND file_year BETWEEN 1997 AND 2001 AND t.id IN {_TOLD.format("europe")}),
    a AS (SELECT table_id, file_year, title, metric_slug AS label, 'row_annual' AS match_field, value, 0 AS n_months FROM c WHERE metric_slug LIKE '%europe%' AND data_month IS NULL
      UNION ALL SELECT table_id, file_year, title, col_path, 'col_annual', value, 0 FROM c WHERE lower(col_path) LIKE '%europe%' AND data_month IS NULL
      UNION ALL SELECT table_id, file_year, title, metric_slug, 'row_monthly_sum', sum(value), count(*) FROM c WHERE metric_slug LIKE '%europe%' AND data_month IS NOT NULL GROUP BY ALL
      UNION ALL SELECT table_id, file_year, title, col_path, 'col_monthly_sum', sum(value), count(*) FROM c WHERE lower(col_path) LIKE '%europe%' AND data_month IS NOT NULL GROUP BY ALL)
    SELECT table_id, label, match_field, round(value, 2) AS value, n_months, CASE WHEN n_months = 12 AND file_year > 1998 THEN 'CY_complete' WHEN n_months = 12 THEN 'FY_likely' WHEN n_months > 0 THEN 'partial' END AS note
    FROM a QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY n_months DESC, value DESC, label, match_field) = 1"""
)
def lookup_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the issues of 1997 to 2001 say of a metric in 1998."""
    ledger = demo_ledger(spark, sf_dir)
    found = tools.lookup(ledger, layers.facts(ledger), ["europe"], 1998, 1997, 2001)
    return found.select("table_id", "label", "match_field", F.round("value", 2).alias("value"), "n_months", "note")


@query(L + f"SELECT id, title, file_year FROM tables t WHERE id IN {_TOLD.format('segment')} AND id IN {_TOLD.format('asia')} AND EXISTS (SELECT 1 FROM cols c WHERE c.table_id = t.id AND c.year_extracted BETWEEN 1996 AND 1997)")
def search_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.search_tables(demo_ledger(spark, sf_dir), ["segment", "asia"], 1996, 1997).select("id", "title", "file_year")


@query(
    L
    + """, y AS (SELECT DISTINCT table_id FROM facts WHERE data_year IN (1996, 1997)), p1 AS (SELECT table_id FROM y WHERE table_id IN (SELECT table_id FROM rws WHERE metric_slug LIKE '%asia%' AND metric_slug LIKE '%east%')),
    p2 AS (SELECT table_id FROM y WHERE table_id IN (SELECT table_id FROM rws WHERE metric_slug LIKE '%asia%' OR metric_slug LIKE '%east%')), n AS (SELECT CASE WHEN (SELECT count(*) FROM p1) >= 4 THEN 0 WHEN (SELECT count(*) FROM p2) >= 4 THEN 1 ELSE 2 END AS channel),
    p AS (SELECT table_id, 0 AS channel FROM p1 UNION ALL SELECT table_id, 1 FROM p2 UNION ALL SELECT table_id, 2 FROM y)
    SELECT metric_slug, count(DISTINCT r.table_id) AS n_tables, n.channel FROM rws r JOIN p ON p.table_id = r.table_id JOIN n ON n.channel = p.channel GROUP BY ALL"""
)
def vocabulary_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No slug has both words, so tables with either are taken."""
    ledger = demo_ledger(spark, sf_dir)
    return tools.vocabulary(ledger, layers.facts(ledger), ["asia", "east"], [1996, 1997], few=4)


_UP = """SELECT t.id, t.title, count(*) AS n_cells, t.file_year, {no} AS request_no, t.signature FROM tables t JOIN rws r ON r.table_id = t.id AND r.metric_slug = '{slug}' JOIN cells x ON x.row_id = r.id JOIN cols c ON c.id = x.col_id
    WHERE x.numeric_value IS NOT NULL AND c.year_extracted = {year} AND t.id IN {told} GROUP BY t.id, t.title, t.signature, t.file_year QUALIFY row_number() OVER (PARTITION BY t.signature ORDER BY t.file_year DESC, t.id DESC) = 1"""


@query(
    L
    + f", u AS ({_UP.format(no=0, slug='middle east', year=1997, told=_TOLD.format('segment'))} UNION ALL {_UP.format(no=1, slug='europe', year=1996, told='(SELECT id FROM tables)')}) SELECT id, title, n_cells, 100.0::DOUBLE AS likeness, CAST(request_no AS INTEGER) AS request_no FROM u"
)
def bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests: a hint whose words stand in another order with a topic, and a keyword with a topic that no table has."""
    asked = [{"hint": "East Middle", "years": [1997], "topic": ["segment"]}, {"hint": " ", "keyword": "europe", "years": [1996], "topic": ["payroll"]}]
    return tools.bottom_up_requests(demo_ledger(spark, sf_dir), asked, 20).select("id", "title", "n_cells", "likeness", "request_no")


@query(
    L
    + """, h AS (SELECT table_id AS id, CAST(-(count(*) + 5) AS DOUBLE) AS score FROM (SELECT DISTINCT table_id, metric_slug, row_path FROM rws WHERE metric_slug = 'middle east') GROUP BY 1)
    SELECT h.id, CASE WHEN EXISTS (SELECT 1 FROM cols c WHERE c.table_id = h.id AND c.year_extracted = 1997) THEN 'primary_year' ELSE 'primary' END AS stage, score FROM h WHERE EXISTS (SELECT 1 FROM cols c WHERE c.table_id = h.id AND c.col_leaf LIKE '%12%')"""
)
def metric_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with the row and the year first, then those with the row; only such as have a column of December."""
    return channels.metric_channel(spark, demo_ledger(spark, sf_dir), "Middle East", column="12", years=[1997], enough=6)


@query(
    L
    + """SELECT table_id AS id, 'partial' AS stage, -CAST(count(*) + 5 * max(CASE WHEN metric_slug = 'asia europe' THEN 1 ELSE 0 END) AS DOUBLE) AS score
    FROM (SELECT DISTINCT table_id, metric_slug, row_path FROM rws) WHERE contains(metric_slug, 'asia') OR contains(metric_slug, 'europe') GROUP BY table_id"""
)
def metric_channel_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row has both words, so the last stage finds rows with either."""
    return channels.metric_channel(spark, demo_ledger(spark, sf_dir), "asia europe")


def _piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three parts one with two sections, one with none, and one whose lines are too few."""
    size = F.col("p_size")
    rows = lambda n, base: [F.concat(F.lit(f"| Row {i} | "), (size + base + i).cast("string"), F.lit(" | "), (size % 7 + i if base == 0 else size + base).cast("string"), F.lit(" |")) for i in range(n)]
    small = [F.concat(F.lit(f"| Row {i} | "), (size % 7).cast("string"), F.lit(" | n.a. |")) for i in range(2)]
    head = ["Orders", "| Item | Unnamed: 1_level_0 > 1940 | 1941 |", "| --- | --- | --- |"]
    lit = lambda xs: [F.lit(x) if isinstance(x, str) else x for x in xs]
    two = F.concat_ws("\n", *lit([*head, "| Warships | nan | nan |", *rows(3, 10), "| Tankers | - |  |", *small, "End"]))
    none = F.concat_ws("\n", *lit([head[1], *rows(2, 10), "", "| a | b |"]))
    few = F.concat_ws("\n", *lit(["| a | b |", "| c | d |", "|"]))
    k = F.col("p_partkey") % 3
    return read(spark, sf_dir, "part")[0].select("p_partkey", F.when(k == 0, two).when(k == 1, none).otherwise(few).alias("text"))


@query(
    """SELECT p_partkey AS id, label, n AS n_lines, start, score FROM part, (VALUES (0, 'Warships', 3, 3, 55.0::DOUBLE), (0, 'Tankers', 2, 7, -20.0::DOUBLE), (1, '', 2, 1, 0.0::DOUBLE)) v(k, label, n, start, score) WHERE p_partkey % 3 = k"""
)
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.sections(_piped(spark, sf_dir), "p_partkey", "text")
    return sections.scored(found, ["warships"], [1960]).select("id", "label", F.size("lines").alias("n_lines"), "start", "score")


@query("SELECT p_partkey AS id, p_name AS row_label, '1940 > ' || c AS \"column\", CAST(p_size * m AS VARCHAR) AS value, CAST(p_size * m AS DOUBLE) AS numeric_value FROM part, (VALUES ('Net', 1), ('Gross', 3)) v(c, m)")
def flat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>Item</th><th colspan=2>1940</th><th></th></tr><tr><th></th><th>Net</th><th>Gross</th><th></th></tr><tr><td>"), "p_name", F.lit(" . . ....</td><td>"), F.col("p_size").cast("string"), F.lit("</td><td>"), (F.col("p_size") * 3).cast("string"), F.lit("</td><td></td></tr></table>"))
    pages = spread(read(spark, sf_dir, "part")[0], "p_partkey").select("p_partkey", html.alias("html"))
    g = stored(spark, ("flat grid", sf_dir), lambda: {"grid": (grid.html_grid(spark, pages, "p_partkey", "html"), [])})["grid"]  # read three times
    return sections.flat_entries(g).select("id", "row_label", "column", "value", "numeric_value")


@query(
    """WITH p AS (SELECT p_partkey AS id, p_size, 1 + p_partkey % 2 AS blocks, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS active FROM part WHERE p_partkey % 5 > 0)
    SELECT id, CAST(b AS INTEGER) AS block, CAST(g AS INTEGER) AS part, CAST(g * 2 - 1 AS INTEGER) AS first_col, CAST(g * 2 AS INTEGER) AS last_col, CAST(1950 + p_size - ((blocks - 1) * 2 + active) + 1 + (b - 1) * 2 + g - 1 AS INTEGER) AS year FROM p, range(1, 3) b(b), range(1, 3) g(g) WHERE b <= blocks AND (b < blocks OR g <= active)"""
)
def year_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of two columns over one or two blocks of months; some last blocks hold one group, some tables don't repeat."""
    k = F.col("p_partkey")
    months = ["Jan.", "Feb.", "Mar.", "Apr.", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec."]
    rows = lambda second: F.lit("".join(f"<tr><td>{m}</td><td>1</td><td>2</td><td>{second}</td><td>-</td></tr>" for m in months))
    last = F.when(k % 3 == 0, rows("3")).otherwise(rows("nan"))
    names = F.when(k % 5 > 0, "<th>Bonds 2/</th><th>Bills</th>").otherwise("<th>Notes</th><th>Bills</th>")
    html = F.concat(F.lit("<table><tr><th>Period</th><th>Bonds 1/</th><th>Bills</th>"), names, F.lit("</tr>"), F.when(k % 2 == 1, rows("3")).otherwise(""), last, F.lit("</table>"))
    pages = spread(read(spark, sf_dir, "part")[0], "p_partkey").select("p_partkey", (F.lit(1950) + F.col("p_size")).cast("int").alias("file_year"), html.alias("html"))
    g = stored(spark, ("year group grid", sf_dir), lambda: {"grid": (grid.html_grid(spark, pages, "p_partkey", "html"), [])})["grid"]  # read five times
    return sections.year_groups(g, pages.select(F.col("p_partkey").alias("id"), "file_year"))
