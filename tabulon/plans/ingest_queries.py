"""Queries over a ledger that is parsed from HTML: a yearly issue with the orders of each nation by quarter, on two pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import channels, grid, layers, render
from tabulon.plans.registry import query
from tabulon.sources import corpus, incremental
from tabulon.sources.ledger import read
from tabulon.sources.shared import folder, spread, stored, written

_QUARTERS = ("Mar.", "June", "Sept.", "Dec.")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = read(spark, sf_dir, "orders", "customer", "nation", "region")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.year("o_orderdate").alias("y"), "r_regionkey", "r_name", "n_name").agg(*(F.count_if(F.quarter("o_orderdate") == q).alias(f"q{q}") for q in range(1, 5)))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, a title, prose, a table of two regions, a footnote, a table of the other regions, prose and a footer."""

    def cell(n: str):
        text = F.concat(F.format_number(n, 0), F.when(F.col(n) % 3 == 0, " r").otherwise(""), F.when(F.col(n) % 5 == 0, " 1/").otherwise(""))
        return F.concat(F.lit("<td>"), F.when(F.col(n) == 0, "-").otherwise(text), F.lit("</td>"))

    nation = F.concat(F.lit('<tr><td style="padding-left:10px">'), "n_name", F.lit("</td>"), *(cell(f"q{q}") for q in range(1, 5)), F.lit("</tr>"))
    sorted_text = lambda by, col: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, col))), lambda x: x[col]), "")
    regions = _counts(spark, sf_dir).withColumn("html", nation).groupBy("y", "r_regionkey", "r_name").agg(sorted_text("n_name", "html").alias("html"))
    regions = regions.withColumn("html", F.concat(F.lit("<tr><td>"), "r_name", F.lit("</td>" + "<td></td>" * 4 + "</tr>"), "html"))
    head = F.concat(F.lit('<table><tr><th rowspan="2">Nation</th><th colspan="4">'), F.col("y").cast("string"), F.lit("</th></tr><tr>" + "".join(f"<th>{q}</th>" for q in _QUARTERS) + "</tr>"))
    tables = regions.groupBy("y", (F.col("r_regionkey") >= 2).alias("second")).agg(sorted_text("r_regionkey", "html").alias("html"))
    tables = tables.select("y", F.when(F.col("second"), 5).otherwise(3).alias("element_seq"), F.lit("table").alias("kind"), F.concat(head, "html", F.lit("</table>")).alias("content"), F.when(F.col("second"), 2).otherwise(1).alias("page_id"))
    other = [(0, "page_header", "Bulletin", 1), (1, "title", "Orders of nations (In thousands)", 1), (2, "text", "Orders by quarter.", 1), (4, "footnote", "1/ Pending ones counted.", 1), (6, "text", "More follows.", 2), (7, "page_footer", "Page 2", 2)]
    rest = spark.createDataFrame(other, "element_seq int, kind string, content string, page_id int").crossJoin(regions.select("y").distinct()).select("y", "element_seq", "kind", "content", "page_id")
    return tables.unionByName(rest).select(F.format_string("issue_%04d_12.json", "y").alias("file"), "element_seq", F.col("element_seq").cast("string").alias("element_id"), "kind", "content", "page_id", F.col("y").alias("file_year"), F.lit(12).alias("file_month"))


def _ingested(spark: SparkSession, sf_dir: str) -> corpus.Ingested:
    keep = lambda name, df: stored(spark, ("ingested", name, sf_dir), lambda: {name: (df, [])})[name]
    return corpus.ingest(spark, keep("elements", _elements(spark, sf_dir)), None, keep)


_Q = """WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, quarter(o_orderdate) AS q, r_regionkey AS rk, r_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    x AS (SELECT y, rk, rk >= 2 AS second, r_name, n_name, CAST(q.q AS INTEGER) AS q, count(*) FILTER (o.q = q.q) AS n FROM o, range(1, 5) q(q) GROUP BY y, rk, r_name, n_name, q.q),
    t AS (SELECT y, second, count(DISTINCT n_name) AS nations, count(DISTINCT r_name) AS regions FROM x GROUP BY 1, 2)"""
_C = """SELECT * FROM (SELECT *, ['Mar.', 'June', 'Sept.', 'Dec.'][q] AS label, r_name || ' > ' || n_name AS row_path FROM x)"""


@query(_Q + f", c AS ({_C}) SELECT printf('issue_%04d_12.json', y) AS file, row_path, y || ' > ' || label AS col_path, y AS data_year, q * 3 AS data_month, CASE WHEN n > 0 THEN CAST(n AS DOUBLE) END AS numeric_value, CASE WHEN n > 0 THEN 'ok' ELSE 'missing' END AS parse_status, 'thousands_usd' AS unit FROM c")
def ingest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From elements over grids, paths and cells to facts."""
    return layers.facts(_ingested(spark, sf_dir)).where("is_section_header = 0").select("file", "row_path", "col_path", "data_year", "data_month", "numeric_value", "parse_status", "unit")


@query(_Q + f", c AS ({_C}) SELECT printf('issue_%04d_12.json', y) AS file, row_path, y || ' > ' || label AS col_path, CASE WHEN n > 0 THEN CAST(n AS DOUBLE) END AS numeric_value, CASE WHEN y BETWEEN 1993 AND 1994 THEN 1 ELSE 2 END AS run FROM c")
def ingest_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over the issues up to 1995, some of them in a version of their own; a second one over all from 1995 on and a new version
    of 1992: facts are those of one run over all, and run tells which files were read again."""
    at = f"{folder(spark)}/ledger-{uuid.uuid4().hex}"
    e = written(_elements(spark, sf_dir))
    y = F.col("file_year")
    early = e.where(y <= 1995).withColumn("content", F.when((y.isin(1992, 1995)) & (F.col("kind") == "table"), F.regexp_replace("content", "<td>[^<]*</td>", "<td>7</td>")).otherwise(F.col("content")))
    incremental.update(spark, early, at)
    ledger = incremental.update(spark, e.where((y >= 1995) | (y == 1992)), at)
    runs = incremental.manifest(spark, at).select("file", "run")
    return layers.facts(ledger).where("is_section_header = 0").join(runs, "file").select("file", "row_path", "col_path", "numeric_value", "run")


_N = "(SELECT count(*) FROM t)"
_DATA = "(SELECT sum(nations + regions) * 4 FROM t)"
_PAIRS = "(SELECT count(*) FROM t a JOIN t b ON a.y = b.y AND a.second AND NOT b.second)"
_YEARS = "(SELECT count(DISTINCT y) FROM t)"
_SANITY = {
    "tables": _N, "tables_ok": _N, "tables_failed": "0", "signatures": "1", "continued": _PAIRS, "with_unit": _N, "with_period": "0", "tables_data": _N, "tables_toc": "0", "dual_agree": _N, "dual_disagree": "0", "first_only": "0", "second_only": "0",
    "columns": f"{_N} * 5", "columns_with_year": f"{_N} * 4", "rows": "(SELECT sum(nations + regions) FROM t)", "rows_with_path": "(SELECT sum(nations) FROM t)", "rows_with_year": "0", "cells": _DATA, "zero": "0", "percent": "0",
    "revised": "(SELECT count(*) FROM x WHERE n > 0 AND n % 3 = 0)", "with_footnote": "(SELECT count(*) FROM x WHERE n > 0 AND n % 5 = 0)", "estimated": "0", "preliminary": "0", "zero_and_missing": "0", "ok": "(SELECT count(*) FROM x WHERE n > 0)",
    "missing": f"{_DATA} - (SELECT count(*) FROM x WHERE n > 0)", "text": "0", "unparseable": "0", "prose": f"{_YEARS} * 2", "prose_near_table": _N, "footnotes": _YEARS, "footnotes_attached": "(SELECT count(*) FROM t WHERE NOT second)", "pages": f"{_YEARS} * 2",
    "invariants_ok": _N, "invariants_off": "0", "sum_of_deltas": "0", "raw_cells": f"(SELECT sum(6 + (nations + regions) * 5) FROM t)", "accounted_cells": "(SELECT sum(5 + nations + regions + regions + (nations + regions) * 4) FROM t)", "facts": _DATA, "metric_rows": "(SELECT count(*) FROM x)",
    "canonical_facts": _DATA, "supersessions": "0", "synthesized": "0", "label_slugs": "(SELECT count(DISTINCT n_name) FROM x)",
}


@query(_Q + " UNION ALL ".join(f" SELECT '{k}' AS label, CAST({v} AS BIGINT) AS n" for k, v in _SANITY.items()))
def ingest_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sanity(_ingested(spark, sf_dir))


@query(_Q + ", y AS (SELECT DISTINCT y FROM t) SELECT y AS file_year, 2 AS element_seq, 'Orders by quarter.' AS content, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.y = y.y AND NOT second) THEN 3 END AS near FROM y UNION ALL SELECT y, 6, 'More follows.', CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.y = y.y AND second) THEN 5 END FROM y")
def ingest_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose with the place of the table it stands next to."""
    i = _ingested(spark, sf_dir)
    at = i.tables.select(F.col("id").alias("near_table_id"), F.col("element_seq").alias("near"))
    return i.prose.join(at, "near_table_id", "left").select("file_year", "element_seq", "content", "near")


@query(_Q + f", c AS ({_C}), r AS (SELECT y, second, rk, n_name, row_path, string_agg(y || ' > ' || label || ' = ' || CASE WHEN n > 0 THEN format('{{:,}}', n) || CASE WHEN n % 3 = 0 THEN ' r' ELSE '' END || CASE WHEN n % 5 = 0 THEN ' 1/' ELSE '' END ELSE '-' END, chr(10) ORDER BY q) AS v FROM c GROUP BY ALL) SELECT y AS file_year, second, string_agg('ROW: ' || row_path || chr(10) || v, chr(10) ORDER BY rk, n_name) AS text FROM r GROUP BY 1, 2")
def row_major_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as a line for each row's path and a line for each of its cells."""
    i = _ingested(spark, sf_dir)
    at = i.tables.select(F.col("id").alias("table_id"), "file_year", (F.col("page_id") == 2).alias("second"))
    return render.row_major(i).join(at, "table_id").select("file_year", "second", "text")


@query(
    """WITH p AS (SELECT p_partkey, p_size, p_name, 6 + p_partkey % 4 AS w FROM part)
    SELECT p_partkey, w >= 8 AS vertical, CASE WHEN w >= 8 THEN p_name || chr(10) || (SELECT string_agg('  ' || m || ' (month ' || i || '): ' || (p_size + i), chr(10) ORDER BY i) FROM (SELECT i, ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September'][i] AS m FROM range(1, w) r(i)))
      ELSE 'Item | ' || (SELECT string_agg(m, ' | ' ORDER BY i) FROM (SELECT i, ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September'][i] AS m FROM range(1, w) r(i))) || chr(10) || p_name || ' | ' || (SELECT string_agg(CAST(p_size + i AS VARCHAR), ' | ' ORDER BY i) FROM range(1, w) r(i)) END AS text FROM p"""
)
def wide_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of six to nine columns; from eight on a line for each column."""
    p = spread(read(spark, sf_dir, "part")[0], "p_partkey")
    w = F.col("p_partkey") % 4 + 5
    months = F.slice(F.lit(["January", "February", "March", "April", "May", "June", "July", "August", "September"]), F.lit(1), w.cast("int"))
    values = F.transform(F.sequence(F.lit(1), w.cast("int")), lambda i: (F.col("p_size") + i).cast("string"))
    row = lambda tag, first, rest: F.concat(F.lit(f"<tr><{tag}>"), first, F.lit(f"</{tag}><{tag}>"), F.array_join(rest, f"</{tag}><{tag}>"), F.lit(f"</{tag}></tr>"))
    pages = p.select("p_partkey", F.concat(F.lit("<table>"), row("th", F.lit("Item"), months), row("td", F.col("p_name"), values), F.lit("</table>")).alias("html"))
    g = stored(spark, ("wide grid", sf_dir), lambda: {"grid": (grid.html_grid(spark, pages, "p_partkey", "html"), [])})["grid"]  # read five times
    return render.readable(g).select(F.col("id").alias("p_partkey"), "vertical", "text")


_PROSE = """, y AS (SELECT DISTINCT y FROM t), p AS (SELECT y AS file_year, 2 AS element_seq, 'prose' AS source, -(1e-6 * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 8 / 7.5))) * 1e6 AS score, 'Orders by quarter.' AS content FROM y
    UNION ALL SELECT y, 4, 'footnote', -(1e-6 * 2 * 2.2 / (2 + 1.2)) * 1e6, '1/ Pending ones counted.' FROM y)"""


@query(_Q + _PROSE + " SELECT file_year, element_seq, source, round(score, 4) AS score FROM p WHERE file_year BETWEEN 1996 AND 2000")
def prose_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose for one word, footnotes for another, of the issues of 1996 to 2000."""
    i = _ingested(spark, sf_dir)
    find = lambda word: channels.prose_channel(spark, i, ("ingested", sf_dir), [word], [1996])
    return find("quarter").unionByName(find("pending")).select("file_year", "element_seq", "source", F.round(F.col("score") * 1e6, 4).alias("score"))


@query(_Q + _PROSE + """, e AS (SELECT y AS file_year, CASE WHEN second THEN 5 ELSE 3 END AS element_seq, 'fts' AS strategy FROM t WHERE y = 1997 UNION ALL SELECT 1997, 2, 'fts' FROM y WHERE y = 1997)
    SELECT * FROM e UNION ALL SELECT * FROM (SELECT file_year, element_seq, 'prose_footnote:prose' FROM p WHERE source = 'prose' AND file_year BETWEEN 1997 AND 2001 AND NOT EXISTS (SELECT 1 FROM e WHERE e.file_year = p.file_year AND e.element_seq = p.element_seq) ORDER BY file_year LIMIT 3)""")
def appended_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables and the prose of 1997, and the three best pieces of prose besides."""
    i = _ingested(spark, sf_dir)
    own = lambda df: df.where("file_year = 1997").select("file", "element_seq", "file_year", F.lit("fts").alias("strategy"))
    entries = own(i.tables).unionByName(own(i.prose.where("element_seq = 2")))
    found = channels.prose_channel(spark, i, ("ingested", sf_dir), ["quarter"], [1997])
    return channels.appended(entries, found, [1997], "calendar").select("file_year", "element_seq", "strategy")
