"""The cell ledger: tables, rows, columns and cells, and a demonstration ledger derived from the order tables.

The demonstration publishes, for each year with orders, two tables: orders by region and orders by segment and region. An
issue covers its own year and the one before. The current year leaves out pending orders and is marked preliminary; the
next issue publishes the year again in full, which is a revision. Columns are months, cells are sums of prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.shared import stored


@dataclass(frozen=True)
class Ledger:
    tables: DataFrame
    rows: DataFrame
    columns: DataFrame
    cells: DataFrame


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title, row_path, issue year, data year, month, value: one aggregation of orders; dimensions are small."""
    orders, customer, nation, region = read(spark, sf_dir, "orders", "customer", "nation", "region")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    who = customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    facts = orders.join(who, F.col("o_custkey") == F.col("c_custkey")).select("r_name", "c_mktsegment", "o_orderstatus", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    small = facts.groupBy("r_name", "c_mktsegment", "y", "m", (F.col("o_orderstatus") == "P").alias("pending")).agg(F.sum("price").alias("price"))
    years = small.select(F.col("y").alias("issue")).distinct()
    issued = small.join(F.broadcast(years), (F.col("issue") == F.col("y")) | (F.col("issue") == F.col("y") + 1)).where((F.col("issue") != F.col("y")) | ~F.col("pending"))
    titles = F.array(
        F.struct(F.lit("Orders by region").alias("title"), F.lit(1).alias("seq"), F.col("r_name").alias("row_path"), F.col("r_name").alias("leaf")),
        F.struct(F.lit("Orders by segment").alias("title"), F.lit(2).alias("seq"), F.concat_ws(" > ", "c_mktsegment", "r_name").alias("row_path"), F.col("r_name").alias("leaf")),
    )
    return issued.select("issue", "y", "m", "price", F.explode(titles).alias("t")).groupBy("issue", "t.title", "t.seq", "t.row_path", "t.leaf", "y", "m").agg(F.sum("price").cast("double").alias("value"))


def demo_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """The demonstration from files, partitioned by the year of issue; written once an application."""
    by_issue = lambda df, table_id: (df.withColumn("issue", F.floor(F.col(table_id) / 10).cast("int")), ["issue"])

    def make() -> dict:
        d = derived_ledger(spark, sf_dir)
        return {"tables": by_issue(d.tables, "id"), "rows": by_issue(d.rows, "table_id"), "columns": by_issue(d.columns, "table_id"), "cells": by_issue(d.cells, "table_id")}

    t = stored(spark, ("demo ledger", sf_dir), make)
    return Ledger(*(t[n].drop("issue") for n in ("tables", "rows", "columns", "cells")))


def derived_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    s = _sums(spark, sf_dir).withColumn("table_id", (F.col("issue") * 10 + F.col("seq")).cast("long"))
    title = F.concat(F.lower("title"), F.lit("||"))
    tables = s.select("table_id", "issue", "title", "seq").distinct().select(
        F.col("table_id").alias("id"), F.format_string("issue_%04d_12.json", "issue").alias("file"), F.col("seq").alias("element_seq"), F.col("issue").alias("file_year"), F.lit(12).alias("file_month"), "title",
        F.lit("dollars").alias("unit"), F.lit("calendar").alias("period"), F.lit("data").alias("table_kind"), F.substring(F.sha1(title), 1, 16).alias("signature"), F.lit(1).alias("parse_ok"),
    )
    from pyspark.sql import Window

    labels = s.select("table_id", "row_path", "leaf").distinct()
    row_index = F.row_number().over(Window.partitionBy("table_id").orderBy("row_path"))
    rows = labels.select(
        (F.col("table_id") * 1000 + row_index).alias("id"), "table_id", row_index.alias("row_index"), "row_path", F.col("leaf").alias("row_leaf"), F.lit(None).cast("int").alias("year_extracted"), F.lit(None).cast("int").alias("month_extracted"),
        F.lit(0).alias("is_section_header"), F.lower("leaf").alias("metric_slug"),
    )
    months = s.select("table_id", "y", "m").distinct()
    col_index = F.row_number().over(Window.partitionBy("table_id").orderBy("y", "m"))
    columns = months.select((F.col("table_id") * 1000 + col_index).alias("id"), "table_id", col_index.alias("col_index"), F.concat_ws(" > ", F.col("y").cast("string"), F.col("m").cast("string")).alias("col_path"), F.col("m").cast("string").alias("col_leaf"), F.col("y").alias("year_extracted"), F.col("m").alias("month_extracted"))
    c = s.alias("s").join(rows.alias("r"), ["table_id", "row_path"]).join(columns.alias("c"), (F.col("s.table_id") == F.col("c.table_id")) & (F.col("y") == F.col("c.year_extracted")) & (F.col("m") == F.col("c.month_extracted")))
    cells = c.select(F.col("s.table_id").alias("table_id"), F.col("r.id").alias("row_id"), F.col("c.id").alias("col_id"), F.col("value").alias("numeric_value"), (F.col("y") == F.col("issue")).cast("int").alias("is_preliminary"), F.lit("ok").alias("parse_status"))
    return Ledger(tables, rows, columns, cells)


#: The same ledger as common table expressions for another SQL engine.
LEDGER_SQL = """
WITH base AS (
  SELECT r_name, c_mktsegment, o_orderstatus = 'P' AS pending, CAST(year(o_orderdate) AS INTEGER) AS y,
         CAST(month(o_orderdate) AS INTEGER) AS m, CAST(o_totalprice AS DECIMAL(18,2)) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
issued AS (SELECT b.*, i.issue FROM base b JOIN (SELECT DISTINCT y AS issue FROM base) i
  ON (i.issue = b.y AND NOT b.pending) OR i.issue = b.y + 1),
sums AS (
  SELECT issue, 'Orders by region' AS title, 1 AS seq, r_name AS row_path, r_name AS leaf, y, m, CAST(sum(price) AS DOUBLE) AS value
  FROM issued GROUP BY ALL
  UNION ALL
  SELECT issue, 'Orders by segment', 2, c_mktsegment || ' > ' || r_name, r_name, y, m, CAST(sum(price) AS DOUBLE)
  FROM issued GROUP BY issue, c_mktsegment, r_name, y, m),
keyed AS (SELECT *, CAST(issue * 10 + seq AS BIGINT) AS table_id FROM sums),
tables AS (SELECT DISTINCT table_id AS id, printf('issue_%04d_12.json', issue) AS file, seq AS element_seq, issue AS file_year,
  12 AS file_month, title, 'dollars' AS unit, 'calendar' AS period, 'data' AS table_kind,
  substr(sha1(lower(title) || '||'), 1, 16) AS signature, 1 AS parse_ok FROM keyed),
rws AS (SELECT table_id * 1000 + row_number() OVER (PARTITION BY table_id ORDER BY row_path) AS id, table_id,
  row_number() OVER (PARTITION BY table_id ORDER BY row_path) AS row_index, row_path, leaf AS row_leaf,
  CAST(NULL AS INTEGER) AS year_extracted, CAST(NULL AS INTEGER) AS month_extracted, 0 AS is_section_header, lower(leaf) AS metric_slug
  FROM (SELECT DISTINCT table_id, row_path, leaf FROM keyed)),
cols AS (SELECT table_id * 1000 + row_number() OVER (PARTITION BY table_id ORDER BY y, m) AS id, table_id,
  row_number() OVER (PARTITION BY table_id ORDER BY y, m) AS col_index, y || ' > ' || m AS col_path, CAST(m AS VARCHAR) AS col_leaf,
  y AS year_extracted, m AS month_extracted FROM (SELECT DISTINCT table_id, y, m FROM keyed)),
cells AS (SELECT k.table_id, r.id AS row_id, c.id AS col_id, k.value AS numeric_value, CAST(k.y = k.issue AS INTEGER) AS is_preliminary,
  'ok' AS parse_status FROM keyed k JOIN rws r ON k.table_id = r.table_id AND k.row_path = r.row_path
  JOIN cols c ON k.table_id = c.table_id AND k.y = c.year_extracted AND k.m = c.month_extracted),
facts AS (SELECT t.id AS table_id, t.signature, t.title, t.file, t.file_year, t.file_month, t.table_kind, t.unit, t.period, r.row_path,
  r.metric_slug, r.row_index, r.is_section_header, c.col_path, c.col_index,
  coalesce(c.year_extracted, r.year_extracted, t.file_year) AS data_year, coalesce(c.month_extracted, r.month_extracted) AS data_month,
  x.numeric_value, x.is_preliminary, x.parse_status, r.id AS row_id, c.id AS col_id
  FROM cells x JOIN tables t ON x.table_id = t.id JOIN rws r ON x.row_id = r.id JOIN cols c ON x.col_id = c.id WHERE t.parse_ok = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY signature, lower(trim(row_path)), lower(trim(col_path)), data_year
  ORDER BY file_year DESC, file_month DESC, table_id DESC) AS vintage FROM facts WHERE table_kind = 'data' AND parse_status IN ('ok', 'missing')),
metrics_base AS (SELECT * FROM facts WHERE table_kind = 'data' AND is_section_header = 0 AND trim(row_path) <> '' AND parse_status IN ('ok', 'missing')),
cy AS (SELECT table_id, metric_slug, data_year, sum(numeric_value) AS value, CAST(max(is_preliminary) AS INTEGER) AS is_preliminary, count(*) AS n_cells
  FROM metrics_base WHERE data_month IS NOT NULL GROUP BY ALL HAVING count(DISTINCT data_month) = 12)
"""
