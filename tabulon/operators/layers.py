"""Layers derived from the ledger: facts, vintages, metrics, families, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.sources.ledger import Ledger

MEASURED = ("ok", "missing")


def data_year(column: str = "c", row: str = "r", table: str = "t") -> Column:
    return F.coalesce(F.col(f"{column}.year_extracted"), F.col(f"{row}.year_extracted"), F.col(f"{table}.file_year"))


def facts(ledger: Ledger) -> DataFrame:
    """A row a cell with its table, row and column. Tables are few; rows and columns join on the table and an id
    that is unique in it."""
    t, r, c, x = ledger.tables.alias("t"), ledger.rows.alias("r"), ledger.columns.alias("c"), ledger.cells.alias("x")
    joined = x.join(r, (F.col("x.table_id") == F.col("r.table_id")) & (F.col("x.row_id") == F.col("r.id"))).join(c, (F.col("x.table_id") == F.col("c.table_id")) & (F.col("x.col_id") == F.col("c.id"))).join(t, F.col("x.table_id") == F.col("t.id")).where("t.parse_ok = 1")
    return joined.select(
        F.col("t.id").alias("table_id"), "t.signature", "t.title", "t.file", "t.file_year", "t.file_month", "t.table_kind", "t.unit", "t.period", "r.row_path", "r.metric_slug", "r.row_index", "r.is_section_header", "c.col_path", "c.col_index",
        data_year().alias("data_year"), F.coalesce("c.month_extracted", "r.month_extracted").alias("data_month"), "x.numeric_value", "x.is_preliminary", "x.parse_status", F.col("r.id").alias("row_id"), F.col("c.id").alias("col_id"),
    )


def ranked(f: DataFrame) -> DataFrame:
    """vintage 1 is the latest publication of a cell; later numbers are superseded."""
    same = Window.partitionBy("signature", F.lower(F.trim("row_path")), F.lower(F.trim("col_path")), "data_year")
    order = same.orderBy(F.desc("file_year"), F.desc("file_month"), F.desc("table_id"))
    return f.where((F.col("table_kind") == "data") & F.col("parse_status").isin(*MEASURED)).withColumn("vintage", F.row_number().over(order))


def canonical(f: DataFrame) -> DataFrame:
    return ranked(f).where("vintage = 1").drop("vintage")


def supersessions(f: DataFrame) -> DataFrame:
    return ranked(f).where("vintage > 1")


def metric_base(f: DataFrame) -> DataFrame:
    return f.where((F.col("table_kind") == "data") & (F.col("is_section_header") == 0) & (F.trim("row_path") != "") & F.col("parse_status").isin(*MEASURED))


def calendar_years(f: DataFrame) -> DataFrame:
    """Totals of slugs whose table has all twelve months of a year; n_cells shows where several cells make a month."""
    months = metric_base(f).where("data_month is not null").groupBy("table_id", "metric_slug", "data_year")
    total = months.agg(F.sum("numeric_value").alias("value"), F.max("is_preliminary").alias("is_preliminary"), F.count("*").alias("n_cells"), F.countDistinct("data_month").alias("n_months"))
    return total.where("n_months = 12").drop("n_months")


def time_key(year: Column, month: Column) -> Column:
    return F.when(month.isNull(), F.format_string("%04d", year)).otherwise(F.format_string("%04d-%02d", year, month))


def metrics(f: DataFrame) -> DataFrame:
    """Cells as metrics, and synthesized calendar-year totals."""
    own = metric_base(f).select("table_id", "metric_slug", "col_path", "data_year", "data_month", F.col("numeric_value").alias("value"), F.lit(0).alias("is_synthesized"))
    made = calendar_years(f).select("table_id", "metric_slug", F.lit("CY total (synthesized)").alias("col_path"), "data_year", F.lit(None).cast("int").alias("data_month"), "value", F.lit(1).alias("is_synthesized"))
    return own.unionByName(made).withColumn("time_key", time_key(F.col("data_year"), F.col("data_month")))


def families(tables: DataFrame) -> DataFrame:
    """Tables of equal title: the count, the latest issue and its table."""
    issue = F.struct("file_year", "file_month", "id")
    named = tables.where("trim(title) <> ''").withColumn("family_id", F.lower(F.trim("title")))
    return named.groupBy("family_id").agg(F.max_by("title", issue).alias("primary_title"), F.count("*").alias("member_count"), F.max(F.col("file_year") * 100 + F.col("file_month")).alias("latest_ver"), F.max_by("id", issue).alias("latest_table_id"))


def family_years(f: DataFrame) -> DataFrame:
    """The best table of each family and data year: the latest issue that has it."""
    issue = F.struct("file_year", "file_month", "table_id")
    return f.groupBy(F.lower(F.trim("title")).alias("family_id"), F.col("data_year").alias("year")).agg(F.max_by("table_id", issue).alias("best_table_id"))


def row_labels(ledger: Ledger) -> DataFrame:
    data = ledger.tables.where("parse_ok = 1 and table_kind = 'data'").select(F.col("id").alias("table_id"))
    return ledger.rows.where("is_section_header = 0 and trim(row_path) <> ''").join(data, "table_id", "left_semi").select("table_id", "metric_slug", "row_path").distinct()


def family_slugs(ledger: Ledger) -> DataFrame:
    t = ledger.tables.select(F.col("id").alias("table_id"), F.lower(F.trim("title")).alias("family_id"))
    return ledger.rows.where("is_section_header = 0").join(t, "table_id").select("family_id", "metric_slug").distinct()


def family_columns(ledger: Ledger) -> DataFrame:
    t = ledger.tables.select(F.col("id").alias("table_id"), F.lower(F.trim("title")).alias("family_id"))
    return ledger.columns.join(t, "table_id").select("family_id", F.lower("col_leaf").alias("col_leaf_lower")).distinct()


def sanity(ledger: Ledger, f: DataFrame) -> DataFrame:
    """Labelled counts (label, n): one pass over each table."""
    one = lambda df, **counts: df.agg(*(c.cast("long").alias(k) for k, c in counts.items()))
    some = lambda cond: F.count_if(cond)
    t = one(ledger.tables, tables=F.count("*"), tables_ok=some(F.col("parse_ok") == 1), tables_data=some(F.col("table_kind") == "data"), tables_titled=some(F.trim("title") != ""), files=F.countDistinct("file"), signatures=F.countDistinct("signature"), tables_with_unit=some(F.col("unit").isNotNull()), calendar_tables=some(F.col("period") == "calendar"))
    r = one(ledger.rows, table_rows=F.count("*"), section_rows=some(F.col("is_section_header") == 1), rows_with_year=some(F.col("year_extracted").isNotNull()), slugs=F.countDistinct("metric_slug"), hierarchical_rows=some(F.col("row_path").contains(" > ")))
    c = one(ledger.columns, table_columns=F.count("*"), columns_with_year=some(F.col("year_extracted").isNotNull()), columns_with_month=some(F.col("month_extracted").isNotNull()))
    x = one(ledger.cells, cells=F.count("*"), cells_ok=some(F.col("parse_status") == "ok"), cells_preliminary=some(F.col("is_preliminary") == 1), cells_null=some(F.col("numeric_value").isNull()))
    v = one(ranked(f), canonical_facts=some(F.col("vintage") == 1), supersessions=some(F.col("vintage") > 1))
    y = one(calendar_years(f), synthesized=F.count("*"))
    long = lambda df: df.unpivot([], df.columns, "label", "n")
    out = long(t)
    for df in (r, c, x, v, y):
        out = out.unionByName(long(df))
    return out


def entries_at(ledger: Ledger, gold: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Data tables that stand at given places, with their first row labels in order and the distinct years of their columns."""
    tables = ledger.tables.where("table_kind = 'data'").join(gold.select(*keys).distinct(), keys, "left_semi")
    ids = tables.select(F.col("id").alias("table_id"))
    rows = ledger.rows.where(F.col("row_index") <= most).join(ids, "table_id", "left_semi").groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "row_path"))), lambda r: r["row_path"]).alias("row_labels"))
    years = ledger.columns.join(ids, "table_id", "left_semi").groupBy("table_id").agg(F.array_sort(F.collect_set("year_extracted")).alias("years"))
    return tables.join(rows, tables["id"] == rows["table_id"], "left").drop("table_id").join(years, F.col("id") == years["table_id"], "left").drop("table_id")
