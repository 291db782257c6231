"""Queries over the demonstration ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.operators import layers, search
from tabulon.plans.registry import query
from tabulon.sources.ledger import LEDGER_SQL, demo_ledger

L = LEDGER_SQL


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.facts(demo_ledger(spark, sf_dir))


@query(L + "SELECT row_path, data_year, round(sum(numeric_value), 2) AS total, CAST(count(*) AS BIGINT) AS n_months FROM ranked WHERE vintage = 1 AND title = 'Orders by region' GROUP BY ALL")
def canonical_value_by_region_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layers.canonical(_facts(spark, sf_dir)).where("title = 'Orders by region'")
    return f.groupBy("row_path", "data_year").agg(F.sum("numeric_value").alias("total"), F.count("*").alias("n_months")).withColumn("total", F.round("total", 2))


@query(L + "SELECT table_id, row_path, col_path, data_year, data_month, numeric_value, is_preliminary FROM facts")
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("table_id", "row_path", "col_path", "data_year", "data_month", "numeric_value", "is_preliminary")


@query(L + "SELECT table_id, row_path, col_path, data_year, numeric_value FROM ranked WHERE vintage = 1")
def canonical_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.canonical(_facts(spark, sf_dir)).select("table_id", "row_path", "col_path", "data_year", "numeric_value")


@query(L + "SELECT table_id, row_path, col_path, data_year, numeric_value, CAST(vintage AS INTEGER) AS vintage FROM ranked WHERE vintage > 1")
def supersessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.supersessions(_facts(spark, sf_dir)).select("table_id", "row_path", "col_path", "data_year", "numeric_value", "vintage")


@query(L + "SELECT table_id, metric_slug, data_year, round(value, 2) AS value, is_preliminary, n_cells FROM cy")
def calendar_year_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.calendar_years(_facts(spark, sf_dir)).select("table_id", "metric_slug", "data_year", F.round("value", 2).alias("value"), "is_preliminary", "n_cells")


@query(
    L
    + """SELECT table_id, metric_slug, col_path, data_year, data_month, round(value, 2) AS value, is_synthesized,
    CASE WHEN data_month IS NULL THEN printf('%04d', data_year) ELSE printf('%04d-%02d', data_year, data_month) END AS time_key
    FROM (SELECT table_id, metric_slug, col_path, data_year, data_month, numeric_value AS value, 0 AS is_synthesized FROM metrics_base
    UNION ALL SELECT table_id, metric_slug, 'CY total (synthesized)', data_year, NULL, value, 1 FROM cy)"""
)
def metrics_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.metrics(_facts(spark, sf_dir)).withColumn("value", F.round("value", 2))


@query(L + "SELECT lower(trim(title)) AS family_id, arg_max(title, file_year * 100 + file_month) AS primary_title, count(*) AS member_count, max(file_year * 100 + file_month) AS latest_ver, arg_max(id, file_year * 100 + file_month) AS latest_table_id FROM tables GROUP BY 1")
def table_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.families(demo_ledger(spark, sf_dir).tables)


@query(L + "SELECT lower(trim(title)) AS family_id, data_year AS year, arg_max(table_id, file_year * 100 + file_month) AS best_table_id FROM facts GROUP BY 1, 2")
def table_family_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.family_years(_facts(spark, sf_dir))


@query(L + "SELECT DISTINCT table_id, metric_slug, row_path FROM rws")
def row_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.row_labels(demo_ledger(spark, sf_dir))


@query(L + "SELECT DISTINCT lower(trim(title)) AS family_id, metric_slug FROM rws JOIN tables ON table_id = tables.id")
def table_family_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.family_slugs(demo_ledger(spark, sf_dir))


@query(L + "SELECT DISTINCT lower(trim(title)) AS family_id, lower(col_leaf) AS col_leaf_lower FROM cols JOIN tables ON table_id = tables.id")
def table_family_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.family_columns(demo_ledger(spark, sf_dir))


@query(L + "SELECT table_id, CAST(count(DISTINCT data_month) AS BIGINT) AS n_months, count(DISTINCT row_id) AS n_rows FROM facts WHERE data_year = 1998 GROUP BY 1")
def year_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where("data_year = 1998").groupBy("table_id").agg(F.countDistinct("data_month").alias("n_months"), F.countDistinct("row_id").alias("n_rows"))


@query(L + "SELECT id, title, file_year FROM tables t WHERE EXISTS (SELECT 1 FROM cols c WHERE c.table_id = t.id AND c.year_extracted = 1997 AND c.month_extracted = 6) AND period IN ('calendar', 'unknown')")
def tables_with_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join on the years that rows or columns have; an unknown period passes."""
    ledger = demo_ledger(spark, sf_dir)
    at = lambda df: df.where("year_extracted = 1997 and month_extracted = 6").select(F.col("table_id").alias("id"))
    return ledger.tables.where(F.col("period").isin("calendar", "unknown")).join(at(ledger.columns).union(at(ledger.rows)).distinct(), "id", "left_semi").select("id", "title", "file_year")


@query(L + "SELECT row_leaf, count(*) AS n FROM rws WHERE year_extracted IS NULL AND month_extracted IS NULL AND length(row_leaf) > 2 AND NOT regexp_matches(row_leaf, '^\\d{4}$') GROUP BY 1")
def label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo_ledger(spark, sf_dir).rows
    plain = F.col("year_extracted").isNull() & F.col("month_extracted").isNull() & (F.length("row_leaf") > 2) & ~F.col("row_leaf").rlike(r"^\d{4}$")
    return rows.where(plain).groupBy("row_leaf").agg(F.count("*").alias("n"))


@query(L + "SELECT table_id, count(*) AS n_rows, max(n) AS best_cells FROM (SELECT r.table_id, r.id, count(x.numeric_value) AS n FROM rws r LEFT JOIN cells x ON x.row_id = r.id WHERE r.metric_slug ILIKE '%asia%' GROUP BY 1, 2) GROUP BY 1")
def cell_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose slug matches, left-joined to their cells; then the rows and the best row's cells of each table."""
    ledger = demo_ledger(spark, sf_dir)
    rows = ledger.rows.where(F.col("metric_slug").ilike("%asia%")).select("table_id", "id")
    each = rows.join(ledger.cells.select("row_id", "numeric_value"), F.col("id") == F.col("row_id"), "left").groupBy("table_id", "id").agg(F.count("numeric_value").alias("n"))
    return each.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.max("n").alias("best_cells"))


@query(L + "SELECT table_id, CAST(-(count(*) + 5 * max(CAST(metric_slug = 'middle east' AS INTEGER))) AS DOUBLE) AS score FROM rws WHERE metric_slug LIKE '%middle%' AND metric_slug LIKE '%east%' GROUP BY 1")
def slug_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.slug_hits(demo_ledger(spark, sf_dir).rows, ["middle", "east"], True)


@query(L + "SELECT lower(title) AS family_id, metric_slug, CAST(min(data_year) AS INTEGER) AS first_year, CAST(max(data_year) AS INTEGER) AS last_year, CAST(min(file_year) AS INTEGER) AS first_issue FROM facts WHERE metric_slug LIKE '%africa%' GROUP BY 1, 2")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where(search.contains_all(F.col("metric_slug"), ["africa"])).groupBy(F.lower("title").alias("family_id"), "metric_slug").agg(F.min("data_year").alias("first_year"), F.max("data_year").alias("last_year"), F.min("file_year").alias("first_issue"))


@query(L + "SELECT lower(title) AS family_id, count(DISTINCT table_id) AS member_count, CAST(min(data_year) AS INTEGER) AS first_year, CAST(max(data_year) AS INTEGER) AS last_year FROM facts WHERE lower(title) LIKE '%segment%' GROUP BY 1")
def search_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).where(search.contains_all(F.col("title"), ["segment"]))
    return f.groupBy(F.lower("title").alias("family_id")).agg(F.countDistinct("table_id").alias("member_count"), F.min("data_year").alias("first_year"), F.max("data_year").alias("last_year"))


@query(L + "SELECT table_id, file_year, CAST(min(data_year) AS INTEGER) AS first_year, CAST(max(data_year) AS INTEGER) AS last_year, file_year - min(data_year) > 3 AS retrospective FROM facts WHERE lower(title) = 'orders by region' GROUP BY table_id, file_year")
def describe_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).where("lower(title) = 'orders by region'").groupBy("table_id", "file_year").agg(F.min("data_year").alias("first_year"), F.max("data_year").alias("last_year"))
    return f.withColumn("retrospective", F.col("file_year") - F.col("first_year") > 3)


@query(L + "SELECT t.id, string_agg(r.row_path, ' | ' ORDER BY r.row_index) AS rows_text, count(*) AS n_rows FROM tables t JOIN rws r ON r.table_id = t.id GROUP BY 1")
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = demo_ledger(spark, sf_dir)
    paths = ledger.rows.groupBy(F.col("table_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "row_path"))), lambda x: x["row_path"]), " | ").alias("rows_text"), F.count("*").alias("n_rows"))
    return ledger.tables.select("id").join(paths, "id")


@query(L + "SELECT table_id, list_sort(list(DISTINCT year_extracted))::VARCHAR AS years, CAST(count(DISTINCT month_extracted) AS BIGINT) AS n_months FROM cols GROUP BY 1")
def distinct_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = demo_ledger(spark, sf_dir).columns
    years = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("year_extracted")), ", "), F.lit("]"))
    return c.groupBy("table_id").agg(years.alias("years"), F.countDistinct("month_extracted").alias("n_months"))


_SANITY = {
    "tables": "count(*) FROM tables", "tables_ok": "count(*) FILTER (parse_ok = 1) FROM tables", "tables_data": "count(*) FILTER (table_kind = 'data') FROM tables", "tables_titled": "count(*) FILTER (trim(title) <> '') FROM tables", "files": "count(DISTINCT file) FROM tables", "signatures": "count(DISTINCT signature) FROM tables",
    "tables_with_unit": "count(unit) FROM tables", "calendar_tables": "count(*) FILTER (period = 'calendar') FROM tables", "table_rows": "count(*) FROM rws", "section_rows": "count(*) FILTER (is_section_header = 1) FROM rws", "rows_with_year": "count(year_extracted) FROM rws", "slugs": "count(DISTINCT metric_slug) FROM rws",
    "hierarchical_rows": "count(*) FILTER (contains(row_path, ' > ')) FROM rws", "table_columns": "count(*) FROM cols", "columns_with_year": "count(year_extracted) FROM cols", "columns_with_month": "count(month_extracted) FROM cols", "cells": "count(*) FROM cells", "cells_ok": "count(*) FILTER (parse_status = 'ok') FROM cells",
    "cells_preliminary": "count(*) FILTER (is_preliminary = 1) FROM cells", "cells_null": "count(*) FILTER (numeric_value IS NULL) FROM cells", "canonical_facts": "count(*) FILTER (vintage = 1) FROM ranked", "supersessions": "count(*) FILTER (vintage > 1) FROM ranked", "synthesized": "count(*) FROM cy",
}


@query(L + " UNION ALL ".join(f"SELECT '{k}' AS label, {v.replace(' FROM', ' AS n FROM', 1)}" for k, v in _SANITY.items()))
def sanity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = demo_ledger(spark, sf_dir)
    return layers.sanity(ledger, layers.facts(ledger))


@query(
    L
    + """SELECT family_id, table_id, CAST(nth AS INTEGER) AS nth FROM (SELECT lower(title) AS family_id, id AS table_id,
    row_number() OVER (PARTITION BY lower(title) ORDER BY abs(file_year - 1998), file_month DESC, id) AS nth FROM tables) WHERE nth <= 3"""
)
def family_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of each family nearest to a year."""
    t = demo_ledger(spark, sf_dir).tables.withColumn("family_id", F.lower("title"))
    w = Window.partitionBy("family_id").orderBy(F.abs(F.col("file_year") - 1998), F.desc("file_month"), "id")
    return t.withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("family_id", F.col("id").alias("table_id"), "nth")


@query(
    L
    + """SELECT q.row_label, q.year, q.month, f.numeric_value AS value, CASE WHEN f.row_id IS NULL THEN 'label_miss' WHEN f.numeric_value IS NULL THEN 'null_numeric' ELSE 'ok' END AS status
    FROM (VALUES ('ASIA', 1997, 3), ('EUROPE', 1999, 12), ('ATLANTIS', 1997, 3), ('AFRICA', 1950, 1)) q(row_label, year, month)
    LEFT JOIN (SELECT * FROM ranked WHERE vintage = 1 AND title = 'Orders by region') f ON lower(f.row_path) = lower(q.row_label) AND f.data_year = q.year AND f.data_month = q.month"""
)
def resolve_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by label, year and month; the latest publication wins; what can't be found has a status."""
    asked = spark.createDataFrame([("ASIA", 1997, 3), ("EUROPE", 1999, 12), ("ATLANTIS", 1997, 3), ("AFRICA", 1950, 1)], "row_label string, year int, month int")
    f = layers.canonical(_facts(spark, sf_dir)).where("title = 'Orders by region'").select(F.lower("row_path").alias("k"), "data_year", "data_month", "numeric_value", "row_id")
    joined = f.join(F.broadcast(asked), (F.lower("row_label") == F.col("k")) & (F.col("year") == F.col("data_year")) & (F.col("month") == F.col("data_month")), "right")
    status = F.when(F.col("row_id").isNull(), "label_miss").when(F.col("numeric_value").isNull(), "null_numeric").otherwise("ok")
    return joined.select("row_label", "year", "month", F.col("numeric_value").alias("value"), status.alias("status"))


@query(L + "SELECT row_path, CAST(data_year AS INTEGER) AS data_year, string_agg(CAST(CAST(round(numeric_value) AS BIGINT) AS VARCHAR), ',' ORDER BY data_month) AS series FROM ranked WHERE vintage = 1 AND title = 'Orders by region' GROUP BY 1, 2 HAVING count(*) = 12")
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered twelve-month series, whole years only."""
    f = layers.canonical(_facts(spark, sf_dir)).where("title = 'Orders by region'")
    g = f.groupBy("row_path", "data_year").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("data_month", F.round("numeric_value").cast("long").cast("string").alias("v")))).alias("s"))
    return g.where("n = 12").select("row_path", "data_year", F.array_join(F.transform("s", lambda x: x["v"]), ",").alias("series"))


@query(L + "SELECT f.row_path, f.data_year, f.file_year, f.numeric_value, first_value(f.numeric_value) OVER w AS first_value, abs(f.numeric_value - first_value(f.numeric_value) OVER w) > 0.02 * abs(first_value(f.numeric_value) OVER w) AS conflict FROM facts f WHERE title = 'Orders by region' AND data_month = 6 WINDOW w AS (PARTITION BY row_path, data_year ORDER BY file_year)")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).where("title = 'Orders by region' and data_month = 6")
    first = F.first("numeric_value").over(Window.partitionBy("row_path", "data_year").orderBy("file_year"))
    return f.select("row_path", "data_year", "file_year", "numeric_value", first.alias("first_value"), (F.abs(F.col("numeric_value") - first) > 0.02 * F.abs(first)).alias("conflict"))


@query(L + "SELECT DISTINCT data_year AS year FROM facts WHERE title = 'Orders by region' INTERSECT SELECT DISTINCT file_year FROM tables EXCEPT SELECT 1995")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = demo_ledger(spark, sf_dir)
    years = layers.facts(ledger).where("title = 'Orders by region'").select(F.col("data_year").alias("year"))
    return years.intersect(ledger.tables.select(F.col("file_year").alias("year"))).exceptAll(spark.sql("SELECT 1995 AS year"))


@query(L + "SELECT title, data_year, sum(round(numeric_value)) AS total, CAST(grouping(title) AS INTEGER) AS all_titles, CAST(grouping(data_year) AS INTEGER) AS all_years FROM ranked WHERE vintage = 1 GROUP BY ROLLUP (title, data_year)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layers.canonical(_facts(spark, sf_dir))
    return f.rollup("title", "data_year").agg(F.sum(F.round("numeric_value")).alias("total"), F.grouping("title").cast("int").alias("all_titles"), F.grouping("data_year").cast("int").alias("all_years"))


_G = "SELECT row_path AS g, data_year * 12 + data_month AS pos, numeric_value / 1000.0 AS v FROM ranked WHERE vintage = 1 AND title = 'Orders by region'"
_M = "avg(v)"


@query(
    L
    + f""", s AS ({_G}), w AS (SELECT *, avg(v) OVER (PARTITION BY g) AS m FROM s)
    SELECT g, round(min_by(v, pos), 4) AS direct, round(sum(v), 2) AS total, round(avg(v), 4) AS average, round(median(v), 4) AS median, max(v) AS max, min(v) AS min, count(v) AS n, round(exp(avg(ln(v))), 4) AS geometric_mean,
    round(count(v) / sum(1.0 / v), 4) AS harmonic_mean, round(stddev_samp(v), 4) AS stdev_sample, round(stddev_pop(v), 4) AS stdev_population, round(var_samp(v), 2) AS variance_sample, round(var_pop(v), 2) AS variance_population, round(stddev_samp(v) / avg(v), 6) AS cv,
    CAST(arg_max(pos, v) AS INTEGER) AS argmax, CAST(arg_min(pos, v) AS INTEGER) AS argmin, round(avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5), 4) AS skewness, round(avg(power(v - m, 4)) / power(avg(power(v - m, 2)), 2) - 3, 4) AS kurtosis,
    round(regr_slope(v, pos), 4) AS slope, round(regr_intercept(v, pos), 1) AS intercept, round(corr(v, pos), 6) AS pearson FROM w GROUP BY g"""
)
def stat_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.operators import stats

    f = layers.canonical(_facts(spark, sf_dir)).where("title = 'Orders by region'")
    s = f.select(F.col("row_path").alias("g"), (F.col("data_year") * 12 + F.col("data_month")).alias("pos"), (F.col("numeric_value") / 1000.0).alias("v"))
    op = stats.single(F.col("v"), F.col("pos"))
    names = {"direct": (4, "direct"), "sum": (2, "total"), "average": (4, "average"), "median": (4, "median"), "geometric_mean": (4, "geometric_mean"), "harmonic_mean": (4, "harmonic_mean"), "stdev_sample": (4, "stdev_sample"), "stdev_population": (4, "stdev_population"), "variance_sample": (2, "variance_sample"), "variance_population": (2, "variance_population"), "coefficient_of_variation": (6, "cv"), "skewness": (4, "skewness"), "kurtosis": (4, "kurtosis"), "regr_slope": (4, "slope"), "regr_intercept": (1, "intercept")}
    plain = [op["max"].alias("max"), op["min"].alias("min"), op["count"].alias("n"), op["argmax"].alias("argmax"), op["argmin"].alias("argmin"), F.round(F.corr("v", "pos"), 6).alias("pearson")]
    return s.groupBy("g").agg(*(F.round(op[k], d).alias(a) for k, (d, a) in names.items()), *plain)


@query(
    L
    + """, s AS (SELECT row_path AS g, data_year, sum(numeric_value) AS v FROM ranked WHERE vintage = 1 AND title = 'Orders by region' GROUP BY 1, 2),
    p AS (SELECT a.g, a.data_year, a.v AS x, b.v AS y FROM s a JOIN s b ON a.g = b.g AND b.data_year = a.data_year + 1)
    SELECT g, data_year, round(y - x, 2) AS difference, round(abs(y - x), 2) AS abs_difference, round((y - x) * 100 / nullif(x, 0), 4) AS percent_change, round(x / nullif(y, 0), 6) AS ratio, round(x * 100 / nullif(y, 0), 4) AS percent_of,
    round((power(y / x, 1.0 / 1) - 1) * 100, 4) AS cagr, round((power(x, 0.5) - 1) / 0.5, 4) AS box_cox FROM p"""
)
def paired_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.operators import stats

    f = layers.canonical(_facts(spark, sf_dir)).where("title = 'Orders by region'")
    s = f.groupBy(F.col("row_path").alias("g"), "data_year").agg(F.sum("numeric_value").alias("v"))
    p = s.alias("a").join(s.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("b.data_year") == F.col("a.data_year") + 1)).select("a.g", "a.data_year", F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    op = stats.paired(F.col("x"), F.col("y"))
    return p.select("g", "data_year", F.round(op["difference"], 2).alias("difference"), F.round(op["abs_difference"], 2).alias("abs_difference"), F.round(op["percent_change"], 4).alias("percent_change"), F.round(op["ratio"], 6).alias("ratio"), F.round(op["percent_of"], 4).alias("percent_of"), F.round(stats.cagr(F.col("x"), F.col("y"), F.lit(1)), 4).alias("cagr"), F.round(stats.box_cox(F.col("x"), 0.5), 4).alias("box_cox"))


@query(
    """WITH s AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer WHERE c_acctbal IS NOT NULL), i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v) AS i FROM s)
    SELECT g, round(coalesce(2 * sum(i * v) / nullif(count(*) * sum(v), 0) - (count(*) + 1.0) / count(*), 0), 6) AS gini,
    round((SELECT avg(v * ln(v)) / avg(v) - ln(avg(v)) FROM s t WHERE t.g = i.g AND v > 0), 6) AS theil_index FROM i GROUP BY g"""
)
def inequality_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.operators import stats

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("v"))
    out = stats.gini(c, "g", "v").join(stats.theil(c, "g", "v"), "g")
    return out.select("g", F.round("gini", 6).alias("gini"), F.round("theil_index", 6).alias("theil_index"))


@query()
def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search for one request."""
    from tabulon.operators import retrieve

    asked = retrieve.Request(years=[1997, 1998], row_terms=["asia"], column_terms=["1998"], must=["region"], avoid=["segment"], mode="calendar", period="calendar", monthly=True)
    return retrieve.retrieve(demo_ledger(spark, sf_dir), asked)


_REQUESTS = [
    ("q1", "v1", "Orders by region", "ASIA", "annual", [1997], None, "sum", "millions"),
    ("q2", "v1", "Orders by region", "EUROPE", "multi_year_annual", [1996, 1997, 1998], None, "average", "thousands"),
    ("q3", "v1", "Orders by region", "AFRICA", "monthly_all", [1998], None, "max", None),
    ("q4", "v1", "Orders by region", "AMERICA", "specific_month", [1997], 6, "direct", None),
    ("q5", "v1", "Orders by region", "NOWHERE", "annual", [1997], None, "sum", None),
]


@query(
    L
    + """, r(uid, hint, y0, y1, m, op, div, by_year) AS (VALUES ('q1', 'asia', 1997, 1997, NULL, 'sum', 1e6, true), ('q2', 'europe', 1996, 1998, NULL, 'average', 1e3, true), ('q3', 'africa', 1998, 1998, NULL, 'max', 1.0, false), ('q4', 'america', 1997, 1997, 6, 'direct', 1.0, false), ('q5', 'nowhere', 1997, 1997, NULL, 'sum', 1.0, true)),
    v AS (SELECT r.*, f.data_year, f.data_month, f.numeric_value AS x FROM r LEFT JOIN (SELECT * FROM ranked WHERE vintage = 1 AND title = 'Orders by region') f ON lower(f.row_path) = hint AND data_year BETWEEN y0 AND y1 AND (m IS NULL OR data_month = m)),
    s AS (SELECT uid, op, div, y0, y1, m, by_year, CASE WHEN by_year THEN data_year ELSE data_month END AS at, sum(x) AS x, count(x) AS n FROM v GROUP BY ALL),
    w AS (SELECT uid, op, div, CASE WHEN by_year THEN y1 - y0 + 1 WHEN m IS NULL THEN 12 ELSE 1 END AS want, count(*) FILTER (n = CASE WHEN by_year THEN 12 ELSE 1 END) AS got, sum(x) FILTER (n = CASE WHEN by_year THEN 12 ELSE 1 END) AS sx, avg(x) FILTER (n = CASE WHEN by_year THEN 12 ELSE 1 END) AS ax, max(x) FILTER (n = CASE WHEN by_year THEN 12 ELSE 1 END) AS mx FROM s GROUP BY ALL)
    SELECT uid, CASE WHEN got < 0.8 * want THEN 'incomplete' ELSE 'ok' END AS status, CASE WHEN got >= 0.8 * want THEN round(CASE op WHEN 'sum' THEN sx WHEN 'average' THEN ax ELSE mx END / div, 6) END AS value FROM w"""
)
def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests of a table in one job: cells, series, operation, unit."""
    from tabulon.operators import requests

    r = spark.createDataFrame(_REQUESTS, requests.REQUEST)
    out = requests.answers(requests.series(requests.resolved(r, _facts(spark, sf_dir))))
    return out.select("uid", "status", F.round("value", 6).alias("value"))


@query("SELECT n_name, round(sum(c_acctbal), 2) / 1000 AS total FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY n_name LIMIT 10")
def guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.operators import guard

    for t in ("nation", "customer"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    found = guard.run_sql(spark, "SELECT n_name, round(sum(c_acctbal), 2) AS s FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY n_name LIMIT 10")
    return found.select("n_name", guard.expression("s / 1000", {"s"}).alias("total"))


@query(L + "SELECT l.table_id, l.metric_slug, y.family_id, CAST(y.year AS INTEGER) AS year FROM (SELECT DISTINCT table_id, metric_slug FROM rws) l LEFT JOIN (SELECT lower(trim(title)) AS family_id, data_year AS year, arg_max(table_id, file_year * 100 + file_month) AS best FROM facts GROUP BY 1, 2) y ON y.best = l.table_id")
def labels_with_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the family years of which their table is the best one; a label of no best table stays."""
    made, f = demo_ledger(spark, sf_dir), _facts(spark, sf_dir)
    l = layers.row_labels(made).select("table_id", "metric_slug").distinct()
    return l.join(layers.family_years(f).withColumnRenamed("best_table_id", "table_id"), "table_id", "left").select("table_id", "metric_slug", "family_id", "year")


@query(
    L
    + """, f AS (SELECT lower(trim(title)) AS family_id, count(*) AS member_count FROM tables GROUP BY 1), y AS (SELECT lower(trim(title)) AS family_id, data_year AS year, arg_max(table_id, file_year * 100 + file_month) AS best FROM facts GROUP BY 1, 2)
    SELECT f.family_id, f.member_count, CAST(y.year AS INTEGER) AS year, t.file FROM f LEFT JOIN y ON y.family_id = f.family_id AND y.year > 1996 LEFT JOIN tables t ON t.id = y.best"""
)
def family_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families, their years after 1996 and the file of each year's best table."""
    made, f = demo_ledger(spark, sf_dir), _facts(spark, sf_dir)
    y = layers.family_years(f).where("year > 1996")
    t = made.tables.select(F.col("id").alias("best_table_id"), "file")
    return layers.families(made.tables).join(y, "family_id", "left").join(t, "best_table_id", "left").select("family_id", "member_count", "year", "file")


@query(
    L
    + """SELECT t.file, t.element_seq, t.title, (SELECT string_agg(row_path, ' | ' ORDER BY row_index) FROM rws WHERE table_id = t.id AND row_index <= 4) AS row_labels, (SELECT string_agg(DISTINCT CAST(year_extracted AS VARCHAR), ',' ORDER BY CAST(year_extracted AS VARCHAR)) FROM cols WHERE table_id = t.id) AS years
    FROM tables t WHERE t.file = 'issue_1996_12.json'"""
)
def gold_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a gold file with their first row labels and years."""
    made = demo_ledger(spark, sf_dir)
    gold = spark.createDataFrame([("issue_1996_12.json",)], "file string")
    return layers.entries_at(made, gold, ["file"], 4).select("file", "element_seq", "title", F.array_join("row_labels", " | ").alias("row_labels"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))
