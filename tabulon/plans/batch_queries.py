"""Queries over whole tables of requests, which come from the benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import answers, contexts
from tabulon.operators import batch, containment, layers, polynomial, series_requests, values
from tabulon.plans.registry import query
from tabulon.sources.ledger import LEDGER_SQL, demo_ledger, read
from tabulon.sources.shared import written

L = LEDGER_SQL


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request an item: a region's orders in one or two years, asked for in several ways."""
    items, region = read(spark, sf_dir, "benchmark", "region")
    i, name = F.col("item_id"), F.lower("r_name")
    y = (1992 + i % 7).cast("int")
    none = F.array().cast("array<string>")
    pick = lambda n, *values: F.element_at(F.array(*values), (i % n + 1).cast("int"))
    month = (1 + i % 12).cast("string")
    return items.join(region, F.col("r_regionkey") == i % 5).select(
        i.alias("q"), F.when(i % 11 == 10, F.array().cast("array<int>")).when(i % 2 == 0, F.array(y)).otherwise(F.array(y, y + 1)).alias("years"),
        pick(4, F.array(name), F.array(F.concat(F.lit("building "), name)), F.array(name, F.lit("machinery")), F.array(F.concat(F.lit("orders of "), name))).alias("hints"),
        pick(3, F.array(month), F.array(F.concat_ws(" ", y, month)), none).alias("columns"), pick(2, F.array(F.lit("orders by region")), F.array(F.lit("by segment"))).alias("titles"),
        F.when(i % 5 == 0, F.array(name)).otherwise(none).alias("must"), F.when(i % 5 == 1, F.array(F.lit("segment"))).otherwise(none).alias("avoid"), pick(3, F.lit("calendar"), F.lit("fiscal"), F.lit("unknown")).alias("mode"),
        (i % 4 < 2).alias("monthly"), F.when(i % 10 == 0, F.array(F.lit("issue_1997_12.json"))).otherwise(none).alias("files"),
    )


_T = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
_REQUESTS = """r AS (SELECT item_id AS q, CASE WHEN item_id % 11 = 10 THEN [] WHEN item_id % 2 = 0 THEN [1992 + item_id % 7] ELSE [1992 + item_id % 7, 1993 + item_id % 7] END AS years,
  CASE item_id % 4 WHEN 0 THEN [lower(r_name)] WHEN 1 THEN ['building ' || lower(r_name)] WHEN 2 THEN [lower(r_name), 'machinery'] ELSE ['orders of ' || lower(r_name)] END AS hints,
  CASE item_id % 3 WHEN 0 THEN [CAST(1 + item_id % 12 AS VARCHAR)] WHEN 1 THEN [(1992 + item_id % 7) || ' ' || (1 + item_id % 12)] ELSE CAST([] AS VARCHAR[]) END AS columns,
  CASE item_id % 2 WHEN 0 THEN ['orders by region'] ELSE ['by segment'] END AS titles, CASE WHEN item_id % 5 = 0 THEN [lower(r_name)] ELSE CAST([] AS VARCHAR[]) END AS must,
  CASE WHEN item_id % 5 = 1 THEN ['segment'] ELSE CAST([] AS VARCHAR[]) END AS avoid, CASE item_id % 3 WHEN 0 THEN 'calendar' WHEN 1 THEN 'fiscal' ELSE 'unknown' END AS mode, item_id % 4 < 2 AS monthly,
  CASE WHEN item_id % 10 = 0 THEN ['issue_1997_12.json'] ELSE CAST([] AS VARCHAR[]) END AS files FROM benchmark JOIN region ON r_regionkey = item_id % 5)"""

_TEXT = f"""tok AS (SELECT id, 2.0 AS w, unnest({_T.format("title")}) AS t FROM tables UNION ALL SELECT table_id, 2.0, unnest({_T.format("col_path")}) FROM (SELECT DISTINCT table_id, col_path FROM cols)
    UNION ALL SELECT table_id, 2.5, unnest({_T.format("row_path")}) FROM (SELECT DISTINCT table_id, row_path FROM rws)),
  len AS (SELECT id, count(*) AS n FROM tok GROUP BY id), st AS (SELECT count(*) AS n_docs, avg(n) AS mean FROM len), df AS (SELECT t, count(DISTINCT id) AS df FROM tok GROUP BY t),
  parts AS (SELECT id, t, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) AS part
    FROM (SELECT id, t, CAST(sum(w) AS DOUBLE) AS f FROM tok GROUP BY id, t) JOIN df USING (t) JOIN len USING (id), st)"""


@query(
    L
    + f""", {_REQUESTS},
  fam AS (SELECT DISTINCT q, lower(trim(title)) AS family_id FROM (SELECT q, unnest(years) AS year FROM r) JOIN (SELECT DISTINCT title, data_year FROM facts) ON data_year = year),
  cand AS (SELECT q, id FROM (SELECT q, t.id, row_number() OVER (PARTITION BY q, family_id ORDER BY abs(file_year - list_min(years)), file_month DESC, t.id) AS nth FROM fam JOIN r USING (q) JOIN tables t ON lower(trim(title)) = family_id) WHERE nth <= 12),
  pool AS (SELECT q, id FROM cand UNION ALL SELECT q, id FROM r, tables WHERE len(years) = 0), {_TEXT},
  qt AS (SELECT DISTINCT q, unnest(flatten(list_transform(list_concat(hints, titles), lambda x: {_T.format("x")}))) AS t FROM r),
  bm AS (SELECT q, id, sum(part) AS text FROM qt JOIN parts USING (t) JOIN pool USING (q, id) GROUP BY q, id),
  hint AS (SELECT DISTINCT q, unnest(hints) AS hint FROM r),
  slug0 AS (SELECT q, id, stage, hint, count(*) + 5 * max(CAST(hint = slug AS INTEGER)) AS score FROM (SELECT q, table_id AS id, metric_slug AS slug, hint, unnest(CASE WHEN list_has_all({_T.format("metric_slug")}, {_T.format("hint")}) THEN [0, 2] WHEN list_has_any({_T.format("metric_slug")}, {_T.format("hint")}) THEN [2] ELSE [] END) AS stage FROM hint, rws) JOIN pool USING (q, id) GROUP BY ALL),
  slug AS (SELECT q, id, first(stage) AS stage, max(score) AS slug FROM (SELECT *, min(stage) OVER (PARTITION BY q, id) AS m FROM slug0) WHERE stage = m GROUP BY q, id),
  found AS (SELECT q, id, coalesce(text, 0) AS text, coalesce(slug, 0) AS slug, stage FROM bm FULL JOIN slug USING (q, id)
    UNION ALL SELECT q, id, 0, 0, NULL FROM cand WHERE q NOT IN (SELECT q FROM bm) AND (q, id) NOT IN (SELECT (q, id) FROM slug)),
  ny AS (SELECT q, id, count(*) AS n_years FROM (SELECT q, unnest(years) AS year FROM r) JOIN (SELECT DISTINCT table_id AS id, year_extracted AS year FROM cols) USING (year) GROUP BY q, id),
  nc AS (SELECT q, id, max(shared) AS n_columns FROM (SELECT q, table_id AS id, len(list_distinct({_T.format("h")})) AS n, len(list_intersect({_T.format("h")}, {_T.format("col_path || ' ' || col_leaf")})) AS shared FROM (SELECT q, unnest(columns) AS h FROM r), cols) WHERE shared >= CASE WHEN n >= 2 THEN n - 1 ELSE n END GROUP BY q, id),
  rh AS (SELECT DISTINCT q, table_id AS id, id AS row_id FROM (SELECT q, rws.table_id, rws.id, len(list_distinct({_T.format("hint")})) AS n, len(list_intersect({_T.format("hint")}, {_T.format("row_path")})) AS shared FROM hint, rws) WHERE shared >= CASE WHEN n >= 3 THEN n - 1 ELSE n END),
  cl AS (SELECT table_id AS id, row_id, data_year AS year, count(numeric_value) AS n FROM facts GROUP BY ALL),
  pr AS (SELECT q, id, count(*) AS n_rows, CAST(max(cells) AS BIGINT) AS best_cells FROM (SELECT rh.q, rh.id, rh.row_id, coalesce(sum(n) FILTER (WHERE len(years) = 0 OR list_contains(years, year)), 0) AS cells FROM rh JOIN r USING (q) LEFT JOIN cl USING (id, row_id) GROUP BY ALL) GROUP BY q, id),
  j0 AS (SELECT f.*, r.* EXCLUDE (q), t.file, t.file_year, t.title, t.period, coalesce(n_years, 0) AS n_years, coalesce(n_columns, 0) AS n_columns, coalesce(n_rows, 0) AS n_rows, coalesce(best_cells, 0) AS best_cells FROM found f JOIN r USING (q) JOIN tables t USING (id) LEFT JOIN ny USING (q, id) LEFT JOIN nc USING (q, id) LEFT JOIN pr USING (q, id)),
  j1 AS (SELECT * FROM j0 QUALIFY len(years) = 0 OR n_years > 0 OR count(*) FILTER (WHERE len(years) = 0 OR n_years > 0) OVER (PARTITION BY q) < 10),
  j2 AS (SELECT * FROM j1 QUALIFY len(columns) = 0 OR n_columns > 0 OR count(*) FILTER (WHERE len(columns) = 0 OR n_columns > 0) OVER (PARTITION BY q) < 10),
  lb AS (SELECT table_id AS id, string_agg(lower(row_path), ' ' ORDER BY lower(row_path)) AS labels FROM rws WHERE row_index <= 40 GROUP BY 1),
  s AS (SELECT *, max(text) OVER w AS tm, max(slug) OVER w AS sm, max(best_cells) OVER w AS cm, file_year - list_max(years) AS o, lower(title) || ' ' || labels AS hay FROM j2 JOIN lb USING (id) WINDOW w AS (PARTITION BY q)),
  b AS (SELECT *, CASE WHEN len(years) = 0 THEN 0 WHEN mode = 'calendar' THEN CASE WHEN o = 0 THEN 2.5 WHEN o = 1 THEN 6 WHEN o = 2 THEN 3.5 WHEN o = 3 THEN 2.5 WHEN o BETWEEN 4 AND 6 THEN 1.5 WHEN o < 0 AND list_min(years) <= file_year THEN 1.5 ELSE 0 END
    WHEN mode = 'fiscal' THEN CASE WHEN o = 0 THEN 7 WHEN o = 1 THEN 3.5 WHEN o = 2 THEN 2.5 WHEN o = 3 THEN 2 WHEN o BETWEEN 4 AND 6 THEN 1 WHEN o < 0 AND list_min(years) <= file_year THEN 1.5 ELSE 0 END
    ELSE CASE WHEN o = 0 THEN 5.5 WHEN o = 1 THEN 4.5 WHEN o = 2 THEN 3 WHEN o = 3 THEN 2.5 WHEN o BETWEEN 4 AND 6 THEN 1.5 WHEN o < 0 AND list_min(years) <= file_year THEN 2 ELSE 0 END END AS bonus FROM s),
  scored AS (SELECT q, id, file, file_year, title, CASE stage WHEN 0 THEN 'primary' WHEN 2 THEN 'partial' END AS stage, n_rows, best_cells, round(0.75 * text / CASE WHEN tm = 0 THEN 1 ELSE tm END + 0.25 * slug / CASE WHEN sm = 0 THEN 1 ELSE sm END + CASE stage WHEN 0 THEN 0.8 WHEN 2 THEN 0.2 ELSE 0 END
    + CASE WHEN n_rows > 0 THEN 5 * best_cells / CASE WHEN cm = 0 THEN 1 ELSE cm END - CASE WHEN best_cells > 0 THEN 0.05 * least(n_rows - 1, 8) ELSE 0 END ELSE 0 END + CASE WHEN len(years) > 0 THEN 2 * n_years / len(years) ELSE 0 END + CASE WHEN n_columns > 0 THEN 0.45 + 0.10 * least(n_columns, 3) ELSE 0 END + CASE WHEN monthly THEN 0.55 ELSE 0.20 END
    + 0.25 * least(len(list_filter(titles, lambda x: contains(lower(title), x))), 3) + coalesce(list_sum(list_transform(must, lambda x: CASE WHEN contains(hay, x) THEN 0.6 ELSE -0.2 END)), 0) + coalesce(list_sum(list_transform(avoid, lambda x: CASE WHEN contains(hay, x) THEN -0.4 ELSE 0 END)), 0)
    + 0.12 * bonus + 0.2 * CASE WHEN mode = 'unknown' THEN 0 WHEN mode = period THEN 0.5 ELSE -0.3 END + CASE WHEN list_contains(files, file) THEN 5 ELSE 0 END, 6) AS score FROM b),
  capped AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY q, file ORDER BY score DESC, id) <= 1)
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM capped QUALIFY place <= 5"""
)
def retrieval_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tables of every request, all in one plan."""
    k = batch.kept(spark, demo_ledger(spark, sf_dir), (sf_dir, "demo"), stem=False)
    return batch.retrieve(k, requests(spark, sf_dir), most=5, per_file=1, stem=False)


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '(?i)\\b[1-9]\\s*/|\\b[rpe]\\s*/', ' ', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NAMED = "(contains({l}, {h}) OR list_has_all(string_split({l}, ' '), list_filter(string_split({h}, ' '), lambda x: len(x) >= 3))) AND len(list_filter(string_split({h}, ' '), lambda x: len(x) >= 3)) > 0"


@query(
    L
    + f""", s AS (SELECT item_id AS uid, item_id % 8 AS k, lower(r_name) AS n, 1993 + item_id % 5 AS issue FROM benchmark JOIN region ON r_regionkey = item_id % 5),
  spec AS (SELECT uid, issue, k = 7 AND uid % 16 = 7 AS cohort, CASE k WHEN 0 THEN n WHEN 1 THEN left(n, 3) WHEN 2 THEN 'r/ ' || array_to_string(list_reverse(string_split(n, ' ')), ', ') WHEN 3 THEN 'atlantis' WHEN 4 THEN 'atlantis' WHEN 7 THEN NULL ELSE n END AS row_hint, CASE k WHEN 3 THEN [n] END AS alternatives,
    CASE k WHEN 0 THEN CAST(issue AS VARCHAR) || ' > 7' WHEN 1 THEN CAST(issue AS VARCHAR) WHEN 5 THEN 'thirteenth' END AS column_hint, CASE k WHEN 6 THEN [1901] WHEN 7 THEN NULL ELSE [1901, issue - 1] END AS years FROM s),
  scope AS (SELECT uid, issue, id AS table_id FROM spec JOIN tables ON file_year = issue AND (uid % 2 = 0 OR element_seq = 1)),
  rl AS (SELECT DISTINCT uid, {_PLAIN.format("row_leaf")} AS l FROM scope JOIN rws USING (table_id)), cl AS (SELECT DISTINCT uid, {_PLAIN.format("col_path")} AS l FROM scope JOIN cols USING (table_id)),
  h AS (SELECT uid, {_PLAIN.format("unnest(list_concat([row_hint], coalesce(alternatives, [])))")} AS h FROM spec),
  ok AS (SELECT spec.*, uid IN (SELECT h.uid FROM h JOIN rl ON h.uid = rl.uid WHERE {_NAMED.format(l="l", h="h")}) AS row_ok, uid IN (SELECT x.uid FROM (SELECT uid, {_PLAIN.format("column_hint")} AS h FROM spec) x JOIN cl ON x.uid = cl.uid WHERE {_NAMED.format(l="l", h="h")}) AS col_ok,
    uid IN (SELECT x.uid FROM (SELECT uid, unnest(years) AS y FROM spec) x JOIN scope ON x.uid = scope.uid JOIN cols ON cols.table_id = scope.table_id AND year_extracted = y) AS year_ok FROM spec)
  SELECT uid, 1 AS request, CASE WHEN cohort THEN 'COHORT' WHEN row_hint IS NULL AND column_hint IS NULL THEN 'EMPTY' WHEN years IS NOT NULL AND NOT year_ok THEN 'YEAR_MISS' WHEN row_hint IS NOT NULL AND NOT row_ok THEN 'ROW_MISS' WHEN column_hint IS NOT NULL AND NOT col_ok THEN 'COL_MISS' ELSE 'OK' END AS code FROM ok"""
)
def spec_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs of all kinds against the labels and years of the tables that they are about."""
    items, region = read(spark, sf_dir, "benchmark", "region")
    ledger = demo_ledger(spark, sf_dir)
    i = F.col("item_id")
    s = items.join(region, F.col("r_regionkey") == i % 5).select(i.alias("uid"), (i % 8).alias("k"), F.lower("r_name").alias("n"), (1993 + i % 5).alias("issue"))
    k, n, issue, none = F.col("k"), F.col("n"), F.col("issue").cast("string"), F.lit(None).cast("string")
    row = F.when(k == 1, F.left(n, F.lit(3))).when(k == 2, F.concat(F.lit("r/ "), F.array_join(F.reverse(F.split(n, " ")), ", "))).when(k.isin(3, 4), "atlantis").when(k != 7, n)
    column = F.when(k == 0, F.concat(issue, F.lit(" > 7"))).when(k == 1, issue).when(k == 5, "thirteenth")
    years = F.when(k == 6, F.array(F.lit(1901))).when(k != 7, F.array(F.lit(1901), (F.col("issue") - 1).cast("int")))
    specs = s.select("uid", F.lit(1).alias("request"), F.lit("corpus").alias("source"), ((k == 7) & (F.col("uid") % 16 == 7)).alias("cohort"), none.alias("label"), row.alias("row_hint"), F.when(k == 3, F.array(n)).alias("alternatives"), column.alias("column_hint"), years.alias("years"))
    scope = s.join(ledger.tables, (F.col("file_year") == F.col("issue")) & ((F.col("uid") % 2 == 0) | (F.col("element_seq") == 1))).select("uid", F.col("id").alias("table_id"))
    coverage = ledger.columns.select("table_id", F.col("year_extracted").alias("year")).distinct()
    rows, columns = ledger.rows.select("table_id", F.col("row_leaf").alias("label")), ledger.columns.select("table_id", F.col("col_path").alias("label"))
    return containment.validated(specs, scope, rows, columns, coverage)


def _standing_for(hint):
    return F.when(F.contains(hint, F.lit("america")), F.array(F.lit("africa"))).otherwise(F.array().cast("array<string>"))


@query(
    L
    + f""", {_REQUESTS}, {_TEXT},
  fam AS (SELECT DISTINCT q, lower(trim(title)) AS family_id FROM (SELECT q, unnest(years) AS year FROM r) JOIN (SELECT DISTINCT title, data_year FROM facts) ON data_year = year),
  cand AS (SELECT DISTINCT q, t.id FROM fam JOIN tables t ON lower(trim(title)) = family_id),
  qe AS (SELECT DISTINCT q, unnest(flatten(list_transform(hints, lambda x: {_T.format("x")}))) AS t FROM r),
  qb AS (SELECT q, t FROM qe UNION SELECT q, 'africa' FROM r WHERE len(list_filter(hints, lambda x: contains(x, 'america'))) > 0),
  bm AS (SELECT q, id, 'exact' AS how, sum(part) AS score FROM qe JOIN parts USING (t) GROUP BY q, id HAVING count(*) = (SELECT count(*) FROM qe e WHERE e.q = qe.q) UNION ALL SELECT q, id, 'synonym', sum(part) FROM qb JOIN parts USING (t) GROUP BY q, id),
  j AS (SELECT bm.*, file_year, list_min(years) AS a, list_max(years) AS b, EXISTS (SELECT 1 FROM cols WHERE table_id = bm.id AND list_contains(years, year_extracted)) AS own FROM bm JOIN r USING (q) JOIN tables USING (id)),
  st2 AS (SELECT q, id, score, unnest(CASE how WHEN 'exact' THEN list_concat(CASE WHEN own THEN [0] ELSE [] END, CASE WHEN file_year BETWEEN a AND b + 5 THEN [2] ELSE [] END, [3]) ELSE list_concat(CASE WHEN own THEN [1] ELSE [] END, CASE WHEN file_year BETWEEN a AND b + 5 THEN [4] ELSE [] END, [5], CASE WHEN own AND file_year BETWEEN a + 5 AND b + 10 THEN [6] ELSE [] END) END) AS stage FROM j),
  lim AS (SELECT q, min(stage) AS end_ FROM (SELECT q, stage FROM st2 GROUP BY q, stage HAVING count(*) >= 6) GROUP BY q),
  one AS (SELECT q, id, min(stage) AS stage, arg_min(score, stage) AS score FROM st2 LEFT JOIN lim USING (q) WHERE end_ IS NULL OR stage <= end_ GROUP BY q, id),
  lm AS (SELECT q, id, score FROM (SELECT q, id, sum(part) AS score FROM qe JOIN parts USING (t) GROUP BY q, id) JOIN cand USING (q, id))
  SELECT q, row_number() OVER (PARTITION BY q ORDER BY stage, score DESC, id) AS place, id, CASE stage WHEN 0 THEN 'exact_year_strict' WHEN 1 THEN 'synonym_year_strict' WHEN 2 THEN 'exact_year_window' WHEN 3 THEN 'exact_unrestricted' WHEN 4 THEN 'synonym_year_window' WHEN 5 THEN 'synonym_unrestricted' ELSE 'year_shifted' END AS stage, round(score, 5) AS score, 'staged' AS mode FROM one
  UNION ALL SELECT q, row_number() OVER (PARTITION BY q ORDER BY round(score, 5) DESC, id), id, NULL, round(score, 5), 'limited' FROM lm"""
)
def table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text in both modes: over all tables in stages, and over each request's candidates only."""
    from pyspark.sql import Window

    k = batch.kept(spark, demo_ledger(spark, sf_dir), (sf_dir, "demo"), stem=False)
    r = written(requests(spark, sf_dir))
    staged = batch.staged(k, r, _standing_for, stem=False, enough=6).withColumn("score", F.round("score", 5)).withColumn("mode", F.lit("staged"))
    among = written(batch.candidates(k, r))
    limited = batch.text_scores(k, batch.asked_terms(r, F.col("hints"), False), among).withColumn("score", F.round("score", 5))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    limited = limited.select("q", place.alias("place"), "id", F.lit(None).cast("string").alias("stage"), "score", F.lit("limited").alias("mode"))
    return staged.unionByName(limited)


@query(
    L
    + """, g0 AS (SELECT r_regionkey, y, m, CAST(sum(price) AS DOUBLE) AS v FROM base JOIN region USING (r_name) GROUP BY r_regionkey, y, m), g AS (SELECT r_regionkey * 10000 + y * 100 + m AS uid, y, m, v * CASE WHEN m % 3 = 0 THEN 1e-6 WHEN m % 3 = 1 THEN 1.0004 ELSE -1 END AS value FROM g0),
  hit AS (SELECT uid, value, scale, c.table_id, c.row_id, c.col_id, abs(numeric_value - value * scale) / abs(value * scale) AS off FROM g, (SELECT unnest([1.0, 1e3, 1e-3, 1e6, 1e-6]) AS scale), cells c WHERE value <> 0 AND abs(numeric_value - value * scale) <= abs(value * scale) * 1e-3),
  n AS (SELECT uid, count(DISTINCT (table_id, row_id, col_id)) AS n_cells, count(DISTINCT table_id) AS n_tables FROM hit GROUP BY uid),
  b AS (SELECT uid, table_id, row_id, col_id, scale FROM hit QUALIFY row_number() OVER (PARTITION BY uid ORDER BY round(off, 12), table_id, row_id, col_id, scale) = 1)
  SELECT g.uid, coalesce(n_cells, 0) AS n_cells, coalesce(n_tables, 0) AS n_tables, CASE WHEN n_tables IS NULL THEN 'none' WHEN n_tables = 1 THEN 'one' ELSE 'several' END AS places, table_id, row_id, col_id, CAST(scale AS DOUBLE) AS scale FROM g LEFT JOIN n USING (uid) LEFT JOIN b USING (uid)"""
)
def value_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the whole ledger monthly totals stand, at any scale: as published, or revised since, or nowhere (of other sign)."""
    return values.summed(_totals(spark, sf_dir), values.places(_totals(spark, sf_dir), demo_ledger(spark, sf_dir).cells, 1e-3))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = read(spark, sf_dir, "orders", "customer", "nation", "region")
    who = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_regionkey")
    y, m = F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")
    sums = orders.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_regionkey", y, m).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    value = F.when(F.col("m") % 3 == 0, F.col("v") * 1e-6).when(F.col("m") % 3 == 1, F.col("v") * 1.0004).otherwise(-F.col("v"))
    return sums.select("r_regionkey", (F.col("r_regionkey") * 10000 + F.col("y") * 100 + F.col("m")).cast("long").alias("uid"), "y", "m", value.alias("value"))


@query(
    L
    + """, g0 AS (SELECT r_regionkey, y, m, CAST(sum(price) AS DOUBLE) AS v FROM base JOIN region USING (r_name) GROUP BY r_regionkey, y, m), g AS (SELECT r_regionkey * 10000 + y * 100 + m AS uid, r_regionkey * 10000 + y AS question, printf('issue_%04d_12.json', y + m % 2) AS file, 1 + m % 2 AS page, v * CASE WHEN m % 3 = 0 THEN 1e-6 WHEN m % 3 = 1 THEN 1.0004 ELSE -1 END AS value FROM g0),
  hit AS (SELECT DISTINCT uid, t.file, t.element_seq AS page FROM g, (SELECT unnest([1.0, 1e3, 1e-3, 1e6, 1e-6]) AS scale), cells c JOIN tables t ON t.id = c.table_id WHERE value <> 0 AND abs(numeric_value - value * scale) <= abs(value * scale) * 1e-3),
  e AS (SELECT question, uid IN (SELECT uid FROM hit) AS found, (uid, file) IN (SELECT (uid, file) FROM hit) AS in_file, (uid, file, page) IN (SELECT (uid, file, page) FROM hit) AS on_page FROM g)
  SELECT question, count(*) AS n_values, CAST(count_if(found) AS BIGINT) AS n_found, bool_or(in_file) AS file_any, bool_and(in_file) AS file_all, bool_or(on_page) AS page_any, bool_and(on_page) AS page_all FROM e GROUP BY question"""
)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each region's year: whether its months stand in the issues and on the pages that are said to have them."""
    t = _totals(spark, sf_dir)
    m, y = F.col("m"), F.col("y")
    gold = t.select("uid", (F.col("r_regionkey") * 10000 + y).cast("long").alias("question"), F.format_string("issue_%04d_12.json", y + m % 2).alias("file"), (1 + m % 2).alias("page"), "value")
    ledger = demo_ledger(spark, sf_dir)
    return values.reachable(gold, values.places(gold, ledger.cells, 1e-3), ledger.tables.select(F.col("id").alias("table_id"), "file", F.col("element_seq").alias("page")))


_V = "CAST(o_totalprice AS DOUBLE)"


@query(
    f"""SELECT o_orderkey, CAST(n AS INTEGER) AS n, value, percent, CAST(start AS INTEGER) AS start, scale FROM (SELECT o_orderkey, unnest([
      {{'n': 0, 'value': {_V}, 'percent': false, 'start': length(p), 'scale': u}}, {{'n': 1, 'value': -(o_custkey % 90) - 0.5, 'percent': true, 'start': length(p) + length(printf('%.2f', {_V})) + length(w) + 2, 'scale': CASE WHEN u IS NOT NULL THEN u END}},
      {{'n': 2, 'value': CAST(year(o_orderdate) AS DOUBLE), 'percent': false, 'start': length(p) + length(printf('%.2f', {_V})) + length(w) + 2 + length('-' || (o_custkey % 90) || '.5%') + 49, 'scale': NULL}}], recursive := true)
      FROM (SELECT *, 'Paid by ' || o_orderpriority[3:] || ': ' AS p, ['', ' million', ' thousands', ' m'][o_orderkey % 4 + 1] AS w, [NULL, 'million', 'thousand', 'million'][o_orderkey % 4 + 1] AS u FROM orders))"""
)
def number_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a sentence for each order, with their places and scale words."""
    (o,) = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    word = F.when(k == 1, " million").when(k == 2, " thousands").when(k == 3, " m").otherwise("")
    text = F.concat(F.lit("Paid by "), F.substring("o_orderpriority", 3, 99), F.lit(": "), F.format_number(F.col("o_totalprice").cast("double"), 2), word, F.lit(" ("), F.lit("−"), (F.col("o_custkey") % 90).cast("string"), F.lit(".5%) "), F.rpad(F.lit("of what was due"), 45, " "), F.lit("y "), F.year("o_orderdate").cast("string"))
    rows = o.select("o_orderkey", F.posexplode(contexts.numbers_in(text)).alias("n", "x"))
    return rows.select("o_orderkey", "n", "x.value", "x.percent", "x.start", "x.scale")


@query(
    f"""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN true WHEN 1 THEN abs({_V} * 1.2 - {_V}) <= 0.01 * {_V} WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true WHEN 5 THEN abs(round({_V} / 3, 2) - {_V}) <= 0.01 * {_V} WHEN 6 THEN o_orderpriority LIKE '%URGENT' WHEN 7 THEN false END AS right_answer FROM orders"""
)
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all kinds against their truths: commas, years beside, scale words, several numbers, words, nothing."""
    (o,) = read(spark, sf_dir, "orders")
    v = F.col("o_totalprice").cast("double")
    plain, grouped, third = F.format_string("%.2f", v), F.format_number(v, 2), F.format_number(F.round(v / 3, 2), 2)
    k = F.col("o_orderkey") % 9
    truth = F.when(k == 2, F.concat(plain, F.lit(" million"))).when(k == 3, F.lit("1995")).when(k.isin(4, 5), F.concat(plain, F.lit(" and "), third)).when(k == 6, '"Urgent (first)"').when(k != 8, plain)
    answer = (
        F.when(k == 0, F.concat(F.lit("The total is $"), grouped, F.lit("."))).when(k == 1, F.concat(F.lit("In 1995 it was "), F.format_number(v * 1.2, 2))).when(k == 2, F.concat(grouped, F.lit(" dollars"))).when(k == 3, "in 1995").when(k == 4, F.concat(F.lit("first "), third, F.lit(" and then "), grouped))
        .when(k == 5, F.concat(F.lit("only this and that: "), third)).when(k == 6, F.regexp_replace("o_orderpriority", r"\d", "")).when(k == 7, "1995").otherwise("nothing")
    )
    return o.select("o_orderkey", contexts.matches(truth, answer, F.lit(0.01)).alias("right_answer"))


@query(
    L
    + f""", mx AS (SELECT table_id, title, file_year, file_month, data_year AS year, data_month AS month, CASE WHEN data_year = 1994 AND row_path LIKE '%ASIA' THEN NULL ELSE numeric_value END AS value, row_path, col_path, row_id, col_id FROM facts),
  c AS (SELECT table_id, title, file_year, file_month, year, month, value, 'columns' AS way, lower(row_path) AS label, row_id AS line FROM mx WHERE title = 'Orders by region'
    UNION ALL SELECT table_id, title, file_year, file_month, year, month, value, 'rows', lower(row_path), row_id FROM mx WHERE title = 'Orders by segment'
    UNION ALL SELECT table_id + 2, 'Orders in years', file_year, file_month, year, NULL, sum(value), 'annual', unnest([lower(row_path), CAST(year AS VARCHAR)]), unnest([row_id, table_id * 1000 + year]) FROM mx WHERE title = 'Orders by region' AND year < 1998 AND year <> 1996 GROUP BY table_id, file_year, file_month, year, row_path, row_id),
  r AS (SELECT item_id AS q, CASE item_id % 8 WHEN 3 THEN 'atlantis' WHEN 6 THEN 'building ' || lower(r_name) ELSE lower(r_name) END AS hint, CASE WHEN item_id % 8 = 5 THEN [1905] ELSE [1992 + item_id % 7, 1994] END AS years, CASE WHEN item_id % 2 = 0 THEN 'annual' ELSE 'monthly' END AS granularity,
    CASE item_id % 8 WHEN 4 THEN 'no such title' WHEN 0 THEN 'region orders' WHEN 1 THEN 'orders in years' ELSE '' END AS title FROM benchmark JOIN region ON r_regionkey = item_id % 5),
  lb AS (SELECT DISTINCT q, title AS want, label FROM r, (SELECT DISTINCT label FROM c) WHERE list_has_all({_T.format("label")}, {_T.format("hint")})),
  h AS (SELECT q, c.* FROM lb JOIN c USING (label) WHERE want = '' OR list_has_all({_T.format("c.title")}, {_T.format("want")})),
  y AS (SELECT DISTINCT q, granularity, unnest(years) AS year FROM r),
  ln AS (SELECT q, year, granularity, way, table_id, line, file_year, file_month, count(v) AS n, sum(v) AS value, list({{'month': month, 'value': v}} ORDER BY month) FILTER (v IS NOT NULL) AS series FROM (SELECT q, year, granularity, way, table_id, line, file_year, file_month, month, max(value) AS v FROM h JOIN y USING (q, year) GROUP BY ALL) GROUP BY ALL),
  b AS (SELECT *, CASE WHEN way <> 'annual' THEN n >= 10 ELSE n > 0 AND granularity <> 'monthly' END AS fits FROM ln QUALIFY row_number() OVER (PARTITION BY q, year ORDER BY fits DESC, CASE way WHEN 'columns' THEN 0 WHEN 'rows' THEN 1 ELSE 2 END, n DESC, file_year DESC, file_month DESC, table_id, line) = 1),
  j AS (SELECT y.*, b.* EXCLUDE (q, year, granularity), CASE WHEN y.q NOT IN (SELECT q FROM lb) THEN 'label_miss' WHEN y.q NOT IN (SELECT q FROM h) THEN 'table_miss' WHEN b.way IS NULL THEN 'year_miss' WHEN b.n = 0 THEN 'null_numeric' WHEN NOT fits THEN 'incomplete' ELSE 'ok' END AS status FROM y LEFT JOIN b ON b.q = y.q AND b.year = y.year)
  SELECT q, CAST(year AS INTEGER) AS year, status, CASE WHEN status IN ('ok', 'incomplete') THEN way END AS way, CASE WHEN status IN ('ok', 'incomplete') THEN table_id END AS table_id, CASE WHEN status IN ('ok', 'incomplete') THEN line END AS line, CASE WHEN status IN ('ok', 'incomplete') THEN n END AS n,
    CASE WHEN status IN ('ok', 'incomplete') THEN round(value, 2) END AS value, CASE WHEN status IN ('ok', 'incomplete') AND granularity = 'monthly' AND way <> 'annual' THEN len(series) END AS n_series FROM j"""
)
def series_for_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by every way and with every status, from tables with months in columns, with months in rows, and of whole years."""
    ledger = demo_ledger(spark, sf_dir)
    hole = (F.col("data_year") == 1994) & F.endswith("row_path", F.lit("ASIA"))
    keep = ["table_id", "title", "file_year", "file_month", "table_kind", "is_section_header", "row_path", "col_path", "row_id", "col_id", "data_year", "numeric_value"]
    f = series_requests.with_axes(layers.facts(ledger), ledger.rows, ledger.columns).withColumn("numeric_value", F.when(~hole, F.col("numeric_value")))
    region = f.where("title = 'Orders by region'").select(*keep, "row_month", "col_month")
    turned = f.where("title = 'Orders by segment'").select(*(F.col({"row_path": "col_path", "col_path": "row_path", "row_id": "col_id", "col_id": "row_id"}.get(c, c)).alias(c) for c in keep), F.col("col_month").alias("row_month"), F.lit(None).cast("int").alias("col_month"))
    years = region.where("data_year < 1998 and data_year <> 1996").groupBy("table_id", "file_year", "file_month", "data_year", "row_path", "row_id").agg(F.sum("numeric_value").alias("numeric_value"))
    whole = years.select((F.col("table_id") + 2).alias("table_id"), F.lit("Orders in years").alias("title"), "file_year", "file_month", F.lit("data").alias("table_kind"), F.lit(0).alias("is_section_header"), "row_path", F.col("data_year").cast("string").alias("col_path"), "row_id", (F.col("table_id") * 1000 + F.col("data_year")).alias("col_id"), "data_year", "numeric_value", F.lit(None).cast("int").alias("row_month"), F.lit(None).cast("int").alias("col_month"))
    items, regions = read(spark, sf_dir, "benchmark", "region")
    i, name = F.col("item_id"), F.lower("r_name")
    k = i % 8
    asked = items.join(regions, F.col("r_regionkey") == i % 5).select(
        i.alias("q"), F.when(k == 3, "atlantis").when(k == 6, F.concat(F.lit("building "), name)).otherwise(name).alias("hint"), F.when(k == 5, F.array(F.lit(1905))).otherwise(F.array((1992 + i % 7).cast("int"), F.lit(1994))).alias("years"),
        F.when(i % 2 == 0, "annual").otherwise("monthly").alias("granularity"), F.when(k == 4, "No such title").when(k == 0, "region orders").when(k == 1, "Orders in years").alias("title"),
    )
    out = series_requests.resolved(asked, region.unionByName(turned).unionByName(whole))
    return out.select("q", "year", "status", "way", "table_id", "line", "n", F.round("value", 2).alias("value"), F.size("series").cast("long").alias("n_series"))


@query(
    f"""WITH o AS (SELECT o_orderpriority AS k, CAST(year(o_orderdate) AS DOUBLE) AS x, {_V} AS y FROM orders), m AS (SELECT k, (min(x) + max(x)) / 2 AS mid, (max(x) - min(x)) / 2 AS half FROM o GROUP BY k),
  s AS (SELECT k, any_value(mid) AS mid, any_value(half) AS half, count(*) AS n, sum(t) AS p1, sum(t * t) AS p2, sum(t * t * t) AS p3, sum(t * t * t * t) AS p4, sum(y) AS q0, sum(t * y) AS q1, sum(t * t * y) AS q2, sqrt(sum(y * y)) AS norm, sum(y) AS total, max(y) AS most FROM (SELECT *, (x - mid) / half AS t FROM o JOIN m USING (k)) GROUP BY k),
  d AS (SELECT *, n * (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p3 * p2) + p2 * (p1 * p3 - p2 * p2) AS det FROM s),
  b AS (SELECT *, (q0 * (p2 * p4 - p3 * p3) - p1 * (q1 * p4 - p3 * q2) + p2 * (q1 * p3 - p2 * q2)) / det AS b0, (n * (q1 * p4 - q2 * p3) - q0 * (p1 * p4 - p3 * p2) + p2 * (p1 * q2 - p2 * q1)) / det AS b1, (n * (p2 * q2 - p3 * q1) - p1 * (p1 * q2 - p2 * q1) + q0 * (p1 * p3 - p2 * p2)) / det AS b2 FROM d)
  SELECT k, n, round(b0 + b1 * (1995 - mid) / half + b2 * ((1995 - mid) / half) ** 2, 1) AS at_1995, round(b0 + b1 * (2001 - mid) / half + b2 * ((2001 - mid) / half) ** 2, 1) AS at_2001, round(norm, 1) AS norm_2, most AS norm_inf, round(most / total, 9) AS most_share FROM b"""
)
def polynomial_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadratic through each priority's orders by year, the norms of their prices, and the share of the dearest."""
    (orders,) = read(spark, sf_dir, "orders")
    o = orders.select(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    fit = polynomial.polynomial(o, "k", "x", "y", 2)
    norms = o.groupBy("k").agg(F.round(polynomial.p_norm(F.col("y"), 2), 1).alias("norm_2"), polynomial.p_norm(F.col("y"), float("inf")).alias("norm_inf"))
    share = polynomial.shares(o, "k", "y", "share").groupBy("k").agg(F.round(F.max("share"), 9).alias("most_share"))
    value = lambda x: F.round(polynomial.at(F.col("coefficients"), F.lit(x)), 1).alias(f"at_{x:.0f}")
    return fit.join(norms, "k").join(share, "k").select("k", "n", value(1995.0), value(2001.0), "norm_2", "norm_inf", "most_share")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' units' WHEN 1 THEN 'second' WHEN 2 THEN 'so it is ' || p_size ELSE '' END AS answer FROM part"""
)
def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers marked once, twice, not at all, and with nothing after the mark."""
    (part,) = read(spark, sf_dir, "part")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Think.\n  Answer:  "), size, F.lit(" units \nbye\n"))).when(k == 1, "ANSWER: first\nANSWER: second\n\n").when(k == 2, F.concat(F.lit("The ANSWER: no\nso it is "), size, F.lit("  \n"))).otherwise("x\nanswer:")
    return part.select("p_partkey", answers.last_line(text).alias("answer"))


@query(
    """SELECT o_orderkey, g, label FROM (SELECT o_orderkey, ['monthly_all', 'annual', 'specific_month'][o_orderkey % 3 + 1] AS g, o_custkey % 5 AS k, CASE o_custkey % 5 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN 'Fiscal year ' || year(o_orderdate) WHEN 2 THEN year(o_orderdate) || '-' || strftime(o_orderdate, '%B') WHEN 3 THEN strftime(o_orderdate, '%B') ELSE 'Total ' || year(o_orderdate) END AS label FROM orders)
    WHERE g = 'specific_month' OR (g = 'monthly_all' AND k NOT IN (0, 1)) OR (g = 'annual' AND k NOT IN (2, 3))"""
)
def granular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that belong to what is asked for: months or whole years."""
    (o,) = read(spark, sf_dir, "orders")
    y, m, k = F.year("o_orderdate").cast("string"), F.date_format("o_orderdate", "MMMM"), F.col("o_custkey") % 5
    label = F.when(k == 0, y).when(k == 1, F.concat(F.lit("Fiscal year "), y)).when(k == 2, F.concat_ws("-", y, m)).when(k == 3, m).otherwise(F.concat(F.lit("Total "), y))
    g = F.element_at(F.array(F.lit("monthly_all"), F.lit("annual"), F.lit("specific_month")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", g.alias("g"), label.alias("label")).where(answers.fits_granularity(F.col("label"), F.col("g")))
