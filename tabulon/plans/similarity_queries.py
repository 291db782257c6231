"""Hints and labels that are alike, held against all pairs in SQL: the longest common subsequence there is a fold over bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import bottom_up, similarity
from tabulon.plans.registry import query
from tabulon.sources.ledger import LEDGER_SQL as L
from tabulon.sources.ledger import demo_ledger, read


def hints_and_slugs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Slugs: names with type and brand; hints: of the first part of each size, its words reversed, run together, with a letter
    missing, or type and brand alone."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", *(F.lower(c).alias(c) for c in ("p_name", "p_type", "p_brand")))
    first = p.groupBy("p_size").agg(F.min_by(F.struct("p_name", "p_type", "p_brand"), "p_partkey").alias("x")).select("p_size", "x.*")
    k = F.col("p_size") % 4
    ways = F.when(k == 0, F.array_join(F.reverse(F.split("p_name", " ")), " ")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit(""))).when(k == 2, F.concat(F.left("p_name", F.lit(1)), F.substring("p_name", 3, 99), F.lit(" "), "p_type")).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    return first.select(ways.alias("hint")).distinct(), p.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("label")).distinct()


_FIRST = "f AS (SELECT p_size, lower(arg_min(p_name, p_partkey)) AS n, lower(arg_min(p_type, p_partkey)) AS t, lower(arg_min(p_brand, p_partkey)) AS b FROM part GROUP BY 1)"
_HINTS = "hints AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN array_to_string(list_reverse(string_split(n, ' ')), ' ') WHEN 1 THEN replace(n, ' ', '') WHEN 2 THEN left(n, 1) || substring(n, 3) || ' ' || t ELSE t || ' ' || b END AS hint FROM f)"
_SORTED = "array_to_string(list_sort({0}), ' ')"
#: The longest common subsequence of two texts of 60 characters or fewer.
_LCS = """(CASE WHEN a = '' OR z = '' THEN 0 ELSE len(a) - bit_count(list_reduce(list_transform(range(1, len(z) + 1), lambda j: CAST(list_sum(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN substring(a, i, 1) = substring(z, j, 1) THEN 1::BIGINT << (i - 1) ELSE 0 END)) AS BIGINT)),
  lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << len(a)) - 1), (1::BIGINT << len(a)) - 1)) END)"""
_PAIRS = f"""p AS (SELECT hint, label, list_distinct(string_split(hint, ' ')) AS w, list_distinct(string_split(label, ' ')) AS x FROM hints, labels),
  s AS (SELECT hint, label, {_SORTED.format("list_intersect(w, x)")} AS shared, {_SORTED.format("list_filter(w, lambda t: NOT list_contains(x, t))")} AS a, {_SORTED.format("list_filter(x, lambda t: NOT list_contains(w, t))")} AS z FROM p),
  c AS (SELECT *, len(shared) AS h, {_LCS} AS common FROM s),
  e AS (SELECT *, h + CASE WHEN h > 0 AND a <> '' THEN 1 ELSE 0 END + len(a) AS n, h + CASE WHEN h > 0 AND z <> '' THEN 1 ELSE 0 END + len(z) AS m FROM c),
  alike AS (SELECT hint, label, CASE WHEN h > 0 AND (a = '' OR z = '') THEN 100.0 ELSE greatest(200.0 * h / (h + n), 200.0 * h / (h + m), 200.0 * (CASE WHEN h > 0 THEN h + 1 ELSE 0 END + common) / (n + m)) END AS likeness FROM e)"""


@query(
    f"""WITH {_FIRST}, {_HINTS}, labels AS (SELECT DISTINCT lower(p_name || ' ' || p_type || ' ' || p_brand) AS label FROM part), {_PAIRS}
  SELECT hint, label, round(likeness, 6) AS likeness FROM alike WHERE likeness >= 60 - 1e-9"""
)
def hint_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slugs that are like a hint by 60 or more."""
    return similarity.alike(*hints_and_slugs(spark, sf_dir)).withColumn("likeness", F.round("likeness", 6))


@query(
    f"""WITH {_FIRST}, {_HINTS}, labels AS (SELECT DISTINCT lower(p_name || ' ' || p_type || ' ' || p_brand) AS label FROM part), {_PAIRS}
  SELECT hint, label, round(likeness, 6) AS likeness, row_number() OVER (PARTITION BY hint ORDER BY round(likeness, 9) DESC, label) AS place FROM alike WHERE likeness >= 65 - 1e-9 QUALIFY place <= 5"""
)
def hint_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five slugs most like each hint, of those by 65 or more."""
    return similarity.nearest(*hints_and_slugs(spark, sf_dir), 5, 65.0).withColumn("likeness", F.round("likeness", 6))


_UP_REQUESTS = """r AS (SELECT item_id AS q, CASE item_id % 5 WHEN 0 THEN array_to_string(list_reverse(string_split(n, ' ')), ' ') WHEN 1 THEN left(n, len(n) - 1) WHEN 2 THEN 'orders ' || n WHEN 3 THEN 'qqq' ELSE ' ' END AS hint,
    CASE item_id % 4 WHEN 0 THEN 'segment' WHEN 1 THEN 'payroll' WHEN 2 THEN n || ' 7' END AS topic, CASE WHEN item_id % 7 = 6 THEN CAST([] AS INTEGER[]) WHEN item_id % 2 = 0 THEN [1992 + item_id % 7] ELSE [1993 + item_id % 7, 1994 + item_id % 7] END AS years
  FROM (SELECT item_id, lower(r_name) AS n FROM benchmark JOIN region ON r_regionkey = item_id % 5)),
  pr AS (SELECT q, 0 AS stage, trim(hint) AS hint, 60.0 AS least FROM r UNION SELECT q, 1, topic, 55.0 FROM r WHERE topic IS NOT NULL UNION SELECT q, 2, unnest(string_split(topic, ' ')), 55.0 FROM r
    UNION SELECT q, 2, unnest(list_transform(range(1, len(string_split(topic, ' '))), lambda i: string_split(topic, ' ')[i] || ' ' || string_split(topic, ' ')[i + 1])), 55.0 FROM r),
  hints AS (SELECT DISTINCT hint FROM pr WHERE hint <> ''), labels AS (SELECT DISTINCT metric_slug AS label FROM rws)"""


@query(
    L
    + f""", {_UP_REQUESTS}, {_PAIRS},
  n0 AS (SELECT q, stage, label, max(likeness) AS likeness FROM pr JOIN alike USING (hint) WHERE likeness >= least - 1e-9 GROUP BY ALL),
  near AS (SELECT q, rws.table_id, rws.id AS row_id, likeness, years, topic FROM (SELECT * FROM n0 QUALIFY stage = min(stage) OVER (PARTITION BY q)) JOIN rws ON metric_slug = label JOIN r USING (q)),
  words AS (SELECT id AS table_id, unnest(string_split(lower(title), ' ')) AS w FROM tables UNION SELECT table_id, unnest(regexp_split_to_array(lower(row_path), '[^a-z0-9]+')) FROM rws UNION SELECT table_id, unnest(regexp_split_to_array(lower(col_path), '[^a-z0-9]+')) FROM cols),
  own AS (SELECT near.*, NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(topic, ' ')) AS t) WHERE t NOT IN (SELECT w FROM words x WHERE x.table_id = near.table_id)) AND topic IS NOT NULL AS told FROM near WHERE len(years) = 0 OR table_id IN (SELECT table_id FROM cols WHERE list_contains(years, year_extracted))),
  hits AS (SELECT * FROM own QUALIFY told OR NOT bool_or(told) OVER (PARTITION BY q)),
  g AS (SELECT q, h.table_id AS id, max(likeness) AS likeness, count(*) AS n_cells FROM hits h JOIN cells x ON x.table_id = h.table_id AND x.row_id = h.row_id JOIN cols c ON c.id = x.col_id WHERE x.numeric_value IS NOT NULL AND (len(years) = 0 OR list_contains(years, year_extracted)) GROUP BY ALL),
  top AS (SELECT g.*, title, file_year, file_month FROM g JOIN tables USING (id) QUALIFY row_number() OVER (PARTITION BY q, signature ORDER BY file_year DESC, file_month DESC, id DESC) = 1)
  SELECT q, id, title, n_cells, round(likeness, 6) AS likeness, row_number() OVER (PARTITION BY q ORDER BY file_year DESC, file_month DESC, id DESC) AS place FROM top QUALIFY place <= 20"""
)
def bottom_up_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request an item: hints in another order, cut short, with a word too many, unknown or blank; topics that tables have or not."""
    items, region = read(spark, sf_dir, "benchmark", "region")
    i, n = F.col("item_id"), F.lower("r_name")
    short = F.left(n, F.length(n) - 1)
    hint = F.when(i % 5 == 0, F.array_join(F.reverse(F.split(n, " ")), " ")).when(i % 5 == 1, short).when(i % 5 == 2, F.concat(F.lit("orders "), n)).when(i % 5 == 3, "qqq").otherwise(" ")
    topic = F.when(i % 4 == 0, "segment").when(i % 4 == 1, "payroll").when(i % 4 == 2, F.concat(n, F.lit(" 7")))
    y = (1992 + i % 7).cast("int")
    years = F.when(i % 7 == 6, F.array().cast("array<int>")).when(i % 2 == 0, F.array(y)).otherwise(F.array(y + 1, y + 2))
    asked = items.join(region, F.col("r_regionkey") == i % 5).select(i.alias("q"), hint.alias("hint"), topic.alias("topic"), years.alias("years"))
    return bottom_up.retrieve(demo_ledger(spark, sf_dir), asked).select("q", "id", "title", "n_cells", F.round("likeness", 6).alias("likeness"), "place")
