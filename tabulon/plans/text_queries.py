"""Queries over documents, conversations, pages and literal fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import labels, numbers
from tabulon.operators import context, fuzzy, grid, hints, index, search
from tabulon.plans.registry import query

_TOK = "list_filter(regexp_split_to_array(translate(lower({0}), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _bm25_sql(texts: str, words: list[str], every: bool) -> str:
    w = ", ".join(f"'{x}'" for x in words)
    return f"""WITH d AS ({texts}), t AS (SELECT id, {_TOK.format("a")} AS x, {_TOK.format("b")} AS y FROM d),
    n AS (SELECT id, len(x) + len(y) AS size FROM t), s AS (SELECT count(*) AS n, avg(size) AS mean FROM n),
    e AS (SELECT id, unnest(x) AS term, 2.0 AS w FROM t UNION ALL SELECT id, unnest(y), 1.5 FROM t),
    f AS (SELECT id, term, sum(w) AS f FROM e WHERE term IN ({w}) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
    SELECT f.id, round(-sum(CASE WHEN ln((s.n - df + 0.5) / (df + 0.5)) > 0 THEN ln((s.n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / s.mean))), 5) AS score
    FROM f JOIN df USING (term) JOIN n USING (id), s GROUP BY f.id {f"HAVING count(*) = {len(words)}" if every else ""}"""


_DOCS = "SELECT doc_id AS id, coalesce(text, '') AS a, coalesce(source, '') AS b FROM documents"


@query(_bm25_sql(_DOCS, ["and", "license", "thonat"], False))
def bm25_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return search.bm25(docs, "doc_id", {"text": 2.0, "source": 1.5}, ["and", "license", "thonat"]).withColumn("score", F.round("score", 5))


@query(_bm25_sql(_DOCS, ["license", "version"], True))
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return search.bm25(docs, "doc_id", {"text": 2.0, "source": 1.5}, ["license", "version"], True).withColumn("score", F.round("score", 5))


@query(f"WITH t AS (SELECT item_id AS id, unnest({_TOK.format('text')}) AS term FROM benchmark) SELECT id, 'text' AS field, term, count(*) AS tf FROM t GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", ["text"])


@query("SELECT doc_id AS id, left(coalesce(text, ''), 500) AS head, n_chars FROM documents WHERE lower(text) LIKE '%license%' ORDER BY n_chars DESC, doc_id LIMIT 20")
def search_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).where(search.contains_all(F.col("text"), ["license"]))
    return found.orderBy(F.desc("n_chars"), "doc_id").limit(20).select(F.col("doc_id").alias("id"), F.left("text", F.lit(500)).alias("head"), "n_chars")


@query("SELECT doc_id, regexp_extract(text, '(?i)licensed[^\\n]*', 0) AS line FROM documents WHERE regexp_matches(text, '(?i)licensed') ORDER BY doc_id LIMIT 20")
def text_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines that match, case-insensitively; 20 at most."""
    d = _documents(spark, sf_dir).where(F.col("text").rlike("(?i)licensed"))
    return d.orderBy("doc_id").limit(20).select("doc_id", F.regexp_extract("text", r"(?i)licensed[^\n]*", 0).alias("line"))


_STAGES = """WITH e AS (SELECT l_orderkey AS id, 0 AS stage, -max(l_quantity) AS score FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 GROUP BY 1
    UNION ALL SELECT l_orderkey, 1, -max(l_quantity) FROM lineitem WHERE l_quantity >= 49 GROUP BY 1 UNION ALL SELECT l_orderkey, 2, -max(l_quantity) FROM lineitem WHERE l_quantity >= 45 GROUP BY 1),
    f AS (SELECT id, min(stage) AS stage FROM e GROUP BY 1), g AS (SELECT e.id, e.stage, min(e.score) AS score FROM e JOIN f ON e.id = f.id AND e.stage = f.stage GROUP BY 1, 2),
    c AS (SELECT stage, count(DISTINCT id) AS hits FROM e GROUP BY 1), n AS (SELECT stage, count(*) AS new FROM g GROUP BY 1),
    o AS (SELECT c.stage, coalesce(max(hits) OVER w, 0) AS h, coalesce(sum(new) OVER w, 0) AS m FROM c LEFT JOIN n USING (stage) WINDOW w AS (ORDER BY c.stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT g.id, CAST(g.stage AS INTEGER) AS stage, CAST(g.score AS DOUBLE) AS score FROM g JOIN o USING (stage) WHERE h < 100 AND m < 60 ORDER BY g.stage, g.score, g.id LIMIT 60"""


@query(_STAGES)
def progressive_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), "l_quantity", "l_returnflag")
    stage = lambda cond: lambda: l.where(cond).groupBy("id").agg((-F.max("l_quantity")).cast("double").alias("score"))
    return search.progressive(spark, [stage("l_returnflag = 'R' and l_quantity = 50"), stage("l_quantity >= 49"), stage("l_quantity >= 45")], 100, 60)


@query("SELECT id, list_no, pos FROM (SELECT id, list_no, pos, row_number() OVER (PARTITION BY id ORDER BY list_no, pos) AS k FROM (SELECT o_custkey AS id, 0 AS list_no, min(o_orderkey) AS pos FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 UNION ALL SELECT o_custkey, 1, min(o_orderkey) FROM orders GROUP BY 1)) WHERE k = 1 ORDER BY list_no, pos, id LIMIT 40")
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = lambda n, df: df.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("pos")).select("id", F.lit(n).alias("list_no"), "pos")
    return search.merge_lists(part(0, o.where("o_orderpriority = '1-URGENT'")).unionByName(part(1, o)), 40)


@query("WITH r AS (SELECT p_partkey AS id, p_brand AS file, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS nth FROM part) SELECT id, file, score, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 2 ORDER BY score DESC, id LIMIT 30")
def capped_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows with at most two of a group."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_retailprice").alias("score"))
    return search.capped(p, "file", 2, 30)


_BONUS = "CASE WHEN o = 0 THEN {0} WHEN o = 1 THEN {1} WHEN o = 2 THEN {2} WHEN o = 3 THEN {3} WHEN o BETWEEN 4 AND 6 THEN {4} WHEN o < 0 AND covers THEN {5} ELSE 0.0 END"


@query(
    f"""WITH g AS (SELECT o_orderkey, ['calendar', 'fiscal', 'unknown'][o_custkey % 3 + 1] AS mode, year(o_orderdate) - 1994 AS o, month(o_orderdate) AS m, o_orderstatus = 'F' AS covers FROM orders),
    x AS (SELECT *, CASE mode WHEN 'calendar' THEN {_BONUS.format(2.0, 6.0, 3.5, 2.5, 1.5, 1.5)} WHEN 'fiscal' THEN {_BONUS.format(6.0, 3.5, 2.5, 2.0, 1.0, 1.5)} ELSE {_BONUS.format(5.0, 4.5, 3.0, 2.5, 1.5, 2.0)} END AS base FROM g)
    SELECT o_orderkey, mode, CAST(base + CASE WHEN base <= 0 THEN 0 WHEN mode = 'calendar' THEN CASE WHEN o = 1 AND m <= 3 THEN 2 WHEN o = 1 AND m <= 6 THEN 1 WHEN o = 0 AND m >= 6 THEN 0.5 ELSE 0 END
    WHEN mode = 'fiscal' THEN CASE WHEN o = 0 AND m BETWEEN 7 AND 10 THEN 2 WHEN o = 0 AND m >= 7 THEN 1 ELSE 0 END ELSE CASE WHEN o = 0 AND m >= 6 THEN 0.5 ELSE 0 END END AS DOUBLE) AS bonus FROM x"""
)
def file_year_bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues of their month, held against the year 1994."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mode = F.element_at(F.array(F.lit("calendar"), F.lit("fiscal"), F.lit("unknown")), (F.col("o_custkey") % 3 + 1).cast("int"))
    bonus = search.file_year_bonus(mode, F.year("o_orderdate") - 1994, F.month("o_orderdate"), F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", mode.alias("mode"), bonus.alias("bonus"))


@query(
    """WITH s AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked,
    last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_turn FROM conversations)
    SELECT conv_id, turn, asked, prior_turn FROM s"""
)
def latched_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the user's last words before it, and the last earlier user turn (an as-of look-up)."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    s = context.latched(c, ["conv_id"], "turn", "role", "text", "user", "asked")
    return context.prior(s, ["conv_id"], "turn", F.col("role") == "user", "prior_turn").select("conv_id", "turn", "asked", "prior_turn")


@query(
    """WITH e AS (SELECT user_id, event_id AS seq, event_type FROM events), p AS (SELECT l.user_id, l.seq AS l_seq, r.seq AS r_seq, row_number() OVER (PARTITION BY l.user_id, l.seq ORDER BY abs(l.seq - r.seq), r.seq) AS k
    FROM e l JOIN e r ON l.user_id = r.user_id AND abs(l.seq - r.seq) <= 200 AND l.event_type = 'click' AND r.event_type = 'purchase')
    SELECT l.user_id, l.seq AS l_seq, p.r_seq FROM e l LEFT JOIN p ON l.user_id = p.user_id AND l.seq = p.l_seq AND p.k = 1 WHERE l.event_type = 'click'"""
)
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("seq"), "event_type")
    return context.nearest(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], 200)


@query(
    """WITH r AS (SELECT l_orderkey AS table_id, l_linenumber AS row_index, CASE WHEN l_linestatus = 'O' AND l_linenumber % 3 = 1 THEN CAST(year(l_shipdate) AS INTEGER) END AS year, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(l_returnflag = 'A' AS INTEGER) AS is_section FROM (SELECT l_orderkey, l_linenumber, max(l_linestatus) AS l_linestatus, max(l_shipdate) AS l_shipdate, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)),
    g AS (SELECT *, sum(is_section) OVER (PARTITION BY table_id ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS g FROM r),
    f AS (SELECT *, last_value(CASE WHEN is_section = 0 THEN year END IGNORE NULLS) OVER (PARTITION BY table_id, g ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g)
    SELECT table_id, row_index, CASE WHEN is_section = 0 AND year IS NULL AND month IS NOT NULL THEN prev ELSE year END AS year, month, is_section FROM f"""
)
def year_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_linestatus", "l_shipdate", "l_returnflag")))
    rows = l.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_index"), F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 3 == 1), F.year("l_shipdate")).alias("year"), F.month("l_shipdate").alias("month"), (F.col("l_returnflag") == "A").cast("int").alias("is_section"))
    return context.year_propagated(rows)


@query("SELECT source, lang, count(*) AS n, grouping(source) + grouping(lang) AS level FROM documents GROUP BY CUBE (source, lang)")
def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).cube("source", "lang").agg(F.count("*").alias("n"), (F.grouping("source") + F.grouping("lang")).cast("long").alias("level"))


_SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '\\s*\\d+/', '', 'g'), '[^\\w\\s\\-]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_SLUG} AS slug FROM (SELECT p_partkey, p_name || '  ' || p_size || '/ (' || p_brand || '), ' || p_type AS x FROM part)")
def metric_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    x = F.concat(F.col("p_name"), F.lit("  "), F.col("p_size").cast("string"), F.lit("/ ("), F.col("p_brand"), F.lit("), "), F.col("p_type"))
    return p.select("p_partkey", labels.slug(x).alias("slug"))


@query(
    """SELECT o_orderkey, CAST(nullif(regexp_extract(x, '\\b(1[89]\\d{2}|20[0-3]\\d)\\b', 1), '') AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
    CASE WHEN o_orderkey % 3 = 0 THEN 'fiscal' ELSE 'unknown' END AS period, substr(sha1(regexp_replace(lower(trim(x)) || '||', '\\s+', ' ', 'g')), 1, 16) AS signature
    FROM (SELECT *, monthname(o_orderdate) || ' ' || year(o_orderdate) || CASE WHEN o_orderkey % 3 = 0 THEN ', fiscal year' ELSE '' END AS x FROM orders)"""
)
def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x = F.concat(F.date_format("o_orderdate", "MMMM yyyy"), F.when(F.col("o_orderkey") % 3 == 0, ", fiscal year").otherwise(""))
    none = F.lit(None).cast("string")
    return o.select("o_orderkey", labels.year_of(x).alias("year"), labels.month_of(x).alias("month"), labels.period_of(x).alias("period"), labels.signature(x, none, none).alias("signature"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN -v WHEN k = 4 THEN NULL ELSE v END AS numeric_value, CASE WHEN k = 4 THEN 'missing' ELSE 'ok' END AS parse_status, CAST(k = 1 AS INTEGER) AS has_footnote,
    CAST(k = 2 AS INTEGER) AS is_revised, CAST(k = 3 AS INTEGER) AS is_percent, CASE WHEN k = 4 THEN 0 ELSE CAST(v = 0 AS INTEGER) END AS is_zero FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice, 2) AS DOUBLE) AS v, (l_orderkey + l_linenumber) % 6 AS k FROM lineitem)"""
)
def cell_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices printed as cells print them - brackets, footnotes, marks, blanks - and read back."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.format_number(F.round("l_extendedprice", 2), 2).alias("v"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).alias("k"))
    printed = F.when(F.col("k") == 0, F.concat(F.lit("("), "v", F.lit(")"))).when(F.col("k") == 1, F.concat("v", F.lit(" 12/"))).when(F.col("k") == 2, F.concat(F.lit("$"), "v", F.lit(" r"))).when(F.col("k") == 3, F.concat("v", F.lit("%"))).when(F.col("k") == 4, "n.a.").otherwise(F.concat("v", F.lit(" million")))
    c = numbers.with_cells(l.select("l_orderkey", "l_linenumber", printed.alias("raw")), "raw")
    return c.select("l_orderkey", "l_linenumber", "numeric_value", "parse_status", "has_footnote", "is_revised", "is_percent", "is_zero")


@query(
    """SELECT p_partkey, s, t, round(CASE WHEN s IS NULL OR sm IS NULL OR s = t THEN v WHEN t IS NULL THEN CASE WHEN s = 'percent' THEN v ELSE v * sm END WHEN (s = 'percent') <> (t = 'percent') OR tm IS NULL THEN v ELSE v * (sm / tm) END, 6) AS out
    FROM (SELECT *, CASE s WHEN 'thousands' THEN 1e3 WHEN 'millions' THEN 1e6 WHEN 'billions' THEN 1e9 WHEN 'percent' THEN 1.0 END AS sm, CASE t WHEN 'thousands' THEN 1e3 WHEN 'millions' THEN 1e6 WHEN 'billions' THEN 1e9 WHEN 'percent' THEN 1.0 END AS tm
    FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS v, ['thousands', 'millions', 'billions', 'percent', 'index', NULL][p_partkey % 6 + 1] AS s, ['thousands', 'millions', 'billions', 'percent', 'count', NULL][p_size % 6 + 1] AS t FROM part))"""
)
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts from one unit to another."""
    unit = lambda n, *names: F.element_at(F.array(*(F.lit(x) for x in names)), (n % 6 + 1).cast("int"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"), unit(F.col("p_partkey"), "thousands", "millions", "billions", "percent", "index", None).alias("s"), unit(F.col("p_size"), "thousands", "millions", "billions", "percent", "count", None).alias("t"))
    return p.select("p_partkey", "s", "t", F.round(numbers.convert_unit(F.col("v"), F.col("s"), F.col("t")), 6).alias("out"))


@query(
    """WITH p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, avg(o_totalprice) AS level FROM orders GROUP BY 1)
    SELECT a.y, round(100.0 * (SELECT level FROM p WHERE y = 1999) / a.level, 4) AS adjusted FROM p a"""
)
def price_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred of each year at the level of 1999: the series is a row a year, so both look-ups are broadcast."""
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("level"))
    target = p.where("y = 1999").select(F.col("level").alias("target"))
    return p.crossJoin(F.broadcast(target)).select("y", F.round(numbers.adjusted(F.lit(100.0), F.col("level"), F.col("target")), 4).alias("adjusted"))


@query(
    """WITH r AS (SELECT c_custkey AS q, (c_custkey * 7919) % 37 + 1 AS rank FROM customer) SELECT avg(CAST(rank <= 1 AS INTEGER)) AS recall_1, avg(CAST(rank <= 5 AS INTEGER)) AS recall_5, avg(CAST(rank <= 10 AS INTEGER)) AS recall_10, round(sum(1.0 / rank) / count(*), 6) AS mrr,
    CAST(count(*) FILTER (rank <= 5) AS BIGINT) AS top_5, CAST(count(*) FILTER (rank BETWEEN 6 AND 20) AS BIGINT) AS top_20, CAST(count(*) FILTER (rank > 20) AS BIGINT) AS beyond FROM r"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.operators import evaluation

    r = spark.read.parquet(f"{sf_dir}/customer.parquet").select(((F.col("c_custkey") * 7919) % 37 + 1).alias("rank"))
    return evaluation.retrieval(r)


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(CASE WHEN k = greatest(1, CAST(ceil(0.5 * n) AS BIGINT)) THEN value END) AS p50, max(CASE WHEN k = greatest(1, CAST(ceil(0.95 * n) AS BIGINT)) THEN value END) AS p95 FROM r GROUP BY 1"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By nearest rank, not interpolated."""
    from tabulon.operators import evaluation

    return evaluation.nearest_rank(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value", "event_id", {"p50": 0.5, "p95": 0.95})


@query(
    """SELECT CASE WHEN g IS NULL THEN 'no_value' WHEN abs(g - e) <= abs(e) * 1e-4 OR abs(g - e) <= 1e-6 THEN 'right' WHEN r BETWEEN 900 AND 1100 OR r BETWEEN 0.0009 AND 0.0011 OR r BETWEEN 9e5 AND 1.1e6 OR r BETWEEN 9e-7 AND 1.1e-6 THEN 'unit_error'
    WHEN k = 4 THEN 'period_error' WHEN r > 1.5 OR r < 0.67 THEN 'wrong_cell' ELSE 'near_miss' END AS class, count(*) AS n FROM (SELECT *, abs(g / nullif(e, 0)) AS r FROM (SELECT o_totalprice AS e, o_orderkey % 7 AS k,
    CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN o_totalprice WHEN 2 THEN o_totalprice * 1000 WHEN 3 THEN o_totalprice / 1e6 WHEN 4 THEN o_totalprice * 1.2 WHEN 5 THEN o_totalprice * 3 ELSE o_totalprice * 1.1 END AS g FROM orders)) GROUP BY 1"""
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_totalprice").alias("e"), (F.col("o_orderkey") % 7).alias("k"))
    g = F.when(F.col("k") == 1, F.col("e")).when(F.col("k") == 2, F.col("e") * 1000).when(F.col("k") == 3, F.col("e") / 1e6).when(F.col("k") == 4, F.col("e") * 1.2).when(F.col("k") == 5, F.col("e") * 3).when(F.col("k") == 6, F.col("e") * 1.1)
    return o.select(numbers.error_class(F.col("e"), g, F.when(F.col("k") == 4, "fiscal")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS g, first(u) AS unit FROM (SELECT c_nationkey, c_mktsegment AS u, count(*) AS n, min(c_custkey) AS p FROM customer GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, p) = 1) GROUP BY 1")
def majority_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value; of equals the one seen first."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("g"), "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("p"))
    return c.groupBy("g").agg(F.max_by("c_mktsegment", F.struct("n", -F.col("p"))).alias("unit"))


@query("SELECT r_name AS region, n_nationkey AS row_key, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations printed as one HTML table a region, its name spanning the rows, and read back through the table function."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    line = F.transform("x", lambda x, i: F.concat(F.when(i == 0, F.concat(F.lit("<tr><td rowspan='"), F.size("x").cast("string"), F.lit("'>"), F.col("r_name"), F.lit("</td>"))).otherwise("<tr>"), F.lit("<td>"), x["n_nationkey"].cast("string"), F.lit("</td><td> <b>"), x["n_name"], F.lit("</b></td></tr>")))
    pages = rows.select(F.col("r_regionkey").alias("page_id"), F.concat(F.lit("<html><table><tr><th>Region</th><th colspan='2'>Nation</th></tr>"), F.array_join(line, ""), F.lit("</table></html>")).alias("html"))
    g = grid.html_grid(spark, pages, "page_id", "html").where("not is_header_row")
    wide = g.groupBy("id", "row_index").agg(*(F.max(F.when(F.col("col_index") == i, F.col("text"))).alias(f"c{i}") for i in range(3)))
    return wide.select(F.col("c0").alias("region"), F.col("c1").cast("int").alias("row_key"), F.col("c2").alias("label"))


@query()
def fuzzy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels most like a hint, by words in any order and by several likenesses. Distinct labels are scored, not rows."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("label")).distinct()
    hint = F.lit("promo ring small")
    scored = p.select("label", fuzzy.token_set_ratio("label", hint).alias("token_set"), fuzzy.weighted_ratio("label", hint).alias("weighted"), fuzzy.sequence_ratio("label", hint).alias("sequence"))
    return scored.where("token_set >= 60")


@query()
def stemmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", fuzzy.stems(search.tokens(F.col("text"))).alias("terms"))
    return b.select("item_id", F.explode("terms").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"))


@query()
def formatted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return o.select("o_orderkey", fuzzy.format_result(F.col("o_totalprice") / 7, F.lit("hundredths")).alias("answer"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ext_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT row_label, year, value FROM (SELECT o_orderpriority AS row_label, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def ext_streamed_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of a key, kept by a stream over the order files."""
    from tabulon.streaming import supersede

    return supersede.latest_orders(spark, sf_dir)


def _index(spark: SparkSession, sf_dir: str, stem: bool) -> index.Index:
    docs = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"), "source")
    return index.index(spark, (sf_dir, "documents"), docs, "doc_id", ["content", "source"], stem)


@query(_bm25_sql(_DOCS, ["license", "version"], True))
def stored_index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as bm25_all from a stored index, of which the question's buckets are read."""
    return index.match(_index(spark, sf_dir, False), {"content": 2.0, "source": 1.5}, ["license", "version"], True).withColumn("score", F.round("score", 5))


@query()
def fts_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages over the stemmed index, run while the pool isn't full: all words, all words or what means the same, any word."""
    ix = _index(spark, sf_dir, True)
    find = lambda words, every: lambda: index.match(ix, {"content": 2.0, "source": 1.5}, words, every)
    same = [x for w in ("licensing", "versions") for x in [w, *hints.synonyms(w)] if " " not in x]
    return search.progressive(spark, [find(["licensing", "versions"], True), find(same, True), find(same, False)], 100, 60)
