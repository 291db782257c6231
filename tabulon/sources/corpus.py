"""Parsed-document files: scan, elements in order, and the ledger that they give.

A table's number is its issue, its file's place among the files of that issue and its place in the file, so later tables have
greater numbers and nothing depends on the run. Tables go through two parsers: the grid's, and a lenient one that splits at
row and cell tags; the second is taken only where the first finds nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import labels, numbers
from tabulon.operators import context, grid, layers
from tabulon.sources.ledger import Ledger

SCHEMA = "document struct<elements: array<struct<type: string, id: string, content: string, bbox: array<struct<page_id: string>>>>, pages: array<struct<id: string, page_id: string, image_uri: string>>>"


def scan(spark: SparkSession, paths: str | list[str], first: int = 0) -> DataFrame:
    """file, document of JSON files, one document each; files are read whole, in parallel. With first, only so many, the first by name: names
    are listed before anything is read."""
    if first:
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        found = [s.getPath() for p in ([paths] if isinstance(paths, str) else paths) for s in fs_path(p).getFileSystem(conf).globStatus(fs_path(p)) or []]
        paths = [p.toString() for p in sorted(found, key=lambda p: p.getName())[:first]]
    return spark.read.schema(SCHEMA).option("multiLine", True).json(paths).select(F.col("_metadata.file_name").alias("file"), "document")


def elements(docs: DataFrame) -> DataFrame:
    """A row an element: file, element_seq, element_id, kind, content, page_id, file_year, file_month."""
    e = docs.select("file", F.posexplode("document.elements").alias("element_seq", "e"))
    period = labels.file_period(F.col("file"))
    page = F.get("e.bbox", F.lit(0))["page_id"].try_cast("int")
    return e.select("file", "element_seq", F.col("e.id").alias("element_id"), F.col("e.type").alias("kind"), F.coalesce("e.content", F.lit("")).alias("content"), page.alias("page_id"), period["year"].alias("file_year"), period["month"].alias("file_month"))


def fetched(e: DataFrame, places: DataFrame) -> DataFrame:
    """file, element_seq, html of tables at given places; empty where no table stands there."""
    tables = e.where("kind = 'table'").select("file", "element_seq", F.col("content").alias("html"))
    return places.select("file", "element_seq").distinct().join(tables, ["file", "element_seq"], "left").fillna("", ["html"])


@dataclass(frozen=True)
class Ingested(Ledger):
    prose: DataFrame
    footnotes: DataFrame
    pages: DataFrame
    invariants: DataFrame


NAMES = ("tables", "rows", "columns", "cells", "prose", "footnotes", "pages", "invariants")
REACH = 5  #: fixed value: places on a page within which prose belongs to a table


def numbered(e: DataFrame) -> DataFrame:
    """Adds id: 18 bits of the issue, 22 of the file's place in it, 22 of the element's place. Files that bring their place (file_no) keep it."""
    issue = F.coalesce(F.col("file_year") * 100 + F.col("file_month"), F.lit(0)).cast("long")
    if "file_no" in e.columns:
        return e.withColumn("id", F.shiftleft(issue, 44) + F.shiftleft(F.col("file_no").cast("long"), 22) + F.col("element_seq") + 1).drop("file_no")
    files = e.select("file", issue.alias("issue")).distinct()
    files = files.withColumn("file_no", F.row_number().over(Window.partitionBy("issue").orderBy("file")))
    number = F.shiftleft(F.col("issue"), 44) + F.shiftleft(F.col("file_no").cast("long"), 22) + F.col("element_seq") + 1
    return e.join(files, "file").withColumn("id", number).drop("issue", "file_no")


def _held(e: DataFrame) -> DataFrame:
    """Elements with the title and section in force."""
    for kind, out in (("title", "title"), ("section_header", "section")):
        e = context.latched(e, ["file"], "element_seq", "kind", "content", kind, out)
    return e


def raw_tables(e: DataFrame) -> DataFrame:
    """Tables with title, section, caption and html."""
    captions = context.captions(e.select("file", F.col("element_seq").alias("seq"), F.col("page_id").alias("page"), "kind", "content")).select("file", F.col("seq").alias("element_seq"), "caption")
    return numbered(_held(e).where("kind = 'table'").join(captions, ["file", "element_seq"])).withColumnRenamed("content", "html")


def _row_parts(html: Column) -> Column:
    return F.slice(F.split(html, r"(?i)<tr\b"), 2, 1 << 30)


def lenient_shape(html: Column) -> Column:
    """struct(n_data_rows, n_cols) by tags alone."""
    rows = _row_parts(html)
    span = lambda tag: F.greatest(F.coalesce(F.regexp_extract(tag, r"(?i)\bcolspan\s*=\s*[\"']?(\d{1,4})", 1).try_cast("int"), F.lit(1)), F.lit(1))
    width = lambda row: F.aggregate(F.transform(F.regexp_extract_all(row, F.lit(r"(?i)<t[dh]\b[^>]*"), F.lit(0)), span), F.lit(0), lambda a, x: a + x)
    return F.struct(F.size(F.filter(rows, lambda r: r.rlike(r"(?i)<td\b"))).alias("n_data_rows"), F.coalesce(F.array_max(F.transform(rows, width)), F.lit(0)).alias("n_cols"))


def lenient_grid(t: DataFrame) -> DataFrame:
    """A grid without spans: each row's cells from the left."""
    rows = t.select("id", F.posexplode(_row_parts(F.col("html"))).alias("row_index", "row"))
    cells = rows.select("id", "row_index", (F.col("row").rlike(r"(?i)<th\b") & ~F.col("row").rlike(r"(?i)<td\b")).alias("is_header_row"), F.posexplode(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]\b|</tr\b|$)"), F.lit(1))).alias("col_index", "text"))
    plain = F.regexp_replace("text", r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    text = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return cells.select("id", F.lit(0).alias("table_no"), "row_index", "col_index", text.alias("text"), F.lit(True).alias("is_origin"), "is_header_row", F.lit(0).alias("indent"))


def cross_checked(t: DataFrame, g: DataFrame) -> DataFrame:
    """Adds parse_method, parse_ok, n_rows and n_cols: the parsers agree if data rows and columns differ by one at most."""
    first = g.groupBy("id").agg((F.max("row_index") + 1).alias("g_rows"), (F.max("col_index") + 1).alias("g_cols"), F.min(F.when(~F.col("is_header_row"), F.col("row_index"))).alias("top"))
    j = t.join(first, "id", "left").withColumn("s", lenient_shape(F.col("html")))
    one, two = F.col("g_rows").isNotNull(), F.col("s.n_cols") > 0
    close = (F.abs(F.col("g_rows") - F.coalesce("top", "g_rows") - F.col("s.n_data_rows")) <= 1) & (F.abs(F.col("g_cols") - F.col("s.n_cols")) <= 1)
    # fixed values: the names of the outcomes
    method = F.when(~one & ~two, "fail").when(~one, "pandas_only").when(~two, "lxml_only").when(close, "dual_agree").otherwise("dual_disagree")
    rows = F.when(one, F.col("g_rows")).when(two, F.size(_row_parts(F.col("html")))).otherwise(0)
    return j.withColumn("parse_method", method).withColumn("parse_ok", (one | two).cast("int")).withColumn("n_rows", rows).withColumn("n_cols", F.when(one, F.col("g_cols")).otherwise(F.col("s.n_cols"))).drop("g_rows", "g_cols", "top", "s")


def _described(t: DataFrame, g: DataFrame) -> DataFrame:
    """Unit and period of the first four rows of the grid, else of what stands around; HTML only where parsers don't agree."""
    top = g.where("row_index < 4 and text <> ''").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "col_index", "text"))), lambda x: x["text"]), " ").alias("top"))
    around = F.concat_ws(" ", "caption", "section", "title")
    where = [F.col(c) for c in ("title", "section", "caption")]
    inner = labels.period_of(F.col("top"))
    out = t.join(top, "id", "left").select(
        "id", "file", "element_seq", "page_id", "file_year", "file_month", "title", "section", "caption", labels.signature(*where).alias("signature"), labels.kind_of(*where).alias("table_kind"),
        F.coalesce(labels.unit_of(F.col("top")), labels.unit_of(around)).alias("unit"), F.when(inner != "unknown", inner).otherwise(labels.period_of(around)).alias("period"), F.when(F.col("html") != "", F.sha2("html", 256)).alias("source_sha256"),
        "parse_method", "parse_ok", "n_rows", "n_cols", F.when(F.col("parse_method") != "dual_agree", F.col("html")).alias("html"),
    )
    return context.continued(out)


def _once(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, as an insert that ignores what is there."""
    order = Window.partitionBy(*keys).orderBy(F.to_json(F.struct(*df.columns)))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ingest(spark: SparkSession, e: DataFrame, pages: DataFrame | None, keep: Callable[[str, DataFrame], DataFrame]) -> Ingested:
    """The ledger of elements (and of pages: file, page_id, image_uri). keep writes a table under a name and gives it back from
    there, so that the parsers run once and a lost executor costs no more than the table in work."""
    raw = keep("raw_tables", raw_tables(e))
    first = keep("first_grid", grid.html_grid(spark, raw, "id", "html").where("table_no = 0"))
    checked = cross_checked(raw, first)
    rescued = lenient_grid(checked.where("parse_method = 'pandas_only'").select("id", "html"))
    g = keep("grid", first.unionByName(rescued))
    tables = keep("tables", _described(checked, g))

    c = grid.column_paths(g).select(F.col("id").alias("table_id"), "col_index", "col_path", "col_leaf", labels.year_of(F.col("col_path")).alias("year"), labels.month_of(F.col("col_path")).alias("month"))
    dated = context.title_months(c.select("table_id", "col_index", "year", "month"), tables.select(F.col("id").alias("table_id"), "title"))
    columns = keep("columns", c.drop("year", "month").join(dated, ["table_id", "col_index"]).select(F.xxhash64("table_id", "col_index").alias("id"), "table_id", "col_index", "col_path", "col_leaf", F.col("year").alias("year_extracted"), F.col("month").alias("month_extracted")))
    r = grid.row_entries(g).select(F.col("id").alias("table_id"), "row_index", "row_leaf", "row_path", "indent", "is_section", labels.year_of(F.col("row_leaf")).alias("year"), labels.month_of(F.col("row_leaf")).alias("month"))
    r = context.year_propagated(r)
    rows = keep("rows", r.select(F.xxhash64("table_id", "row_index").alias("id"), "table_id", "row_index", "row_path", "row_leaf", "indent", F.col("year").alias("year_extracted"), F.col("month").alias("month_extracted"), F.col("is_section").alias("is_section_header"), labels.slug(F.col("row_leaf")).alias("metric_slug")))

    body = g.where("not is_header_row and col_index > 0").select(F.col("id").alias("table_id"), "row_index", "col_index", F.col("text").alias("raw_value"))
    placed = body.join(rows.select("table_id", "row_index", F.col("id").alias("row_id")), ["table_id", "row_index"]).join(columns.select("table_id", "col_index", F.col("id").alias("col_id")), ["table_id", "col_index"])
    cells = keep("cells", numbers.with_cells(placed, "raw_value"))

    count = lambda df, key, **what: df.groupBy(F.col(key).alias("id")).agg(*(x.alias(k) for k, x in what.items()))
    made = raw.select("id", F.size(F.regexp_extract_all("html", F.lit(r"(?i)<t[dh]\b"), F.lit(0))).cast("long").alias("raw_html_cells"))
    for part in (count(g, "id", n_origin_cells=F.count_if("is_origin")), count(columns, "table_id", n_column_cells=F.count("*")), count(rows, "table_id", n_row_labels=F.count("*"), n_section_hdr=F.count_if(F.col("is_section_header") == 1)), count(cells, "table_id", n_data_cells=F.count("*"))):
        made = made.join(part, "id", "left")
    made = made.join(tables.where("parse_ok = 1").select("id"), "id", "left_semi").fillna(0).withColumnRenamed("id", "table_id").withColumn("delta", F.col("raw_html_cells") - F.col("n_origin_cells"))
    invariants = keep("invariants", made.withColumn("ok", (F.col("delta") == 0).cast("int")))

    text = _held(e).where("kind in ('text', 'footnote', 'page_header', 'page_footer')").withColumn("content", F.trim("content")).where("content <> ''")
    at = tables.select("file", F.col("page_id").alias("page"), F.col("element_seq").alias("seq"), F.col("id").alias("t")).where("page is not null")
    told = text.where("kind = 'text'")
    near = context.nearest(told.where("page_id is not null").select("file", F.col("page_id").alias("page"), F.col("element_seq").alias("seq")), at, ["file", "page"], REACH).join(at.withColumnRenamed("seq", "r_seq"), ["file", "page", "r_seq"]).select("file", F.col("l_seq").alias("element_seq"), F.col("t").alias("near_table_id"))
    prose = keep("prose", _once(told.join(near, ["file", "element_seq"], "left").select("file", "element_seq", "page_id", "file_year", "file_month", "section", "title", "content", "near_table_id"), ["file", "element_seq"]))
    notes = text.where("kind = 'footnote'").select("file", "element_seq", F.col("page_id").alias("page"), "file_year", "file_month", "content", F.lit(None).cast("long").alias("t"))
    both = notes.unionByName(at.select("file", F.col("seq").alias("element_seq"), "page", "t"), allowMissingColumns=True)
    prior = F.last("t", ignorenulls=True).over(Window.partitionBy("file", "page").orderBy("element_seq").rowsBetween(Window.unboundedPreceding, 0))
    attached = both.withColumn("attached_to_table_id", F.when(F.col("page").isNotNull(), prior)).where("t is null")
    footnotes = keep("footnotes", _once(attached.select("file", "element_seq", F.col("page").alias("page_id"), "file_year", "file_month", labels.footnote_marker(F.col("content")).alias("marker"), "content", "attached_to_table_id"), ["file", "element_seq"]))
    lines = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("element_seq", "content")))), lambda x: x["content"]), "\n")
    strips = text.where("kind in ('page_header', 'page_footer') and page_id is not null").groupBy("file", "page_id").agg(F.nullif(lines("page_header"), F.lit("")).alias("header_text"), F.nullif(lines("page_footer"), F.lit("")).alias("footer_text"))
    # of several images of a page the last one stays
    images = pages.groupBy("file", "page_id").agg(F.max_by("image_uri", F.col("pos")).alias("image_uri")) if pages is not None else strips.select("file", "page_id", F.lit(None).cast("string").alias("image_uri")).limit(0)
    return Ingested(tables, rows, columns, cells, prose, footnotes, keep("pages", strips.join(images, ["file", "page_id"], "full")), invariants)


def page_images(docs: DataFrame) -> DataFrame:
    p = docs.select("file", F.posexplode("document.pages").alias("pos", "p"))
    return p.select("file", F.coalesce("p.id", "p.page_id").try_cast("int").alias("page_id"), "p.image_uri", "pos").where("page_id is not null")


def write_ledger(spark: SparkSession, paths: str | list[str], folder: str) -> Ingested:
    """The ledger of files as Parquet tables in a folder."""

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    docs = scan(spark, paths)
    return ingest(spark, elements(docs), page_images(docs), keep)


def read_ledger(spark: SparkSession, folder: str) -> Ingested:
    return Ingested(*(spark.read.parquet(f"{folder}/{n}") for n in NAMES))


def purge_missing(cells: DataFrame) -> DataFrame:
    """Cells that hold something; the ledger itself keeps the others."""
    return cells.where("is_missing = 0")


def sanity(i: Ingested) -> DataFrame:
    """46 labelled counts (label, n): one pass over each table."""
    c = F.col
    on = lambda name: F.count_if(c(name) == 1)
    said = lambda name, **values: {k: F.count_if(c(name) == v) for k, v in values.items()}
    f = layers.facts(i)
    packs = [
        (i.tables, {"tables": F.count("*"), "tables_ok": on("parse_ok"), "tables_failed": F.count_if(c("parse_ok") == 0), "signatures": F.countDistinct("signature"), "continued": F.count("continues_from"), "with_unit": F.count("unit"), "with_period": F.count_if(c("period") != "unknown")} | said("table_kind", tables_data="data", tables_toc="toc") | said("parse_method", dual_agree="dual_agree", dual_disagree="dual_disagree", first_only="lxml_only", second_only="pandas_only")),
        (i.columns, {"columns": F.count("*"), "columns_with_year": F.count("year_extracted")}),
        (i.rows, {"rows": F.count("*"), "rows_with_path": F.count_if(c("row_path").contains(" > ")), "rows_with_year": F.count("year_extracted")}),
        (i.cells, {"cells": F.count("*"), "zero": on("is_zero"), "percent": on("is_percent"), "revised": on("is_revised"), "with_footnote": on("has_footnote"), "estimated": on("is_estimated"), "preliminary": on("is_preliminary"), "zero_and_missing": F.count_if((c("is_zero") == 1) & (c("is_missing") == 1))} | said("parse_status", ok="ok", missing="missing", text="text", unparseable="unparseable")),
        (i.prose, {"prose": F.count("*"), "prose_near_table": F.count("near_table_id")}),
        (i.footnotes, {"footnotes": F.count("*"), "footnotes_attached": F.count("attached_to_table_id")}),
        (i.pages, {"pages": F.count("*")}),
        (i.invariants, {"invariants_ok": on("ok"), "invariants_off": F.count_if(c("ok") == 0), "sum_of_deltas": F.coalesce(F.sum(F.abs("delta")), F.lit(0)), "raw_cells": F.coalesce(F.sum("raw_html_cells"), F.lit(0)), "accounted_cells": F.coalesce(F.sum(c("n_column_cells") + c("n_row_labels") + c("n_section_hdr") + c("n_data_cells")), F.lit(0))}),
        (f, {"facts": F.count("*"), "metric_rows": F.count_if((c("table_kind") == "data") & (c("is_section_header") == 0) & (F.trim("row_path") != "") & c("parse_status").isin(*layers.MEASURED))}),
        (layers.ranked(f), {"canonical_facts": F.count_if(c("vintage") == 1), "supersessions": F.count_if(c("vintage") > 1)}),
        (layers.calendar_years(f), {"synthesized": F.count("*")}),
        (layers.row_labels(i), {"label_slugs": F.countDistinct("metric_slug")}),
    ]
    long = lambda df, what: df.agg(*(x.cast("long").alias(k) for k, x in what.items())).unpivot([], list(what), "label", "n")
    return reduce(DataFrame.unionByName, (long(df, what) for df, what in packs))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A question file: uid, question, answer, and its (page, file) places as an array."""
    q = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return q.select("uid", "question", "answer", F.arrays_zip(labels.pages_of(F.col("source_docs")).alias("page"), F.split("source_files", "\n").alias("file")).alias("places"))
