"""A ledger that grows by files. A manifest tells which files it holds, by a digest of what is in them; a run takes only files that
are new or have changed, and replaces what an earlier version of a file gave.

Tables are partitioned by issue (year and month of a file). A run writes the issues of its files anew, from their other files' rows as
they are and the new files' rows, to a folder of its own first; then these issues' partitions are overwritten; then the manifest gets
its rows. A run that was cut off leaves no manifest rows, so the next one does the same files again and arrives at the same
tables. Files keep their number in an issue, so ids of unchanged tables stay.

One run at a time may write to a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.sources import corpus
from tabulon.sources.shared import written

MANIFEST = "file string, issue long, file_no long, digest string, run int"


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, at: str) -> bool:
    fs, path = _path(spark, at)
    return fs.exists(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files that a ledger holds: the latest entry of each."""
    if not _exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return rows.groupBy("file").agg(F.max_by(F.struct("issue", "file_no", "digest", "run"), "run").alias("m")).select("file", "m.*")


def read(spark: SparkSession, folder: str) -> corpus.Ingested:
    """The ledger in a folder; a table may have no rows, and so no files that tell its columns."""
    return corpus.Ingested(*(_read(spark, folder, n) for n in corpus.NAMES))


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/columns_of/{name}").schema).parquet(f"{folder}/{name}")


def digests(elements: DataFrame) -> DataFrame:
    """file, issue, digest: of a file's elements, whatever their order."""
    row = F.xxhash64(*sorted(elements.columns)).cast("decimal(38,0)")
    return elements.groupBy("file").agg(F.max(F.coalesce(F.col("file_year") * 100 + F.col("file_month"), F.lit(0))).cast("long").alias("issue"), F.concat_ws(":", F.count("*"), F.sum(row)).alias("digest"))


def _numbered(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """Adds file_no: the one a file has, or the next of its issue."""
    last = old.groupBy("issue").agg(F.max("file_no").alias("last"))
    j = fresh.join(old.select("file", F.col("file_no").alias("own"), F.col("issue").alias("own_issue")), "file", "left").join(last, "issue", "left")
    own = F.when(F.col("own_issue") == F.col("issue"), F.col("own"))
    w = Window.partitionBy("issue", own.isNull()).orderBy("file")  # the files of an issue
    return j.select("file", "issue", "digest", F.coalesce(own, F.coalesce("last", F.lit(0)) + F.row_number().over(w)).cast("long").alias("file_no"))


def update(spark: SparkSession, elements: DataFrame, folder: str, images: DataFrame | None = None, known: DataFrame | None = None) -> corpus.Ingested:
    """The ledger in a folder, brought up to date with files' elements. Files that aren't among them stay as they are. known: file, issue, digest where
    they can be told without reading elements."""
    old = written(manifest(spark, folder))
    fresh = (digests(elements) if known is None else known).join(old, ["file", "digest"], "left_anti")
    fresh = written(_numbered(fresh, old))
    if fresh.limit(1).count():
        run = (old.agg(F.max("run")).first()[0] or 0) + 1
        own = elements.join(fresh.select("file", "file_no"), "file")
        ledger = corpus.ingest(spark, written(own), images.join(fresh.select("file"), "file", "left_semi") if images is not None else None, lambda _, df: written(df))
        # a file that has moved to another issue leaves its old one
        gone = old.select("file", "issue", "file_no").join(fresh.select("file"), "file", "left_semi")
        touched = fresh.select("issue").union(gone.select("issue")).distinct()
        stay = old.select("file", "issue", "file_no").join(fresh.select("file"), "file", "left_anti")  # not what a run that was cut off has left
        for name in corpus.NAMES:
            _replace(spark, getattr(ledger, name), folder, name, fresh, stay, touched)
        fresh.withColumn("run", F.lit(run)).select(*(f.split()[0] for f in MANIFEST.split(", "))).write.mode("append").parquet(f"{folder}/manifest")
    return read(spark, folder)


def _replace(spark: SparkSession, new: DataFrame, folder: str, name: str, fresh: DataFrame, stay: DataFrame, touched: DataFrame) -> None:
    """Overwrites the touched issues of a table: what the files gave that stay, and what is new."""
    at, by_file = f"{folder}/{name}", "file" in new.columns
    number = F.shiftright(F.col("id" if "file" in new.columns and "id" in new.columns else "table_id"), 22)
    placed = new.join(fresh.select("file", "issue"), "file") if by_file else new.withColumn("issue", F.shiftright(number, 22))
    if _exists(spark, at):
        held = _read(spark, folder, name).join(touched, "issue", "left_semi")
        if by_file:
            held = held.join(stay.select("file"), "file", "left_semi")
        else:
            held = held.withColumn("_no", number).join(stay.select((F.shiftleft("issue", 22) + F.col("file_no")).alias("_no")), "_no", "left_semi").drop("_no")
        placed = held.select(*new.columns, "issue").unionByName(placed.select(*new.columns, "issue"))
    staged = written(placed.select(*new.columns, "issue"))
    staged.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/columns_of/{name}")
    staged.repartition("issue").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issue").parquet(at)
    for r in touched.join(staged.select("issue").distinct(), "issue", "left_anti").collect():  # issues of this run that are empty now
        fs, path = _path(spark, f"{at}/issue={r['issue']}")
        fs.delete(path, True)


def update_files(spark: SparkSession, paths: str, folder: str) -> corpus.Ingested:
    """The same from JSON files, one document each. Files are told by name, length and time, and only new and changed ones are read."""
    fs, pattern = _path(spark, paths)
    found = [(s.getPath().getName(), s.getPath().toString(), f"{s.getLen()}:{s.getModificationTime()}") for s in fs.globStatus(pattern) or []]  # a listing, as any reader makes
    from tabulon.functions import labels

    listed = spark.createDataFrame(found, "file string, path string, digest string")
    period = labels.file_period(F.col("file"))
    known = written(listed.withColumn("issue", F.coalesce(period["year"] * 100 + period["month"], F.lit(0)).cast("long")))
    new = known.join(manifest(spark, folder), ["file", "digest"], "left_anti").select("path").collect()
    if not new:
        return read(spark, folder)
    docs = corpus.scan(spark, [r["path"] for r in new])
    return update(spark, corpus.elements(docs), folder, corpus.page_images(docs), known.drop("path").join(new_names(spark, new), "file", "left_semi"))


def new_names(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([(r["path"].rsplit("/", 1)[-1],) for r in rows], "file string")
