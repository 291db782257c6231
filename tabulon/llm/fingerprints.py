"""Document fingerprints (operator 10), by DataFrame and SQL functions only.

Method: a canonical exact digest. A text is put in Unicode's compatibility composition (NFKC), its case is folded in full
(sharp s and SS, final and medial sigma become one), the result is composed again and white space runs become one space, none at the ends; the fingerprint is four 64-bit xxhashes of that, each with a seed
of its own, in hex. Rows with equal fingerprints are compared byte by byte before they count as one group.

Likeness of two such fingerprints is 1.0 where they are equal and 0.0 otherwise: the digest is exact.

``reflect`` calls the composition and case folding of the ICU library that Spark itself ships and uses for collations; it is a SQL
function and runs in the JVM.

Scale: the next document comes by one range-like shuffle: cut into blocks of neighbouring ids, each block gets the first
row of the following one as a guest. Only ids and counts are used to place blocks; texts move once.

Defined results: null text counts as empty; an empty or blank text has the fingerprint of the empty text; repeated ids are
ordered by text; a table of one row is its own next; an empty table gives no rows; only doc_id and text are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.util import Scratch, block_of, blocks_for, range_bounds, release, table, text_or_empty

SEEDS = (1, 2, 3, 4)
BROADCAST_ROWS = 500_000  # fingerprints of at most this many groups (64 MB) are sent to all executors


def canonical(text: Column) -> Column:
    text = text_or_empty(text)
    composed = lambda t: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    return F.trim(F.regexp_replace(F.when(text.rlike(r"[^\x00-\x7F]"), composed(folded)).otherwise(F.lower(text)), r"[\s\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(s), canon)), 16, "0") for s in SEEDS)))


def fingerprint(text: Column) -> Column:
    return wide_hash(canonical(text))


def grouped(hashed: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds group_id and group_size to rows that have doc_id and fingerprint: a group is all rows with byte-equal
    canonical texts; its id is its smallest doc_id.

    Buckets of two rows or more are compared: a bucket whose least and greatest canonical text are the same holds one
    text only, and both come from map-side aggregation, so a bucket of any size costs a task one row. Any other bucket
    (a collision of 256 bits) is told apart by the text itself: its fingerprints get the text's sha256 appended."""
    scratch = Scratch(docs.sparkSession, "groups")
    counts = hashed.groupBy("fingerprint").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("group_id"))
    counts = scratch.write(counts.where("group_size > 1"), "counts")
    canon = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("canon")).withColumn("fingerprint", wide_hash(F.col("canon")))
    many = counts.select("fingerprint")
    side = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    compared = canon.join(side, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min("canon").alias("a"), F.max("canon").alias("b"))
    mixed = scratch.write(compared.where(F.col("a") != F.col("b")).select("fingerprint"), "mixed")
    size, least = F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce("group_id", "doc_id").alias("group_id")
    clean = hashed.join(counts, "fingerprint", "left").select(*hashed.columns, size, least)
    if not mixed.limit(1).count():
        return clean
    told = canon.join(mixed, "fingerprint", "left_semi").withColumn("sha", F.sha2("canon", 256)).select("doc_id", "fingerprint", "sha")
    apart = told.groupBy("fingerprint", "sha").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("group_id"))
    split = hashed.join(mixed, "fingerprint", "left_semi").join(told.distinct(), ["doc_id", "fingerprint"]).join(apart, ["fingerprint", "sha"])
    split = split.withColumn("fingerprint", F.concat("fingerprint", "sha")).select(*clean.columns)
    return clean.join(mixed, "fingerprint", "left_anti").select(*clean.columns).unionByName(split)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint: those of the next row by ascending doc_id; the first row's
    after the last."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    cuts = range_bounds(rows.where("doc_id is not null"), "doc_id", blocks_for(spark))
    rows = rows.withColumn("block", block_of(F.col("doc_id"), cuts))
    firsts = rows.groupBy("block").agg(F.min(F.struct("doc_id", F.sha2("text", 256).alias("h"))).alias("first"))
    # at most as many rows as there are cuts, a fixed number: this window and this broadcast don't grow with the rows
    around = Window.orderBy("block")
    hosts = firsts.select("first", F.coalesce(F.lag("block").over(around), F.max("block").over(Window.partitionBy())).alias("host"), F.lag("block").over(around).isNull().alias("wraps"))
    is_first = rows["doc_id"].eqNullSafe(F.col("first.doc_id")) & (F.sha2(rows["text"], 256) == F.col("first.h"))
    guests = rows.join(F.broadcast(hosts), is_first).dropDuplicates(["host"]).select("doc_id", "text", F.col("host").alias("block"), F.lit(True).alias("guest"), "wraps")
    both = rows.select("*", F.lit(False).alias("guest"), F.lit(False).alias("wraps")).unionByName(guests)
    order = Window.partitionBy("block").orderBy("guest", "doc_id", F.sha2("text", 256))
    both = both.repartition("block").withColumn("fingerprint", fingerprint(F.col("text")))
    after = both.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint"))
    return after.where(~F.col("guest")).select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text").cast("int")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    digests = pairs.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    hashed = digests.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    like = lambda other: F.when(F.col("fingerprint") == F.col(other), F.lit(1.0)).otherwise(F.lit(0.0))
    rows = hashed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
    rows = Scratch(spark, "op10").write(rows, "rows")
    release(spark)
    return grouped(rows, table(spark, sf_dir, "documents"))
