"""The corpus pipeline: stages that each take the documents the one before has kept.

A stage is a function of (spark, docs, sf_dir); run() writes each stage's rows as Parquet in the shared folder and reads
them again for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, jaccard, mixing, quality, suffixes
from tabulon.llm.util import Scratch, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject. Null texts and metadata count as empty and as values of
    their own; rows without an id and repeated rows are judged each; where labels don't hold both kinds all stay; an
    empty table gives no rows; other columns go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = quality.scored(docs, model, COLUMNS).where("kept")
    return rows.select(*(F.col(f"keep_{c}").alias(c) for c in COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at five words and 0.8: the one with the smallest id. Rows with equal ids are
    one document, so repeated rows of one that stays all stay. Null, empty and blank texts are near to nothing and stay, as
    do rows without an id; an empty table gives no rows; other columns go."""
    classes = jaccard.jaccard_components(docs, 5, 80)
    gone = Scratch(spark, "near").write(classes.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    few = gone.count() <= jaccard.BROADCAST_ROWS
    return docs.select(*COLUMNS).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that also start earlier; documents of which nothing is left go, so of equal texts of 100
    bytes or more one stays. Null and short texts stay as they are; an empty table gives no rows; other columns go."""
    return suffixes.without_repeats(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, range-sorted by training position: each pass over a
    source has positions of its own. The plan is made of keys and sizes; texts move once, for the sort. Equal rows count as
    one in the plan and are taken alike. Texts without words are never taken; the null source is a source; an empty table
    gives no rows; other columns go."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text", "source").alias("key"))
    plan = mixing.mix(keyed.select("doc_id", "source", "text", "key").dropDuplicates(["doc_id", "key"]), keep=["key"]).where("taken > 0")
    plan = Scratch(spark, "mixing").write(plan.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "positions"), "plan")
    few = plan.count() <= mixing.BROADCAST_ROWS
    side = F.broadcast(plan) if few else plan
    taken = keyed.join(side, keyed["doc_id"].eqNullSafe(side["id"]) & (keyed["key"] == side["k"]))
    placed = taken.select(*COLUMNS, F.explode("positions").alias("place"))
    return placed.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of the text, and whether decoding gave the text back. A null or empty text has no ids;
    repeated rows each give a row; an empty table gives no rows; other columns go."""
    import public_tokenizers

    path, spec = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_rows(docs, path, spec)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs


ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
