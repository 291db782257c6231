"""A stored full-text index: postings by bucket of their term, lengths, and corpus statistics. A question reads its terms'
buckets only; texts are tokenized once, when the index is made."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import fuzzy, search
from tabulon.session import ship
from tabulon.sources.shared import stored

BUCKETS = 64


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # bucket, term, id, field, tf, n_tokens
    stats: DataFrame  # n, mean: one row
    stemmed: bool


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _root(word: Column) -> Column:
    return F.get(fuzzy.stems(F.array(word)), F.lit(0))


def _counted(terms: Column) -> Column:
    """array<struct<term, tf>> of a sorted array: a term begins where it differs from the one before, and ends where the next begins."""
    starts = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    ends = F.concat(F.slice(starts, 2, 1 << 30), F.array(F.size(terms)))
    found = F.zip_with(starts, ends, lambda i, j: F.struct(F.get(terms, i).alias("term"), (j - i).cast("long").alias("tf")))
    return F.when(F.size(terms) > 0, found)


def make(docs: DataFrame, id_col: str, fields: list[str], stem: bool) -> dict:
    """A document's terms are counted in its own row, with its length beside: postings are shuffled once, to their buckets."""
    split = docs.select(F.col(id_col).alias("id"), *(search.tokens(F.coalesce(f, F.lit(""))).alias(f) for f in fields))
    size = reduce(lambda a, b: a + b, (F.size(f) for f in fields))
    if stem:
        ship(docs.sparkSession)
    root = fuzzy.stems if stem else lambda c: c
    each = split.select("id", size.alias("n_tokens"), *(root(F.col(f)).alias(f) for f in fields))
    each = each.select("id", "n_tokens", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.array_sort(f).alias("terms")) for f in fields))).alias("e")).select("id", "n_tokens", "e.field", "e.terms")
    rows = each.select("id", "n_tokens", "field", F.explode(_counted(F.col("terms"))).alias("x")).select("id", "field", "x.term", "x.tf", "n_tokens", bucket(F.col("x.term")).alias("bucket"))
    sizes = search.lengths(docs, id_col, fields)
    return {"postings": (rows, ["bucket"]), "stats": (sizes.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean")), [])}


def index(spark: SparkSession, key: tuple, docs: DataFrame, id_col: str, fields: list[str], stem: bool = True) -> Index:
    t = stored(spark, ("index", *key, *fields, stem), lambda: make(docs, id_col, fields, stem))
    return Index(t["postings"], t["stats"], stem)


def terms_of(spark: SparkSession, words: list[str], stemmed: bool) -> list[str]:
    if not stemmed:
        return sorted(set(words))
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(_root(F.col("w")).alias("r")).collect()  # a question's words
    return sorted({r["r"] for r in rows})


def match(ix: Index, weights: dict[str, float], words: list[str], match_all: bool = False) -> DataFrame:
    """(id, score), lower is better: BM25 with a weight for each field."""
    spark = ix.postings.sparkSession
    terms = terms_of(spark, words, ix.stemmed)
    at = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket(F.col("t"))).distinct().collect()]
    weight = reduce(lambda w, f: w.when(F.col("field") == f, F.lit(weights[f])), list(weights)[1:], F.when(F.col("field") == next(iter(weights)), F.lit(next(iter(weights.values())))))
    hits = ix.postings.where(F.col("bucket").isin(*at) & F.col("term").isin(*terms)).groupBy("id", "n_tokens", "term").agg(F.sum(weight * F.col("tf")).alias("f"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(ix.stats))  # a row a term of the question, and one row
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    part = idf * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("n_tokens") / F.col("mean")))
    out = rows.groupBy("id").agg((-F.sum(part)).alias("score"), F.count("*").alias("k"))
    return (out.where(F.col("k") == len(terms)) if match_all else out).select("id", "score")
