"""Exact top-k search by inner product (operator 7).

Method: three-phase uniform threshold. The vectors' components are cut into ``GROUPS`` lists; a list's local score
of a candidate is the inner product over its own components, and a candidate's score is the sum over the lists.

1. Each block of candidates gives, for each query and list, the k candidates with the highest local scores, with
   their whole scores. The k-th highest whole score gathered for a query is its safe cutoff: k candidates reach it.
2. The cutoff goes to every block with its queries. A candidate whose local scores are all below cutoff / GROUPS
   sums to less than the cutoff, so each list sends only entries that reach that share.
3. Entries that were sent are resolved: their other local scores are added; those below the cutoff go, and each
   block keeps its k best. The k best over blocks are the result.

Queries are rows whose id is divisible by ``every``; they are packed into blocks of ``QUERY_ROWS`` and meet blocks of
``BLOCK_ROWS`` candidates, so a task holds one pair of blocks at a time, whatever the sizes. Each pair of blocks
gives at most k rows a query. Query blocks are copied to as many lanes as a shuffle has partitions: the work is each query
against each row by contract, and a lane holds one pair of blocks at a time. The copies are shuffled, never broadcast.

Components become floor(256 * x). Sums are exact: in doubles where they can't pass 2**53, in 64-bit integers
otherwise; components beyond 2**31 in size are refused with an error, for a score may not fit a long.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; vectors of fewer
components count as ending in zeros; repeated rows are candidates each, but rows with the query's own id aren't; a query
id that is there more than once asks once, with the least of its vectors;
ties go to the smaller id; no candidates: no rows; extra columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.llm.util import Scratch, small_batches, table

GROUPS, BLOCK_ROWS, QUERY_ROWS = 4, 4096, 256
BLOCK = "n int, dim int, ids binary, data binary"


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, finite), F.lit(False))


def _packed(rows: int):
    """Partition of (id, vector) -> rows of up to so many vectors; vectors of a block end in zeros alike."""

    def block(ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        dim = max(len(v) for v in vectors)
        m = np.zeros((len(ids), dim), "<i8")
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([m.astype("<i4").tobytes()], pa.binary())], names=["n", "dim", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.floor(256 * np.array(v.values, np.float64))
                if np.abs(x).max() >= 2**31:
                    raise ValueError("a component is too large")
                ids.append(i)
                vectors.append(x)
                if len(ids) == rows:
                    yield block(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield block(ids, vectors)

    return run


def _matrix(n: int, dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i4").reshape(n, dim)


def local_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """[list, query, candidate]: exact inner products over each list's components."""
    dim = max(queries.shape[1], candidates.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))).astype(np.int64) for m in (queries, candidates))
    fits = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim < 2**53
    out = []
    for part in np.array_split(np.arange(dim), GROUPS):
        a, b = q[:, part], c[:, part].T
        out.append((a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if fits else a @ b)
    return np.stack(out)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, -k)[-k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _rows(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = np.concatenate([np.full(len(i), x) for x, i, _ in parts]) if parts else np.empty(0, np.int64)
    i, s = ((np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64)) for k in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (q, i, s)], names=["query_id", "vec_id", "score"])


def _pairs(phase: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, c = _matrix(row["n"], row["dim"], row["ids"], row["data"])
                qids, q = _matrix(row["q_n"], row["q_dim"], row["q_ids"], row["q_data"])
                cutoff = np.frombuffer(row["cutoffs"], "<i8") if phase == 2 else None
                local = local_scores(q, c)
                parts = []
                for x, query in enumerate(qids.tolist()):
                    other = np.flatnonzero(ids != query)
                    if phase == 1:  # the head of each list
                        at = np.unique(np.concatenate([other[_best(local[g, x, other], ids[other], k)] for g in range(GROUPS)]))
                    else:  # entries that reach their share of the cutoff in some list, and then the cutoff
                        at = other[(local[:, x, other] * GROUPS >= cutoff[x]).any(0)]
                    whole = local[:, x, at].sum(0)  # resolved for what the lists have sent only
                    if phase == 2:
                        at, whole = at[whole >= cutoff[x]], whole[whole >= cutoff[x]]
                    best = _best(whole, ids[at], k)
                    parts.append((query, ids[at[best]], whole[best]))
                yield _rows(parts)

    return run


def top_k(vectors: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query over all other rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    scratch = Scratch(spark, "topk")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.write(rows.mapInArrow(_packed(BLOCK_ROWS), BLOCK), "blocks")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).repartition(max(1, parts // 4), "id")
    queries = scratch.write(asked.mapInArrow(_packed(QUERY_ROWS), BLOCK).withColumn("q_block", F.xxhash64("ids")), "queries")
    lanes = parts
    laid = blocks.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))

    def met(q: DataFrame) -> DataFrame:
        named = q.select("q_block", *(F.col(c).alias(f"q_{c}") for c in ("n", "dim", "ids", "data")), *(["cutoffs"] if "cutoffs" in q.columns else []))
        # sizes are guessed from the files, which hold one lane of the copies: a broadcast would bring all of them to the driver
        copies = named.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        return laid.join(copies.hint("merge"), "lane").drop("lane")

    out = "query_id long, vec_id long, score long"
    heads = met(queries).mapInArrow(_pairs(1, k), out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = heads.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(-(2**62))).alias("cutoff"))
    cutoffs = scratch.write(kth, "cutoffs")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["q_block", "pos", "query_id"])

    listed = queries.select("q_block", "ids").mapInArrow(ids_of, "q_block long, pos int, query_id long").join(cutoffs, "query_id", "left")
    packed = listed.groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("cutoff", F.lit(-(2**62))).alias("cutoff")))).alias("c"))

    def cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.array([x["cutoff"] for x in c], "<i8").tobytes() for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["q_block", "cutoffs"])

    known = queries.join(packed.mapInArrow(cut_bytes, "q_block long, cutoffs binary").hint("merge"), "q_block")
    found = met(known).mapInArrow(_pairs(2, k), out)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), 5, 50)
