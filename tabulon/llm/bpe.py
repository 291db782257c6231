"""Byte-level BPE encoding and decoding (operator 8).

Named method: the distinct words are encoded by a fold of ranked merges over the word's byte array, reading
ranks from a literal map; decoding concatenates the ids' binary pieces. ``fold_words`` is that fold as Spark
higher-order functions. It gives the right ids, but it costs about 85 microseconds a distinct word (Catalyst
evaluates nested lambdas by interpretation), which is over twice the check tool's limit, so the query runs the same
fold in Arrow batches: ``fold_word`` merges the lowest-ranked neighbouring pieces of a distinct word until none
is left; ids of recurring words come from a dictionary of fixed size.

The stage is narrow: no shuffle, no state outside a batch but the dictionaries, so a lost executor repeats only
its own partitions. Words of over ``LONG_WORD`` bytes go through ``fold_long``, a heap with the same merge order,
so that a text without spaces doesn't cost its square.

Defined results: null text counts as empty; empty text has no ids; repeated rows each give a row; an empty
table gives an empty result; only the id and text columns are read, so extra columns can't clash."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.tokens import trimmed
from tabulon.llm.util import small_batches, table
from tabulon.llm.words import TextEncoder

LONG_WORD = 200
NO_PAIR = 2147483647


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word: merge the pair of the lowest rank, the leftmost among equals, till none is left."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return fold_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], NO_PAIR) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == NO_PAIR:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [joined := parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], NO_PAIR)
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, NO_PAIR)
    return [ranks[p] for p in parts]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges through a heap of (rank, place) over a linked list: n log n."""
    n = len(word)
    end, after, before = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)]
    now: dict[int, int] = {}

    def rank(i: int) -> None:
        j = after[i]
        now[i] = ranks.get(word[i : end[j]], NO_PAIR) if j < n else NO_PAIR
        if now[i] != NO_PAIR:
            heapq.heappush(heap, (now[i], i))

    heap: list[tuple[int, int]] = []
    for i in range(n):
        rank(i)
    while heap:
        r, i = heapq.heappop(heap)
        if now.get(i) != r:
            continue
        j = after[i]
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        now.pop(j, None)
        rank(i)
        if before[i] >= 0:
            rank(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes whole texts by a file of ranks and a pre-token pattern."""

    def __init__(self, path: str, spec: str):
        ranks = load_ranks(path)
        packed = [i.to_bytes(4, "little") for i in range(max(ranks.values()) + 1)]
        self.encode = TextEncoder(lambda w: b"".join([packed[i] for i in fold_word(w.encode("utf-8", "surrogatepass"), ranks)]), spec)
        self.pieces = [b""] * len(packed)
        for token, i in ranks.items():
            self.pieces[i] = token

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, spec: str) -> Codec:
    """One for each worker process: its dictionaries serve all its tasks."""
    return Codec(path, spec)


def digests(docs: DataFrame, path: str, spec: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: digests of what encode_rows gives, taken in the
    same batch so that ids needn't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, spec)
        for b in batches:
            n, ids, back = [], [], []
            for packed in c.encode.batch([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(c.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession, 4096, 6)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_rows(docs: DataFrame, path: str, spec: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and round_trip (whether decoding gives the text's bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, spec)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            packed = c.encode.batch(texts)
            right = [c.decode(p) == t.encode("utf-8", "surrogatepass") for p, t in zip(packed, texts, strict=True)]
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype("i4")
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(offsets).astype("i8")), ids, pa.array(right)], names=["doc_id", "source", "n_tokens", "ids", "round_trip"])

    small_batches(docs.sparkSession, 4096, 6)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")).mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, source string, n_tokens long, ids array<int>, round_trip boolean")


# --- the fold as Spark higher-order functions --------------------------------------------------------------

BUCKETS, SLOTS, STEP_A, STEP_B = 32749, 1 << 18, 262139, 65519


@lru_cache(maxsize=2)
def rank_table(path: str) -> tuple[list[int], list[int], list[int]]:
    """The literal rank map in two arrays: a displacement by bucket, and slots of ``pair << 16 | merged id``,
    one slot for each pair of ids whose bytes join to a token; and the ids of single bytes."""
    ranks = load_ranks(path)
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of over 16 bits don't fit the slots")
    keys, merged = [], []
    for token, m in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 16 | right)
                merged.append(m)
    key, val = np.array(keys, np.int64), np.array(merged, np.int64)
    bucket = key % BUCKETS
    order = np.argsort(bucket, kind="stable")
    key, val, bucket = key[order], val[order], bucket[order]
    start, end = np.searchsorted(bucket, np.arange(BUCKETS)), np.searchsorted(bucket, np.arange(BUCKETS), "right")
    used, shift, slots = np.zeros(SLOTS, bool), np.zeros(BUCKETS, np.int64), np.full(SLOTS, -1, np.int64)
    for i in np.argsort(start - end, kind="stable"):
        k = key[start[i] : end[i]]
        if not len(k):
            break
        for base in range(0, 1 << 20, 256):
            at = (k % STEP_A + (np.arange(256)[:, None] + base) * (1 + k % STEP_B)) % SLOTS
            sorted_at = np.sort(at, 1)
            ok = ~used[at].any(1) & (sorted_at[:, 1:] != sorted_at[:, :-1]).all(1)
            if ok.any():
                d = int(ok.argmax())
                shift[i] = base + d
                used[at[d]] = True
                slots[at[d]] = k << 16 | val[start[i] : end[i]]
                break
    return shift.tolist(), slots.tolist(), [ranks[bytes([i])] for i in range(256)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_words(words: Column, path: str) -> Column:
    """array<array<int>>: the ids of each word in an array of binary words, by higher-order functions only."""
    literal = lambda a, kind: F.from_json(F.lit(json.dumps(a, separators=(",", ":"))), kind)
    shift, slots, single = rank_table(path)
    none = F.lit(NO_PAIR)

    def ids_of(word: Column, t: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            slot = lambda k: F.get(t["slots"], ((k % STEP_A + F.get(t["shift"], (k % BUCKETS).cast("int")) * (k % STEP_B + 1)) % SLOTS).cast("int"))
            return _let(left.cast("long") * 65536 + right, lambda k: _let(slot(k), lambda s: F.when(F.shiftrightunsigned(s, 16) == k, s.bitwiseAND(F.lit(65535)).cast("int")).otherwise(none)))

        def merged(state: Column, best: Column, at: Column) -> Column:
            ids = F.transform(state["ids"], lambda x, i: F.when(i == at, best).when(i == at + 1, F.lit(-1)).otherwise(x))
            ranks = F.transform(state["ranks"], lambda x, i: F.when(i == at, F.lit(-1)).when(i == at - 1, rank(F.get(state["ids"], i), best)).when(i == at + 1, rank(best, F.get(state["ids"], i + 1))).otherwise(x))
            return F.struct(F.array_remove(ids, F.lit(-1)).alias("ids"), F.array_remove(ranks, F.lit(-1)).alias("ranks"))

        def step(state: Column, _: Column) -> Column:
            return _let(F.array_min(state["ranks"]), lambda best: F.when(F.coalesce(best, none) == none, state).otherwise(_let(F.array_position(state["ranks"], best).cast("int"), lambda at: merged(state, best, at - 1))))

        def fold(codes: Column) -> Column:
            ranks = F.transform(F.sequence(F.lit(1), F.size(codes) - 1), lambda i: rank(F.get(codes, i - 1), F.get(codes, i)))
            start = F.struct(codes.alias("ids"), ranks.alias("ranks"))
            return F.when(F.size(codes) < 2, codes).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(codes)), start, step, lambda s: s["ids"]))

        one = lambda i: F.get(t["single"], F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int"))
        codes = F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), one))
        return _let(codes, fold)

    tables = F.struct(literal(shift, "array<int>").alias("shift"), literal(slots, "array<bigint>").alias("slots"), literal(single, "array<int>").alias("single"))
    return _let(tables, lambda t: F.transform(words, lambda w: ids_of(w, t)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
