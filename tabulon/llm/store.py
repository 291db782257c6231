"""Token ids in a content-addressed store (operator 4).

Method: rolling hashes cut each document's id stream into chunks; each distinct chunk is stored once under its
sha256; a recipe lists a document's chunks, and Merkle roots over recipes verify what is read back.

File format, three Parquet tables in one folder:

- ``objects/kind=chunk``: key (sha256 of the ids as little-endian unsigned 32-bit integers), n, data (the ids as
  little-endian unsigned integers of ``width`` bytes). One row a distinct chunk.
- ``recipes``: one row a document, ascending doc_id: doc_id, start (ids of all documents before it), n_tokens, the
  chunk keys in order, their lengths, and the Merkle root of the keys.
- ``manifest``: for each run of documents its first and last doc_id, its counts and the Merkle root over its documents
  (a leaf is the hash of doc_id, n_tokens and the recipe's root). It is made of the objects, before recipes are
  written; its number of documents must be the input's, and reading first compares it with the recipes.

Cuts come where a rolling hash of the last 16 ids has its low bits zero, so equal passages are cut alike wherever they
stand; a chunk has ``MOST`` ids at most. The crc of a document isn't taken from a second copy of its ids: each chunk
that is read gives its own crc, and crcs of concatenations are sums of shifted crcs, so only a few bytes a chunk
travel. A chunk that doesn't hash to its key, a recipe that doesn't hash to its root, or recipes that differ from the
manifest end the read with an error. A recipe's key is the hash of its id and chunk keys; equal rows are counted
and dealt out again, so nothing depends on the order or the run of a task.

Defined results: null text counts as empty and gives the end id alone; repeated rows each keep a recipe of their own
and follow one another; an empty table gives empty tables; only doc_id and text are read."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.pretokens import BatchEncoder
from tabulon.llm.tokens import trimmed
from tabulon.llm.util import Scratch, block_of, blocks_for, range_bounds, release, running_start, small_batches, table

WINDOW, LOW_BITS, MOST = 16, 9, 8192


def byte_characters() -> dict[int, str]:
    """How byte-level BPE writes bytes as characters: printable ones as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """texts -> (all their ids, where each text's begin and the last one's end), by the library's BPE model for each
    distinct pre-token. A text that holds an added token's string goes through the library whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    listed = Tokenizer(tokenizer.model)  # of pre-tokens in a row, written as byte characters, which hold no space
    listed.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    letters = np.array([ord(c) for _, c in sorted(byte_characters().items())], "<u4")
    n_bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        n_bytes[i] = len(token)

    def pieces(words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            sizes = np.cumsum([len(w) for w in some])
            # a space, which no byte is written as, stands between two words
            spelled = np.insert(letters[np.frombuffer(b"".join(some), np.uint8)], sizes[:-1], 32).tobytes().decode("utf-32-le")
            ids = np.array(listed.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            covered = np.cumsum(n_bytes[ids])
            if not len(ids) or covered[-1] != sizes[-1]:
                raise ValueError("the vocabulary lacks a byte")
            ends = np.searchsorted(covered, sizes) + 1
            packed, at = ids.tobytes(), 0
            for e in (4 * ends).tolist():
                out.append(packed[at:e])
                at = e
        return out

    fast = BatchEncoder(pieces, 400_000)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for a in added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if not whole.any():
            return fast(texts)
        ids, bounds = fast(pc.if_else(pa.array(whole), "", texts))
        own = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts.filter(pa.array(whole)).to_pylist()]
        each = np.zeros(len(texts), np.int64)
        each[whole] = [len(o) for o in own]
        ids = np.insert(ids, np.repeat(bounds[:-1], each), np.concatenate([np.array(o, "<u4") for o in own]))
        return ids, bounds + np.append(0, np.cumsum(each))

    return encode


_GEAR = np.random.default_rng(20).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def all_cut_points(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of id streams that lie one after another; bounds: where each begins and the last ends."""
    cuts, step = [], 1 << 16
    for a in range(0, len(ids), step):  # so many ids stay in the processor's cache
        some = ids[max(a - WINDOW + 1, 0) : a + step]
        h = _GEAR[some & 0xFFFF] ^ (some >> 16).astype(np.uint64)
        for k in (1, 2, 4, 8):  # after these h[i] holds ids i - 15 to i, each shifted by its distance
            h[k:] = h[k:] + (h[:-k] << np.uint64(k))
        at = np.flatnonzero(h >> np.uint64(64 - LOW_BITS) == 0) + max(a - WINDOW + 1, 0)
        cuts.append(at[at >= a] + 1)
    cuts = np.concatenate([np.empty(0, np.int64), *cuts])
    cuts = cuts[cuts < len(ids)]
    # the window lies in the stream
    cuts = cuts[cuts - bounds[np.searchsorted(bounds, cuts, "right") - 1] >= WINDOW]
    ends = np.union1d(cuts, bounds[1:][np.diff(bounds) > 0])
    gaps = np.diff(ends, prepend=0)
    long = gaps > MOST
    if long.any():
        ends = np.union1d(ends, np.concatenate([np.arange(e - g + MOST, e, MOST) for e, g in zip(ends[long], gaps[long], strict=True)]))
    return ends


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one id stream."""
    return all_cut_points(ids, np.array([0, len(ids)]))


def merkle(keys: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up unchanged; no keys: the hash of nothing."""
    if not keys:
        return hashlib.sha256(b"").digest()
    while len(keys) > 1:
        keys = [hashlib.sha256(b"\1" + b"".join(keys[i : i + 2])).digest() if i + 1 < len(keys) else keys[i] for i in range(0, len(keys), 2)]
    return keys[0]


ROWS = "kind string, key binary, doc_id long, n long, width int, data binary, lengths binary, root binary"


def recipe_key(doc_id: int | None, listed: bytes) -> bytes:
    """Of id and chunk keys, so that a task that is run again sends its rows where they went before."""
    return hashlib.sha256(b"%s\0%s" % (repr(doc_id).encode(), listed)).digest()


def _objects(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            ids, bounds = encode(b.column(1))
            ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            ends = all_cut_points(ids, bounds)
            begins = np.append(0, ends)[:-1]
            sizes = ends - begins
            wide, narrow = memoryview(ids.tobytes()), memoryview(ids.astype("<u2").tobytes())
            keys = [hashlib.sha256(wide[4 * i : 4 * j]).digest() for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
            first = sorted({key: k for k, key in reversed(list(enumerate(keys)))}.values())
            widths = np.where(np.maximum.reduceat(ids, begins) < 1 << 16, 2, 4)[first].tolist() if first else []
            data = [bytes((narrow if w == 2 else wide)[w * i : w * j]) for w, i, j in zip(widths, begins[first].tolist(), ends[first].tolist(), strict=True)]
            listed, lengths = b"".join(keys), sizes.astype("<u4").tobytes()
            of = np.searchsorted(ends, bounds, "right").tolist()
            spans = list(zip(of[:-1], of[1:], strict=True))
            lists = [listed[32 * i : 32 * j] for i, j in spans]
            doc_ids, none = b.column(0).to_pylist(), [None]
            chunks, recipes = len(first), len(spans)
            cols = (
                (pa.string(), ["chunk"] * chunks + ["recipe"] * recipes),
                (pa.binary(), [keys[k] for k in first] + [recipe_key(d, own) for d, own in zip(doc_ids, lists, strict=True)]),
                (pa.int64(), none * chunks + doc_ids),
                (pa.int64(), np.append(sizes[first], np.diff(bounds)) if first else np.diff(bounds)),
                (pa.int32(), widths + [0] * recipes),
                (pa.binary(), data + lists),
                (pa.binary(), none * chunks + [lengths[4 * i : 4 * j] for i, j in spans]),
                (pa.binary(), none * chunks + [merkle(keys[i:j]) for i, j in spans]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for k, c in cols], names=["kind", "key", "doc_id", "n", "width", "data", "lengths", "root"])

    return run


MANIFEST = {"block": pa.int32(), "first_doc": pa.int64(), "last_doc": pa.int64(), "documents": pa.int64(), "n_tokens": pa.int64(), "root": pa.binary()}
MANIFEST_DDL = "block int, first_doc long, last_doc long, documents long, n_tokens long, root binary"


def _summary(key, got):
    """The manifest's row of a run of documents. Where starts are given, each must follow from the one before."""
    rows = list(zip(*(got[c].to_pylist() for c in ("doc_id", "uid", "n_tokens", "root")), got["start"].to_pylist() if "start" in got.column_names else [None] * got.num_rows, strict=True))
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    leaves = []
    for i, (doc_id, _, n, root, start) in enumerate(rows):
        if start is not None and i and start != rows[i - 1][4] + rows[i - 1][2]:
            raise ValueError("a recipe doesn't start where the one before ends")
        leaves.append(hashlib.sha256(b"\0%s\0%d\0%s" % (repr(doc_id).encode(), n, root)).digest())
    ids = [r[0] for r in rows if r[0] is not None] or [None]
    row = (key[0].as_py(), ids[0], ids[-1], len(rows), sum(r[2] for r in rows), merkle(leaves))
    return pa.table({c: pa.array([v], t) for v, (c, t) in zip(row, MANIFEST.items(), strict=True)} | ({"start": pa.array([rows[0][4]], pa.int64())} if rows[0][4] is not None else {}))


def check_manifest(recipes: DataFrame, manifest: DataFrame) -> None:
    """Ends with an error unless the recipes are those of the manifest, none lost or doubled, with the right starts.
    The driver gets one row a run of documents."""
    made = recipes.select("block", "doc_id", "uid", "n_tokens", "root", "start").groupBy("block").applyInArrow(_summary, f"{MANIFEST_DDL}, start long")
    got = sorted(tuple(r) for r in made.collect())
    if [r[:-1] for r in got] != sorted(tuple(r) for r in manifest.select(*MANIFEST).collect()):
        raise ValueError("the recipes don't match the manifest")
    at = 0
    for r in got:
        if r[-1] != at:
            raise ValueError("a run of recipes doesn't start where the one before ends")
        at += r[4]


def write_store(docs: DataFrame, path: str, end_id: int, scratch: Scratch) -> None:
    """Encodes all documents and writes the three tables of the format to the scratch folder."""
    spark = docs.sparkSession
    objects = _objects(path, end_id)
    small_batches(spark, 4096, 8)  # pre-tokens of many texts are numbered together
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda batches: trimmed(objects(batches)), ROWS)
    once = made.groupBy("kind", "key").agg(*(F.first(c).alias(c) for c in ("doc_id", "n", "width", "data", "lengths", "root")), F.count("*").alias("copies"))
    once.write.partitionBy("kind").option("compression", "zstd").parquet(scratch.path("objects"))
    del made, once
    release(spark)
    raw = spark.read.schema("key binary, doc_id long, n long, data binary, lengths binary, root binary, copies long, kind string").parquet(scratch.path("objects")).where("kind = 'recipe'")
    raw = raw.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    cuts = range_bounds(raw, "doc_id", blocks_for(spark))
    blocked = raw.select("doc_id", F.col("n").alias("n_tokens"), "data", "lengths", "root", F.concat_ws("-", F.hex("key"), F.lpad(F.col("copy").cast("string"), 12, "0")).alias("uid"), block_of(F.col("doc_id"), cuts).alias("block"))
    # made of the objects, before recipes are placed and written
    blocked.select("block", "doc_id", "uid", "n_tokens", "root").groupBy("block").applyInArrow(_summary, MANIFEST_DDL).write.parquet(scratch.path("manifest"))
    started = running_start(blocked, ["doc_id", "uid"], "n_tokens", "block", "start")

    recipes = started.select("doc_id", "uid", "start", "n_tokens", "data", "lengths", "block", "root")
    written = recipes.repartitionByRange(blocks_for(spark) // 2 or 1, "doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    written.write.option("compression", "zstd").parquet(scratch.path("recipes"))
    given, kept = docs.count(), spark.read.schema(MANIFEST_DDL).parquet(scratch.path("manifest")).agg(F.sum("documents")).first()[0] or 0
    if given != kept:
        raise ValueError(f"the manifest has {kept} documents, the input {given}")



POLY = 0xEDB88320


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """[k, byte number, byte]: what a crc becomes when 2**k zero bytes follow, as four table look-ups."""
    def times(matrix: list[int], v: int) -> int:
        out = 0
        for m in matrix:
            if not v:
                break
            if v & 1:
                out ^= m
            v >>= 1
        return out

    one_bit = [POLY, *(1 << i for i in range(31))]
    square = lambda m: [times(m, x) for x in m]
    matrix = square(square(square(one_bit)))
    tables = []
    for _ in range(48):
        tables.append([[times(matrix, byte << (8 * j)) for byte in range(256)] for j in range(4)])
        matrix = square(matrix)
    return np.array(tables, np.uint32)


def crc_shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The crc's share in the crc of a text in which so many bytes follow."""
    t, crc, zeros = _shift_tables(), crc.astype(np.uint32), zeros.astype(np.int64)
    for k in range(int(zeros.max()).bit_length() if len(zeros) else 0):
        on = (zeros >> k) & 1 == 1
        c = crc[on]
        crc[on] = t[k, 0][c & 255] ^ t[k, 1][(c >> 8) & 255] ^ t[k, 2][(c >> 16) & 255] ^ t[k, 3][c >> 24]
    return crc


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crcs = []
        for key, n, width, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
            if hashlib.sha256(ids).digest() != key or len(ids) != 4 * n:
                raise ValueError("a stored chunk doesn't match its key")
            crcs.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crcs, pa.int64())], names=["key", "crc"])


def _read_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        uids, keys, after = [], [], []
        for uid, n, data, lengths, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = [data[i : i + 32] for i in range(0, len(data), 32)]
            size = np.frombuffer(lengths, "<u4").astype(np.int64)
            if merkle(own) != root or size.sum() != n:
                raise ValueError("a recipe doesn't match its root")
            uids += [uid] * len(own)
            keys += own
            after.append(4 * (n - np.cumsum(size)))
        flat = np.concatenate(after) if after else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.string()), pa.array(keys, pa.binary()), pa.array(flat)], names=["uid", "key", "after"])


def _shift_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = crc_shifted(b.column("crc").to_numpy(), b.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(out.astype(np.int64)), pa.array(b.column("after"))], names=["uid", "part", "after"])


def read_store(spark: SparkSession, scratch: Scratch) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of every document, from the files; all hashes are verified."""
    chunk_rows = spark.read.schema("key binary, n long, width int, data binary, kind string").parquet(scratch.path("objects")).where("kind = 'chunk'").select("key", "n", "width", "data")
    recipes = spark.read.parquet(scratch.path("recipes"))
    crcs = chunk_rows.mapInArrow(_read_chunks, "key binary, crc long")
    try:
        manifest = spark.read.schema(MANIFEST_DDL).parquet(scratch.path("manifest"))
    except AnalysisException:
        crcs.write.format("noop").mode("overwrite").save()  # damaged chunks are told first
        raise ValueError("the store has no manifest") from None
    check_manifest(recipes, manifest)
    parts = recipes.select("uid", "n_tokens", "data", "lengths", "root").mapInArrow(_read_recipes, "uid string, key binary, after long")
    shifted = parts.join(crcs, "key").select("uid", "after", "crc").mapInArrow(_shift_crcs, "uid string, part long, after long")
    whole = shifted.groupBy("uid").agg(F.bit_xor("part").alias("ids_crc32"), F.count("*").alias("found"))
    out = recipes.select("uid", "doc_id", "start", "n_tokens", (F.length("data") / 32).cast("long").alias("n_chunks")).join(whole, "uid", "left")
    lost = F.when(F.coalesce("found", F.lit(0)) != F.col("n_chunks"), F.raise_error(F.lit("a chunk of a recipe isn't in the store")).cast("long")).otherwise(F.col("ids_crc32"))
    return out.select("doc_id", "start", "n_tokens", lost.alias("ids_crc32"), "n_chunks")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "op4")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, scratch)
    release(spark)
    return read_store(spark, scratch)
