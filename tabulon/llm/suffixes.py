"""Suffix-array dedup (operator 3): removes each byte that lies in a string of ``SPAN`` bytes that also starts earlier.

Method: a hash-compared suffix sort. Two suffixes are compared by the longest prefix that they share, found by binary
search over prefix polynomial hashes, so a comparison takes log steps whatever they share; a merge sort with that
comparison brings equal suffixes together, and equal ones are verified byte by byte, since hashes can collide.

A suffix counts for its first SPAN bytes only, so suffixes are first dealt out by content. Of the ``GRAM``-byte grams that
start in a window's first SPAN - GRAM + 1 bytes the one with the least hash is its anchor. Equal windows have equal
anchors at equal places, so a window meets all its equals in the group of its anchor.

1. ``_anchors`` lists the anchors of each text with the digest of the text; ``_repeated`` finds by hash which anchors occur
   twice. A text equal to an earlier one goes whole (if it has SPAN bytes) and takes no further part.
2. ``_contexts`` cuts, around each anchor that occurs twice, the bytes that its windows cover. Of equal contexts in a batch
   the first is sent; the later ones are repeats whatever else there is.
3. ``_sorted_group`` takes a block of anchor groups: equal contexts fold into their first, window hashes that occur once
   are put aside, and the others' suffixes are sorted; all but the first of equal suffixes are repeats.
4. Repeats are merged into spans by document, and texts are cut where they are read.

Skew: a passage in a third of all documents costs its block one context for each batch where its anchors lie deep in it.
Near its edges contexts hold each document's own bytes and differ, so the contexts of an anchor that occurs ``HOT``
times are sent as single windows, dealt by anchor and by the window's own hash: equal windows still meet, of those of a
batch only the first is sent, and the others spread over all blocks. So no group grows with the number of documents by
more than a window a batch. Texts aren't shuffled while the tables that belong to them are small enough to be broadcast, which is checked;
beyond that they are joined by shuffle.

Order: documents by id; rows with equal ids by their digest; rows with equal ids and texts are one document with equal
results. Defined results: null or empty text: 0 bytes, nothing removed; texts below SPAN bytes keep all; an empty table gives no
rows; only doc_id and text are read; a null id comes before all others."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.jaccard import mixed
from tabulon.llm.packing import bucket_of, ints, table_of, unints
from tabulon.llm.tokens import trim, trimmed
from tabulon.llm.util import Scratch, release, small_batches, table

SPAN, GRAM = 100, 32
WINDOW = SPAN - GRAM + 1
BASE = np.uint64(0x9E3779B97F4A7C15)
LETTER = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
CHUNK = 1 << 20  # bytes whose grams are hashed together
FLUSH = 10 << 20  # bytes of text of a row of anchors or a batch of contexts
BLOCK = 24 << 20  # bytes of text for each block of anchor groups
TOGETHER = 10_000  # contexts that are compared together
BROADCAST_BYTES = 32 << 20
HOT = 1000  # occurrences from which an anchor's windows are dealt one by one
LOW = np.uint64((1 << 27) - 1)


def anchors_of(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that follow one another: (anchor, first window, last window) as places in data, and the gram's hash."""
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if len(data) < SPAN:
        return none
    with np.errstate(over="ignore"):
        h, power = LETTER[data], BASE
        for k in (1, 2, 4, 8, 16):
            h = h[:-k] * power + h[k:]
            power = power * power
        h = mixed(h)
    low = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= WINDOW:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (WINDOW - reach)], low[WINDOW - reach :])
    end = np.cumsum(size)
    room = np.repeat(end, size)[: len(low)] - np.arange(len(low))
    start = np.flatnonzero(room >= SPAN)
    if not len(start):
        return none
    at = (low[start] & LOW).astype(np.int64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[new], start[new], start[np.append(new[1:], len(at)) - 1], h[at[new]]


def _chunks(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """(text number, start, end) of pieces that are hashed together. A long text is cut; pieces overlap by SPAN - 1 bytes, so
    each window lies in one."""
    own, n = [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(len(t) - SPAN + 1, 1), CHUNK):
            end = min(start + CHUNK + SPAN - 1, len(t))
            if own and n + end - start > CHUNK:
                yield own
                own, n = [], 0
            own.append((i, start, end))
            n += end - start
    if own:
        yield own


def found_in(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first window, last window, hash) of all texts; places are inside the text."""
    parts = []
    for own in _chunks(texts):
        number, begin, end = (np.array(x, np.int64) for x in zip(*own, strict=True))
        size = end - begin
        first = np.cumsum(size) - size
        at, lo, hi, h = anchors_of(np.frombuffer(b"".join(texts[i][s:e] for i, s, e in own), "u1"), size)
        doc = np.searchsorted(first, at, "right") - 1
        # empty texts share their start with the next one; the last of equals is the one that has bytes
        move = begin[doc] - first[doc]
        parts.append((number[doc], at + move, lo + move, hi + move, h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def tag_of(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


ANCHORED = {"batch": pa.string(), "doc_ids": pa.list_(pa.int64()), "shas": pa.binary(), "sizes": pa.binary(), "each": pa.binary(), "hashes": pa.binary()}
ANCHORED_DDL = "batch string, doc_ids array<long>, shas binary, sizes binary, each binary, hashes binary"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import uuid

    def row() -> pa.RecordBatch:
        doc, _, _, _, h = found_in(texts)
        each = np.bincount(doc, minlength=len(texts))
        return table_of([(uuid.uuid4().hex, ids, b"".join(hashlib.sha256(t).digest() for t in texts), ints(np.array([len(t) for t in texts])), ints(each), h.tobytes())], ANCHORED)

    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(encoded(t))
            n += len(texts[-1])
            if n > FLUSH:
                yield row()
                ids, texts, n = [], [], 0
    if ids:
        yield row()


def _asked(blocks: int):
    """Each batch's distinct hashes by block, six bytes each (a false match costs a context, no result)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h, count = np.unique(np.frombuffer(r["hashes"], "<u8"), return_counts=True)
                at = bucket_of(h, blocks)
                rows = []
                for i in range(blocks):
                    own = at == i
                    if own.any():
                        c = count[own]
                        rows.append((i, r["batch"], h[own].view("u1").reshape(-1, 8)[:, 2:].tobytes(), np.packbits(c > 1).tobytes() + ints(c[c > 1])))
                yield table_of(rows, {"block": pa.int32(), "batch": pa.string(), "hashes": pa.binary(), "twice": pa.binary()})

    return run


def _six(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), "u1")
    wide[:, :6] = np.frombuffer(b, "u1").reshape(-1, 6)
    return wide.view("<u8").ravel()


def _repeated(hot: int):
    """flags: of a batch's hashes those that occur twice, and then, if there are any, those that occur ``hot`` times."""

    def run(key, got):
        parts = [_six(h) for h in got["hashes"].to_pylist()]
        times = []
        for t, p in zip(got["twice"].to_pylist(), parts, strict=True):
            bits = -(-len(p) // 8)
            c = np.ones(len(p), np.int64)
            c[np.unpackbits(np.frombuffer(t, "u1", bits), count=len(p)) > 0] = unints(t[bits:])
            times.append(c)
        _, where = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(where, np.concatenate(times))[where]
        at, rows = 0, []
        for batch, p in zip(got["batch"].to_pylist(), parts, strict=True):
            own = count[at : at + len(p)]
            often = np.packbits(own >= hot).tobytes() if (own >= hot).any() else b""
            rows.append((batch, key[0].as_py(), np.packbits(own > 1).tobytes() + often))
            at += len(p)
        trim()
        return pa.Table.from_batches([table_of(rows, {"batch": pa.string(), "block": pa.int32(), "flags": pa.binary()})])

    return run


DOCS_DDL = "doc_id long, tag long, sha binary, n_bytes long, flags binary, hot binary"


def _documents(blocks: int):
    """A row a document: id, digest, size, and which of its anchors occur twice and which are hot (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h = np.frombuffer(r["hashes"], "<u8")
                distinct, where = np.unique(h, return_inverse=True)
                at = bucket_of(distinct, blocks)
                flag, often = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
                for p in r["parts"] or []:
                    own = np.flatnonzero(at == p["block"])
                    bits = -(-len(own) // 8)
                    flag[own] = np.unpackbits(np.frombuffer(p["flags"], "u1", bits), count=len(own)) > 0
                    if len(p["flags"]) > bits:
                        often[own] = np.unpackbits(np.frombuffer(p["flags"], "u1", bits, bits), count=len(own)) > 0
                flag, often = flag[where], often[where]
                each, sizes = unints(r["each"]).astype(np.int64), unints(r["sizes"]).astype(np.int64)
                ends = np.cumsum(each)
                shas = [r["shas"][i : i + 32] for i in range(0, len(r["shas"]), 32)]
                flags, hot = ([np.packbits(f[e - n : e]).tobytes() if f[e - n : e].any() else None for e, n in zip(ends.tolist(), each.tolist(), strict=True)] for f in (flag, often))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([tag_of(s) for s in shas], pa.int64()), pa.array(shas, pa.binary()), pa.array(sizes), pa.array(flags, pa.binary()), pa.array(hot, pa.binary())], names=["doc_id", "tag", "sha", "n_bytes", "flags", "hot"])

    return run


CONTEXTS = {"block": pa.int32(), "meta": pa.binary(), "data": pa.binary(), "done": pa.binary()}
CONTEXTS_DDL = "block int, meta binary, data binary, done binary"


def _order(doc_id: int | None) -> int:
    return -(1 << 63) if doc_id is None else doc_id


def _contexts(blocks: int):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        import zstandard

        rows = list({(i, tag): (i, tag, t, f, o) for i, tag, t, f, o in rows}.values())
        texts = [t for _, _, t, _, _ in rows]
        doc, at, lo, hi, h = found_in(texts)
        each = np.bincount(doc, minlength=len(texts))
        bits = lambda f, n: np.unpackbits(np.frombuffer(f or bytes(-(-n // 8)), "u1"), count=n)
        flags, often = (np.concatenate([bits(r[k], n) for r, n in zip(rows, each.tolist(), strict=True)]) > 0 for k in (3, 4))
        doc, at, lo, hi, h, often = (x[flags] for x in (doc, at, lo, hi, h, often))
        ids = np.array([_order(r[0]) for r in rows], np.int64)
        tags = np.array([r[1] for r in rows], np.int64)
        order = np.lexsort((lo, tags[doc], ids[doc]))
        seen: set = set()
        kept: list[tuple] = []  # document, anchor, first and last window, hash, bytes; no bytes: an earlier one is equal
        for d, a, s, e, x, split in zip(*(c[order].tolist() for c in (doc, at, lo, hi, h, often)), strict=True):
            context = (a - s, texts[d][s : e + SPAN])
            if context in seen:
                kept.append((d, a, s, e, x, b""))
                continue
            seen.add(context)
            if not split:
                kept.append((d, a, s, e, x, context[1]))
                continue
            for w in range(s, e + 1):
                window = (a - w, texts[d][w : w + SPAN])
                new = e == s or window not in seen
                seen.add(window)
                own = int.from_bytes(hashlib.blake2b(window[1], digest_size=8).digest(), "little") ^ x ^ (a - w) if new else x
                kept.append((d, a, w, w, own, window[1] if new else b""))
        doc, at, lo, hi = (np.array([k[j] for k in kept], np.int64) for j in range(4))
        h = np.array([k[4] for k in kept], np.uint64)
        data = [k[5] for k in kept]
        first = np.array([len(x) > 0 for x in data], bool)
        ids, tags = ids[doc], tags[doc]
        out = []
        where = bucket_of(h, blocks)
        pack = zstandard.ZstdCompressor(level=1).compress
        again = ~first
        done_at = bucket_of((ids ^ tags).view(np.uint64), blocks)
        for b in range(blocks):
            own = np.flatnonzero(first & (where == b))
            past = np.flatnonzero(again & (done_at == b))
            if len(own) or len(past):
                meta = np.stack([h[own].view(np.int64), ids[own], tags[own], at[own], lo[own], hi[own]])
                done = np.stack([ids[past], tags[past], lo[past], hi[past] + SPAN])
                out.append((b, pack(meta.tobytes()), pack(b"".join(data[i] for i in own.tolist())), pack(done.tobytes())))
        return table_of(out, CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for b in batches:
            for i, text, tag, flags, hot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = encoded(text)
                if tag_of(hashlib.sha256(t).digest()) != tag:
                    continue  # another row with this id
                rows.append((i, tag, t, flags, hot))
                n += len(t)
                if n > FLUSH:
                    yield flush(rows)
                    rows, n = [], 0
                    trim()
        if rows:
            yield flush(rows)

    return run


class Suffixes:
    """Contexts in a matrix, anchors in one column, and the prefix polynomial hashes of each row."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.hash = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        self.power = np.ones(SPAN + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(rows.shape[1]):
                self.hash[:, j + 1] = self.hash[:, j] * BASE + LETTER[rows[:, j]]
            for j in range(SPAN):
                self.power[j + 1] = self.power[j] * BASE

    def part(self, row: np.ndarray, start: np.ndarray, n) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.hash[row, start + n] - self.hash[row, start] * self.power[n]

    def shared(self, ra: np.ndarray, sa: np.ndarray, rb: np.ndarray, sb: np.ndarray) -> np.ndarray:
        """The length of the prefix that two suffixes share, up to SPAN: binary search over hashes."""
        low, high = np.zeros(len(ra), np.int64), np.full(len(ra), SPAN)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.part(ra, sa, mid) == self.part(rb, sb, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, ra, sa, rb, sb, or_equal: bool) -> np.ndarray:
        n = self.shared(ra, sa, rb, sb)
        end = n == SPAN
        at = np.minimum(n, SPAN - 1)
        a, b = self.rows[ra, sa + at], self.rows[rb, sb + at]
        return np.where(end, or_equal, a < b)

    def sort(self, segment: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Order by (segment, suffix), stable, of items that come by segment: a merge sort of all segments at once. An
        item's place after a merge is its place in its run plus the number of the other run's items before it, found by
        binary search."""
        n = len(segment)
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        size = np.diff(np.append(first, n))
        begin, length = np.repeat(first, size), np.repeat(size, size)
        order, width = np.arange(n), 1
        while n and width < size.max():
            inside = np.arange(n) - begin
            run = inside // width
            mine = begin + run * width
            other = begin + (run ^ 1) * width
            other_end = np.minimum(other + width, begin + length)
            has = other < begin + length
            low, high = np.where(has, other, 0), np.where(has, other_end, 0)
            right = run % 2 == 1  # of equal items those of the left run come first
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                a, b = order[mid], order[open_]
                before = np.where(right[open_], self.less(row[a], start[a], row[b], start[b], True), self.less(row[a], start[a], row[b], start[b], False))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            smaller = np.where(has, low - other, 0)
            place = np.minimum(mine, np.where(has, other, mine)) + (np.arange(n) - mine) + smaller
            new = np.empty_like(order)
            new[place] = order
            order, width = new, 2 * width
        return order


def repeats(h: np.ndarray, key: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, data: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts that come by (hash, document order): (context, first window, last window) of windows that have an equal
    one before them."""
    n, size = len(h), hi - lo + SPAN
    left = WINDOW - 1 - (at - lo)
    rows = np.zeros((n, WINDOW - 1 + SPAN), "u1")
    flat = np.repeat(np.arange(n) * rows.shape[1] + left, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rows.ravel()[flat] = data[np.repeat(offset, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    s = Suffixes(rows)
    whole = s.hash[:, -1]
    group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
    # equal contexts fold into their first
    order = np.lexsort((np.arange(n), size, left, whole, group))
    same = np.append(False, (group[order][1:] == group[order][:-1]) & (whole[order][1:] == whole[order][:-1]) & (left[order][1:] == left[order][:-1]) & (size[order][1:] == size[order][:-1]))
    head = np.empty(n, np.int64)
    head[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(n)))]
    equal = (rows == rows[head]).all(1)  # a collision leaves a context on its own
    folded = equal & (head != np.arange(n))
    out = [(np.flatnonzero(folded), lo[folded], hi[folded])]
    kept = np.flatnonzero(~folded)
    many = np.bincount(group[kept], minlength=group[-1] + 1)[group[kept]] > 1
    kept = kept[many]
    if len(kept):
        each = hi[kept] - lo[kept] + 1
        row = np.repeat(kept, each)
        window = np.repeat(lo[kept], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        start = window - at[row] + WINDOW - 1
        print_ = s.part(row, start, SPAN)
        segment = group[row] * WINDOW + start
        order = np.lexsort((row, print_, segment))
        row, window, start, print_, segment = (x[order] for x in (row, window, start, print_, segment))
        same = np.append(False, (segment[1:] == segment[:-1]) & (print_[1:] == print_[:-1]))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(row))))
        # a hash's first window stands for all windows that hold the same bytes; others are sorted on their own
        true = np.ones(len(row), bool)
        told = np.flatnonzero(same)
        for part in np.array_split(told, max(1, len(told) // 200_000)):
            a, b = part, first[part]
            true[part] = (rows[row[a][:, None], start[a][:, None] + np.arange(SPAN)] == rows[row[b][:, None], start[b][:, None] + np.arange(SPAN)]).all(1)
        stands = ~same | ~true
        shared = np.bincount(first, minlength=len(row)) > 1
        item = np.flatnonzero(stands & (shared[first]))
        again = same & true
        sorted_ = item[s.sort(segment[item], row[item], start[item])]
        a, b = sorted_[1:], sorted_[:-1]
        near = (segment[a] == segment[b]) & (s.shared(row[a], start[a], row[b], start[b]) == SPAN)
        a, b = a[near], b[near]
        if len(a):  # equal bytes, verified, under two hashes or beside a collision
            really = (rows[row[a][:, None], start[a][:, None] + np.arange(SPAN)] == rows[row[b][:, None], start[b][:, None] + np.arange(SPAN)]).all(1)
            again[np.maximum(a, b)[really]] = True
        hit = np.flatnonzero(again)
        hit = hit[np.lexsort((window[hit], row[hit]))]
        r, w = row[hit], window[hit]
        if len(r):
            new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)))
            out.append((r[new], w[new], w[np.append(new[1:], len(r)) - 1]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


SPANS = {"part": pa.int32(), "spans": pa.binary()}


def _sorted_group(blocks: int):
    def run(key, got):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        meta, data, done = [], [], []
        for r in got.to_pylist():
            meta.append(np.frombuffer(unpack(r["meta"]), "<i8").reshape(6, -1))
            data.append(np.frombuffer(unpack(r["data"]), "u1"))
            done.append(np.frombuffer(unpack(r["done"]), "<i8").reshape(4, -1))
        m, bytes_ = np.concatenate(meta, 1), np.concatenate(data)
        spans = [np.concatenate(done, 1)]
        size = m[5] - m[4] + SPAN
        offset = np.cumsum(size) - size
        order = np.lexsort((m[4], m[2], m[1], m[0]))
        m, offset = m[:, order], offset[order]
        if m.shape[1]:  # a row that is there twice is one document
            once = np.append(True, (m[:3, 1:] != m[:3, :-1]).any(0) | (m[4, 1:] != m[4, :-1]))
            m, offset = m[:, once], offset[once]
        start = np.flatnonzero(np.append(True, m[0, 1:] != m[0, :-1])) if m.shape[1] else np.empty(0, np.int64)
        count = np.diff(np.append(start, m.shape[1]))
        kept = np.flatnonzero(np.repeat(count, count) > 1)
        m, offset = m[:, kept], offset[kept]
        at = 0
        while at < m.shape[1]:
            end = min(at + TOGETHER, m.shape[1])
            while end < m.shape[1] and m[0, end] == m[0, end - 1]:
                end += 1
            x = m[:, at:end]
            who, first, last = repeats(x[0].view(np.uint64), x[1], x[3], x[4], x[5], bytes_, offset[at:end])
            spans.append(np.stack([x[1][who], x[2][who], first, last + SPAN]))
            at = end
        found = np.concatenate(spans, 1)
        part = bucket_of((found[0] ^ found[1]).view(np.uint64), blocks)
        pack = zstandard.ZstdCompressor(level=1).compress
        rows = [(p, pack(np.ascontiguousarray(found[:, part == p]).tobytes())) for p in np.unique(part).tolist()]
        out = pa.Table.from_batches([table_of(rows, SPANS)])
        trim()
        return out

    return run


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of spans that overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _by_document(key, got):
    import zstandard

    found = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(s), "<i8").reshape(4, -1) for s in got["spans"].to_pylist()], 1)
    order = np.lexsort((found[2], found[1], found[0]))
    found = found[:, order]
    rows = []
    new = np.flatnonzero(np.append(True, (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), found.shape[1]], strict=True):
        start, end = merged_spans(found[2, a:b], found[3, a:b])
        doc_id = int(found[0, a])
        rows.append((None if doc_id == -(1 << 63) else doc_id, int(found[1, a]), start.tolist(), end.tolist()))
    return pa.Table.from_batches([table_of(rows, {"doc_id": pa.int64(), "tag": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())})])


def _side(df: DataFrame, weight) -> DataFrame:
    """Broadcast if its rows take few bytes, else as it is."""
    size = df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _trimmed(f):
    return lambda batches: trimmed(f(batches))


def repeated_spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): documents has doc_id, tag, sha, n_bytes, first (whether no earlier row has this text); spans has
    doc_id, tag, starts, ends for the first ones that hold repeats. Spans are disjoint byte ranges."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    anchored = scratch.write(texts.mapInArrow(_trimmed(_anchors), ANCHORED_DDL), "anchored")
    total = int(anchored.agg(F.sum(F.length("hashes"))).first()[0] or 0) * 4
    blocks = max(4, total // BLOCK)
    asked = anchored.select("batch", "hashes").mapInArrow(_asked(blocks), "block int, batch string, hashes binary, twice binary")
    flags = scratch.write(asked.groupBy("block").applyInArrow(_repeated(HOT), "batch string, block int, flags binary"), "flags")
    parts = flags.groupBy("batch").agg(F.collect_list(F.struct("block", "flags")).alias("parts"))
    rows = scratch.write(anchored.join(parts, "batch", "left").mapInArrow(_documents(blocks), DOCS_DDL), "flagged")
    del asked, parts
    scratch.drop("anchored")
    scratch.drop("flags")
    release(spark)
    least = rows.groupBy("sha").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("least"))
    least = scratch.write(least, "least")
    same = rows["sha"] == least["sha"]
    known = rows.join(least, same).select("doc_id", "tag", rows["sha"], "n_bytes", "flags", "hot", (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("least")).alias("first"))
    known = scratch.write(known, "documents")
    active = known.where("first and flags is not null").select("doc_id", "tag", "flags", "hot").dropDuplicates(["doc_id", "tag"])
    side = _side(active, F.length("flags") + F.coalesce(F.length("hot"), F.lit(0)) + 40).select(F.col("doc_id").alias("id"), "tag", "flags", "hot")
    cut = texts.join(side, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "tag", "flags", "hot").mapInArrow(_trimmed(_contexts(blocks)), CONTEXTS_DDL)
    found = cut.groupBy("block").applyInArrow(_sorted_group(blocks), "part int, spans binary")
    spans = scratch.write(found.groupBy("part").applyInArrow(_by_document, "doc_id long, tag long, starts array<long>, ends array<long>"), "spans")
    del cut, found
    release(spark)
    return known, spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, text, tag, starts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
            t = encoded(text)
            if tag_of(hashlib.sha256(t).digest()) == tag:
                kept, at = hashlib.sha256(), 0
                for s, e in zip(starts, ends, strict=True):
                    kept.update(t[at:s])
                    at = e
                kept.update(t[at:])
                rows.append((i, tag, sum(ends) - sum(starts), len(starts), kept.hexdigest()))
        yield table_of(rows, {"doc_id": pa.int64(), "tag": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()})


def removed_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    known, spans = repeated_spans(docs, scratch)
    side = _side(spans, F.size("starts") * 16 + 40).select(F.col("doc_id").alias("id"), "tag", "starts", "ends")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = texts.join(side, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "tag", "starts", "ends").mapInArrow(_cut, "doc_id long, tag long, n_removed long, n_spans long, kept_sha256 string")
    cut = scratch.write(cut.dropDuplicates(["doc_id", "tag"]), "cut")
    cut = cut.select(F.col("doc_id").alias("id"), F.col("tag").alias("t"), "n_removed", "n_spans", "kept_sha256")
    rows = known.join(cut, known["doc_id"].eqNullSafe(cut["id"]) & (known["tag"] == cut["t"]), "left")
    gone = ~F.col("first") & (F.col("n_bytes") >= SPAN)
    nothing = hashlib.sha256(b"").hexdigest()
    pick = lambda whole, own, none: F.when(gone, whole).otherwise(F.coalesce(own, none))
    return rows.select("doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"), pick(F.lit(nothing), F.col("kept_sha256"), F.lower(F.hex("sha"))).alias("kept_sha256"))


def cut_text(t: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the whole characters that the spans cover."""
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        while s < e and t[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(t) and t[e] & 0xC0 == 0x80:
            e -= 1
        out.append(t[at:s])
        at = max(at, e)
    out.append(t[at:])
    return b"".join(out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """documents with repeated strings cut out of the texts and n_chars as it is then; rows of which nothing is left go."""
    known, spans = repeated_spans(docs, Scratch(docs.sparkSession, "suffixes"))
    whole = known.where((~F.col("first")) & (F.col("n_bytes") >= SPAN)).select("doc_id", "tag", F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_bytes").alias("ends"))
    cuts = spans.select("doc_id", "tag", "starts", "ends").unionByName(whole.distinct())
    cuts = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "starts", "ends")).alias("cuts")).withColumnRenamed("doc_id", "id")
    side = _side(cuts, F.aggregate("cuts", F.lit(0), lambda n, c: n + F.size(c["starts"]) * 16 + 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, texts, n_chars = [], [], []
            for text, n, own in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                t = encoded(text)
                tag = tag_of(hashlib.sha256(t).digest()) if own else None
                cut = next((c for c in own or [] if c["tag"] == tag), None)
                left = cut_text(t, cut["starts"], cut["ends"]) if cut else t
                keep.append(cut is None or bool(left))
                if cut:
                    text = left.decode("utf-8", "surrogatepass")
                    n = len(text)
                texts.append(text)
                n_chars.append(n)
            rows = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("lang"), b.column("source"), pa.array(n_chars, pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    joined = rows.join(side, rows["doc_id"].eqNullSafe(F.col("id")), "left").select("doc_id", "text", "lang", "source", "n_chars", "cuts")
    return joined.mapInArrow(_trimmed(run), "doc_id long, text string, lang string, source string, n_chars long")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digests(table(spark, sf_dir, "documents"))
