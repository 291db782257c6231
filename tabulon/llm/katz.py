"""Language-model scoring (operator 5): a Katz back-off bigram model.

Method: Good-Turing discounted n-gram counts with exactly normalised back-off weights, in tables partitioned by
history, evaluated recursively for each token: a bigram seen in training has its discounted relative frequency; any
other has the back-off weight of its history times the unigram probability; an unknown word has the unigrams'
left-over mass.

    p(w | h) = d(c) c(h, w) / (c(h) + PSEUDO)                   if c(h, w) > 0
             = alpha(h) p(w)                                    otherwise
    alpha(h) = (1 - sum of seen p(w | h)) / (1 - sum of seen p(w))

d(c) is Katz's Good-Turing discount for c up to ``K``, and 1 above. Raw counts of counts are ragged, so they are first smoothed
log-linearly over c = 1 .. K + 1, as in simple Good-Turing: n(c) ~ c**slope. The slope is kept below -1, which puts each discount
between 0 and 1; with fewer than two kinds of counts it is ``SLOPE``. PSEUDO, a small part of a count, leaves mass
for unseen words after histories that have no low counts. Each text is a start, its words and one end.

Flow. Texts are read once and packed into batches of about ``BATCH`` tokens: word numbers and a dictionary of 64-bit word
hashes (words are told apart by these). Dictionary counts go to buckets by word and come back as each word's total (unigrams)
and its id, small for frequent words. Then the distinct (history, word, document) entries of each batch, sorted, as
differences of ids and compressed, go to buckets by history, where bigrams are counted by their exact pairs of ids, and each bucket
scores its entries: discounts are global, so scores stay linear in their logarithms until counts of counts are known; entries of
unseen bigrams keep what their history's weight needs. A document's score is the sum over buckets.

Skew: counts are summed in each batch before anything is shuffled, so a word or bigram costs one entry a
document at most. Histories that have over 1 / (4 * buckets) of all tokens - at most 4 * buckets of them - are spread over
buckets by the next word; the partial sums of their weights, a few numbers each, are added up on the driver.

Defined results: null text counts as empty: one end token; a null id belongs to training; repeated rows count as
texts each; with no training text every word is unknown with probability 1; an empty table gives no rows; only doc_id
and text are read."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.packing import bucket_of, ddl, ints, squeezed, table_of, unints, unsqueezed
from tabulon.llm.tokens import numbered, trimmed
from tabulon.llm.util import Scratch, release, small_batches, table

K, PSEUDO, SLOPE, FLATTEST = 5, 1e-3, -2.0, -1.1
BATCH, BUCKET = 1_000_000, 2_000_000
END = 1  # the key that stands beside word hashes
START = 1 << 40  # the id that stands beside word ids


def words_of(text: str | None) -> list[bytes]:
    """Words by the rule [^\\x20\\x09-\\x0D]+ with A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


LONGS, DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
PACKED = {"batch": pa.string(), "doc_ids": LONGS, "held": pa.binary(), "lens": pa.binary(), "stream": pa.binary(), "keys": pa.binary(), "tokens": pa.int64(), "train_tokens": pa.int64(), "train_docs": pa.int64()}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def row() -> pa.RecordBatch:
        held = np.array([held_out(i) for i in ids], "u1")
        size = np.concatenate(sizes)
        train = held == 0
        keys = np.fromiter(number, np.uint64, len(number))
        return table_of([(uuid.uuid4().hex, ids, held.tobytes(), ints(size), squeezed([np.concatenate(parts)]), keys.tobytes(), int(size.sum()), int(size[train].sum()), int(train.sum()))], PACKED)

    number: dict[int, int] = {END: 0}
    ids: list[int | None] = []
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    n = 0
    for b in batches:
        words, coded, each = numbered(b.column(1))
        own = np.fromiter((number.setdefault(xxhash.xxh3_64_intdigest(w) | 4, len(number)) for w in words), np.uint32, len(words))
        ends = np.cumsum(each)
        stream = np.insert(own[coded], ends, 0).astype(np.uint32)  # the end is number 0
        ids += b.column(0).to_pylist()
        parts.append(stream)
        sizes.append(each + 1)
        n += len(stream)
        if n >= BATCH or len(ids) >= 1 << 15:
            yield row()
            number, ids, parts, sizes, n = {END: 0}, [], [], [], 0
    if ids:
        yield row()


def _split(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, and the buckets' bounds in it."""
    at = bucket_of(key, buckets)
    order = np.argsort(at, kind="stable")
    return at, order, np.searchsorted(at[order], np.arange(buckets + 1))


ASKED = {"bucket": pa.int32(), "batch": pa.string(), "keys": pa.binary(), "counts": pa.binary()}


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (stream,), keys = unsqueezed(r["stream"]), np.frombuffer(r["keys"], "<u8")
                train = np.repeat(np.frombuffer(r["held"], "u1") == 0, unints(r["lens"]))
                counts = np.bincount(stream[train], minlength=len(keys))
                _, order, at = _split(keys, buckets)
                parts = [order[at[i] : at[i + 1]] for i in range(buckets)]
                yield table_of([(i, r["batch"], keys[p].tobytes(), ints(counts[p])) for i, p in enumerate(parts) if len(p)], ASKED)

    return run


TOTALS = {"batch": pa.string(), "bucket": pa.int32(), "known": pa.binary(), "types": pa.int64(), "counts_of_counts": LONGS, "hot": LONGS}


def count_of_counts(total: np.ndarray) -> list[int]:
    return np.bincount(total[(total > 0) & (total <= K + 1)].astype(np.int64), minlength=K + 2)[1:].tolist()


def _total(hot_from: int, buckets: int):
    """A word's id is its place by frequency in its bucket, times the number of buckets, plus the bucket's number, from 1."""

    def run(key, got):
        parts = [np.frombuffer(k, "<u8") for k in got["keys"].to_pylist()]
        distinct, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(where, np.concatenate([unints(c) for c in got["counts"].to_pylist()]), len(distinct)).astype(np.int64)
        bucket, at, rows = key[0].as_py(), 0, []
        ids = np.empty(len(distinct), np.int64)
        ids[np.lexsort((distinct, -total))] = np.arange(len(distinct)) * buckets + bucket + 1
        for batch, part in zip(got["batch"].to_pylist(), parts, strict=True):
            own = where[at : at + len(part)]
            rows.append((batch, bucket, squeezed([total[own], ids[own]]), 0, None, None))
            at += len(part)
        rows.append((None, bucket, None, int((total > 0).sum()), count_of_counts(total), ids[total >= hot_from].tolist()))
        return pa.Table.from_batches([table_of(rows, TOTALS)])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """d(0..K) from counts of counts n(1..K+1); d(0) isn't used. With n(c) = a * c**slope, (c + 1) n(c + 1) / (c n(c)) is
    ((c + 1) / c) ** (slope + 1), and Katz's common share (K + 1) n(K + 1) / n(1) is (K + 1) ** (slope + 1)."""
    c, r = np.array(n, np.float64), np.arange(1, K + 2)
    some = c > 0
    slope = np.polyfit(np.log(r[some]), np.log(c[some]), 1)[0] if some.sum() > 1 else SLOPE
    power = min(slope, FLATTEST) + 1
    common = (K + 1) ** power
    d = np.ones(K + 1)
    d[1:] = (((r[:K] + 1) / r[:K]) ** power - common) / (1 - common)
    return d


class Unigrams:
    """p(w) from a word's training count: sums to 1 over the types and the unknown word."""

    def __init__(self, tokens: int, n: list[int]):
        self.tokens, self.d = tokens, discounts(n)
        self.low = float(sum((1 - self.d[r]) * r * n[r - 1] for r in range(1, K + 1)))
        self.more = 0.0 if self.low > 0 else 1.0

    def __call__(self, count: np.ndarray) -> np.ndarray:
        all_mass = self.tokens + self.more
        seen = count * np.where(count <= K, self.d[np.minimum(count, K).astype(np.int64)], 1.0) / all_mass
        return np.where(count > 0, seen, (self.low + self.more) / all_mass)


KNOWN = {k: v for k, v in PACKED.items() if k != "keys"} | {"known": pa.binary(), "n_known": LONGS, "base": DOUBLES}


def _attach(buckets: int, tokens: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys = np.frombuffer(r["keys"], "<u8")
                _, order, _ = _split(keys, buckets)
                counts, ids = (np.empty(len(keys), np.int64) for _ in range(2))
                parts = [unsqueezed(p["known"]) for p in r["parts"]]
                counts[order], ids[order] = (np.concatenate([p[k] for p in parts]) for k in range(2))
                (stream,) = unsqueezed(r["stream"])
                c = counts[stream]
                first = np.concatenate([[0], np.cumsum(unints(r["lens"]), dtype=np.int64)[:-1]])
                base = np.add.reduceat(np.log10((c + 1) / (tokens + types + 1)), first)
                known = np.add.reduceat((c > 0).astype(np.int64), first)
                yield table_of([tuple(r[k] for k in PACKED if k != "keys") + (squeezed([counts, ids]), known, base)], KNOWN)

    return run


#: data: histories, their counts, pairs of each, words, their counts, documents of each pair, documents, counts in them
ENTRIES = {"bucket": pa.int32(), "batch": pa.string(), "held": pa.binary(), "data": pa.binary()}


def _spread(a: np.ndarray, each: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rows of groups of so many each, with the groups in another order."""
    start = np.cumsum(each) - each
    new = each[order]
    at = np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new) + np.repeat(start[order], new)
    return a[at]


def _entries(buckets: int, hot: np.ndarray, starts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lens, (counts, ids) = unints(r["lens"]).astype(np.int64), unsqueezed(r["known"])
                keys, counts = np.append(ids.astype(np.uint64), np.uint64(START)), np.append(counts.astype(np.int64), starts)
                by_id = np.argsort(keys)  # numbers in the order of ids, so that entries come sorted by them
                place = np.empty_like(by_id)
                place[by_id] = np.arange(len(by_id))
                keys, counts = keys[by_id], counts[by_id]
                stream = place[unsqueezed(r["stream"])[0]].astype(np.uint64)
                n, docs = np.uint64(len(keys)), np.uint64(len(lens))
                before = np.empty_like(stream)
                before[1:] = stream[:-1]
                before[np.cumsum(lens) - lens] = n - np.uint64(1)  # the start has the largest id
                all_of = ((before * n + stream) * docs) + np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
                all_of.sort()
                new = np.flatnonzero(np.append(True, all_of[1:] != all_of[:-1]))
                entry, count = all_of[new], np.diff(np.append(new, len(all_of)))
                pair, doc = entry // docs, (entry % docs).astype(np.int64)
                new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                pair, each = pair[new], np.diff(np.append(new, len(pair)))
                h, w = (pair // n).astype(np.int64), (pair % n).astype(np.int64)
                with np.errstate(over="ignore"):
                    lane = np.where(np.isin(keys, hot)[h], keys[h] ^ (keys[w] * np.uint64(0x9E3779B97F4A7C15)), keys[h])
                _, order, at = _split(lane, buckets)
                h, w = h[order], w[order]
                doc, count, each = _spread(doc, each, order), _spread(count, each, order), each[order]
                entry_at = np.append(0, np.cumsum(each))
                rows = []
                for i in range(buckets):
                    p = slice(at[i], at[i + 1])
                    if at[i] == at[i + 1]:
                        continue
                    e = slice(entry_at[at[i]], entry_at[at[i + 1]])
                    runs = np.flatnonzero(np.append(True, h[p][1:] != h[p][:-1]))
                    own = h[p][runs]
                    data = squeezed([keys[own], counts[own], np.diff(np.append(runs, at[i + 1] - at[i])), keys[w[p]], counts[w[p]], each[p], doc[e], count[e]], deltas=(0, 3))
                    rows.append((i, r["batch"], r["held"], data))
                yield table_of(rows, ENTRIES)

    return run


SCORED = {"kind": pa.string(), "batch": pa.string(), "docs": pa.binary(), "sums": pa.binary(), "low": pa.binary(), "open_docs": pa.binary(), "open_counts": pa.binary(), "open_history": pa.binary(), "histories": pa.binary(), "weights": pa.binary(), "counts_of_counts": LONGS}


def _score(unigrams: Unigrams, hot: np.ndarray):
    """One bucket: its bigram counts, and of every batch what its documents score by them. A row of weights is
    (low counts 1..K, the rest of the mass, the seen words' unigram mass, the history's count)."""

    def run(key, got):
        rows, at_pair = [], 0
        blobs = got.select(["batch", "held"]).to_pylist()
        data = [unsqueezed(x) for x in got["data"].to_pylist()]
        h = np.concatenate([np.repeat(x[0].astype(np.uint64), x[2]) for x in data])
        cs = [np.repeat(x[1].astype(np.int64), x[2]) for x in data]
        w, w_local = np.unique(np.concatenate([x[3] for x in data]), return_inverse=True)
        names, hist = np.unique(h, return_inverse=True)
        _, first, which = np.unique(hist * len(w) + w_local, return_index=True, return_inverse=True)
        hist = hist[first]
        del w, w_local, h
        wc = np.concatenate([x[4].astype(np.int64) for x in data])
        each, doc, count = ([x[k].astype(np.int64) for x in data] for k in (5, 6, 7))
        del data
        held = [np.frombuffer(r["held"], "u1") for r in blobs]
        own = [np.add.reduceat(np.where(o[d] == 0, c, 0), np.cumsum(e) - e) for e, d, c, o in zip(each, doc, count, held, strict=True)]
        total = np.bincount(which, np.concatenate(own), len(first)).astype(np.int64)
        weights = np.zeros((len(names), K + 3))
        for r in range(1, K + 1):
            weights[:, r - 1] = np.bincount(hist[total == r], minlength=len(names))
        weights[:, K] = np.bincount(hist, np.where(total > K, total, 0), len(names))
        p = unigrams(wc)
        weights[:, K + 1] = np.bincount(hist, np.where(total > 0, p[first], 0.0), len(names))
        weights[hist, K + 2] = np.concatenate(cs)[first]
        spread = np.isin(names, hot)
        for r, c, e, d, n, o in zip(blobs, cs, each, doc, count, held, strict=True):
            mine = slice(at_pair, at_pair + len(e))
            at_pair += len(e)
            t = np.repeat(total[which[mine]], e)
            seen = t > 0
            with np.errstate(divide="ignore"):
                log = np.where(seen, np.log10(np.maximum(t, 1) / (np.repeat(c, e) + PSEUDO)), np.log10(np.repeat(p[mine], e)))
            docs = np.unique(d)
            low = np.stack([np.bincount(d, np.where(t == k, n, 0), len(o)).astype(np.int64)[docs] for k in range(1, K + 1)], 1)
            sums = np.bincount(d, n * log, len(o))[docs]
            open_h = np.repeat(hist[which[mine]], e)[~seen]
            used, local = np.unique(open_h, return_inverse=True)
            rows.append(("batch", r["batch"], ints(docs), sums.tobytes(), ints(low.ravel()), ints(d[~seen]), ints(n[~seen]), ints(local), np.where(spread[used], names[used], 0).astype("<u8").tobytes(), weights[used].tobytes(), None))
        rows.append(("bucket", None, None, None, None, None, None, None, names[spread].tobytes(), weights[spread].tobytes(), count_of_counts(total)))
        return pa.Table.from_batches([table_of(rows, SCORED)])

    return run


def log_alpha(weights: np.ndarray, d: np.ndarray) -> np.ndarray:
    r = np.arange(1, K + 1)
    kept = (weights[:, :K] * (r * d[1:])).sum(1) + weights[:, K]
    mass = weights[:, K + 2] + PSEUDO
    return np.log10((mass - kept) / mass) - np.log10(1 - weights[:, K + 1])


SUMS = {"batch": pa.string(), "docs": pa.binary(), "sums": pa.binary()}


def _close(d: np.ndarray, hot_names: np.ndarray, hot_alpha: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                docs, sums = unints(r["docs"]).astype(np.int64), np.frombuffer(r["sums"], np.float64).copy()
                sums += unints(r["low"]).reshape(-1, K) @ np.log10(d[1:])
                names = np.frombuffer(r["histories"], "<u8")
                if len(names):
                    alpha = log_alpha(np.frombuffer(r["weights"], np.float64).reshape(-1, K + 3), d)
                    spread = names > 0
                    alpha[spread] = hot_alpha[np.searchsorted(hot_names, names[spread])]
                    share = np.bincount(np.searchsorted(docs, unints(r["open_docs"])), unints(r["open_counts"]) * alpha[unints(r["open_history"])], len(docs))
                    sums += share
                rows.append((r["batch"], ints(docs), sums.tobytes()))
            yield table_of(rows, SUMS)

    return run


RESULT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _finish(tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                score = np.zeros(len(r["doc_ids"]))
                for p in r["parts"]:
                    score[unints(p["docs"])] += np.frombuffer(p["sums"], np.float64)
                held = np.frombuffer(r["held"], "u1") > 0
                cols = [r["doc_ids"], held, unints(r["lens"]).astype(np.int64), r["n_known"], np.full(len(score), tokens), r["base"], score]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, RESULT.values(), strict=True)], names=list(RESULT))

    return run


def katz_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "katz")
    mapped = lambda df, f, kinds: df.mapInArrow(lambda batches: trimmed(f(batches)), ddl(kinds))
    packed = scratch.write(mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _pack, PACKED), "packed")
    known = packed.agg(F.sum("train_tokens"), F.sum("train_docs"), F.sum("tokens")).first()
    tokens, starts, all_tokens = (int(x or 0) for x in known)
    buckets = max(4, -(-all_tokens // BUCKET))
    hot_from = max(2, tokens // (4 * buckets))

    asked = mapped(packed.select("batch", "held", "lens", "stream", "keys"), _ask(buckets), ASKED)
    totals = scratch.write(asked.groupBy("bucket").applyInArrow(_total(hot_from, buckets), ddl(TOTALS)), "totals")
    stats = totals.where("batch is null").select("types", "counts_of_counts", "hot").collect()  # one row a bucket
    types = sum(r["types"] for r in stats)
    unigrams = Unigrams(tokens, [sum(r["counts_of_counts"][i] for r in stats) for i in range(K + 1)])
    hot = np.array([START, *(h for r in stats for h in r["hot"])], np.int64).view(np.uint64)
    parts = totals.where("batch is not null").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "known"))).alias("parts"))
    batches = scratch.write(mapped(packed.join(parts, "batch"), _attach(buckets, tokens, types), KNOWN), "known")
    del asked, parts
    scratch.drop("packed")
    scratch.drop("totals")
    release(spark)

    entries = mapped(batches.select("batch", "held", "lens", "stream", "known"), _entries(buckets, hot, starts), ENTRIES)
    scored = scratch.write(entries.groupBy("bucket").applyInArrow(_score(unigrams, hot), ddl(SCORED)), "scored")
    del entries
    release(spark)
    names: dict[int, np.ndarray] = {}
    n = np.zeros(K + 1, np.int64)
    for r in scored.where("kind = 'bucket'").select("histories", "weights", "counts_of_counts").collect():  # hot histories only
        n += r["counts_of_counts"]
        for h, w in zip(np.frombuffer(r["histories"], "<u8").tolist(), np.frombuffer(r["weights"], np.float64).reshape(-1, K + 3), strict=True):
            names[h] = names[h] + w * ([1] * (K + 2) + [0]) if h in names else w.copy()
    d = discounts(n.tolist())
    hot_names = np.array(sorted(names), np.uint64)
    hot_alpha = log_alpha(np.stack([names[h] for h in sorted(names)]), d) if names else np.empty(0)
    sums = mapped(scored.where("kind = 'batch'").drop("counts_of_counts", "kind"), _close(d, hot_names, hot_alpha), SUMS)
    by_batch = sums.groupBy("batch").agg(F.collect_list(F.struct("docs", "sums")).alias("parts"))
    rows = batches.select("batch", "doc_ids", "held", "lens", "n_known", "base").join(by_batch, "batch")
    return rows.mapInArrow(_finish(tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
