"""N-gram Jaccard join (operator 1).

Method: a blocked sparse product of the document by n-gram incidence matrix with itself. A document's row is the set of
its distinct word n-grams; columns are dealt to blocks, a block's sorted (column, document) entries give each column's
list of documents, every two documents of a list add to their pair's overlap count, partial counts are summed over
blocks, and pairs whose count can't reach the bound that their sizes set are discarded. Counts of the pairs that are
left are completed over whole rows: links are decided by exact overlaps.

Size-derived bounds. Partners of sizes a and b share at least need(a, b) = ceil(percent * (a + b) / (100 + percent))
n-grams. In one order of all columns, rare to common, a row takes part with its first size - least + 1 columns only, where
least = ceil(percent / 100 * size). With c columns in common among these, two rows share at most
c + max(least) - 1, so a pair goes unless c >= need - max(least) + 1. And sizes fit only if the smaller is at least
the larger one's least.

1. ``_rows``: sizes and 128-bit digests of the sets, and a sketch of n-gram frequencies: a fixed number of counters, which
   only sets the order rare to common; any order gives the same links. Documents with equal sets are a class,
   represented by its smallest doc_id.
2. ``_columns`` deals each class's first columns to blocks; ``_lists`` gives the lists of classes that share a column.
   Columns with equal lists are one list with a weight, over all blocks. A frequent column (by the sketch) is cut
   into segments by class before it is dealt, and any longer list afterwards, so no task holds a whole hot column.
3. First product: of each list only the pairs with its head (a number in proportion to the entries). Of each
   class the pair of the largest count goes on if it passes the bound. Its links join groups of near copies.
4. Second product: the lists of one head are a block; its rows are the members' entries in these lists. Rows are cut into
   segments, those of a large component by themselves, and two segments make a tile, which is multiplied at once. A
   pair leaves its tile if its members aren't in one component yet and its count in the tile, with what both have
   outside the block, can reach the bound. Counts of tiles are then summed over blocks and meet the bound itself. Tiles
   of one component are skipped, so a group of near copies that the first product has joined costs none, and no link
   between components is missed: a pair that links shares a column, hence a list.

Texts aren't shuffled: sets of candidates are made anew where their texts are read, and go to the blocks of pairs that
ask for them.

N-grams are compared as 64-bit hashes, and sets as 128-bit digests of their hashes: two n-grams of a document and its
partner that collide would count as one (odds of about size**2 / 2**64 a pair).

Defined results: null or blank text: an empty set, linked with nothing; fewer words than n: the whole sequence is the
one n-gram; rows with equal ids count as one document in components; a row without id has a size and no component;
repeated rows each give a row; an empty table gives no rows; only doc_id and text are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.components import components
from tabulon.llm.packing import bucket_of, ints, table_of, unints
from tabulon.llm.tokens import trim, trimmed, word_hashes
from tabulon.llm.util import Scratch, release, small_batches, table

SKETCH = 1 << 20
BLOCK = 300_000  # entries of a block of columns
PAIRS = 2_000  # pairs of a block that are verified together
BROADCAST_ROWS = 1_000_000  # routes of at most this many rows (24 MB) are sent to all executors
FLUSH = 600_000
SEGMENT = 2_048  # members of a list that stay together
HOT = 16  # a column is cut before it is dealt if its counter is so many times the mean and over a segment


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s[np.append(True, s[1:] != s[:-1])]


def ngram_sets(texts: pa.Array | list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    flat, size = word_hashes(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()))
    with np.errstate(over="ignore"):
        gram = np.full(max(len(flat) - n + 1, 0), n, np.uint64)
        for k in range(n):
            gram = (gram ^ flat[k : k + len(gram)]) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(29)
        gram = mixed(gram)
        out, at = [], 0
        for s in size.tolist():
            if s >= n:
                out.append(distinct(gram[at : at + s - n + 1]))
            elif s:
                one = np.uint64(1000 + s)
                for h in flat[at : at + s]:
                    one = (one ^ h) * np.uint64(0x9E3779B97F4A7C15)
                    one ^= one >> np.uint64(29)
                out.append(mixed(np.array([one], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
            at += s
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
    return int(d[0]), int(d[1])


ROWS = {"doc_id": pa.int64(), "n": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "part": pa.int32(), "counts": pa.binary()}
ROWS_DDL = "doc_id long, n long, k1 long, k2 long, part int, counts binary"
PARTS = 16


def _rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            sets = ngram_sets(b.column(1), n)
            counts += np.bincount((np.concatenate(sets) % SKETCH).astype(np.int64), minlength=SKETCH)
            yield table_of([(i, len(s), *digest(s), None, None) for i, s in zip(b.column(0).to_pylist(), sets, strict=True)], ROWS)
        if counts.any():
            yield table_of([(None, None, None, None, i, ints(c)) for i, c in enumerate(np.split(counts, PARTS))], ROWS)

    return lambda batches: trimmed(run(batches))


def _summed(key, got):
    total = sum(unints(c).astype(np.int64) for c in got["counts"].to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([ints(total)], pa.binary())})


COLUMNS = {"block": pa.int32(), "grams": pa.binary(), "which": pa.binary(), "docs": pa.binary(), "keys": pa.binary(), "sizes": pa.binary()}
COLUMNS_DDL = "block int, grams binary, which binary, docs binary, keys binary, sizes binary"


def least_shared(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * size // 100)


def segment_of(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The segment, of so many, in which a class stands in a column."""
    return (mixed(keys.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % cuts


def _columns(n: int, percent: int, level: np.ndarray, cuts: np.ndarray, blocks: int):
    """Each class's rarest n-grams, by blocks of columns. level: the frequency's order of magnitude by counter; cuts: the
    segments of a counter's columns."""

    def flush(seen: dict) -> pa.RecordBatch:
        docs = np.array([d for d, _, _ in seen.values()], np.int64)
        sizes = np.array([s for _, s, _ in seen.values()], np.int64)
        keys = np.array([k[0] for k in seen], np.int64)
        parts = [g for _, _, g in seen.values()]
        which, grams = np.repeat(np.arange(len(parts)), [len(g) for g in parts]), np.concatenate(parts)
        many = cuts[(grams % SKETCH).astype(np.int64)].astype(np.int64)
        at = bucket_of(grams + segment_of(keys[which], many).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), blocks)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(blocks + 1))
        rows = []
        for i in np.unique(at).tolist():
            own = order[bounds[i] : bounds[i + 1]]
            used, local = np.unique(which[own], return_inverse=True)
            rows.append((i, grams[own].tobytes(), ints(local), docs[used].tobytes(), keys[used].tobytes(), ints(sizes[used])))
        return table_of(rows, COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        total = 0
        for b in batches:
            for doc_id, s in zip(b.column(0).to_pylist(), ngram_sets(b.column(1), n), strict=True):
                if doc_id is None or not len(s):
                    continue
                key = digest(s)
                if key in seen:
                    if doc_id < seen[key][0]:
                        seen[key] = (doc_id, *seen[key][1:])
                    continue
                take = len(s) - int(least_shared(np.int64(len(s)), percent)) + 1
                rank = level[(s % SKETCH).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                seen[key] = (doc_id, len(s), s[np.argpartition(rank, take - 1)[:take]])
                total += take
            if total > FLUSH:
                yield flush(seen)
                seen, total = {}, 0
        if seen:
            yield flush(seen)

    return lambda batches: trimmed(run(batches))


LISTS = {"list": pa.binary(), "segment": pa.int64(), "weight": pa.int64(), "docs": pa.list_(pa.int64()), "keys": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64())}
LISTS_DDL = "list binary, segment long, weight long, docs array<long>, keys array<long>, sizes array<long>"


def _lists(cuts: np.ndarray):
    """The lists of a block's columns. A list's name is a hash of its members, or of the column where that was cut."""

    def run(key, got):
        blobs = got.to_pylist()
        base = np.cumsum([0] + [len(r["docs"]) // 8 for r in blobs])
        gram = np.concatenate([np.frombuffer(r["grams"], "<u8") for r in blobs])
        who = np.concatenate([unints(r["which"]).astype(np.int64) + o for r, o in zip(blobs, base, strict=False)])
        docs, keys = (np.concatenate([np.frombuffer(r[c], "<i8") for r in blobs]) for c in ("docs", "keys"))
        sizes = np.concatenate([unints(r["sizes"]).astype(np.int64) for r in blobs])
        many = cuts[(gram % SKETCH).astype(np.int64)].astype(np.int64)
        part = segment_of(keys[who], many)
        order = np.lexsort((docs[who], keys[who], part, gram))
        gram, who, part, many = gram[order], who[order], part[order], many[order]
        k = keys[who]
        new = np.append(True, (gram[1:] != gram[:-1]) | (k[1:] != k[:-1]))
        gram, who, part, many = gram[new], who[new], part[new], many[new]  # of each class its smallest id
        order = np.lexsort((docs[who], part, gram))
        gram, who, part, many = gram[order], who[order], part[order], many[order]
        start = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])))
        each = np.diff(np.append(start, len(gram)))
        cut = many[start] > 1
        with np.errstate(over="ignore"):
            signs = [np.add.reduceat(mixed(docs[who].view(np.uint64) + np.uint64(c)) ^ mixed(keys[who].view(np.uint64) * np.uint64(c)), start) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            names = np.stack([np.where(cut, gram[start], signs[0]), np.where(cut, mixed(gram[start]), signs[1] + each.astype(np.uint64))], 1)
        whole = np.flatnonzero(~cut & (each > 1))
        _, first, weight = np.unique(names[whole], axis=0, return_index=True, return_counts=True)
        rows = []
        taken = [*zip(whole[first].tolist(), weight.tolist(), strict=True), *((i, 1) for i in np.flatnonzero(cut).tolist())]
        for i, w in taken:
            for j, at in enumerate(range(start[i], start[i] + each[i], SEGMENT)):
                own = who[at : min(at + SEGMENT, start[i] + each[i])]
                rows.append((names[i].tobytes(), int(part[start[i]]) << 32 | j, w, docs[own], keys[own], sizes[own]))
        out = pa.Table.from_batches([table_of(rows, LISTS)])
        trim()
        return out

    return run


def needed(a, b, percent: int):
    """What two sets of these sizes share at least if they link."""
    return -(-percent * (a + b) // (100 + percent))


def least_count(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least count of common first columns with which rows of these sizes can link."""
    return needed(a, b, percent) - least_shared(np.maximum(a, b), percent) + 1


PAIR = {"u": pa.int64(), "ku": pa.int64(), "v": pa.int64(), "kv": pa.int64(), "weight": pa.int64(), "least": pa.int64()}
PAIR_DDL = "u long, ku long, v long, kv long, weight long, least long"
SIDE = ("doc", "key", "size", "label", "rest")  # of a segment's rows; then lists and weights of their entries


def tile_counts(rows: tuple[np.ndarray, np.ndarray], cols: tuple[np.ndarray, np.ndarray], weight: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The product of two segments: counts[i, j] is the weight of the lists that row i of one and row j of the other share.
    rows, cols: the entries' rows and lists on either side; weight: of each list."""
    if sum(shape) * len(weight) <= 1 << 22:
        a, b = (np.zeros((n, len(weight)), np.float32) for n in shape)
        a[rows[0], cols[0]] = weight[cols[0]]
        b[rows[1], cols[1]] = 1
        return (a @ b.T).astype(np.int64) if weight.sum() < 1 << 24 else (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    counts = np.zeros(shape, np.int32)
    order = [np.argsort(c, kind="stable") for c in cols]
    bounds = [np.searchsorted(c[o], np.arange(len(weight) + 1)) for c, o in zip(cols, order, strict=True)]
    for k in np.intersect1d(*cols).tolist():
        x, y = (r[o[b[k] : b[k + 1]]] for r, o, b in zip(rows, order, bounds, strict=True))
        counts[np.ix_(x, y)] += weight[k]
    return counts


def _product(percent: int):
    """Pairs of tiles that can still reach their bound, with their counts. A tile has two segments, each as columns ``SIDE``,
    lists and weights; the last two are arrays for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in range(b.num_rows):
                x, y = ([b.column(k + j)[t].values for j in range(7)] for k in (1, 8))
                a, c = (np.stack([side[j].to_numpy() for j in range(5)]) for side in (x, y))
                names, where = np.unique(np.concatenate([side[5].values.to_numpy()[side[5].offsets[0].as_py() : side[5].offsets[-1].as_py()] for side in (x, y)]), return_inverse=True)
                each = [side[5].value_lengths().to_numpy() for side in (x, y)]
                rows = tuple(np.repeat(np.arange(len(e)), e) for e in each)
                cols = np.split(where, [each[0].sum()])
                weight = np.zeros(len(names), np.int64)
                for side, col in zip((x, y), cols, strict=True):
                    weight[col] = side[6].flatten().to_numpy()
                counts = tile_counts(rows, cols, weight, (a.shape[1], c.shape[1]))
                low, high = np.minimum.outer(a[2], c[2]), np.maximum.outer(a[2], c[2])
                fit = (a[3][:, None] != c[3]) & (low >= least_shared(high, percent)) & (counts > 0)
                fit &= counts + np.minimum.outer(a[4], c[4]) >= needed(low, high, percent) - least_shared(high, percent) + 1
                if b.column(0)[t].as_py():
                    fit = np.triu(fit, 1)
                i, j = np.nonzero(fit)
                u, v = a[:, i], c[:, j]
                swap = (v[0] < u[0]) | ((v[0] == u[0]) & (v[1] < u[1]))
                u, v = np.where(swap, v, u), np.where(swap, u, v)
                out.append(np.stack([u[0], u[1], v[0], v[1], counts[i, j], least_count(u[2], v[2], percent)]))
            flat = np.concatenate(out, 1) if out else np.empty((6, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], names=list(PAIR))

    return lambda batches: trimmed(run(batches))


def _candidate_sets(n: int):
    """Of the routed documents the sets, once for each block that asks. A block asks by id and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, routes, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), ngram_sets(b.column(1), n), strict=True):
                key = digest(s)[0]
                blocks = {r["block"] for r in routes if r["key"] == key}
                rows += [(x, doc_id, key, s.tobytes()) for x in blocks]
            yield table_of(rows, {"block": pa.int32(), "doc": pa.int64(), "key": pa.int64(), "grams": pa.binary()})

    return lambda batches: trimmed(run(batches))


def _verify(percent: int):
    """The pairs of a block whose counts, completed over whole rows, make a link."""

    def run(key, pairs, sets):
        of = {(d, k): np.frombuffer(g, "<u8") for d, k, g in zip(sets["doc"].to_pylist(), sets["key"].to_pylist(), sets["grams"].to_pylist(), strict=True)}
        links = []
        for u, ku, v, kv in zip(*(pairs[c].to_pylist() for c in ("u", "ku", "v", "kv")), strict=True):
            a, b = of[u, ku], of[v, kv]
            shared = np.intersect1d(a, b, assume_unique=True).size
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                links.append((u, v))
        return pa.Table.from_batches([table_of(links, {"u": pa.int64(), "v": pa.int64()})])

    return run


def column_lists(texts: DataFrame, n: int, percent: int, rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """list, segment, weight, docs, keys, sizes: the lists of two or more classes that share a column."""
    counts = np.zeros(SKETCH, np.int64)
    for r in sketch.groupBy("part").applyInArrow(_summed, "part int, counts binary").collect():  # SKETCH counters in all
        counts[r["part"] * SKETCH // PARTS : (r["part"] + 1) * SKETCH // PARTS] = unints(r["counts"])
    level = np.floor(np.log2(1 + counts.astype(np.float64)) * 2).astype(np.uint8)
    hot = counts > max(HOT * counts.mean(), 4 * SEGMENT)
    cuts = np.where(hot, np.minimum(-(-counts // (2 * SEGMENT)), 1 << 30), 1).astype(np.int32)
    size = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    blocks = max(4, int(size) // BLOCK)
    posted = texts.mapInArrow(_columns(n, percent, level, cuts, blocks), COLUMNS_DDL)
    found = posted.groupBy("block").applyInArrow(_lists(cuts), LISTS_DDL)
    return found.groupBy("list", "segment").agg(F.sum("weight").alias("weight"), *(F.first(c).alias(c) for c in ("docs", "keys", "sizes")))


def entries_of(lists: DataFrame) -> DataFrame:
    """list, weight, doc, key, size, own, head: one row a member of a list. own is the weight of all of the class's entries.
    A list's head is its member of the largest row sum of the product, that is of what it has in common with all
    others in all columns: among copies that were edited at random the one that most of them are near to."""
    rows = lists.select("list", "weight", F.size("docs").alias("n"), F.explode(F.arrays_zip(F.col("docs").alias("doc"), F.col("keys").alias("key"), F.col("sizes").alias("size"))).alias("m"))
    rows = rows.select("list", "weight", "n", "m.*")
    totals = rows.groupBy("doc", "key").agg(F.sum(F.col("weight") * (F.col("n") - 1)).alias("total"), F.sum("weight").alias("own"))
    known = rows.drop("n").join(totals, ["doc", "key"])
    heads = known.groupBy("list").agg(F.max_by(F.struct("doc", "key", "size"), F.struct("total", -F.col("doc"), "key")).alias("head"))
    return known.join(heads, "list").select("list", "weight", "doc", "key", "size", "own", "head")


def leading_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """First product: u, ku, v, kv of each class v the pair of the largest count with the head of a list, if that count
    passes the bound."""
    members = entries.withColumn("m", F.struct("doc", "key", "size"))
    least = lambda c: F.ceil(c * percent / 100)
    low, high = F.least("head.size", "m.size"), F.greatest("head.size", "m.size")
    apart = members.where((F.col("head") != F.col("m")) & (low >= least(high)))
    counted = apart.groupBy(F.col("head.doc").alias("u"), F.col("head.key").alias("ku"), F.col("m.doc").alias("v"), F.col("m.key").alias("kv"), F.col("head.size").alias("a"), F.col("m.size").alias("b")).agg(F.sum("weight").alias("weight"))
    bound = F.ceil((F.col("a") + F.col("b")) * percent / (100 + percent)) - least(F.greatest("a", "b")) + 1
    fit = counted.where((F.col("weight") >= bound) & (F.col("u") != F.col("v")))
    best = fit.groupBy("v", "kv").agg(F.max_by(F.struct("u", "ku"), F.struct("weight", -F.col("u"))).alias("to"))
    return best.select("to.u", "to.ku", "v", "kv")


def crossing_pairs(entries: DataFrame, labels: DataFrame | None, percent: int, scratch: Scratch) -> DataFrame:
    """Second product: u, ku, v, kv of all pairs between components that pass the bound."""
    made = entries.groupBy("head", "doc", "key", "size", "own").agg(F.collect_list(F.xxhash64("list")).alias("lists"), F.collect_list("weight").alias("weights"), F.sum("weight").alias("here"))
    rows = made.select("head", "doc", "key", "size", (F.col("own") - F.col("here")).alias("rest"), "lists", "weights")
    if labels is None:
        rows = rows.withColumn("label", F.col("doc"))
    else:
        rows = rows.join(labels.select(F.col("node").alias("doc"), "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    rows = scratch.write(rows, "block-rows")
    each = rows.groupBy("head", "label").agg(F.count("*").alias("n"))
    large = F.col("n") >= SEGMENT
    heads = each.groupBy("head").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.when(~large, F.col("n"))).alias("small")).where("low <> high").select("head", "small")
    cuts = scratch.write(each.join(heads, "head").select("head", "label", F.when(large, F.col("label")).alias("alone"), F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / SEGMENT).alias("cuts")), "cuts")
    by = F.when(F.col("alone").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("doc", "key"))
    placed = rows.join(cuts, ["head", "label"]).withColumn("segment", F.struct("alone", F.pmod(by, F.col("cuts")).alias("cut")))
    found = placed.groupBy("head", "segment").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.collect_list(F.struct(*SIDE, "lists", "weights")).alias("rows"))
    segments = scratch.write(found, "segments")
    a, b = (segments.select(F.col("head").alias(f"h{x}"), F.col("segment").alias(f"s{x}"), F.col("low").alias(f"l{x}"), F.col("high").alias(f"g{x}"), F.col("rows").alias(x)) for x in ("a", "b"))
    tiles = a.join(b, (F.col("ha") == F.col("hb")) & (F.col("sa") <= F.col("sb"))).where(F.least("la", "lb") != F.greatest("ga", "gb"))
    flat = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("a", "b") for c in (*SIDE, "lists", "weights")]
    parts = tiles.select((F.col("sa") == F.col("sb")).alias("same"), *flat).mapInArrow(_product(percent), PAIR_DDL)
    counted = parts.groupBy("u", "ku", "v", "kv", "least").agg(F.sum("weight").alias("weight"))
    return counted.where(F.col("weight") >= F.col("least")).select("u", "ku", "v", "kv")


def jaccard_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links reach, itself included."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = scratch.write(texts.mapInArrow(_rows(n), ROWS_DDL), "rows")
    rows = made.where("part is null").select("doc_id", "n", "k1", "k2")
    lists = scratch.write(column_lists(texts, n, percent, rows, made.where("part is not null").select("part", "counts")), "lists")
    release(spark)
    entries = scratch.write(entries_of(lists), "entries")

    links = labels = None
    for step in ("leading", "crossing"):
        found = leading_pairs(entries, percent) if step == "leading" else crossing_pairs(entries, labels, percent, scratch)
        pairs = scratch.write(found, f"{step}-pairs")
        many = pairs.count()
        if many:
            new = verified(texts, pairs, many, n, percent, scratch, f"{step}-links")
            links = new if links is None else links.unionByName(new)
            labels = components(links, scratch, f"{step}-labels")
        release(spark)
    classes = scratch.write(rows.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "classes")
    out = rows.join(classes, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("node"))
    if labels is not None:
        out = out.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    else:
        out = out.select("doc_id", "n_shingles", F.col("node").alias("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def verified(texts: DataFrame, pairs: DataFrame, many: int, n: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs that link. Pairs of a pivot share its block, salted so that a hot pivot has many."""
    blocks = max(4, many // PAIRS)
    salt = F.pmod(F.xxhash64("v"), F.lit(max(1, blocks // 4)))
    hot = scratch.write(pairs.groupBy("u").agg(F.count("*").alias("n_u")).where(F.col("n_u") > PAIRS).select(F.col("u").alias("hot_u")), f"{name}-hot")
    marked = pairs.join(hot, pairs["u"] == hot["hot_u"], "left")
    block = F.pmod(F.xxhash64("u", F.when(F.col("hot_u").isNotNull(), salt).otherwise(F.lit(-1))), F.lit(blocks)).cast("int")
    placed = scratch.write(marked.select("u", "ku", "v", "kv", block.alias("block")), f"{name}-placed")
    asks = placed.select(F.col("u").alias("doc_id"), F.col("ku").alias("key"), "block").unionByName(placed.select(F.col("v").alias("doc_id"), F.col("kv").alias("key"), "block")).distinct()
    routes = scratch.write(asks.groupBy("doc_id").agg(F.collect_list(F.struct("key", "block")).alias("routes")), f"{name}-routes")
    few = routes.count() <= BROADCAST_ROWS
    asked = texts.join(F.broadcast(routes) if few else routes, "doc_id").select("doc_id", "text", "routes")
    sets = asked.mapInArrow(_candidate_sets(n), "block int, doc long, key long, grams binary")
    return scratch.write(placed.groupBy("block").cogroup(sets.groupBy("block")).applyInArrow(_verify(percent), "u long, v long"), name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)
