"""Each operator against a brute-force version, on rows that are null, empty, repeated, tied, long or clashing."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import re

from tabulon.llm import bpe, fingerprints, jaccard, katz, licenses, mixing, pretokens, quality, store, suffixes, topk
from tabulon.llm.util import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, block int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made(seed: int = 1, n: int = 120) -> list[tuple]:
    """Documents with copies, near copies, shared passages and odd texts; the last two columns clash with names used inside."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts: list[str | None] = [None, "", " ", "\t\n", "one", "two words", "a b c", "x" * 5000, "ab " * 400, passage, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "don't we'll\n\n  <|endoftext|>  x", "日本語 テスト 😀😀"]
    base = [rng.choice(words) for _ in range(150)]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.15:
            texts.append(rng.choice(texts))
        elif kind < 0.45:
            near = list(base)
            for _ in range(rng.randint(0, 6)):
                near[rng.randrange(len(near))] = rng.choice(words).upper()
            texts.append(" ".join(near))
        else:
            own = [rng.choice(words) for _ in range(rng.randint(1, 120))]
            if rng.random() < 0.5:
                own.insert(rng.randrange(len(own)), passage)
            texts.append(rng.choice([" ", "\n", "  "]).join(own))
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None]), len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[0]]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    expected = Counter((i, len(sets[i]), top(i)) for i, *_ in rows)
    assert Counter(tuple(r) for r in jaccard.jaccard_components(docs, n, percent).collect()) == expected


def jaccard_texts(rng: random.Random) -> list[str]:
    """Groups whose members link to some others only, chains, and a passage that unlike texts share."""
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    chain = [f"c{i}" for i in range(60)]
    for k in range(12):  # each a little further from the first
        chain[5 * k] = f"d{k}"
        texts.append(" ".join(chain))
    for k in range(40):
        texts.append(" ".join([f"own{k}a{i}" for i in range(rng.randint(0, 3))] + base[:30]))
    rng.shuffle(texts)
    return texts


def test_jaccard_by_segments(spark, monkeypatch):
    """Every column is hot: cut before it is dealt and met by tiles."""
    monkeypatch.setattr(jaccard, "HOT", 0)
    monkeypatch.setattr(jaccard, "SEGMENT", 2)
    rows = [(i, t, None, None, 0, "", 0) for i, t in enumerate(jaccard_texts(random.Random(7)))]
    test_jaccard(spark.createDataFrame(rows, DOCS), rows, 4, 85)
    lists = []
    real = jaccard.entries_of
    monkeypatch.setattr(jaccard, "entries_of", lambda given: (lists.extend(given.collect()), real(given))[1])
    test_jaccard(spark.createDataFrame(rows[:60], DOCS), rows[:60], 4, 85)
    assert lists and max(len(r["docs"]) for r in lists) <= 2


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 1, 40), (3, 2, 50), (4, 1, 60)])
def test_jaccard_links_between_components(spark, monkeypatch, seed, n, percent):
    """Low limits: links of which neither end's best partner knows; only the second product finds them."""
    rng = random.Random(seed)
    base = [[rng.randrange(30) for _ in range(10)] for _ in range(3)]
    texts = jaccard_texts(rng) if seed == 1 else []
    for _ in range(40):
        t = list(dict.fromkeys(rng.choice(base)))
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.randrange(30)
        texts.append(" ".join(f"w{x}" for x in t))
    rows = [(i, t, None, None, 0, "", 0) for i, t in enumerate(texts)]
    test_jaccard(spark.createDataFrame(rows, DOCS), rows, n, percent)
    monkeypatch.setattr(jaccard, "leading_pairs", lambda entries, percent: entries.sparkSession.createDataFrame([], "u long, ku long, v long, kv long"))
    test_jaccard(spark.createDataFrame(rows, DOCS), rows, n, percent)


def test_suffixes(docs, rows):
    first, out = set(), {}
    for i, t in sorted({(r[0], (r[1] or "").encode()) for r in rows}):
        mark = np.zeros(len(t) + 1, int)
        for s in range(len(t) - 99):
            if t[s : s + 100] in first:
                mark[s] += 1
                mark[s + 100] -= 1
            first.add(t[s : s + 100])
        gone = np.cumsum(mark)[:-1] > 0
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    got = suffixes.removed_digests(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == out
    assert sum(x[1] for x in out.values()) > 1000


def boilerplate(n: int) -> list[bytes]:
    """Documents of random words with one passage at changing places."""
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(70))
    own = lambda: " ".join("".join(rng.choice("ghijkl") for _ in range(6)) for _ in range(rng.randint(18, 40)))
    return [f"{own()} {passage} {own()}".encode() for _ in range(n)]


def test_suffixes_with_hot_anchors(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    test_suffixes(docs, rows)
    texts = [(i, t.decode(), None, None, 0, "", 0) for i, t in enumerate(boilerplate(60))]
    test_suffixes(spark.createDataFrame(texts, DOCS).repartition(5), texts)


def test_hot_anchors_spread():
    """A passage in 2,000 documents with other surroundings: no group of windows holds more than a few."""
    import zstandard

    texts = boilerplate(2000)

    def largest(hot: bool) -> int:
        each = np.bincount(suffixes.found_in(texts)[0], minlength=len(texts))
        ones = [np.packbits(np.ones(n, bool)).tobytes() for n in each.tolist()]
        tags = [suffixes.tag_of(hashlib.sha256(t).digest()) for t in texts]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.decode() for t in texts]), pa.array(tags), pa.array(ones, pa.binary()), pa.array(ones if hot else [None] * len(texts), pa.binary())], names=["doc_id", "text", "tag", "flags", "hot"])
        groups = Counter()
        for out in suffixes._contexts(4)(iter([batch])):
            for meta in out.column(1).to_pylist():
                groups.update(np.frombuffer(zstandard.ZstdDecompressor().decompress(meta), "<i8").reshape(6, -1)[0].tolist())
        return max(groups.values())

    assert largest(False) > 1000
    assert largest(True) <= 3


def test_long_texts_are_cut(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 99, 100, 4000, 20, 7000)]

    def windows() -> dict:
        return {(d, w): (a, h) for d, a, lo, hi, h in zip(*(x.tolist() for x in suffixes.found_in(texts)), strict=True) for w in range(lo, hi + 1)}

    whole = windows()
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    assert windows() == whole and len(whole) == 1 + 3901 + 6901


def test_suffix_sort():
    """The merge sort against Python's, with ties in order."""
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (40, 168)).astype("u1")
    rows[5:25] = rows[5]
    rows[10:20, 130:] = 98
    s = suffixes.Suffixes(rows)
    segment = np.repeat([0, 1, 2], [25, 1, 14])
    row, start = np.arange(40), np.full(40, 30)
    order = s.sort(segment, row, start)
    assert order.tolist() == sorted(range(40), key=lambda i: (segment[i], rows[i, 30:130].tobytes()))
    assert s.shared(np.array([5]), np.array([0]), np.array([6]), np.array([0])).tolist() == [100]


def test_cut_keeps_characters_whole():
    t = "aé日b".encode()
    assert suffixes.cut_text(t, [2], [5]).decode() == "aé日b"[:2] + "日b"
    assert suffixes.cut_text(t, [1], [6]) == b"ab"


@pytest.fixture(scope="module")
def tokenizers():
    return pytest.importorskip("public_tokenizers")


def test_token_store(spark, docs, rows, tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    scratch = Scratch(spark, "test")
    store.write_store(docs, path, 2, scratch)
    got = {}
    for r in store.read_store(spark, scratch).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    at, expected = 0, {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        expected.setdefault(i, []).append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_store_tells_damage(spark, tokenizers):
    docs = spark.createDataFrame([(1, "some words", None, None, 0, "", 0)], DOCS)
    scratch = Scratch(spark, "test")
    store.write_store(docs, tokenizers.path("byte_bpe_50k.json"), 2, scratch)
    from pyspark.sql import functions as F

    bad = spark.read.parquet(scratch.path("objects")).withColumn("data", F.when(F.col("kind") == "chunk", F.concat(F.substring("data", 3, 10**6), F.substring("data", 1, 2))).otherwise(F.col("data")))
    other = Scratch(spark, "test")
    bad.write.partitionBy("kind").parquet(other.path("objects"))
    spark.read.parquet(scratch.path("recipes")).write.parquet(other.path("recipes"))
    with pytest.raises(Exception, match="match its key"):
        store.read_store(spark, other).collect()


def test_store_tells_lost_and_doubled_recipes(spark, tokenizers):
    docs = spark.createDataFrame([(i, f"words of {i}", None, None, 0, "", 0) for i in (1, 2, 3, 3, None)], DOCS)
    scratch = Scratch(spark, "test")
    store.write_store(docs, tokenizers.path("byte_bpe_50k.json"), 2, scratch)
    assert store.read_store(spark, scratch).count() == 5
    whole = spark.read.parquet(scratch.path("recipes"))
    for bad in (whole.where("doc_id = 1 or doc_id = 3 or doc_id is null"), whole.where("doc_id is null or doc_id < 3"), whole.unionByName(whole.where("doc_id = 3").limit(1)), whole.withColumn("start", whole["start"] + 1)):
        other = Scratch(spark, "test")
        for name in ("objects", "manifest"):
            store_rows = spark.read.parquet(scratch.path(name))
            (store_rows.write.partitionBy("kind") if name == "objects" else store_rows.write).parquet(other.path(name))
        bad.write.parquet(other.path("recipes"))
        with pytest.raises(Exception, match="manifest|start where"):
            store.read_store(spark, other).collect()


def test_store_rows_repeat_when_a_task_is_run_again(tokenizers):
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 1]), pa.array(["a b", "a b", None])], names=["doc_id", "text"])
    made = [list(store._objects(tokenizers.path("byte_bpe_50k.json"), 2)(iter([batch]))) for _ in range(2)]
    assert made[0] == made[1]


def test_store_encodes_odd_texts_as_the_library(tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    library, encode, rng = Tokenizer.from_file(path), store.encoder(path), random.Random(4)
    bits = ["'", "'s", "'ll", "'v", "'l", "S", " ", "  ", "\n", "\r\n", "\u0085", "\u00a0", "\u2003", "\u200b", "a", "é", "日", "😀", "1", "²", "٣", "!", "...", "\u0301", "the", "<|endoftext|>", "\x00", "\x1c", "x" * 70, "re", "m"]
    for kind, most in ((pa.string(), 6), (pa.large_string(), 40), (pa.string(), 1)):
        texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(0, most))) for _ in range(1500))]
        ids, bounds = encode(pa.array(["left out", *texts], kind).slice(1))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    ids, bounds = encode(pa.array([], pa.string()))
    assert not len(ids) and bounds.tolist() == [0]
    broken = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 2], "<i4")), pa.py_buffer(b"a\xe6")])
    with pytest.raises(pa.ArrowInvalid, match="UTF8"):
        encode(broken)


def test_store_asks_for_distinct_words_of_a_batch_at_once():
    """A call a word took most of the time of op4."""
    asked = []

    def pieces(keys):
        asked.append(sorted(keys))
        return [np.frombuffer(k, np.uint8).astype("<u4").tobytes() for k in keys]

    encode = pretokens.BatchEncoder(pieces, 2)
    texts = ["one two, one", " two\none's", "y" * 65]
    ids, bounds = encode(pa.array(texts))
    assert [bytes(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])] == [t.encode() for t in texts]
    assert asked == [sorted([b"one", b" two", b",", b" one", b"\n", b"'s", b"y" * 65])]
    for text in ("one one", " three", "y" * 65, " three one"):  # words come back from the older generation, long ones aren't kept
        assert bytes(encode(pa.array([text]))[0].tolist()) == text.encode()
    assert asked[1:] == [[], [b" three"], [b"y" * 65], []]


def test_cut_points_of_many_streams(monkeypatch):
    monkeypatch.setattr(store, "MOST", 700)
    rng = np.random.default_rng(2)
    sizes = [1, 15, 16, 17, 70_000, 1, 0, 2000, 140_000]
    streams = [rng.integers(0, 90_000, n).astype("<u4") for n in sizes] + [np.full(2000, 7, "<u4")]
    bounds = np.cumsum([0, *map(len, streams)])
    want = [store.cut_points(s) + at for s, at in zip(streams, bounds)]
    ends = store.all_cut_points(np.concatenate(streams), bounds)
    assert ends.tolist() == np.concatenate(want).tolist() and np.diff(ends, prepend=0).max() == 700
    for s, own, at in zip(streams, want, bounds):  # by the definition, id by id
        mixed = [int(store._GEAR[i & 0xFFFF]) ^ (i >> 16) for i in s.tolist()]
        cuts = [e for e in range(16, min(len(s), 3000)) if sum(m << k for k, m in enumerate(mixed[e - 16 : e][::-1])) % 2**64 >> 55 == 0]
        assert {e + at for e in cuts} <= set(own.tolist())


def test_cut_points_and_crc():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 60_000).astype("<u4")
    ends = store.cut_points(ids)
    assert ends[-1] == len(ids) and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= store.MOST
    assert set(store.cut_points(np.concatenate([ids[:777], ids]))[5:]) >= {e + 777 for e in ends[5:].tolist()}
    parts = np.split(ids, ends[:-1])
    after = 4 * (len(ids) - ends)
    shifted = store.crc_shifted(np.array([zlib.crc32(p.tobytes()) for p in parts]), after)
    assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(ids.tobytes())


def test_katz(docs, rows, monkeypatch):
    def check(frame, given):
        texts = [(i, [*words(t), None], zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False) for i, t, *_ in given]
        u, pairs, heads = Counter(), Counter(), Counter()
        for _, t, held in texts:
            if not held:
                u.update(t)
                pairs.update(zip(["<s>", *t], t, strict=False))
                heads.update(["<s>", *t[:-1]])
        n, k = sum(u.values()), 5

        def good_turing(counts):
            """Katz's discounts from counts of counts that a straight line in logarithms smooths."""
            kinds = Counter(counts.values())
            at = [(math.log(r), math.log(kinds[r])) for r in range(1, k + 2) if kinds[r]]
            mx, my = (sum(x[j] for x in at) / max(len(at), 1) for j in (0, 1))
            slope = sum((x - mx) * (y - my) for x, y in at) / sum((x - mx) ** 2 for x, _ in at) if len(at) > 1 else -2.0
            smooth = lambda r: r ** min(slope, -1.1)
            common = (k + 1) * smooth(k + 1) / smooth(1)
            d = {r: ((r + 1) * smooth(r + 1) / smooth(r) / r - common) / (1 - common) for r in range(1, k + 1)}
            assert all(0 < x < 1 for x in d.values())
            return d

        d1, d = good_turing(u), good_turing(pairs)
        unseen = sum((1 - d1[c]) * c for c in u.values() if c <= k)
        more = 0 if unseen else 1
        p = lambda w: (u[w] * (d1[u[w]] if u[w] <= k else 1) if u[w] else unseen + more) / (n + more)
        low = lambda c: c * (d[c] if c <= k else 1)
        seen = defaultdict(list)
        for (h, w), c in pairs.items():
            seen[h].append((w, c))
        alpha = {h: (1 - sum(low(c) for _, c in x) / (heads[h] + 1e-3)) / (1 - sum(p(w) for w, _ in x)) for h, x in seen.items()}
        for h in list(seen)[:25]:  # sums to one over the types and the unknown word
            all_of = sum(low(pairs[h, w]) / (heads[h] + 1e-3) if pairs[h, w] else alpha[h] * p(w) for w in u) + alpha[h] * p("not a word")
            assert all_of == pytest.approx(1)
        expected = []
        for i, t, held in texts:
            base = sum(math.log10((u[w] + 1) / (n + len(u) + 1)) for w in t)
            score = sum(math.log10(low(pairs[h, w]) / (heads[h] + 1e-3) if pairs[h, w] else alpha.get(h, 1) * p(w)) for h, w in zip(["<s>", *t], t, strict=False))
            expected.append((i, held, len(t), sum(u[w] > 0 for w in t), n, pytest.approx(base, rel=1e-9, abs=1e-9), pytest.approx(score, rel=1e-9, abs=1e-9)))
        key = lambda r: (r[0], r[2])
        assert sorted((tuple(r) for r in katz.katz_scores(frame).collect()), key=key) == sorted(expected, key=key)

    check(docs, rows)
    monkeypatch.setattr(katz, "BATCH", 700)  # many batches and buckets, hot histories
    monkeypatch.setattr(katz, "BUCKET", 900)
    check(docs, rows)


def test_good_turing_discounts():
    """Counts of counts of real training bigrams, of which raw estimates leave (0, 1); and too few to fit."""
    for n in ([1579638, 246704, 51653, 21705, 18939, 7580], [45315, 4880, 1537, 331, 336, 86], [10, 0, 0, 0, 0, 0], [0] * 6, [1, 1, 1, 1, 1, 1]):
        d = katz.discounts(n)[1:]
        assert (d > 0).all() and (d < 1).all() and (np.diff(d) > 0).all()


def test_mixing(spark, docs, rows):
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    got = mixing.mix(docs, keep=["source"]).collect()
    again = mixing.mix(docs.repartition(7), keep=["source"]).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    other = mixing.mix(docs, keep=["source"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in other)
    assert len(got) == len(rows)
    assert all(len(r["positions"]) == r["copies"] and r["positions"] == sorted(r["positions"]) and all(0 <= x <= 1 for x in r["positions"]) for r in got)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["position"] is None or 0 <= r["position"] <= 1
        taken[r["source"]] += r["taken"]
    for s in order:
        assert taken[s] == math.floor(target[s] + 1e-6)


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t / 20, s) for t in range(21) for s in (-0.8, 0.0, 0.8)], "t double, s double")
    place = F.lit(70.0) * (F.col("t") + F.col("s") * F.col("t") * (1 - F.col("t")))
    for r in df.select("t", mixing.demand_time(place, F.lit(70.0), F.col("s")).alias("x")).collect():
        assert r["x"] == pytest.approx(r["t"], abs=1e-9)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(10)], 0) for i in range(0, 400, 5)]
    vectors += [(1000, None, 0), (1001, [], 0), (1050, [float("nan")] * 10, 0), (1051, [None, 1.0], 0), (1100, [0.5] * 4, 0), (1101, [0.5] * 10, 0), (1102, [0.5] * 10, 0), (1103, [0.5] * 10, 0), (1103, [0.5] * 10, 0), (1150, [float("inf")], 0)]
    vectors += [vectors[10], (150, [0.25] * 10, 0), (150, [0.125] * 10, 0)]  # 50 twice, 150 with three vectors
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(4)
    whole = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v, _ in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    asked = {}
    for (i, v, _), (q, a) in zip([x for x in vectors if x[0] in {w[0] for w in whole}], whole, strict=True):
        if q % 50 == 0 and (q not in asked or v < asked[q][0]):
            asked[q] = (v, a)
    for q, (_, a) in asked.items():
        best = sorted(((sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in whole if i != q), key=lambda s: (-s[0], s[1]))[:5]
        expected += [(q, k + 1, i, s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df, 5, 50).collect()) == sorted(expected)


def test_topk_copies_no_query_to_the_driver(spark):
    """Copies of the query blocks for all lanes are shuffled: their size isn't known when the join is planned."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    plan = topk.top_k(df, 5, 50)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [lane" not in plan and "SortMergeJoin [lane" in plan


def test_bpe(docs, rows, tokenizers):
    import base64

    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "$", "é", "ß", " ", "　", "\x1c", "\x85", "日", "😀", ".", " .", ",", "-", "_", "́"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    c = bpe.codec(path, tokenizers.PATTERN)
    for t in odd:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == enc.encode_ordinary(t), repr(t)
        assert c.decode(c.encode(t)) == t.encode()
    expected = Counter()
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs, path, tokenizers.PATTERN).collect()) == expected
    assert all(r["round_trip"] for r in bpe.encode_rows(docs, path, tokenizers.PATTERN).collect())


def test_bpe_folds_agree(spark, tokenizers):
    """The higher-order fold, the fold in Python and the heap give the same ids."""
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    some = [b"", b"a", b" the", b" understanding", b"aaaaaaaaaaaaa", "日本語".encode(), b"\xff\xfe", b" thonatthinwh"]
    got = spark.createDataFrame([(some,)], "w array<binary>").select(bpe.fold_words("w", path).alias("x")).first()["x"]
    assert got == [bpe.fold_word(w, ranks) if w else [] for w in some] == [bpe.fold_long(w, ranks) for w in some]


def test_licenses(spark, docs, rows):
    import duckdb
    import pandas as pd

    extra = [
        (9001, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial\nportions of the Software."),
        (9002, "text. Released under the MIT License. more\nLicensed under CC BY-NC 4.0."),
        (9003, "licensed under nothing known"),
    ]
    df = docs.unionByName(spark.createDataFrame([(i, t, None, None, 0, "", 0) for i, t in extra], DOCS))
    got = Counter(tuple(r) for r in licenses.scan(df).collect())
    documents = pd.DataFrame([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], columns=["doc_id", "text"])  # noqa: F841
    c = duckdb.connect()
    c.register("documents", documents)
    assert Counter(c.execute(licenses.ORACLE).fetchall()) == got
    by_id = {r[0]: r for r in got}
    assert by_id[9001][3] == "MIT" and by_id[9002][3] == "CC-BY-NC-4.0 MIT" and by_id[9003][3] == "" and by_id[30][3] == "All-Rights-Reserved Apache-2.0"


def canon(text):
    return re.sub(r"[\s  -     　 ]+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())).strip(" ")


MIT_TEXT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD_TEXT = """Copyright (c) 2020, A Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_TEXT = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
APACHE_TEXT = """Copyright 2020 A Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
"""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_official_licence_texts(spark):
    """Hard-wrapped as published, then with comment marks."""
    free = "This {} is free software{} you can redistribute it and/or\nmodify it under the terms of the GNU {}General Public\nLicense as published by the Free Software Foundation{} either\nversion {} of the License, or (at your option) any later version.\n"
    known = [
        (free.format("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1"), (free.format("library", ":", "Lesser ", ",", "3"), "LGPL-3.0"), (free.format("program", ":", "Affero ", ",", "3"), "AGPL-3.0"), (free.format("program", ":", "", ",", "3"), "GPL-3.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", "ISC"),
        ("This is free and unencumbered software released into the public domain.\n", "Unlicense"), ("x = 1\nSPDX-License-Identifier: Apache-2.0\ny = 2\n", "Apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0"), ("Licensed under the ISC License.\n", "ISC"),
        (MIT_TEXT, "MIT"), (BSD_TEXT, "BSD-2-Clause"), (BSD_TEXT + NAMES, "BSD-3-Clause"), (BSD_TEXT.replace("Person\n\n", "Person\n"), "BSD-2-Clause"), (GPL_TEXT, "GPL-2.0"), (APACHE_TEXT, "Apache-2.0"), (MPL_TEXT, "MPL-2.0"),
    ]
    marked = lambda mark, t: "\n".join(f"{mark} {line}".rstrip() for line in t.splitlines())
    cases = [(f(t), want) for t, want in known for f in (str, lambda t: t.replace("\n", "\r\n"), lambda t: marked("//", t), lambda t: marked("--", t), lambda t: marked("#", t), lambda t: f"/*\n{marked(' *', t)}\n */\nint x;")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_fingerprints(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    path = str(tmp_path)
    more = [(7001, "Café ﬁne"), (7002, "  café  FINE\n"), (7003, "café fin"), (7004, "Straße ΣΟΦΟΣ J̌"), (7005, "STRASSE σοφοσ ǰ")]
    given = rows[:-2] + [(i, t, None, None, 0, "", 0) for i, t in more]
    spark.createDataFrame(given, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.op10_fingerprints(spark, path).collect()}
    order = sorted(given, key=lambda r: r[0])
    assert len(got) == len(given)
    group = defaultdict(list)
    for i, t, *_ in given:
        group[canon(t)].append(i)
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(canon(t) == canon(edited)), float(canon(t) == canon(nxt)))
        assert (r["group_id"], r["group_size"]) == (min(group[canon(t)]), len(group[canon(t)]))
    prints = defaultdict(set)
    for i, t, *_ in given:
        prints[canon(t)].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and len(set.union(*prints.values())) == len(prints)
    assert got[7004]["fingerprint"] == got[7005]["fingerprint"]
    assert got[7001]["fingerprint"] == got[7002]["fingerprint"] != got[7003]["fingerprint"]
    plan = fingerprints.with_next(spark.read.parquet(f"{path}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.range(1).select(fingerprints.fingerprint(F.lit("")).alias("x")).first()["x"] == got[0]["fingerprint"]


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert len(got) == docs.count()
    known = [(r["doc_id"], r["quality"]) for r in labels.collect()]
    right = sum(got[i]["kept"] == (q == 1) for i, q in known if i in got)
    assert right >= 0.9 * len(known)


def test_quality_on_held_out_rows(spark):
    """Accuracy on labelled rows that the model hasn't seen."""
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r["kept"] for r in quality.scored(docs, model).collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.where("doc_id % 3 = 0").collect()]
    good = [got[i] for i, q in known if q == 1]
    bad = [not got[i] for i, q in known if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) >= 0.8 * len(bad)


def test_quality_scores_by_hand(spark, sf):
    """Scores of odd and clean rows, computed from the model's cuts and weights one by one."""
    from bisect import bisect_left

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), pool=100)
    odd = [(-1, None, None, None, None, "x", 1), (-2, "", "en", "a", -5, "x", 1), (-3, "a " * 9000, "??", "no such", 10**9, "x", 1), (-3, "a " * 9000, "??", "no such", 10**9, "x", 1), (None, "\t", "de", None, 1, "x", 1)]
    given = odd + [tuple(r) + ("x", 1) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").limit(40).collect()]

    def logistic(v):
        return 1 / (1 + math.exp(-v))

    expected = []
    for i, t, lang, source, n, *_ in given:
        f = quality.text_features(t)
        own = lambda s, k: 0 if s is None else 1 + zlib.crc32(s.encode()) % (k - 1)
        views, at = [], 1
        total = model.weights[0][0]
        for x, cuts in zip(f, model.binned[0].cuts, strict=True):
            total += model.weights[0][at + bisect_left(cuts.tolist(), x)]
            at += len(cuts) + 1
        views.append(total)
        w = model.weights[1]
        length = -1.0 if n is None else math.log1p(max(n, 0))
        views.append(w[0] + w[1 + own(lang, 8)] + w[9 + own(source, 64)] + w[73 + bisect_left(model.binned[1].cuts.tolist(), length)])
        v = [c[0] + c[1] * min(max(x, -12), 12) for c, x in zip(model.calibration, views, strict=True)]
        score = logistic(model.joint[0] + model.joint[1] * v[0] + model.joint[2] * v[1])
        expected.append((i, pytest.approx(logistic(v[0])), pytest.approx(logistic(v[1])), pytest.approx(score), score >= 0.4))
    got = [tuple(r) for r in quality.scored(spark.createDataFrame(given, DOCS), model).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_quality_without_two_kinds(spark, docs, rows):
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model is None
    assert all(r["kept"] and r["score"] == 1.0 for r in quality.scored(docs, model).collect())


def test_empty_tables(spark, empty, tmp_path, tokenizers):
    path, spec = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    assert jaccard.jaccard_components(empty, 4, 85).count() == 0
    assert suffixes.removed_digests(empty).count() == 0
    assert katz.katz_scores(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert bpe.digests(empty, path, spec).count() == 0
    assert licenses.scan(empty).count() == 0
    scratch = Scratch(spark, "test")
    store.write_store(empty, tokenizers.path("byte_bpe_50k.json"), 2, scratch)
    assert store.read_store(spark, scratch).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert fingerprints.op10_fingerprints(spark, str(tmp_path)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.scored(empty, quality.fit(empty, labels)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.top_k(none, 5, 50).count() == 0


def test_null_ids(spark):
    rows = [(None, "some words of a text that is long enough " * 4, None, None, None, "", 0), (None, None, None, None, None, "", 0), (1, "some words of a text that is long enough " * 4, None, None, None, "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert Counter(r["component_id"] for r in jaccard.jaccard_components(df, 4, 85).collect()) == {None: 2, 1: 1}
    assert len(suffixes.removed_digests(df).collect()) == 3
    assert len(katz.katz_scores(df).collect()) == 3
    assert len(mixing.mix(df).collect()) == 3
    assert len(licenses.scan(df).collect()) == 3
    assert len(quality.scored(df, None).collect()) == 3
