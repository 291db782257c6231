"""Runs against a brute-force version."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tabulon.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, times=3):
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(least, times * q):
                found.setdefault((a, i - a + q), q)
    return sorted((a, m, q) for (a, m), q in found.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 2), (9, 4)])
def test_runs_of(least, times):
    rng = random.Random(least)
    texts = []
    for _ in range(300):
        text = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.6:
            part = [rng.randrange(3) for _ in range(rng.randint(1, 15))]
            text[len(text) // 2 : len(text) // 2] = (part * 9)[: rng.randint(1, 9 * len(part))]
        texts.append(text)
    flat = np.array([w for t in texts for w in t], np.int64)
    got = [[] for _ in texts]
    for d, *run in zip(*(x.tolist() for x in periodic.runs_of(flat, np.array([len(t) for t in texts]), least, times)), strict=True):
        got[d].append(tuple(run))
    assert got == [brute(t, least, times) for t in texts]


def test_small_chunks(monkeypatch):
    text = np.array(([1, 2, 3] * 20 + [9] * 40 + list(range(10, 40))) * 3, np.int64)
    whole = periodic.runs_of(text, np.array([len(text)]))
    monkeypatch.setattr(periodic, "CHUNK", 7)
    for a, b in zip(whole, periodic.runs_of(text, np.array([len(text)])), strict=True):
        assert a.tolist() == b.tolist()
    assert list(zip(*(x.tolist() for x in whole[1:]), strict=True)) == brute(text.tolist())


def made():
    rng = random.Random(4)
    rows = [(None, "a b " * 20), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "x " * 23), (5, "x " * 24), (6, "y z " * 30000), (7, ("a b c " * 9 + "d ") * 4), (8, "A a " * 30)]
    for i in range(9, 250):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.3:
            words += words[: rng.randint(1, 9)] * rng.randint(2, 20)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows + rows[20:22]


def test_query(spark, tmp_path):
    rows = made()
    spark.createDataFrame([(i, t, "x", 5, 1.5) for i, t in rows], "doc_id long, text string, runs string, n_words int, id double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periodic.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == cols
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(i, t) for i, t in rows), key=str)
    assert sum(x[1] > 0 for x in map(tuple, got.collect())) > 40


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert periodic.op11_periodic_runs(spark, str(tmp_path)).count() == 0


def test_other_ids(spark):
    docs = spark.createDataFrame([("k", "a b " * 20)], "name string, body string")
    (row,) = periodic.periodic_runs(docs, "name", "body").collect()
    assert row["name"] == "k" and row["n_words"] == 40 and row["collapsed"] == "a b"
    assert [tuple(r) for r in row["runs"]] == [(0, 40, 2)]
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, "name", "body", times=1)
