"""Toxicity: held-out accuracy on made texts, counts against a brute-force version, what scores may depend on."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import toxicity as X

DOCS = "doc_id long, text string, lang string, source string, score double, toxic int"


def made(seed=3, n=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdefgilnorstuv") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    stems = ["grumpf", "zloty", "quexo"]  # insults with endings of their own
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "scum", *(rng.choice(stems) + rng.choice(["", "a", "en", "s"]) for _ in range(3))]))
        docs.append((i, " ".join(text), rng.choice(["en", None]), rng.choice(["a", "b"]), 0.5, 7))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic != (rng.random() < 0.02))))
    truth = {i: any(w.startswith(("idiot", "scum", *stems)) for w in t.split()) for i, t, *_ in docs}
    odd = [(5000, None), (5001, ""), (5002, " \n"), (5003, "word " * 30000), (5004, "你好 idiot"), (None, "scum idiot"), (5006, "idiot!!! SCUM"), (5006, "idiot!!! SCUM")]
    return docs + [(i, t, None, None, None, None) for i, t in odd], labels, truth


@pytest.fixture(scope="module")
def data(spark):
    docs, labels, truth = made()
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy(data):
    docs, labels, truth = data
    rows = X.scored(docs, X.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    hit = sum(r["predicted"] for r in held if truth[r["doc_id"]]) / sum(truth[r["doc_id"]] for r in held)
    wrong = sum(r["predicted"] for r in held if not truth[r["doc_id"]])
    assert hit > 0.9 and wrong <= 2
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    odd = {}
    for r in rows:
        odd.setdefault(r["doc_id"], set()).add(r["score"])
    assert max(odd[5000]) == max(odd[5001]) == max(odd[5002]) < 0.5
    assert len(odd[5006]) == 1 and min(odd[5006]) > 0.7 and min(odd[None]) > 0.7


def test_only_texts_and_allowed_labels_matter(spark, data):
    docs, labels, _ = data
    one = {(r["doc_id"], r["score"]) for r in X.scored(docs, X.fit(docs, labels)).collect()}
    other = docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source")
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic").repartition(2)
    assert {(r["doc_id"], r["score"]) for r in X.scored(other, X.fit(other, turned)).collect()} == one


def test_counts():
    rng = random.Random(6)
    vocabulary = ["abcde", "abcdx", "Abcdefghijk", "abc", "zz", "scum", "SCUM", "don't", "ab1cd", "éclat", "töten"]
    texts = ["  ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "!!! you are a f*ck"]
    terms = ["abc", "abcd", "abcde", "abcdefgh", "zz$", "don$", "écl"]
    counts = np.array([[rng.randint(0, 9) for _ in range(2 * X.FOLDS)] for _ in terms])
    lexicons = X.Lexicons(terms, counts, np.array([40, 9] * X.FOLDS))
    fold = np.array([rng.randrange(X.FOLDS) for _ in texts])
    for folds in (None, fold):
        got, _ = lexicons.counts(pa.array(texts, pa.string()), folds)
        for i, text in enumerate(texts):
            want = np.zeros(X.COUNTS)
            found = {t for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for t in X.terms_of(w)} & set(lexicons.number)
            for t in found:
                for g in (lexicons.group[X.FOLDS if folds is None else fold[i], lexicons.number[t]], lexicons.insult[lexicons.number[t]]):
                    if g >= 0:
                        want[g] += 1
            for k, p in enumerate(X.PATTERNS):
                want[X.MINED + len(X.INSULTS) + k] = len(re.findall(p.replace("(a|an|ein|eine|un|une|una|such)", "(?:a|an|ein|eine|un|une|una|such)").replace("(you are", "(?:you are"), text or ""))
            assert got[i].tolist() == want.tolist(), text


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(8)
    y = rng.random(4000) < 0.2
    speaks = np.array([True, True, True, True, False])
    toxic, clean = np.array([0.8, 0.6, 0.6, 0.3, 0.1]), np.array([0.05, 0.1, 0.1, 0.02, 0.8])
    v = (rng.random((4000, 5)) < np.where(y[:, None], toxic, clean)).astype(float)
    v[:, 2] = v[:, 1]  # two voters that are one
    label = np.where(rng.random(4000) < 0.1, ~y, y).astype(int)
    m = X.LabelModel(v, speaks, label)
    assert np.abs(m.toxic[:5] - toxic).max() < 0.08 and np.abs(m.clean[:5] - clean).max() < 0.05
    assert m.weight[1] < 0.6 < m.weight[0] and m.weight[-1] == 1
    assert ((m.q > 0.5) == y).mean() > (label == y).mean()


@pytest.mark.parametrize("given", [[], [(1, 1, 1)], [(1, 1, 0), (2, 0, 0)], [(None, 1, 1), (3, 0, None)]])
def test_labels_of_one_kind(spark, data, given):
    docs, *_ = data
    few = docs.limit(20)
    model = X.fit(few, spark.createDataFrame(given, "doc_id long, quality int, toxic int"))
    assert model is None and {r["score"] for r in X.scored(few, model).collect()} == {0.0}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert X.op13_toxicity(spark, str(tmp_path)).count() == 0
