"""Quality classifier (operator 2).

Method: co-training. Two classifiers see a document from two sides: one its text content, one its page metadata (language,
source, stated length). Both learn from labelled rows; in each round each labels the rows of an unlabelled pool that it
is surest of, and these pseudo-labels are added to the other's training rows. At the end each view is calibrated
on labelled rows kept apart, the calibrated views are combined by a logistic model of their logits, and all documents are
scored.

Fitting uses bounded samples, taken by a hash of the id: at most ``LABELLED`` labelled and ``POOL`` unlabelled rows, whose features
(a few hundred bytes each) come to the driver. Scoring is one narrow pass over whole texts with weights of fixed
size. Both views are logistic models over one-hot bins of features, so thresholds need no hand tuning.

A document is rejected where its score, the probability of good quality, is below ``KEEP``: well below even, so that
clean documents stay in doubt.

Defined results: null text counts as empty; null metadata are values of their own; labels of repeated ids are averaged;
with labels of one kind only, or none, every score is 1.0 and all are kept; repeated rows each give a row; an empty
table gives no rows; only doc_id, text, lang, source, n_chars and doc_id, quality are read."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.tokens import trimmed
from tabulon.llm.util import Scratch, small_batches, table

LABELLED, POOL, ROUNDS, SURE = 8000, 8000, 5, 0.04
KEEP = 0.4
BINS = 12
N_TEXT = 18
LANGS, SOURCES = 8, 64


def text_features(text: str | None) -> list[float]:
    """Shares and lengths that describe a text's content."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    c = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    mark = c[[33, 35, 36, 37, 38, 42, 43, 61, 64, 94, 126]].sum()
    stop = c[[46, 44, 59, 58, 63]].sum()
    words = data.split()
    many = max(len(words), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    runs = sum(map(bytes.__eq__, words[1:], words[:-1]))
    lines = [x for x in data.split(b"\n") if x]
    line_counts = Counter(lines)
    again = len(lines) - len(line_counts)
    length = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(len(words)), float(length.mean()), float(length.max()), upper / n, (upper + 1) / (upper + lower + 2), digit / n, mark / n, stop / n, c[124] / n, c[128:].sum() / n,
        len(counts) / many, len(counts) / many**0.7, top / many, runs / many, again / max(len(lines), 1), len(lines) / many, c[60] / n + c[62] / n, len(data) / max(len(words), 1),
    ]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    own = lambda s, k: 0 if s is None else 1 + zlib.crc32(s.encode("utf-8", "surrogatepass")) % (k - 1)
    return [own(lang, LANGS), own(source, SOURCES), -1.0 if n_chars is None else float(np.log1p(max(n_chars, 0)))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights, the constant first, by Newton steps; ridge on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ b)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


class Text:
    """One-hot bins by quantiles of the sample, with a bin of its own for each of the extreme values."""

    def __init__(self, sample: np.ndarray):
        self.cuts = [np.unique(np.quantile(f, [0.01, 0.03, *np.linspace(0.06, 0.94, BINS), 0.97, 0.99])) for f in sample.T]

    def __call__(self, f: np.ndarray) -> np.ndarray:
        return np.concatenate([np.eye(len(c) + 1)[np.searchsorted(c, x)] for c, x in zip(self.cuts, f.T, strict=True)], 1)


class Meta:
    def __init__(self, sample: np.ndarray):
        self.cuts = np.unique(np.quantile(sample[:, 2], np.linspace(0.05, 0.95, 10)))

    def __call__(self, f: np.ndarray) -> np.ndarray:
        return np.concatenate([np.eye(LANGS)[f[:, 0].astype(int)], np.eye(SOURCES)[f[:, 1].astype(int)], np.eye(len(self.cuts) + 1)[np.searchsorted(self.cuts, f[:, 2])]], 1)


class Model:
    """The two views, their calibrations and the combination."""

    def __init__(self, labelled: np.ndarray, y: np.ndarray, pool: np.ndarray):
        rng = np.random.default_rng(5)
        apart = rng.permutation(len(y)) < len(y) // 3  # rows for calibration only
        every = np.concatenate([labelled, pool]) if len(pool) else labelled
        self.binned = [Text(every[:, :N_TEXT]), Meta(every[:, N_TEXT:])]
        x = [b(labelled[:, s]) for b, s in zip(self.binned, self.sides, strict=True)]
        u = [b(pool[:, s]) for b, s in zip(self.binned, self.sides, strict=True)] if len(pool) else None
        fit = ~apart if len(set(y[~apart])) == 2 and len(set(y[apart])) == 2 else np.ones(len(y), bool)
        apart = ~fit if not fit.all() else fit
        given = [np.full(len(pool), -1.0), np.full(len(pool), -1.0)]  # pseudo-labels by the other view
        share = y[fit].mean()
        for turn in range(ROUNDS + 1):
            self.weights = []
            for k in range(2):
                own = given[k] >= 0
                rows, target = x[k][fit], y[fit]
                weight = np.ones(len(rows))
                if own.any():
                    rows, target, weight = np.concatenate([rows, u[k][own]]), np.concatenate([target, given[k][own]]), np.concatenate([weight, np.full(own.sum(), 0.3)])
                self.weights.append(logistic(rows, target, weight, 1.0))
            if turn == ROUNDS or u is None:
                break
            for k in range(2):  # view k teaches the other
                p = self._logit(k, u[k])
                order = np.argsort(p, kind="stable")
                free = order[given[1 - k][order] < 0]
                few = int(SURE * len(free))
                low, high = int(few * (1 - share)), int(few * share)
                sure_low = free[:low][p[free[:low]] < -1.5]
                sure_high = free[len(free) - high :][p[free[len(free) - high :]] > 1.5]
                given[1 - k][sure_low], given[1 - k][sure_high] = 0.0, 1.0
        logits = [self._logit(k, x[k][apart]) for k in range(2)]
        one = np.ones(int(apart.sum()))
        self.calibration = [logistic(v[:, None], y[apart], one, 0.01) for v in logits]
        calibrated = np.column_stack([c[0] + c[1] * v for c, v in zip(self.calibration, logits, strict=True)])
        self.joint = logistic(calibrated, y[apart], one, 0.1)

    sides = (slice(0, N_TEXT), slice(N_TEXT, None))

    def _logit(self, k: int, binned: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[k][0] + binned @ self.weights[k][1:], -12, 12)

    def __call__(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = [c[0] + c[1] * self._logit(k, self.binned[k](features[:, self.sides[k]])) for k, c in enumerate(self.calibration)]
        return sigmoid(v[0]), sigmoid(v[1]), sigmoid(self.joint[0] + np.column_stack(v) @ self.joint[1:])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, *meta = (c.to_pylist() for c in b.columns[:5])
        f = [text_features(t) + meta_features(*m) for t, *m in zip(texts, *meta, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(f, pa.list_(pa.float64())), b.column(5)], names=["doc_id", "f", "y"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """The model, or None where labels don't hold both kinds. labelled, pool: rows of either kind that it is fitted on; their
    features come to the driver."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    pick = lambda df, n, salt: df.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(n)
    some = pick(known.join(cols.select("doc_id").distinct(), "doc_id", "left_semi"), labelled, "labelled")
    rest = pick(cols.select("doc_id").where("doc_id is not null").join(known, "doc_id", "left_anti").distinct(), pool, "pool").select("doc_id", F.lit(-1.0).alias("y"))
    small_batches(docs.sparkSession)
    sample = F.broadcast(some.unionByName(rest))  # at most LABELLED + POOL rows
    rows = cols.join(sample, "doc_id").mapInArrow(_features, "doc_id long, f array<double>, y double").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    f, y = np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows])
    if not {0.0, 1.0} <= set(y.tolist()):
        return None
    return Model(f[y >= 0], y[y >= 0], f[y < 0])


def scored(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept of every row (and the columns in keep)."""
    small_batches(docs.sparkSession)
    names = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts, *meta = (c.to_pylist() for c in b.columns[:5])
            f = np.array([text_features(t) + meta_features(*m) for t, *m in zip(texts, *meta, strict=True)])
            a, m, s = model(f) if model else (np.ones(len(f)),) * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a), pa.array(m), pa.array(s), pa.array(s >= KEEP), *b.columns[5:]], names=["doc_id", "text_score", "meta_score", "score", "kept", *(f"keep_{c}" for c in names)])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")]
    kinds = dict(docs.dtypes)
    ddl = "doc_id long, text_score double, meta_score double, score double, kept boolean" + "".join(f", keep_{c} {kinds[c]}" for c in names)
    return docs.select(*cols, *(F.col(c).alias(f"keep_{c}") for c in names)).mapInArrow(lambda batches: trimmed(run(batches)), ddl)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
