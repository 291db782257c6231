"""Toxicity (operator 13).

Method: weak supervision. Many voters look at a text: lexicons that were mined from labelled rows, lexicons of common insults, and
patterns; each votes toxic (or clean) or abstains. A generative label model estimates each voter's accuracy, and how far voters
agree beyond what the class explains, from their votes alone together with the given labels, which are one more voter of
unknown accuracy; correlated voters share their weight. Its posterior, not the labels, is what a linear classifier of
the voters' counts is trained on; the classifier scores all documents.

Mined lexicons hold beginnings of words (3 to 8 letters) and short whole words that occur in many more toxic than clean
documents, so inflected and compound insults of any language are found; they are told apart by form and by a
cautious estimate of their strength. A labelled row's votes come from lexicons whose strengths leave out the row's own
fold (one of ``FOLDS``), as a row must not vouch for what was mined from it.

Fitting uses at most ``LABELLED`` labelled rows, picked by a hash of the id; at most ``TERMS`` mined terms, the ones with most evidence. The
terms are counted in Spark; only terms and the sample's votes (a few hundred bytes a row) come to the driver. Scoring is one narrow
pass over whole texts.

Only rows for which crc32 of the id modulo 3 isn't 1 give labels. Language, source and id are no inputs.

Defined results: a null text counts as empty; an empty text is scored as any text without a vote; rows without an id aren't held out;
labels of repeated ids are averaged; where the labels given hold one kind only, or none, every score is 0.0; repeated rows each give a row;
an empty table gives no rows; only doc_id, text and doc_id, toxic are read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.quality import logistic, sigmoid
from tabulon.llm.tokens import numbered, trimmed
from tabulon.llm.util import Scratch, small_batches, table, text_or_empty

LABELLED, FOLDS, TERMS = 24_000, 4, 6_000
TOXIC = 0.7
SHORT, LONG = 3, 8  # letters of beginnings
WHOLE = 12  # letters of the longest whole words that are terms
TIERS = (1.5, 3.0, 4.5)  # cautious log odds from which a term is weak, fair, strong
ROUNDS = 12
PRIOR = 4.0
RIDGE = 0.1
BEYOND = 0.05  # correlation from which voters share their weight
LETTERS = re.compile(r"[^\W\d_]+")

#: Common insults, by language, and threats.
INSULTS = [
    "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown ugly jerk fool garbage idiots morons losers freak creep".split(),
    "idiot dumm dreck abschaum widerlich wertlos versager trottel depp arsch blödmann ekelhaft mistkerl".split(),
    "idiot imbécile crétin débile ordure minable dégoûtant stupide connard abruti salaud pourri".split(),
    "idiota imbécil estúpido estúpida basura asqueroso inútil patético escoria payaso tonto cretino".split(),
    "kill die destroy hurt strangle töten sterben mourir tuer morir matar".split(),
]
#: Patterns: shouting, repeated exclamation marks, letters masked by marks, addressing somebody.
PATTERNS = [r"\b[A-Z]{4,}\b", r"!{2,}|[?!]{3,}", r"[A-Za-z][*@#$]{1,4}[A-Za-z]", r"(?i)\b(you are|you're|du bist|tu es|eres) (a|an|ein|eine|un|une|una|such)\b"]
MINED = 3 * len(TIERS)  # short beginnings, long ones, whole words, by tier
COUNTS = MINED + len(INSULTS) + len(PATTERNS)


def terms_of(word: str) -> list[str]:
    """The beginnings of a word of letters, and the word itself with a mark at its end."""
    out = [word[:k] for k in range(SHORT, min(len(word), LONG) + 1)]
    if len(word) <= WHOLE:
        out.append(word + "$")
    return out


def form(term: str) -> int:
    return 2 if term[-1] == "$" else int(len(term) > 4)


def _each_term(texts: pa.Array, of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term) once each, and words of each text; of: the numbers of a word's terms."""
    words, number, each = numbered(texts)
    lists = []
    for w in words:
        found: list[int] = []
        for part in LETTERS.findall(w.decode("utf-8", "replace").lower()):
            found += of(part)
        lists.append(found)
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for found in lists for x in found), np.int64, int(n.sum()))
    text = np.repeat(np.arange(len(each)), each)
    some = n[number] > 0
    number, text = number[some], text[some]
    many, start = n[number], (np.cumsum(n) - n)[number]
    at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    top = int(flat.max(initial=0)) + 1
    pairs = np.unique(np.repeat(text, many) * top + flat[at])
    return pairs // top, pairs % top, each


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic, fold -> in how many clean and toxic texts of each fold a term is, by batch."""
    for b in batches:
        if not b.num_rows:
            continue
        known: dict[str, int] = {}
        text, term, _ = _each_term(b.column(0), lambda w: [known.setdefault(t, len(known)) for t in terms_of(w)])
        kind = b.column(2).to_numpy() * 2 + b.column(1).to_numpy()
        counts = np.bincount(term * (2 * FOLDS) + kind[text], minlength=2 * FOLDS * len(known))
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), *(pa.array(counts[k :: 2 * FOLDS]) for k in range(2 * FOLDS))], names=["term", *COLUMNS])


COLUMNS = [f"c{k}" for k in range(2 * FOLDS)]


def cautious(toxic: np.ndarray, clean: np.ndarray, n_toxic: np.ndarray, n_clean: np.ndarray) -> np.ndarray:
    """Log odds of a term for toxic texts, a standard error off either count."""
    return np.log((np.maximum(toxic - np.sqrt(toxic), 0) + 0.25) / n_toxic) - np.log((clean + np.sqrt(clean) + 1) / n_clean)


class Lexicons:
    """Terms and the mined lexicon each belongs to; one column for each fold that is left out, the last for none."""

    def __init__(self, terms: list[str], counts: np.ndarray, totals: np.ndarray):
        """counts: [term, 2 * fold + toxic] texts with the term; totals: texts, likewise."""
        self.number = {t: k for k, t in enumerate(terms)}
        own = [self.number.setdefault(w + "$", len(self.number)) for group in INSULTS for w in group]
        self.group = np.full((FOLDS + 1, len(self.number)), -1, np.int64)
        forms = np.array([form(t) for t in terms], np.int64)
        for left_out in range(FOLDS + 1):
            use = [k for k in range(FOLDS) if k != left_out]
            n = totals.reshape(FOLDS, 2)[use].sum(0)
            if not len(terms) or not n.all():
                continue
            c = counts.reshape(-1, FOLDS, 2)[:, use].sum(1)
            tier = np.searchsorted(TIERS, cautious(c[:, 1], c[:, 0], n[1], n[0]), "right") - 1
            self.group[left_out, : len(terms)] = np.where(tier >= 0, forms * len(TIERS) + tier, -1)
        lengths = [len(group) for group in INSULTS]
        self.insult = np.full(len(self.number), -1, np.int64)
        self.insult[own] = MINED + np.repeat(np.arange(len(INSULTS)), lengths)

    def counts(self, texts: pa.Array, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """([text, voter's count], words of each text)."""
        texts, get = pc.fill_null(texts, ""), self.number.get

        def of(word: str) -> list[int]:
            return [k for t in terms_of(word) if (k := get(t)) is not None]

        text, term, each = _each_term(texts, of)
        out = np.zeros((len(each), COUNTS))
        for group in (self.group[FOLDS if fold is None else fold[text], term], self.insult[term]):
            at = group >= 0
            np.add.at(out, (text[at], group[at]), 1)
        for k, pattern in enumerate(PATTERNS, MINED + len(INSULTS)):
            out[:, k] = pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        return out, each


def votes_of(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, 1 where a voter speaks; whether each voter speaks for toxic). Mined lexicons have two voters, for any term and for
    three or more; the last voters speak for clean texts: no strong, no fair, no mined term, no insult at all."""
    mined, insults, patterns = np.split(counts, [MINED, MINED + len(INSULTS)], 1)
    tier = np.arange(MINED) % len(TIERS)
    per_100 = 100 * patterns / np.maximum(words, 20)[:, None]
    calm = [mined[:, tier == 2].sum(1) == 0, mined[:, tier >= 1].sum(1) == 0, mined.sum(1) == 0, insults[:, :-1].sum(1) == 0]
    votes = np.column_stack([mined > 0, mined >= 3, insults > 0, insults >= 2, per_100 > 2, *calm]).astype(float)
    return votes, np.arange(votes.shape[1]) < votes.shape[1] - len(calm)


class LabelModel:
    """Votes -> the probability of toxic. Fitted by expectation and maximisation; the label is the vote of a last voter."""

    def __init__(self, votes: np.ndarray, speaks: np.ndarray, label: np.ndarray):
        v = np.column_stack([votes, label == 1])
        speaks = np.append(speaks, True)
        self.q = np.where(label == 1, 0.85, 0.08)
        for _ in range(ROUNDS):
            q = self.q
            self.share = float(np.clip(q.mean(), 0.01, 0.99))
            # a few rows' worth of belief beforehand: a voter speaks in half of its own class and rarely in the other
            toxic = (v.T @ q + PRIOR * np.where(speaks, 0.5, 0.1)) / (q.sum() + PRIOR)
            clean = (v.T @ (1 - q) + PRIOR * np.where(speaks, 0.02, 0.7)) / ((1 - q).sum() + PRIOR)
            # a voter is never believed to say the opposite of what it speaks for
            low, high = np.minimum(toxic, clean), np.maximum(toxic, clean)
            middle = (toxic + clean) / 2
            agrees = (toxic >= clean) == speaks
            self.toxic = np.where(agrees, np.where(speaks, high, low), middle)
            self.clean = np.where(agrees, np.where(speaks, low, high), middle)
            rest = v - np.outer(q, self.toxic) - np.outer(1 - q, self.clean)
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            self.correlation = (rest.T @ rest) / len(v) / np.outer(spread, spread)
            beyond = np.clip(self.correlation, 0, 1)
            beyond[beyond < BEYOND] = 0
            beyond[-1] = beyond[:, -1] = 0  # the label is a source of its own
            np.fill_diagonal(beyond, 0)
            self.weight = 1 / (1 + beyond.sum(1))
            says = v @ (self.weight * np.log(self.toxic / self.clean)) + (1 - v) @ (self.weight * np.log((1 - self.toxic) / (1 - self.clean)))
            self.q = sigmoid(np.log(self.share / (1 - self.share)) + says)


def inputs(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(counts), np.log1p(words) / 10])


class Model:
    def __init__(self, lexicons: Lexicons, counts: np.ndarray, words: np.ndarray, label: np.ndarray):
        self.lexicons = lexicons
        self.labels = LabelModel(*votes_of(counts, words), label)
        x, q = inputs(counts, words), self.labels.q
        one = np.ones(len(q))
        self.weights = logistic(np.concatenate([x, x]), np.concatenate([one, 0 * one]), np.concatenate([q, 1 - q]), RIDGE)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        x = inputs(*self.lexicons.counts(texts))
        return sigmoid(self.weights[0] + x @ self.weights[1:])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, terms: int = TERMS) -> Model | None:
    """The model, or None where labels that may be learnt from don't hold both kinds. labelled, terms: the bounds of the sample and of
    mined terms."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    some = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64(F.lit("toxic"), "id"), "id").limit(labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty(F.col("text").cast("string")).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int")
    scratch = Scratch(spark, "toxicity")
    sample = scratch.write(rows.join(F.broadcast(some), "id").select("id", "text", "toxic", fold.alias("fold")), "sample")  # at most LABELLED ids
    totals = np.zeros(2 * FOLDS)
    for r in sample.groupBy("fold", "toxic").count().collect():
        totals[2 * r["fold"] + r["toxic"]] = r["count"]
    if not totals.reshape(FOLDS, 2).sum(0).all():
        return None
    counted = sample.select("text", "toxic", "fold").mapInArrow(_mined, "term string, " + ", ".join(f"{c} long" for c in COLUMNS)).groupBy("term").agg(*(F.sum(c).alias(c) for c in COLUMNS))
    toxic, clean = (sum((F.col(COLUMNS[2 * k + y]) for k in range(1, FOLDS)), F.col(COLUMNS[y])) for y in (1, 0))
    n_clean, n_toxic = totals[0::2].sum(), totals[1::2].sum()
    odds = F.log((toxic + 0.5) / n_toxic) - F.log((clean + 0.5) / n_clean)
    best = counted.withColumn("odds", odds).where((toxic >= 2) & (F.col("odds") > 1.5)).orderBy(F.desc(toxic * F.col("odds")), "term").limit(terms).collect()
    same = {}
    for r in best:  # of beginnings of one another in the same numbers of texts the longest stays
        same.setdefault(tuple(r[c] for c in COLUMNS), []).append(r["term"])
    rows = [r for r in best if not any(o != r["term"] and o.startswith(r["term"]) for o in same[tuple(r[c] for c in COLUMNS)])]
    lexicons = Lexicons([r["term"] for r in rows], np.array([[r[c] for c in COLUMNS] for r in rows], np.int64).reshape(-1, 2 * FOLDS), totals)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                counts, words = lexicons.counts(b.column(1), b.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(np.column_stack([counts, words])), pa.list_(pa.float64())), b.column(2)], names=["id", "f", "toxic"])

    found = sample.mapInArrow(seen, "id long, f array<double>, toxic int").collect()
    found.sort(key=lambda r: (r["id"], r["f"]))
    f, y = np.array([r["f"] for r in found]), np.array([r["toxic"] for r in found])
    return Model(lexicons, f[:, :-1], f[:, -1], y)


def scored(docs: DataFrame, model: Model | None, threshold: float = TOXIC) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold on) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model(b.column(2)) if model and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty(F.col("text").cast("string")).alias("text"))
    return rows.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, held_out boolean, score double, predicted int")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
