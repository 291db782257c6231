"""Periodic run detection (operator 11).

A run is a stretch of consecutive words with smallest period q, of at least ``LEAST`` words and ``TIMES`` periods, that no
neighbouring word extends with the period kept.

Method: Karp-Miller-Rosenberg naming. Two blocks of 2**k words have the same name exactly where they are the same words: names of
level 0 are those of words, a name of level k + 1 is that of the pair of level-k names of its halves. So the longest common
extension of two places, either way, is found by going down the levels once. A run of period q has as many places i with word[i] =
word[i + q] side by side as its length less q, so a grid of that width meets each run: the grid's places are the candidates,
each is extended both ways, and what is long enough is a run. Nothing is hashed and no suffixes are sorted. A stretch that is
found for several periods has the smallest one as its period, for the others are its multiples.

All texts of an Arrow batch are named together, with a mark of its own after each text, so no block reaches from one
text into another. Blocks that occur once in their text keep a name of their own and are left out of the next level, so levels
cost what repeats, not what there is. Candidates are made in chunks of a fixed number. The work is narrow: no shuffle, and a
task holds one batch.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text; repeated rows each give a
row; an empty table gives no rows; only the id and the text are read, so other columns may have any name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.tokens import trimmed
from tabulon.llm.util import WORD, small_batches, table, text_or_empty

LEAST, TIMES = 24, 3
CHUNK = 1 << 19  # candidates that are extended together

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of all texts, words of each text)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = split.offsets.to_numpy().astype(np.int64)
    values = split.values[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    real = pc.not_equal(values, "").to_numpy(zero_copy_only=False)  # white space at either end gives empty words
    if real.all():
        return values, np.diff(offsets)
    return values.filter(pa.array(real)), np.diff(np.append(0, np.cumsum(real))[offsets])


class Names:
    """Names of all blocks of 1, 2, 4, ... words. A block that occurs once in its text is named by its place, from ``size`` on."""

    def __init__(self, words: np.ndarray, each: np.ndarray):
        text = np.repeat(np.arange(len(each)), each)
        at = np.arange(len(words)) + text  # a mark follows each text
        self.size = len(words) + len(each)
        self.base = np.cumsum(each + 1) - (each + 1)
        kinds = int(words.max(initial=0)) + 1
        self.levels: list[np.ndarray] = []
        again = self._level(text * kinds + words, at)
        while len(again) and 1 << len(self.levels) <= each.max():
            half, names = 1 << (len(self.levels) - 1), self.levels[-1]
            at = again[again + half < self.size]
            at = at[names[at + half] < self.size]
            again = self._level(names[at].astype(np.int64) * self.size + names[at + half], at)

    def _level(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Adds a level and gives the places whose blocks occur more than once."""
        names = np.arange(self.size, 2 * self.size, dtype=np.int64 if self.size > 1 << 30 else np.int32)
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[name] > 1
        names[at[many]] = name[many]
        self.levels.append(names)
        return at[many]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from place i on equal those from place j on."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][a] == self.levels[k][b]) * (1 << k)
            a += step
            b += step
        return a - i

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before place i equal those before place j, which is after i."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - (1 << k), b - (1 << k)
            step = ((x >= 0) & (self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)])) * (1 << k)
            a -= step
            b -= step
        return i - a


def runs_of(words: np.ndarray, each: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run, by text, start and period; words: a number for each word of all texts."""
    none = (np.empty(0, np.int64),) * 4
    long = each >= least
    if not long.any():
        return none
    place = np.flatnonzero(long)
    words, each = words[np.repeat(long, each)], each[long]
    named = Names(words, each)
    top = each // times  # the longest period
    text = np.repeat(np.arange(len(each)), top)
    period = 1 + np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top)
    step = np.maximum(least - period, (times - 1) * period)
    grid = (each[text] - period - 1) // step + 1
    ends = np.cumsum(grid)
    found, at = [], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = grid[at:to]
        own = np.repeat(np.arange(at, to), n)
        i = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * step[own] + named.base[text[own]]
        j = i + period[own]
        same = named.levels[0][i] == named.levels[0][j]
        i, j, own = i[same], j[same], own[same]
        back = named.back(i, j)
        length = back + (j - i) + named.ahead(i, j)
        run = length >= np.maximum(least, times * (j - i))
        found.append(np.stack([i[run] - back[run], length[run], (j - i)[run], text[own[run]]]))
        at = to
    start, length, period, text = np.concatenate(found, 1)
    order = np.lexsort((period, length, start))
    start, length, period, text = start[order], length[order], period[order], text[order]
    first = np.ones(len(start), bool)  # of equal stretches the one of least period
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period, text = start[first], length[first], period[first], text[first]
    order = np.lexsort((period, start))
    return place[text[order]], (start - named.base[text])[order], length[order], period[order]


def kept_words(each: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each word of all texts stays: those in a run after its first period go."""
    base = (np.cumsum(each) - each)[text]
    change = np.zeros(int(each.sum()) + 1, np.int64)
    np.add.at(change, base + start + period, 1)
    np.add.at(change, base + start + length, -1)
    return np.cumsum(change[:-1]) == 0


def _lists(values: pa.Array, each: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), values)


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values, each = split_words(b.column(1))
            words = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            text, *spans = runs_of(words, each, least, times)
            keep = kept_words(each, text, *spans)
            owner = np.repeat(np.arange(len(each)), each)
            left = _lists(values.filter(pa.array(keep)), np.bincount(owner[keep], minlength=len(each)))
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in spans], fields=list(RUN))
            runs = _lists(runs, np.bincount(text, minlength=len(each)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(each), runs, pc.binary_join(left, " ")], names=["id", "n_words", "runs", "collapsed"])

    return lambda batches: trimmed(run(batches))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The id, n_words, runs (start, length and period in words, by start and period) and collapsed (the words that stay, joined
    by one space) of every row. A run has at least ``least`` words and ``times`` periods."""
    if times < 2 or least < 2:
        raise ValueError("a run has two words and two periods at least")
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_found(least, times), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; ties go to the first; null without runs."""
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    return F.when(F.size(runs) > 0, F.reduce(runs, F.element_at(runs, 1), better))


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text, by a checksum of its id, goes round in a cycle from some word on. Rows
    without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text_or_empty(F.col("text").cast("string")).alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(text_or_empty(F.col("text").cast("string")), F.lit(WORD), F.lit(0))).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    cycle = F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))
    turned = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(F.flatten(cycle), F.lit(1), n - a)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_cycles(table(spark, sf_dir, "documents")))
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
