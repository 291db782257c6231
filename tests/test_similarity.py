import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import fuzzy, similarity


def _all(hints, labels, least):
    out = {(h, v): fuzzy.token_set(h, v) for h in set(hints) for v in set(labels) if h and v}
    return {k: round(x, 6) for k, x in out.items() if x >= least - 1e-9 and k[0].strip() and k[1].strip()}


def _found(df):
    return {(r["hint"], r["label"]): round(r["likeness"], 6) for r in df.collect()}


def _texts(n, seed):
    r = random.Random(seed)
    words = ["ring", "rings", "red", "tin", "steel", "polished tin", "a", "b", "Übung", "total", "totals", "net receipts", "ab", "é", "abc abc", "𝔘x", "1941", "19 41"]
    odd = [None, "", "  ", "\t", "x" * 300, "tin  tin", " tin ", "TIN", "tin ring"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(n)] + ["".join(r.choice("abcdef ") for _ in range(r.randrange(1, 12))) for _ in range(n)] + odd


@pytest.mark.parametrize("least", [35.0, 60.0, 85.0, 100.0])
def test_alike_is_all_pairs(spark, least):
    hints, labels = _texts(15, 1), _texts(60, 2)
    h, v = (spark.createDataFrame([(x, 1) for x in xs + xs[:3]], f"{c} string, words int") for xs, c in ((hints, "hint"), (labels, "label")))
    assert _found(similarity.alike(h, v, least)) == _all(hints, labels, least)


def test_hot_words_and_empty_sides(spark):
    labels = [f"net total {i % 7} item{i}" for i in range(300)]
    h = spark.createDataFrame([("total net 3",), ("item17 net",)], "hint string")
    v = spark.createDataFrame([(x,) for x in labels], "label string")
    assert _found(similarity.alike(h, v)) == _all(["total net 3", "item17 net"], labels, 60.0)
    assert similarity.alike(h.limit(0), v).count() == 0
    assert similarity.alike(h, v.limit(0)).count() == 0


def test_pairs_with_no_chance_are_not_aligned(spark):
    h = spark.createDataFrame([("quarterly receipts",)], "hint string")
    v = spark.createDataFrame([("zzz",), ("quarterly receipts of the fund",), ("receipts quarterly",), ("quarterly receipt",)], "label string")
    b = similarity.bounded(h, v, 60.0)
    assert {r["label"] for r in b.collect()} == {"quarterly receipts of the fund", "receipts quarterly", "quarterly receipt"}
    assert [r["label"] for r in b.where(similarity.undecided(b)).collect()] == ["quarterly receipt"]


def test_nearest_breaks_ties_by_label(spark):
    h = spark.createDataFrame([("tin",)], "hint string")
    v = spark.createDataFrame([("tin b",), ("tin a",), ("tins",), ("gold",)], "label string")
    assert [(r["label"], r["place"]) for r in similarity.nearest(h, v, 2).orderBy("place").collect()] == [("tin a", 1), ("tin b", 2)]


def _stretch(a, b):
    """Every stretch, with nothing left out."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    m, n = len(short), len(long)
    own = lambda s, t: [t[max(0, i) : min(len(t), i + len(s))] for i in range(1 - len(s), len(t))]
    best = max(fuzzy.indel_ratio(short, x) for x in own(short, long))
    return max(best, *(fuzzy.indel_ratio(long, x) for x in own(long, short))) if m == n else best


def test_partial_is_the_best_stretch():
    r = random.Random(5)
    for _ in range(2000):
        a, b = ("".join(r.choice("abcx ") for _ in range(r.randrange(0, 12))) for _ in range(2))
        assert fuzzy.partial(a, b) == _stretch(a, b), (a, b)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("this is a test", "this is a test!", 2800 / 29),
        ("new york jets", "New York Jets", 100.0),
        ("new york jets", "new york giants", 2200 / 28),
        ("cowboys", "dallas cowboys", 90.0),
        ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0),
        ("ring", "a very long label about every ring that was ever sold here", 60.0),
        ("", "x", 0.0),
        ("abc", "xyz", 0.0),
    ],
)
def test_weighted_ratio(a, b, want):
    assert fuzzy.weighted(a, b) == pytest.approx(want)
    assert fuzzy.weighted(b, a) == pytest.approx(want)


def test_weighted_ratio_of_columns(spark):
    df = spark.createDataFrame([("cowboys", "dallas cowboys"), (None, "x")], "a string, b string")
    assert [r["r"] for r in df.select(F.round(fuzzy.weighted_ratio("a", "b"), 6).alias("r")).collect()] == [90.0, 0.0]
