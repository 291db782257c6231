"""Containment joins and the steps of batch retrieval against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tabulon.operators import batch, containment, index
from tabulon.sources import shared

WORDS = "tax net income total gold silver debt public notes a b of".split()


def tokens(s):
    return [t for t in re.split(r"[^0-9a-z]+", s.lower()) if t]


def texts(rng, n, most):
    return [rng.choice([" ", ", ", " > "]).join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(5)
    hints, labels = texts(rng, 60, 4) + ["tax tax", "TAX", "zebra net"], texts(rng, 120, 6) + ["net tax", "1/ Gold r/ Total"]
    return hints, labels, spark.createDataFrame([(h,) for h in hints], "hint string"), spark.createDataFrame([(x,) for x in labels], "label string")


@pytest.mark.parametrize("lacks", [0, 1])
def test_by_tokens(both, lacks):
    hints, labels, h, x = both
    want = set()
    for a in set(hints):
        own = set(tokens(a))
        few = min(lacks if len(own) >= 3 else 0, len(own) - 1)
        want |= {(a, b, len(own), len(own & set(tokens(b)))) for b in set(labels) if own and len(own - set(tokens(b))) <= few}
    got = containment.by_tokens(h, x, F.when(F.col("n_tokens") >= 3, lacks).otherwise(0)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_named(both):
    hints, labels, h, x = both
    plain = lambda s: " ".join(re.sub(r"[^\w\s]", " ", re.sub(r"(?i)\b[1-9]\s*/|\b[rpe]\s*/", " ", s.lower())).split())
    p = lambda df, c: df.select(containment.plain(F.col(c)).alias(c))
    want = set()
    for a in map(plain, hints):
        long = {w for w in a.split() if len(w) >= 3}
        want |= {(a, b) for b in map(plain, labels) if long and (a in b or long <= set(b.split()))}
    assert {tuple(r) for r in containment.named(p(h, "hint"), p(x, "label")).collect()} == want


def test_pairs_are_blocked_by_the_rarest_token(spark):
    hints = spark.createDataFrame([("total zinc",)], "hint string")
    labels = spark.createDataFrame([(f"total {k}",) for k in range(500)] + [("zinc total",)], "label string")
    grams = lambda df, c: df.withColumn("grams", F.split(c, " "))
    assert containment.met(grams(hints, "hint"), grams(labels, "label"), "grams").count() == 1


def test_soft_cuts(spark):
    rng = random.Random(2)
    rows = [(q, i, rng.random() < 0.6, rng.random() < 0.5, rng.random() < 0.4) for q in range(12) for i in range(rng.randint(1, 40))]
    got = batch.soft(spark.createDataFrame(rows, "q int, i int, a boolean, b boolean, c boolean"), "q", [F.col("a"), F.col("b"), F.col("c")], 5)
    want = []
    for q in range(12):
        own = [r for r in rows if r[0] == q]
        for k in (2, 3, 4):
            cut = [r for r in own if r[k]]
            own = cut if len(cut) >= 5 else own
        want += own
    assert sorted(map(tuple, got.collect())) == sorted(want)


class Made:
    """A few tables as batch.Kept has them."""

    def __init__(self, spark):
        docs = spark.createDataFrame([(k, t, r) for k, (t, r) in enumerate([("Taxes collected", "net taxes | gold"), ("Tax rates", "income tax"), ("Gold held", "gold | silver"), ("Public debt", "notes")])], "id long, title string, rows string")
        made = index.make(docs, "id", ["title", "rows"], True)
        self.postings, self.stats = made["postings"][0], made["stats"][0]
        self.terms = self.postings.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df"))
        slugs = [(0, 1, "net taxes"), (0, 2, "gold"), (1, 3, "income tax"), (2, 4, "gold"), (2, 5, "silver"), (3, 6, "notes")]
        self.rows = spark.createDataFrame(slugs, "table_id long, row_id long, slug string")


def test_text_of_many_requests_is_that_of_each(spark):
    from tabulon.session import ship

    ship(spark)
    k = Made(spark)
    asked = {1: ["taxes"], 2: ["gold taxes"], 3: ["nothing"], 4: ["silver", "notes"]}
    r = spark.createDataFrame(list(asked.items()), "q long, hints array<string>")
    terms = batch.asked_terms(r, F.col("hints"), True)
    got = {(x["q"], x["id"]): x["score"] for x in batch.text_scores(k, terms).collect()}
    whole = index.Index(k.postings.withColumn("bucket", index.bucket(F.col("term"))), k.stats, True)
    for q, words in asked.items():
        one = index.match(whole, {"title": 2.0, "rows": 2.5}, tokens(" ".join(words)))
        assert {i: pytest.approx(s) for (n, i), s in got.items() if n == q} == {x["id"]: -x["score"] for x in one.collect()}
    among = spark.createDataFrame([(2, 0), (4, 3)], "q long, id long")
    assert {(x["q"], x["id"]): x["score"] for x in batch.text_scores(k, terms, among).collect()} == {p: got[p] for p in ((2, 0), (4, 3))}
    assert {(x["q"], x["id"]) for x in batch.text_scores(k, terms, every=True).collect()} == {(1, 0), (1, 1), (2, 0)}


def test_slug_stages(spark):
    k = Made(spark)
    r = spark.createDataFrame([(1, ["Gold"]), (2, ["net tax"]), (3, ["taxes gold"])], "q long, hints array<string>")
    other = lambda hint: F.when(hint == "net tax", F.array(F.lit("net taxes"))).otherwise(F.array().cast("array<string>"))
    got = lambda **more: {(x["q"], x["id"], x["stage"], x["score"]) for x in batch.slug_scores(k, r, other, **more).collect()}
    every = {(1, 0, "primary", 6.0), (1, 2, "primary", 6.0), (2, 0, "synonym", 6.0), (2, 1, "partial", 1.0), (3, 0, "partial", 2.0), (3, 2, "partial", 1.0)}
    assert got() == every
    assert got(enough=1) == {x for x in every if x != (2, 1, "partial", 1.0)}


def test_stored_follows_its_inputs(spark, tmp_path):
    at = str(tmp_path / "t")
    count = lambda: shared.stored(spark, ("test", at), lambda: {"n": (spark.read.parquet(at), [])})["n"].count()
    spark.range(3).write.parquet(at)
    assert count() == 3 and count() == 3
    spark.range(5).write.mode("overwrite").parquet(at)
    assert count() == 5
    with pytest.raises(Exception, match="none"):
        shared.stored(spark, ("test", str(tmp_path / "none")), dict)


def test_postings_are_shuffled_once(spark):
    """Terms are counted in their document's row, with its length beside."""
    from pyspark.sql import functions as F

    from tabulon.operators import index

    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "runs running a")], "id long, text string")
    plain, stemmed = (index.make(docs, "id", ["text"], stem)["postings"][0] for stem in (False, True))
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in plain.select("id", "term", "tf", "n_tokens").collect()) == [(1, "a", 1, 3), (1, "b", 2, 3), (4, "a", 1, 3), (4, "running", 1, 3), (4, "runs", 1, 3)]
    assert [r["tf"] for r in stemmed.where(F.col("term") == "run").collect()] == [2]
