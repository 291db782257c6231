"""The pipeline's stages on a small corpus."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, sf):
    import corpus_pipeline as p

    from tabulon.llm.util import Scratch

    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {"": docs}
    for name, stage in p.STAGES:
        docs = seen[name] = scratch.write(stage(spark, docs, sf), name)
        if name != p.STAGES[-1][0]:
            assert docs.columns == p.COLUMNS
    kept = lambda n: [r["doc_id"] for r in seen[n].select("doc_id").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len(set(good) & set(kept("quality"))) >= 0.95 * len(good)
    near = kept("near_duplicates")
    assert len(near) == len(set(near)) <= len(kept("quality"))
    assert set(kept("suffix_dedup")) <= set(near)
    assert max(Counter(kept("mixing")).values()) <= 2
    last = seen["encoding"].collect()
    assert last and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)


def test_suffix_stage_cuts_texts(spark, sf):
    import corpus_pipeline as p

    again = "this passage stands in two documents and is well over one hundred bytes long, so the later one loses it; "
    rows = [(1, f"first {again}", "en", "a", 0), (2, f"second é{again}end", "en", "a", 0), (3, f"first {again}", "en", "a", 0), (4, None, None, None, None), (5, "", "en", "a", 0)]
    out = {r["doc_id"]: r["text"] for r in p.suffix_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf).collect()}
    assert out == {1: f"first {again}", 2: "second éend", 4: None, 5: ""}


def test_mixing_stage_on_empty_and_odd_rows(spark, sf):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert p.mixing_stage(spark, spark.createDataFrame([], schema), sf).count() == 0
    rows = [(1, "a b c d", "en", "s", 7), (2, None, None, None, None), (None, "x y", None, None, 3), (3, "p q r s t", "en", "t", 9)]
    out = Counter(r["doc_id"] for r in p.mixing_stage(spark, spark.createDataFrame(rows, schema), sf).collect())
    assert 2 not in out and out[1] >= 1 and max(out.values()) <= 2


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, block int, position double, key long"
NEAR = " ".join(f"word{i}" for i in range(80))


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "suffix_dedup", "mixing", "encoding"])
def test_each_stage_on_odd_rows(spark, sf, name):
    """Null, empty, repeated, tied and very long rows beside columns with clashing names; and an empty table."""
    import corpus_pipeline as p

    more = ("x", 1, 0.5, 7)
    rows = [(1, NEAR, "en", "a", 500, *more), (2, NEAR + " more", "en", "a", 505, *more), (2, NEAR + " more", "en", "a", 505, *more), (3, None, None, None, None, *more), (4, "", "en", "a", 0, *more), (None, "no id here", None, None, 3, *more), (5, "\u65e5\u672c \U0001f600 " * 20000, "ja", "b", 1, *more), (6, " \t\n", "en", None, 3, *more)]
    stage = dict(p.STAGES)[name]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = stage(spark, docs, sf)
    assert name == "encoding" or out.columns == p.COLUMNS
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    if name == "near_duplicates":
        assert ids == Counter([1, 3, 4, None, 5, 6])
    elif name == "suffix_dedup":
        assert ids == Counter(r[0] for r in rows)
    elif name == "encoding":
        assert ids == Counter(r[0] for r in rows) and all(r["round_trip"] for r in out.collect())
        assert {r["doc_id"]: r["n_tokens"] for r in out.collect()}[3] == 0
    elif name == "mixing":
        assert not {3, 4, 6} & set(ids) and {1, 2, 5} <= set(ids)
    else:
        assert set(ids) <= {r[0] for r in rows}
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0
