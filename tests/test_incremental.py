"""A ledger that grows by files, and the reverse value index, against whole runs and brute force."""

import json
import random
import time

from pyspark.sql import functions as F

from tabulon.operators import values
from tabulon.operators.evaluation import SCALES
from tabulon.sources import corpus, incremental


def document(at, name, *numbers, note=True):
    rows = "".join(f"<tr><td>Item {k}</td><td>{n}</td></tr>" for k, n in enumerate(numbers))
    e = [{"type": "title", "id": "0", "content": "Budget", "bbox": [{"page_id": "1"}]}]
    if numbers:
        e.append({"type": "table", "id": "1", "content": f"<table><tr><th>Item</th><th>1940</th></tr>{rows}</table>", "bbox": [{"page_id": "1"}]})
    if note:
        e.append({"type": "footnote", "id": "2", "content": "1/ Revised.", "bbox": [{"page_id": "1"}]})
    (at / name).write_text(json.dumps({"document": {"elements": e, "pages": [{"id": "1", "image_uri": name}]}}))


def content(ledger):
    """What a ledger holds, without its ids."""
    t = ledger.tables.select(F.col("id").alias("table_id"), "file")
    cells = ledger.cells.join(t, "table_id").join(ledger.rows.select("table_id", F.col("id").alias("row_id"), "row_path"), ["table_id", "row_id"])
    return {
        "cells": sorted(map(tuple, cells.select("file", "row_path", "numeric_value").collect())), "tables": sorted(map(tuple, ledger.tables.select("file", "title", "n_rows").collect())),
        "notes": sorted(map(tuple, ledger.footnotes.select("file", "content").collect())), "pages": sorted(map(tuple, ledger.pages.select("file", "page_id", "image_uri").collect())), "invariants": ledger.invariants.count(),
    }


def test_runs_over_growing_files(spark, tmp_path):
    docs, at = tmp_path / "docs", str(tmp_path / "ledger")
    docs.mkdir()
    paths = f"{docs}/*.json"
    document(docs, "issue_1940_07.json", 1, 2)
    document(docs, "issue_1940_07b.json", 3)
    document(docs, "issue_1941_01.json", 4)
    document(docs, "issue_1942_01.json", 9)
    first = content(incremental.update_files(spark, paths, at))
    assert [c[2] for c in first["cells"]] == [1.0, 2.0, 3.0, 4.0, 9.0]
    assert first == content(corpus.write_ledger(spark, paths, f"{tmp_path}/whole1"))
    ids = {r["file"]: r["id"] for r in spark.read.parquet(f"{at}/tables").collect()}

    assert content(incremental.update_files(spark, paths, at)) == first  # nothing new: nothing done
    assert incremental.manifest(spark, at).agg(F.max("run")).first()[0] == 1

    time.sleep(0.05)
    document(docs, "issue_1940_07b.json", 5, 6, 7, note=False)  # changed
    document(docs, "issue_1940_07a.json", 8)  # new, in an issue that is there
    document(docs, "issue_1942_01.json", note=False)  # nothing but a title is left
    second = content(incremental.update_files(spark, paths, at))
    assert second == content(corpus.write_ledger(spark, paths, f"{tmp_path}/whole2"))
    runs = {r["file"]: r["run"] for r in incremental.manifest(spark, at).collect()}
    assert runs == {"issue_1940_07.json": 1, "issue_1940_07b.json": 2, "issue_1941_01.json": 1, "issue_1942_01.json": 2, "issue_1940_07a.json": 2}
    now = {r["file"]: r["id"] for r in spark.read.parquet(f"{at}/tables").collect()}
    assert {f: now[f] for f in ids if f in now} == {f: i for f, i in ids.items() if f in now} and len(set(now.values())) == len(now)


def test_a_run_that_was_cut_off(spark, tmp_path, monkeypatch):
    docs, at = tmp_path / "docs", str(tmp_path / "ledger")
    docs.mkdir()
    document(docs, "issue_1940_07.json", 1)
    incremental.update_files(spark, f"{docs}/*.json", at)
    document(docs, "issue_1940_07b.json", 2)
    replace, done = incremental._replace, []

    def cut(*a):
        if len(done) == 4:
            raise RuntimeError("lost")
        done.append(replace(*a))

    monkeypatch.setattr(incremental, "_replace", cut)
    try:
        incremental.update_files(spark, f"{docs}/*.json", at)
        raise AssertionError
    except RuntimeError:
        pass
    monkeypatch.setattr(incremental, "_replace", replace)
    assert content(incremental.update_files(spark, f"{docs}/*.json", at)) == content(corpus.write_ledger(spark, f"{docs}/*.json", f"{tmp_path}/whole"))


def test_places(spark):
    rng = random.Random(9)
    cells = [(t, r, 1, rng.choice([0.0, None, float("nan"), float("inf"), rng.uniform(-2, 2), rng.uniform(1, 1.1) * 1e3, rng.uniform(1, 1.1) * 1e6, 100.0, 101.0, 99.0])) for t in range(12) for r in range(30)]
    gold = [(i, rng.choice([0.0, 1.05, 1050.0, -1.0, None, float("nan"), 100.0, 1.0 / 0.99, rng.uniform(-2, 2)])) for i in range(60)]
    want = set()
    for u, v in gold:
        for t, r, c, w in cells:
            for s in SCALES:
                if v is not None and w is not None and abs(w) < float("inf") and abs(w - v * s) <= abs(v * s) * 0.01:
                    want.add((u, t, r, c, s))
    g, x = spark.createDataFrame(gold, "uid int, value double"), spark.createDataFrame(cells, "table_id int, row_id int, col_id int, numeric_value double")
    got = values.places(g, x)
    rows = got.collect()
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    s = {r["uid"]: r for r in values.summed(g, got).collect()}
    assert len(s) == len(gold)
    for u, _ in gold:
        own = {w for w in want if w[0] == u}
        assert (s[u]["n_cells"], s[u]["n_tables"]) == (len({w[1:4] for w in own}), len({w[1] for w in own}))
        assert s[u]["places"] == {0: "none", 1: "one"}.get(s[u]["n_tables"], "several")
