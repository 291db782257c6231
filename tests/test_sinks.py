"""Results as JSON, files by name, tables fetched again."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from tabulon.sources import corpus, sinks


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(f"u{k:03d}", k, None if k % 7 == 0 else k / 2) for k in range(300)], "uid string, n int, score double").repartition(5)
    sinks.write_results(df, df.agg(F.count("*").alias("total"), F.avg("score").alias("mean")), str(tmp_path))
    lines = [json.loads(x) for p in sorted(Path(f"{tmp_path}/details").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["uid"] for x in lines] == sorted(x["uid"] for x in lines) and len(lines) == 300 and lines[0] == {"uid": "u000", "n": 0, "score": None}
    (only,) = Path(f"{tmp_path}/summary").glob("part-*")
    assert json.loads(only.read_text())["total"] == 300
    assert sinks.read_results(df, str(tmp_path)).exceptAll(df).count() == 0


def test_first_files_and_fetching(spark, tmp_path):
    for name in ("c_1942_01", "a_1940_01", "b_1941_01"):
        doc = {"document": {"elements": [{"type": "table", "id": "0", "content": f"<table>{name}</table>", "bbox": []}, {"type": "text", "id": "1", "content": "x", "bbox": []}], "pages": []}}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    docs = corpus.scan(spark, f"{tmp_path}/*.json", 2)
    assert sorted(r["file"] for r in docs.collect()) == ["a_1940_01.json", "b_1941_01.json"]
    places = spark.createDataFrame([("a_1940_01.json", 0), ("a_1940_01.json", 0), ("a_1940_01.json", 1), ("z.json", 0)], "file string, element_seq int")
    got = {(r["file"], r["element_seq"]): r["html"] for r in corpus.fetched(corpus.elements(docs), places).collect()}
    assert got == {("a_1940_01.json", 0): "<table>a_1940_01</table>", ("a_1940_01.json", 1): "", ("z.json", 0): ""}
