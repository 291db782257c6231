"""The guarded endpoint, hints, requests and corpus files."""

import json

import pytest
from pyspark.sql import functions as F

from tabulon.operators import guard, hints, layers, requests
from tabulon.sources import corpus


@pytest.mark.parametrize("text", ["DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "show tables", ""])
def test_sql_is_refused(text):
    with pytest.raises(guard.Refused):
        guard.checked(text)


def test_sql_is_run(spark):
    assert guard.checked("SELECT 'drop; table' AS x;") == "SELECT 'drop; table' AS x"
    assert len(guard.run_sql(spark, "SELECT repeat('a', 500) AS x").first()["x"]) == 200


def test_expressions(spark):
    df = spark.createDataFrame([(6.0, 3.0, 0.0)], "a double, b double, z double")
    value = lambda t: df.select(guard.expression(t, {"a", "b", "z"}).alias("x")).first()["x"]
    assert value("(a - b) / b * 100") == 100.0
    assert value("a / z") is None
    assert value("max([a, b]) + abs(-b)") == 9.0
    for bad in ("__import__('os')", "a.b", "c + 1", "[x for x in a]", "a if b else z", "open('f')"):
        with pytest.raises(guard.Refused):
            guard.expression(bad, {"a", "b", "z"})


def test_hints():
    assert "receipts" in hints.synonyms("revenue")
    assert hints.phrases("national defense outlays") == ["national defense", "outlays"]
    assert {"defense spending", "military spending", "defensespending"} <= set(hints.variants("Defense spending"))
    assert hints.descriptive("all of the rows such as these", True) and not hints.descriptive("receipts", True)
    told = ["all tax rows", "Excluding gold", "aggregates of it", "w " * 16, "e.g.gold"]
    assert all(hints.descriptive(t, True) for t in told) and not any(hints.descriptive(t, True) for t in ("all of the rows", "an included sum", "e.g. gold", "net public debt of gold"))
    assert hints.descriptive("net public debt gold", False) and not hints.descriptive("all tax rows", False)
    assert [hints.year_mode(q) for q in ("in fiscal year 1940", "fiscal year and calendar year", "FY 88", "the fy of", "CY")] == ["fiscal", "calendar", "fiscal", "unknown", "unknown"]
    assert hints.operation("What was the percent change from 1940?") == "percent_change"


def test_problems(spark):
    rows = [("a", "v", "t", "", "annual", [], None, "sum", None), ("b", "v", "t", "receipts", "specific_month", [1700], None, "sum", None), ("c", "v", "t", "receipts", "annual", [1940], None, "sum", None)]
    got = {r["uid"]: r["codes"] for r in requests.problems(spark.createDataFrame(rows, requests.REQUEST)).collect()}
    assert got == {"a": ["EMPTY", "MISSING_YEARS"], "b": ["BAD_YEAR", "MISSING_MONTH"], "c": []}


def test_corpus(spark, tmp_path):
    html = "<table><tr><th>Item</th><th>1940</th></tr><tr><td>Receipts</td><td>1,200 r</td></tr><tr><td>Other</td><td>n.a.</td></tr></table>"
    e = lambda i, kind, content, page: {"type": kind, "id": str(i), "content": content, "bbox": [{"page_id": str(page)}]}
    doc = {"document": {"elements": [e(0, "title", "Budget (In millions of dollars)", 1), e(1, "table", html, 1), e(2, "footnote", "1/ Revised.", 1), e(3, "title", "", 2)], "pages": [{"id": "1", "image_uri": "a"}, {"id": "1", "image_uri": "b"}]}}
    (tmp_path / "issue_1940_07.json").write_text(json.dumps(doc))
    corpus.write_ledger(spark, f"{tmp_path}/*.json", f"{tmp_path}/ledger")
    i = corpus.read_ledger(spark, f"{tmp_path}/ledger")
    t = i.tables.first()
    assert (t["title"], t["unit"], t["file_year"], t["file_month"], t["page_id"], t["table_kind"], t["parse_method"], t["html"]) == ("Budget (In millions of dollars)", "millions_usd", 1940, 7, 1, "data", "dual_agree", None)
    cells = {r["row_index"]: (r["numeric_value"], r["parse_status"], r["is_revised"]) for r in i.cells.collect()}
    assert cells == {1: (1200.0, "ok", 1), 2: (None, "missing", 0)}
    assert corpus.purge_missing(i.cells).count() == 1
    note = i.footnotes.first()
    assert (note["marker"], note["attached_to_table_id"]) == ("1/", t["id"])
    assert {(r["row_path"], r["data_year"], r["numeric_value"]) for r in layers.facts(i).collect()} == {("Receipts", 1940, 1200.0), ("Other", 1940, None)}
    assert [(r["page_id"], r["image_uri"], r["header_text"]) for r in i.pages.collect()] == [(1, "b", None)]
    assert i.invariants.first()["delta"] == 0
    assert spark.read.parquet(f"{tmp_path}/ledger/tables").where(F.col("signature").isNotNull()).count() == 1


def test_parsers_differ(spark, tmp_path):
    """A broken table is rescued, one whose spans only one parser follows is told, what holds no cell fails."""
    html = ["<tr><th>A</th><th>1940</th></tr><tr><td>x &amp; y</td><td>5</td></tr>", "<table><tr><td rowspan=3>A</td><td rowspan=3>1</td></tr><tr><td>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr></table>", "<p>none</p>"]
    e = spark.createDataFrame([("issue_1940_07.json", n, str(n), "table", h, 1, 1940, 7) for n, h in enumerate(html)], "file string, element_seq int, element_id string, kind string, content string, page_id int, file_year int, file_month int")

    def keep(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    i = corpus.ingest(spark, e, None, keep)
    t = {r["element_seq"]: (r["parse_method"], r["parse_ok"], r["n_rows"], r["n_cols"]) for r in i.tables.collect()}
    assert t == {0: ("pandas_only", 1, 2, 2), 1: ("dual_disagree", 1, 3, 4), 2: ("fail", 0, 0, 0)}
    assert [r["row_leaf"] for r in i.rows.where(F.col("row_index") == 1).orderBy("table_id").collect()][0] == "x & y"
    assert corpus.sanity(i).count() == 46
