"""Grid, context, evaluation and ranking operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import context, evaluation, grid, search, stats


def rows_of(html):
    out = {}
    for t, r, c, text, *_ in grid.grids(html):
        out.setdefault((t, r), {})[c] = text
    return [[row[c] for c in sorted(row)] for _, row in sorted(out.items())]


def test_rowspan_repeats_labels_only():
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td rowspan=2>Receipts</td><td rowspan=2>9</td></tr><tr></tr><tr><td>Other</td><td>1</td></tr></table>"
    assert rows_of(html) == [["A", "B"], ["Receipts", "9"], ["Receipts", ""], ["Other", "1"]]


def test_bad_span_and_nested_tags():
    assert rows_of("<table><tr><td colspan='x'><b>Bold</b> text</td><td>123</td></tr></table>") == [["Bold text", "123"]]
    assert rows_of("") == [] and rows_of(None) == []


def test_origins_equal_cells():
    rng = random.Random(4)
    for _ in range(50):
        n = 0
        html = "<table>"
        for _ in range(rng.randint(1, 5)):
            html += "<tr>"
            for _ in range(rng.randint(1, 4)):
                n += 1
                html += f"<td colspan={rng.randint(1, 3)}>{n}</td>"
            html += "</tr>"
        assert sum(x[4] for x in grid.grids(html + "</table>")) == n


def test_paths(spark):
    html = "<table><tr><th>Item</th><th colspan=2>1940</th></tr><tr><th></th><th>Jan</th><th>Feb</th></tr><tr><td>Receipts</td><td></td><td></td></tr><tr><td style='padding-left:10px'>Tax</td><td>1</td><td>2</td></tr></table>"
    g = grid.html_grid(spark, spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").cache()
    cols = {r["col_index"]: r["col_path"] for r in grid.column_paths(g).collect()}
    assert cols == {0: "Item", 1: "1940 > Jan", 2: "1940 > Feb"}
    rows = {r["row_index"]: (r["row_path"], r["is_section"]) for r in grid.row_entries(g).collect()}
    assert rows == {2: ("Receipts", 1), 3: ("Receipts > Tax", 0)}
    assert grid.invariants(g).first()["n_origin_cells"] == 11
    assert grid.rendered(g).first()["text"].split("\n")[3] == "Tax | 1 | 2"


def test_captions(spark):
    e = [(1, 1, "caption", "C1"), (2, 1, "table", ""), (3, 1, "table", ""), (4, 1, "caption", "C2"), (5, 2, "text", "t"), (6, 1, "table", ""), (7, 1, "caption", "C3"), (8, 1, "caption", ""), (9, 1, "table", "")]
    df = spark.createDataFrame([("f", *x) for x in e], "file string, seq int, page int, kind string, content string")
    assert {r["seq"]: r["caption"] for r in context.captions(df).collect()} == {2: "C1", 3: None, 6: None, 9: None}


def test_year_propagation(spark):
    """Against a loop, over random tables."""
    import random

    rng = random.Random(8)
    rows, expected = [], {}
    for t in range(40):
        last = None
        for i in range(rng.randint(1, 12)):
            section = int(rng.random() < 0.2)
            year = rng.choice([None, None, rng.randint(1900, 1999)])
            month = rng.choice([None, rng.randint(1, 12)])
            rows.append((t, i, year, month, section))
            if section:
                last = None
            elif year is not None:
                last = year
            expected[t, i] = last if year is None and month is not None and not section else year
    df = spark.createDataFrame(rows, "table_id int, row_index int, year int, month int, is_section int")
    assert {(r["table_id"], r["row_index"]): r["year"] for r in context.year_propagated(df).collect()} == expected


def test_dated_months(spark):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(["1940-Nov", "Dec", "Jan", "Total", "1950", "Feb"])], "key string, pos int, label string")
    assert [r["label"] for r in context.dated_months(df).orderBy("pos").collect()] == ["1940-Nov", "1940-Dec", "1941-Jan", "Total", "1950", "Feb"]


def test_continuation(spark):
    df = spark.createDataFrame([("f", 1, 1, 10, "s"), ("f", 2, 2, 11, "s"), ("f", 3, 4, 12, "s"), ("f", 4, 5, 13, "t")], "file string, element_seq int, page_id int, id int, signature string")
    assert [r["continues_from"] for r in context.continued(df).orderBy("id").collect()] == [None, 10, None, None]


def test_nearest_prefers_earlier(spark):
    l = spark.createDataFrame([("p", 5), ("p", 100)], "page string, seq int")
    r = spark.createDataFrame([("p", 3), ("p", 7)], "page string, seq int")
    assert {x["l_seq"]: x["r_seq"] for x in context.nearest(l, r, ["page"], 5).collect()} == {5: 3, 100: None}


def test_evaluation(spark):
    found = spark.createDataFrame([("q1", "f", 1, 2), ("q1", "f", 1, 1), ("q2", "g", 9, 1)], "question string, file string, page int, rank int")
    gold = spark.createDataFrame([("q1", "f", 1, 5.0), ("q2", "g", 1, 7.0)], "question string, file string, page int, value double")
    assert {r["question"]: r["rank"] for r in evaluation.first_hits(found, gold).collect()} == {"q1": 1, "q2": None}
    cells = spark.createDataFrame([("f", 1, 5000.0), ("g", 1, 8.0)], "file string, page int, numeric_value double")
    assert {r["question"]: r["found"] for r in evaluation.present(cells, gold).collect()} == {"q1": True, "q2": False}


def test_cover_and_budget(spark):
    e = spark.createDataFrame([("k", 1, [1940]), ("k", 2, [1940]), ("k", 3, [1941])], "k string, rank int, years array<int>")
    assert [r["rank"] for r in evaluation.covering(e, "k").orderBy("place").collect()] == [1, 3, 2]
    t = spark.createDataFrame([("k", 1, "a" * 600), ("k", 2, "b" * 600)], "k string, rank int, text string")
    assert [len(r["text"]) for r in evaluation.budgeted(t, "k", 1150).orderBy("rank").collect()] == [600, 550]


def test_soft_filter(spark):
    df = spark.range(30)
    assert search.soft_filter(df, F.col("id") < 12, 10).count() == 12
    assert search.soft_filter(df, F.col("id") < 5, 10).count() == 30


def test_quantile_and_box_cox(spark):
    assert stats.normal_quantile(0.95) == pytest.approx(1.6448536, abs=1e-6)
    assert spark.createDataFrame([(4.0,)], "v double").select(stats.box_cox(F.col("v"), 0.5)).first()[0] == pytest.approx(2.0)


def test_title_months(spark):
    titles = spark.createDataFrame([(1, "Receipts, November 1940 to February 1941"), (2, "Receipts in 1940")], "table_id int, title string")
    cols = spark.createDataFrame([(1, 0, None, None), (1, 1, None, 11), (1, 2, None, 12), (1, 3, None, 1), (1, 4, None, 3), (1, 5, None, 2), (2, 1, None, 5)], "table_id int, col_index int, year int, month int")
    got = {(r["table_id"], r["col_index"]): r["year"] for r in context.title_months(cols, titles).collect()}
    assert got == {(1, 0): None, (1, 1): 1940, (1, 2): 1940, (1, 3): 1941, (1, 4): None, (1, 5): None, (2, 1): None}


def test_without_aggregates(spark):
    df = spark.createDataFrame([("a", "Total receipts"), ("a", "Customs"), ("a", "Other taxes"), ("b", "Total")], "k string, label string")
    assert {(r["k"], r["label"]) for r in search.without_aggregates(df, "k", "label").collect()} == {("a", "Customs"), ("b", "Total")}


def test_sections(spark):
    from tabulon.operators import sections

    texts = ["a | b\n| --- | --- |\n| X | nan |\n| Y |  |", "| a | b |\n| X | |\n|1|2|\n|\n| only | two |", None, "no table\n|", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r["id"], r["section"]): (r["label"], r["header"], r["start"], r["lines"]) for r in sections.sections(df, "id", "text").collect()}
    assert got == {(0, 0): ("", "a | b", 2, ["| X | nan |", "| Y |  |"]), (1, 1): ("X", "| a | b |", 1, ["|1|2|"])}


def test_section_score():
    from tabulon.operators import sections

    months = ["| 1940-January | 10 |", *(f"| {m} | 20 |" for m in ("February", "Mar.", "April", "May", "June", "July", "Aug.", "September", "October", "Market")), "| 1941-January | 30 |"]
    # the label is the term (40), a header holds it (0.85 * 15), the year stands there (20) with ten months (40), numbers (15)
    assert sections.score("Ships", ["Old ships"], months, ["ships"], [1940]) == pytest.approx(40 + 12.75 + 20 + 40 + 15)
    assert sections.score("", [], ["| a | b |"], ["zzz"], []) == -20


def test_numbers_of_sections():
    from tabulon.operators import sections

    large = ["1,234 r", "r/ 1,234", "12%", "+50", "(1,234)", "$ 55.5", "1,234 1/", "10", "-10.", "1,234.5 p 2/", "$(12)"]
    assert all(map(sections._large, large))
    assert not any(map(sections._large, ["9.99", "9 r", "", "-", "nan", "...", "1940-Jan.", "12 34", "a 12", "12 x", ".5", "1/"]))


def test_lines_of_one_number_stay_in_the_tables_order(spark, tmp_path):
    """47 then 27 is a change of -43 %, which isn't the sum; 27 then 47 is 74 %, which is nearly the sum of 74."""
    from tabulon.plans import catalog

    rows = [(2, 3, 47.0), (2, 3, 27.0), (10, 3, 27.0), (10, 3, 47.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r["l_orderkey"]: r["fails"] for r in catalog.QUERIES["submission_checks"](spark, str(tmp_path)).collect()} == {2: True, 10: False}


def test_plain_markup_reads_as_parsed(monkeypatch):
    """Plain tags go past the parser; the grids are the same, with spans that overlap, clash and never close."""
    import random
    import re

    rng = random.Random(7)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<td rowspan=2>", "<td colspan='3'>", '<th colspan="2">', "<td colspan='2\">", "<td colspan=0>", "a", " b  c ", "<b>", "</b>", "x > y", "&amp;"]
    texts = ["<table>" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    fast = [list(grid.grids(t)) for t in texts]
    assert any(grid._PLAIN.fullmatch(t) for t in texts)
    monkeypatch.setattr(grid, "_PLAIN", re.compile(r"(?!)"))
    assert fast == [list(grid.grids(t)) for t in texts]


@pytest.mark.parametrize("name", ["flat_entries", "year_groups", "wide_texts"])
def test_parts_are_dealt_out_before_they_are_parsed(spark, sf, tmp_path, monkeypatch, name):
    """A small file is read by one task; its tables are parsed by as many as a shuffle has."""
    from tabulon.plans import catalog

    seen = []
    whole = grid.html_grid
    monkeypatch.setattr(grid, "html_grid", lambda spark, pages, *names: seen.append(pages.rdd.getNumPartitions()) or whole(spark, pages, *names))
    spark.read.parquet(f"{sf}/part.parquet").limit(20).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_columns_are_made_where_their_table_is(spark, sf):
    """titled_months shuffles tables, not the columns that it makes of them."""
    from tabulon.plans import catalog

    plan = catalog.QUERIES["titled_months"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(table_id" not in plan
