from tabulon.operators import bottom_up
from tabulon.sources.ledger import Ledger

R = "q long, hint string, topic string, years array<int>"


def _ledger(spark):
    tables = [(1, "Receipts of the fund", "a", 1990, 1), (2, "Receipts of the fund", "a", 1991, 1), (3, "Payroll", "b", 1991, 1), (4, "Old", "c", 1980, 1)]
    rows = [(10, 1, "Net receipts", None, 0, "net receipts"), (20, 2, "Net receipts", None, 0, "net receipts"), (30, 3, "Net receipt", None, 0, "net receipt"), (31, 3, "Head", None, 1, "net receipts"), (40, 4, "Customs", 1980, 0, "customs")]
    columns = [(100, 1, "Year 1990", None), (200, 2, "Total", 1990), (201, 2, "Total", 1991), (300, 3, "Fiscal year ended 11990", 1991), (400, 4, "Total", None), (401, 4, None, 1980)]
    cells = [(1, 10, 100, 1.0), (2, 20, 200, 2.0), (2, 20, 201, 3.0), (3, 30, 300, 4.0), (3, 31, 300, 5.0), (4, 40, 400, 6.0), (4, 40, 401, None)]
    return Ledger(
        spark.createDataFrame(tables, "id long, title string, signature string, file_year int, file_month int"),
        spark.createDataFrame(rows, "id long, table_id long, row_path string, year_extracted int, is_section_header int, metric_slug string"),
        spark.createDataFrame(columns, "id long, table_id long, col_path string, year_extracted int"),
        spark.createDataFrame(cells, "table_id long, row_id long, col_id long, numeric_value double"),
    )


def _rows(spark, requests, most=20):
    got = bottom_up.retrieve(_ledger(spark), spark.createDataFrame(requests, R), most).orderBy("q", "place").collect()
    return [(r["q"], r["id"], r["n_cells"], round(r["likeness"], 2)) for r in got]


def test_requests_side_by_side(spark):
    asked = [
        (1, "Receipts net", None, [1990]),  # the latest table of a signature; a column path that names the year, among longer numbers too
        (2, "Receipts net", "payroll", [1991]),  # only tables that hold the topic
        (3, "Receipts net", "nowhere", [1991]),  # a topic that no table has
        (4, "custom", None, None),  # all years
        (5, "", "the customs", [1980]),  # the topic in the hint's place; no number in a column of that year
        (6, "qqq", None, [1990]),
        (7, None, None, [1990]),
        (8, "Receipts net", None, [1850]),
    ]
    assert _rows(spark, asked) == [(1, 3, 1, 95.65), (1, 2, 1, 100.0), (2, 3, 1, 95.65), (3, 3, 1, 95.65), (3, 2, 1, 100.0), (4, 4, 1, 92.31)]
    assert _rows(spark, asked[:1], 1) == [(1, 3, 1, 95.65)]
    assert _rows(spark, []) == []


def test_stages_of_probes(spark):
    r = spark.createDataFrame([(1, "qqq", "zz customs zz", []), (2, "net receipts", "customs", []), (3, "qqq", "vv net receipt", [])], R)
    got = {(x["q"], x["metric_slug"], round(x["likeness"], 1)) for x in bottom_up.slugs(_ledger(spark), r).collect()}
    assert got == {(1, "customs", 100.0), (2, "net receipts", 100.0), (2, "net receipt", 95.7), (3, "net receipt", 100.0), (3, "net receipts", 84.6)}
