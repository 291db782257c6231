"""Series of requests: every way and status on a small ledger."""

from pyspark.sql import functions as F

from tabulon.operators import series_requests as S

FACTS = "table_id int, title string, file_year int, file_month int, table_kind string, is_section_header int, row_path string, col_path string, row_id int, col_id int, data_year int, numeric_value double, row_month int, col_month int"


def made():
    rows = []

    def add(table, title, issue, row, col, year, value, row_month=None, col_month=None):
        ids = (sum(map(ord, row)), sum(map(ord, col)))
        rows.append((table, title, issue, 1, "data", 0, row, col, *ids, year, value, row_month, col_month))

    for m in range(1, 13):
        add(1, "Receipts", 1941, "Taxes, net", f"1940 > {m}", 1940, 1.0 * m, None, m)  # months in columns
        add(2, "Outlays", 1941, f"1940 > {m}", "Army", 1940, 2.0 * m, m)  # months in rows
        add(3, "Receipts", 1942, "Taxes, net", f"1940 > {m}", 1940, 10.0 * m, None, m)  # a later issue
        add(4, "Empty", 1941, "Nothing", f"1940 > {m}", 1940, None, None, m)
    for m in range(1, 5):
        add(1, "Receipts", 1941, "Customs", f"1940 > {m}", 1940, 1.0, None, m)  # four months
    add(5, "Years", 1943, "Customs", "1940", 1940, 99.0)
    add(5, "Years", 1943, "Navy", "1940", 1940, 7.0)
    return rows


def test_ways_and_statuses(spark):
    asked = [
        (1, "taxes net", [1940], "annual", None), (2, "Army", [1940], "monthly", ""), (3, "customs", [1940], "annual", None), (4, "customs", [1940], "monthly", None), (5, "navy", [1940], "annual", "years"), (6, "navy", [1940], "monthly", None),
        (7, "gold", [1940], "annual", None), (8, "army", [1940], "annual", "receipts"), (9, "army", [1950], "annual", None), (10, "nothing", [1940], "annual", None), (11, "taxes", [1940, 1950], "annual", None), (12, "army", [], "annual", None),
    ]
    got = S.resolved(spark.createDataFrame(asked, "q int, hint string, years array<int>, granularity string, title string"), spark.createDataFrame(made(), FACTS)).collect()
    out = {(r["q"], r["year"]): (r["status"], r["way"], r["table_id"], r["n"], r["value"]) for r in got}
    assert len(got) == len(out)
    none = (None,) * 4
    assert out == {
        (1, 1940): ("ok", "columns", 3, 12, 780.0), (2, 1940): ("ok", "rows", 2, 12, 156.0), (3, 1940): ("ok", "annual", 5, 1, 99.0), (4, 1940): ("incomplete", "columns", 1, 4, 4.0), (5, 1940): ("ok", "annual", 5, 1, 7.0), (6, 1940): ("incomplete", "annual", 5, 1, 7.0),
        (7, 1940): ("label_miss", *none), (8, 1940): ("table_miss", *none), (9, 1950): ("year_miss", *none), (10, 1940): ("null_numeric", *none), (11, 1940): ("ok", "columns", 3, 12, 780.0), (11, 1950): ("year_miss", *none),
    }
    series = {r["q"]: [tuple(x) for x in r["series"]] for r in got if r["series"] is not None}
    assert series == {2: [(m, 2.0 * m) for m in range(1, 13)], 4: [(m, 1.0) for m in range(1, 5)]}


def test_nearest_labels(spark):
    missed = spark.createDataFrame([(1, "net gold taxes"), (2, "silver")], "q int, hint string")
    got = S.nearest_labels(missed, spark.createDataFrame(made(), FACTS)).where(F.col("place") == 1).collect()
    assert [(r["q"], r["label"], r["n_shared"]) for r in got] == [(1, "taxes, net", 2)]
