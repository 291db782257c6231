"""Expressions on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from tabulon.functions import labels, numbers
from tabulon.operators import fuzzy, search


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()["x"]


CELLS = [
    ("1,234", 1234.0, "ok", {}), ("(123)", -123.0, "ok", {}), ("$ 5.5 r", 5.5, "ok", {"is_revised": 1}), ("7 p/", 7.0, "ok", {"is_preliminary": 1}), ("12 e/", 12.0, "ok", {"is_estimated": 1}), ("12.5%", 12.5, "ok", {"is_percent": 1}), ("10,0653/", 10065.0, "ok", {"has_footnote": 1}),
    ("1,844 1/2", 1844.5, "ok", {}), ("1/2", 0.5, "ok", {}), ("$2.5 million (revised)", 2.5, "ok", {"is_revised": 1}), ("n.a.", None, "missing", {"is_missing": 1}), (None, None, "missing", {"is_missing": 1}), ("", None, "missing", {"is_missing": 1}), ("Total receipts", None, "text", {}), ("12d", None, "unparseable", {}), ("0", 0.0, "ok", {"is_zero": 1}), ("*", None, "missing", {"has_footnote": 1}),
]


def test_cells(spark):
    rows = numbers.with_cells(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CELLS)], "i int, raw string"), "raw").collect()
    for r in rows:
        raw, value, status, flags = CELLS[r["i"]]
        assert (r["numeric_value"], r["parse_status"]) == (value, status), raw
        for k, v in flags.items():
            assert r[k] == v, (raw, k)


@pytest.mark.parametrize(("label", "slug"), [("Total  Receipts 1/", "total receipts"), ("Défense, (net)", "défense net"), (None, ""), ("Grants-in-aid", "grants-in-aid")])
def test_slug(spark, label, slug):
    assert one(spark, labels.slug(F.col("a")), a=label) == slug


@pytest.mark.parametrize(("text", "year", "month"), [("1940-Jan.", 1940, 1), ("Sept. 1951", 1951, 9), ("no date 1799", None, None), ("may 2039", 2039, 5), (None, None, None)])
def test_year_month(spark, text, year, month):
    assert one(spark, labels.year_of(F.col("a")), a=text) == year
    assert one(spark, labels.month_of(F.col("a")), a=text) == month


@pytest.mark.parametrize(("label", "month"), [("Mar.", 3), ("Market", None), ("Octane", None), ("sept", 9), ("Mayor", None), ("May", 5)])
def test_leading_month(spark, label, month):
    assert one(spark, labels.leading_month(F.col("a")), a=label) == month


@pytest.mark.parametrize(("text", "unit"), [("(In millions of dollars)", "millions_usd"), ("In thousande of dollars", "thousands_usd"), ("Percent", "percent"), ("dollars", "dollars"), ("Index 1913=100", "index"), ("", None)])
def test_unit(spark, text, unit):
    assert one(spark, labels.unit_of(F.col("a")), a=text) == unit


@pytest.mark.parametrize(("text", "years"), [("in the 1940s", list(range(1940, 1950))), ("1950-1953", [1950, 1951, 1952, 1953]), ("between 1990 and 1992", [1990, 1991, 1992]), ("none", [])])
def test_years(spark, text, years):
    assert one(spark, labels.years_in(F.col("a")), a=text) == years


@pytest.mark.parametrize(("y", "m", "fy"), [(1970, 7, 1971), (1970, 6, 1970), (1976, 8, None), (1976, 10, 1977), (1990, 9, 1990)])
def test_fiscal_year(spark, y, m, fy):
    assert one(spark, labels.fiscal_year(F.col("y"), F.col("m")), y=y, m=m) == fy


def test_units_convert(spark):
    convert = lambda s, t: one(spark, numbers.convert_unit(F.col("v"), F.col("s"), F.col("t")), v=5.0, s=s, t=t)
    assert convert("thousands", "millions") == pytest.approx(0.005)
    assert convert("millions", None) == 5e6
    assert convert("percent", "millions") == 5.0
    assert convert(None, "millions") == 5.0


def test_parsers(spark):
    assert one(spark, numbers.clean_value(F.col("a")), a="r/ (1,200)") == -1200.0
    assert one(spark, numbers.loose_number(F.col("a")), a="a/ 12*") == 12.0
    assert one(spark, numbers.answer_number(F.col("a")), a="$3.5 billion") == 3.5


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("adjustment", "adjust"), ("controll", "control"), ("rate", "rate"), ("sky", "sky")])
def test_stem(word, stem):
    assert fuzzy.stem(word) == stem


def test_likeness():
    assert fuzzy.lcs_length("abcde", "ace") == 3
    assert fuzzy.token_set("national defense", "defense national total") == 100.0
    assert fuzzy.indel_ratio("", "") == 100.0
    assert 0 < fuzzy.weighted("receipts", "receipt") < 100


def test_formats():
    assert fuzzy.formatted(2.675, "hundredths") == "2.67"
    assert fuzzy.formatted(3.0, None) == "3"
    assert fuzzy.matches("1,234 million", "about 1234", 0.01)
    assert not fuzzy.matches("1,234", "1,300", 0.01)


def test_stems_in_spark(spark):
    df = spark.createDataFrame([(["running", "ponies"],), (None,)], "w array<string>")
    assert [r["s"] for r in df.select(fuzzy.stems("w").alias("s")).collect()] == [["run", "poni"], None]


def test_bm25_against_sqlite(spark):
    import sqlite3

    texts = [("debt of the state", "alpha"), ("debt debt receipts", "beta gamma"), ("receipts only here", ""), ("nothing", "debt")]
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(a, b)")
    c.executemany("insert into f(rowid, a, b) values (?, ?, ?)", [(i, *t) for i, t in enumerate(texts)])
    expected = dict(c.execute("select rowid, bm25(f, 2.0, 1.5) from f where f match 'debt OR receipts'"))
    got = search.bm25(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, a string, b string"), "id", {"a": 2.0, "b": 1.5}, ["debt", "receipts"])
    assert {r["id"]: pytest.approx(r["score"]) for r in got.collect()} == expected


def test_numbers_in_context(spark):
    """Against a version that walks over matches."""
    import random

    from tabulon.functions import contexts

    def walked(text):
        text = re.sub(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", lambda m: m.group().replace(",", ""), text.replace("−", "-"))
        scale = lambda c: next((n for n, p in contexts.SCALES if re.search(p, c)), None)
        around = lambda m: text[max(0, m.start() - 20) : m.end() + 20].lower()
        return [(float(m.group().rstrip("%")), m.group().endswith("%"), m.start(), around(m), scale(around(m))) for m in re.finditer(r"-?\d+\.?\d*%?", text)]

    rng = random.Random(3)
    parts = ["1,234", "5", "-7.5%", "−12", "1,2345", "12,34,567", "1.", ".5", "million", "Billions", "b", "k", "in 1995", ", ", "%", "-", "(3)", "x1,000,000.25y", "é"]
    texts = ["", "none"] + [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", contexts.numbers_in(F.col("t")).alias("n")).collect()
    for r in rows:
        assert [tuple(x) for x in r["n"]] == walked(r["t"]), r["t"]


@pytest.mark.parametrize(
    ("truth", "answer", "right"),
    [("5", "five", False), ("0", "0.0 left", True), ("0", "1", False), ("12%", "about 12.0 percent", True), ("-3", "3", False), ("1,000 and 1990", "in 1990 and 1000", True), ("gold", "Silver", False), ("'gold'", "some Gold (pure)", True), ("5 apples", "5", False), ("5 apples", "5 red apples", True), ("5 apples", "I have 5 apples", True), (None, "5", None), ("5", "", None), ("7", "1999 7", True), ("1999", "1999", True)],
)
def test_answer_matches_in_the_jvm(spark, truth, answer, right):
    from tabulon.functions import contexts

    assert spark.createDataFrame([(truth, answer)], "t string, a string").select(contexts.matches(F.col("t"), F.col("a"), F.lit(0.0))).first()[0] is right


@pytest.mark.parametrize(("truth", "answer", "right"), [("2000.00", "In 1995 it was 2,400.00", False), ("1995.00", "1995", False), ("1995.00", "1,995.00", True), ("1995", "It was 1995.", True)])
def test_prices_are_no_years(spark, truth, answer, right):
    """A price such as 2000.00 doesn't make the years of an answer count."""
    from tabulon.functions import contexts

    assert spark.createDataFrame([(truth, answer)], "t string, a string").select(contexts.matches(F.col("t"), F.col("a"), F.lit(0.01))).first()[0] is right
