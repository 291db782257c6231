"""Numbers in text, units, price levels. Built-in functions only; the parsers differ on purpose and aren't merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that hold nothing.
MISSING = ("", "-", "—", "–", "...", "....", ".....", "nan", "na", "n.a.", "n/a", "(x)", "x")
#: Units and what one of them is worth.
MULTIPLIERS = {"thousands": 1e3, "millions": 1e6, "billions": 1e9, "percent": 1.0}
PLAIN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def as_double(text: Column) -> Column:
    """A plain decimal as a double, else null: casts alone would take '12d'."""
    return F.when(text.rlike(PLAIN), text.try_cast("double"))


def is_missing(text: Column) -> Column:
    return F.lower(text).isin(*MISSING)


def with_cells(df: DataFrame, raw: str) -> DataFrame:
    """Adds numeric_value, is_missing, is_zero, is_percent, has_footnote, is_revised, is_preliminary, is_estimated and
    parse_status of a cell's text. Each step takes a mark off and is a projection of its own, so the next one's
    expressions stay small."""
    c, own = F.col, df.columns
    early = c("_s").isNull() | is_missing(c("_s"))

    def has(name: str, *marks: str) -> Column:
        """A look for plain characters, which most cells don't have, saves a pattern's run."""
        return reduce(lambda x, y: x | y, (F.contains(c(name), F.lit(m)) for m in marks))

    test = lambda name, pattern, *marks: has(name, *marks) & c(name).rlike(pattern)
    without = lambda name, pattern, to, *marks: F.when(has(name, *marks), F.trim(F.regexp_replace(name, pattern, to))).otherwise(c(name))
    steps = [
        {"_s": F.trim(raw)},
        {"_tail": test("_s", r"(\d/|\s\d{1,2}/|\*+|†)\s*$", "/", "*", "†"), "_a": without("_s", r"(\s+\d{1,2}/|\d/|\s*\*+|\s*†)\s*$", "", "/", "*", "†")},
        {"_head": test("_a", r"^\s*\d+/", "/") & ~c("_a").rlike(r"^\s*\d+/\d+\s*$")},
        {"_b": F.when(c("_head"), F.trim(F.regexp_replace("_a", r"^\s*\d+/\s*", ""))).otherwise(c("_a"))},
        {"_revised": test("_b", r"(\br/|\sr)\s*$", "r"), "_c": without("_b", r"(\s*\br/|\s+r)\s*$", "", "r")},
        {"_preliminary": test("_c", r"(\bp/|\sp)\s*$", "p"), "_d": without("_c", r"(\s*\bp/|\s+p)\s*$", "", "p")},
        {"_estimated": test("_d", r"\be/\s*$", "e/"), "_e": without("_d", r"\s*\be/\s*$", "", "e/")},
        {f"_said_{w}": test("_e", rf"(?i)\(\s*{w}d?\s*\)", "(") for w in ("revised", "preliminary", "estimate")} | {"_f": without("_e", r"(?i)\s*\(\s*(revised|preliminary|estimated|estimate)\s*\)\s*", " ", "(")},
        {"_low": F.lower("_f")},
        {"_g": F.when(has("_low", "illion", "thousand"), F.trim(F.regexp_replace("_f", r"(?i)\b(million|billion|thousand)s?\b", ""))).otherwise(c("_f"))},
        {"_percent": c("_g").endswith("%"), "_h": without("_g", "%$", "", "%")},
        {"_negative": c("_h").startswith("(") & c("_h").endswith(")") & (F.length("_h") > 1)},
        {"_body": F.when(c("_negative"), F.trim(F.regexp_replace("_h", r"^\(|\)$", ""))).otherwise(c("_h"))},
        {"_cleaned": F.translate("_body", ",$ ", "")},
        {"_size": F.coalesce(F.when(has("_body", "/"), F.coalesce(_mixed(c("_body")), _fraction(c("_body")))), as_double(c("_cleaned"))), "_nothing": F.coalesce(early | is_missing(c("_h")) | is_missing(c("_cleaned")), F.lit(True))},
        {"numeric_value": F.when(~c("_nothing"), F.when(c("_negative"), -c("_size")).otherwise(c("_size")))},
    ]
    for s in steps:
        df = df.withColumns(s)
    flag = lambda x: F.when(early, 0).otherwise(F.coalesce(x, F.lit(False)).cast("int"))
    more = F.regexp_count("_s", F.lit(r"\p{L}")) > F.regexp_count("_s", F.lit(r"\d"))
    status = F.when(c("_nothing"), "missing").when(c("numeric_value").isNotNull(), "ok").when(more, "text").otherwise("unparseable")
    return df.select(
        *own, "numeric_value", c("_nothing").cast("int").alias("is_missing"), F.coalesce((c("numeric_value") == 0).cast("int"), F.lit(0)).alias("is_zero"), flag(c("_percent")).alias("is_percent"), flag(c("_tail") | c("_head")).alias("has_footnote"),
        flag(c("_revised") | c("_said_revised")).alias("is_revised"), flag(c("_preliminary") | c("_said_preliminary")).alias("is_preliminary"), flag(c("_estimated") | c("_said_estimate")).alias("is_estimated"), status.alias("parse_status"),
    )


def _mixed(body: Column) -> Column:
    part = lambda i: as_double(F.replace(F.regexp_extract(body, r"^\s*([\d,]+)\s+(\d+)/(\d+)\s*$", i), F.lit(","), F.lit("")))
    return part(1) + F.try_divide(part(2), part(3))


def _fraction(body: Column) -> Column:
    part = lambda i: as_double(F.regexp_extract(body, r"^\s*(\d+)/(\d+)\s*$", i))
    return F.try_divide(part(1), part(2))


def clean_value(text: Column) -> Column:
    """Numbers as tables print them: footnotes, revision letters, brackets for minus, separators."""
    s = F.regexp_replace(F.trim(text), r"\d+/", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"^[rpe]/", ""), r"[rpe]$", ""))
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    return as_double(F.translate(s, ",$%+ ", ""))


def loose_number(text: Column) -> Column:
    s = F.lower(F.trim(text))
    s = F.translate(F.regexp_replace(s, r"[a-z0-9]+/", ""), "*,$% ", "")
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    return F.when(~is_missing(s), as_double(s))


def answer_number(text: Column) -> Column:
    """A stated answer: a scale word at its end doesn't scale it."""
    s = F.regexp_replace(F.lower(F.trim(text)), r"\s*(million|billion|thousand|trillion|percent)s?\s*$", "")
    return as_double(F.translate(s, ",$% ", ""))


def parse_unit(text: Column) -> Column:
    t = F.lower(F.trim(text))
    out = F.lit(None).cast("string")
    for word, unit in reversed((("billion", "billions"), ("million", "millions"), ("thousand", "thousands"), ("percent", "percent"), ("%", "percent"))):
        out = F.when(t.contains(word), unit).otherwise(out)
    return F.when(t != "", out)


def multiplier(unit: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in MULTIPLIERS.items() for x in pair)), unit)


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """value in target units. No source or an unknown unit: unchanged; no target: raw dollars for dollar scales. Percent and
    dollar scales aren't converted into one another."""
    s, t = multiplier(source), multiplier(target)
    scale = source.isin("thousands", "millions", "billions")
    mixed_up = (source == "percent") != (target == "percent")
    return F.when(source.isNull() | s.isNull() | (source == target), value).when(target.isNull(), F.when(scale, value * s).otherwise(value)).when(t.isNull() | mixed_up, value).otherwise(value * (s / t))


def adjusted(value: Column, base: Column, target: Column) -> Column:
    """A value at the target year's price level."""
    return F.try_divide(value * target, base)


def close_to(a: Column, b: Column) -> Column:
    """Equal up to a ten-thousandth part or a millionth."""
    return (F.abs(a - b) <= F.abs(b) * 1e-4) | (F.abs(a - b) <= 1e-6)


def error_class(expected: Column, got: Column, text: Column) -> Column:
    """What kind of mistake an answer is, by its ratio to the truth and by period words."""
    r = F.abs(F.try_divide(got, expected))
    powers = r.between(900, 1100) | r.between(0.0009, 0.0011) | r.between(9e5, 1.1e6) | r.between(9e-7, 1.1e-6)
    period = F.lower(F.coalesce(text, F.lit(""))).rlike(r"fiscal|calendar|\bfy\b|\bcy\b")
    return F.when(expected.isNull() | got.isNull(), "no_value").when(close_to(got, expected), "right").when(powers, "unit_error").when(period, "period_error").when((r > 1.5) | (r < 0.67), "wrong_cell").otherwise("near_miss")
