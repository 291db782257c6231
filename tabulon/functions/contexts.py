"""Numbers in their context, as expressions: every number of a text with its place, per cent sign and the words around it, and whether an answer
gives the numbers of the truth. Nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AROUND = 20  #: fixed value: characters of context on either side
NUMBER = r"-?\d+\.?\d*%?"  # fixed value
#: Scale words and letters, the first that is found.
SCALES = (("trillion", r"\btrillions?\b"), ("billion", r"\bbillions?\b|\bb\b"), ("million", r"\bmillions?\b|\bm\b"), ("thousand", r"\bthousands?\b|\bk\b"))
#: Words that go with a number and say nothing of what it is.
UNIT_WORDS = "trillion trillions billion billions million millions thousand thousands hundred hundreds percent percentage".split()
FIRST_YEAR, LAST_YEAR = 1900, 2100  # fixed values


def signed(text: Column) -> Column:
    """The minus sign as a hyphen."""
    return F.replace(text, F.lit("−"), F.lit("-"))


def without_commas(text: Column) -> Column:
    """Commas between groups of three digits go; what follows the decimals of such a number isn't part of it."""
    return F.regexp_replace(signed(text), r"(?<=\d)(?<!,\d{3}\.\d{1,60}),(?=\d{3})", "")


def numbers_in(text: Column) -> Column:
    """array<struct<value, percent, start, context, scale>> of a text's numbers in their order. start counts from 0, in the text without
    commas; context is in lower case, scale the scale word in it.

    What stands between numbers is split off once; places are running sums of lengths."""
    plain = without_commas(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0))
    gaps = F.split(plain, NUMBER, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, n: int, text: string>>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["gap"]) + F.length(x["text"])).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["gap"])).alias("start"), F.length(x["text"]).alias("n"), x["text"].alias("text")))).alias("out"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, t: F.struct(g.alias("gap"), t.alias("text")))
    placed = F.reduce(pairs, zero, step, lambda s: s["out"])

    def told(x: Column) -> Column:
        first = F.greatest(x["start"] - AROUND, F.lit(0))
        context = F.lower(F.substring(plain, first + 1, x["start"] + x["n"] + AROUND - first))
        scale = reduce(lambda c, s: F.when(context.rlike(s[1]), s[0]).otherwise(c), reversed(SCALES), F.lit(None).cast("string"))
        return F.struct(F.rtrim(x["text"], F.lit("%")).cast("double").alias("value"), F.endswith(x["text"], F.lit("%")).alias("percent"), x["start"].alias("start"), context.alias("context"), scale.alias("scale"))

    return F.transform(placed, told)


def values_in(text: Column) -> Column:
    """array<struct<value, year>>: the values of a text's numbers alone, and whether one is written as a year, which 2000.00 isn't."""
    found = F.regexp_extract_all(without_commas(F.coalesce(text, F.lit(""))), F.lit(NUMBER), F.lit(0))
    value = lambda x: F.rtrim(x, F.lit("%")).cast("double")
    return F.transform(found, lambda x: F.struct(value(x).alias("value"), (value(x).between(FIRST_YEAR, LAST_YEAR) & ~x.rlike(r"\.\d")).alias("year")))


def words_of(text: Column) -> Column:
    """What a text says besides numbers and their units; empty where that is less than two characters."""
    t = F.regexp_replace(F.lower(signed(F.coalesce(text, F.lit("")))), NUMBER, "")
    t = F.regexp_replace(F.replace(t, F.lit(","), F.lit("")), r"\b(" + "|".join(UNIT_WORDS) + r")\b", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return F.when(F.length(t) >= 2, t).otherwise("")


def overlaps(truth: Column, answer: Column) -> Column:
    """A truth of numbers only asks for no words; otherwise the words of one have to be among those of the other."""
    t, a = words_of(truth), words_of(answer)
    return (t == "") | ((a != "") & (F.contains(a, t) | F.contains(t, a)))


def matches(truth: Column, answer: Column, tolerance: Column) -> Column:
    """Whether an answer gives the truth: all of its numbers within a relative tolerance and its words; without numbers on either side,
    its text. Years among the answer's numbers don't count unless the truth has years, or, where it is one number, words. Null where either is
    null or empty."""
    t, a = values_in(truth), values_in(answer)
    years_count = F.exists(t, lambda x: x["year"]) | ((F.size(t) <= 1) & (words_of(truth) != ""))
    given = F.filter(a, lambda x: years_count | ~x["year"])
    near = lambda x, y: F.when(x == 0, y == 0).otherwise(F.abs(x - y) <= tolerance * F.abs(x))
    every = F.forall(t, lambda x: F.exists(given, lambda y: near(x["value"], y["value"]))) & overlaps(truth, answer)
    plain = lambda c: F.trim(F.regexp_replace(F.trim(F.trim(F.lower(F.trim(c)), F.lit('"')), F.lit("'")), r"\([^)]*\)", ""))
    text = F.contains(plain(answer), plain(truth))
    empty = (F.coalesce(truth, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == "")
    return F.when(~empty, F.when((F.size(t) > 0) & (F.size(a) > 0), every).otherwise(text))
