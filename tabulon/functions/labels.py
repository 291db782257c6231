"""Label and header expressions: slugs, years and months, units, periods, signatures. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month words and their numbers.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Words that are months, and what a year looks like.
MONTH_WORDS = {**{m: i + 1 for i, m in enumerate(MONTHS)}, **{m[:3]: i + 1 for i, m in enumerate(MONTHS)}, "sept": 9}
YEAR = r"\b(1[89]\d{2}|20[0-3]\d)\b"
MONTH = r"\b(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\b"
#: What a header says of its unit, in the order of trial.
UNIT_RULES = (
    (r"\b(in\s+)?millions?\s+of\s+dollars?\b", "millions_usd"),
    (r"\bin\s+million\b", "millions_usd"),
    (r"\b(in\s+)?billions?\s+of\s+dollars?\b", "billions_usd"),
    (r"\bin\s+billion\b", "billions_usd"),
    (r"\b(in\s+)?thousande?s?\s+of\s+dollars?\b", "thousands_usd"),
    (r"\b(in\s+)?thousands?\b", "thousands_usd"),
    (r"\b(in\s+)?millions?\b", "millions_usd"),
    (r"\b(in\s+)?billions?\b", "billions_usd"),
    (r"^\s*\(?dollars?\)?\s*$", "dollars"),
    (r"\bpercent(age)?\b|\bper\s*cent\b|%", "percent"),
    (r"\bindex\b", "index"),
    (r"\bnumber\b", "count"),
)


def slug(label: Column) -> Column:
    """Lower case, footnote numbers and punctuation out, single spaces; null gives ''."""
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    for pattern, to in ((r"\s*\d+/", ""), (r"(?U)[^\w\s\-]", ""), (r"(?U)\s+", " ")):
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def year_of(label: Column) -> Column:
    found = F.regexp_extract(F.coalesce(label, F.lit("")), YEAR, 1)
    return F.when(found != "", found.cast("int"))


def _month_number(word: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in MONTH_WORDS.items() for x in pair)), word)


def month_of(label: Column) -> Column:
    """The first month word anywhere in a label."""
    return _month_number(F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), f"(?i){MONTH}", 1)))


def leading_month(label: Column) -> Column:
    """The month that a label begins with, unless letters go on: 'Mar.' is one, 'Market' isn't."""
    words = "|".join(sorted(MONTH_WORDS, key=len, reverse=True))
    return _month_number(F.regexp_extract(F.lower(F.trim(label)), f"^({words})(?![a-z])", 1))


def loose_month(label: Column) -> Column:
    """The month by the first three letters, whatever follows them."""
    return _month_number(F.substring(F.lower(F.trim(label)), 1, 3))


def annotated_month(label: Column) -> Column:
    m = leading_month(label)
    return F.when(m.isNotNull(), F.concat(label, F.lit(" (month "), m.cast("string"), F.lit(")"))).otherwise(label)


def unit_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, unit in reversed(UNIT_RULES):
        out = F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}"), F.lit(unit)).otherwise(out)
    return out


def period_of(text: Column) -> Column:
    """Fiscal or calendar only where exactly one of them is meant."""
    t = F.lower(F.coalesce(text, F.lit("")))
    fiscal = t.contains("fiscal year") | t.rlike(r"\bfy\b")
    calendar = t.contains("calendar year") | t.contains("calendar mo") | t.contains("cal. yr")
    return F.when(fiscal & ~calendar, "fiscal").when(calendar & ~fiscal, "calendar").otherwise("unknown")


def kind_of(title: Column, section: Column, caption: Column) -> Column:
    return F.when(F.lower(F.concat_ws(" ", title, section, caption)).contains("table of contents"), "toc").otherwise("data")


def signature(title: Column, section: Column, caption: Column) -> Column:
    parts = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (title, section, caption)]
    return F.substring(F.sha1(F.regexp_replace(F.concat_ws("|", *parts), r"\s+", " ")), 1, 16)


def footnote_marker(text: Column) -> Column:
    found = F.regexp_extract(text, r"^\s*(\d+/|\*+|†)", 1)
    return F.when(found != "", found)


def file_period(name: Column) -> Column:
    """struct(year, month) of names that end in _YYYY_MM."""
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(name, r"_(\d{4})_(\d{2})(?:\D|$)", i), F.lit("")), F.lit("9999")).cast("int")
    return F.struct(part(1).alias("year"), part(2).alias("month"))


def years_in(text: Column) -> Column:
    """Sorted years of a question: single ones, decades (1940s), ranges of up to thirty years, and 'between A and B'."""
    single = F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[89]\d{2}|20[0-3]\d)\b")), lambda y: y.cast("int"))
    decade = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[89]\d|20[0-3])0s\b")), lambda d: F.sequence(d.cast("int") * 10, d.cast("int") * 10 + 9)))
    pair = r"(?i)\b(1[89]\d{2}|20[0-3]\d)\s*(?:-|to|through|and)\s*(1[89]\d{2}|20[0-3]\d)\b"
    starts, ends = (F.transform(F.regexp_extract_all(text, F.lit(pair), F.lit(i)), lambda y: y.cast("int")) for i in (1, 2))
    joined = F.flatten(F.zip_with(starts, ends, lambda a, b: F.when((b >= a) & (b - a <= 30), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))))
    return F.array_sort(F.array_distinct(F.concat(single, decade, joined)))


def pages_of(urls: Column) -> Column:
    """Page numbers in a text of URLs, in order."""
    return F.transform(F.regexp_extract_all(urls, F.lit(r"[?&]page=(\d+)")), lambda p: p.cast("int"))


def fiscal_year(year: Column, month: Column) -> Column:
    """Through 1976 July to June, from October 1976 October to September; July to September 1976 belongs to no year."""
    early = F.when(month >= 7, year + 1).otherwise(year)
    late = F.when(month >= 10, year + 1).otherwise(year)
    at = year * 12 + month
    return F.when(at < 1976 * 12 + 7, early).when(at >= 1976 * 12 + 10, late)


def bare_year(label: Column) -> Column:
    """A row of a year as a whole: '1940', 'Fiscal year 1940', 'FY 1940'."""
    return F.trim(label).rlike(r"^(\d{4}|(Fiscal year|FY|Fiscal)\s+\d{4}.*)$")


def aggregate(label: Column) -> Column:
    """A label of a total or a remainder."""
    return F.lower(F.trim(label)).rlike(r"^(total|all other|grand total|subtotal|sub-total)\b|^other ")
