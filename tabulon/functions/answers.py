"""Answers as text: tags, numbers as people write them, unit and period mistakes, checks of submissions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import labels, numbers


def tagged(text: Column) -> Column:
    """What stands between final-answer tags; the text itself where there are none; null where the tags are empty."""
    found = F.regexp_extract(text, r"(?is)<final_answer>(.*?)</final_answer>", 1)
    has = text.rlike(r"(?is)<final_answer>.*?</final_answer>")
    return F.when(has, F.nullif(F.regexp_replace(found, r"^\s+|\s+$", ""), F.lit(""))).otherwise(text)


def last_line(text: Column) -> Column:
    """What follows ANSWER: (in any case) on the last line that begins with it; else the last line."""
    lines = F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    marked = F.filter(lines, lambda x: F.startswith(F.upper(x), F.lit("ANSWER:")))
    return F.when(F.size(marked) > 0, F.regexp_replace(F.substring(F.try_element_at(marked, F.lit(-1)), 8, 1 << 30), r"^\s+", "")).otherwise(F.try_element_at(lines, F.lit(-1)))


def written(value: Column) -> Column:
    """Commas between thousands; near-integers without decimals, others with three at most and no zeros at the end."""
    whole = F.abs(value - F.round(value)) < 1e-9
    part = F.regexp_replace(F.format_number(value, 3), r"\.?0+$", "")
    return F.when(whole, F.format_number(F.round(value), 0)).otherwise(part)


def unit_fixed(answer: Column, source: Column, target: Column) -> Column:
    """The answer in the target's unit, written out; null where units agree, one is unknown, or it is no number."""
    s, t, value = numbers.multiplier(source), numbers.multiplier(target), numbers.answer_number(answer)
    return F.when((source != target) & s.isNotNull() & t.isNotNull(), written(value * (s / t)))


def period_confused(period: Column, names: Column) -> Column:
    """Whether a calendar question got labels of fiscal years only, or the other way round. names: the labels, an array."""
    text = F.array_join(names, " ")
    fiscal, calendar = text.rlike(r"(?i)\bfiscal\s+year\b|\bfy\b|\bfy\s*\d{4}"), text.rlike(r"(?i)\bcalendar\s+year\b|\bcy\b|\bcy\s*\d{4}")
    p = F.lower(period)
    wrong = (p.isin("calendar", "cy", "calendar_year") & fiscal & ~calendar) | (p.isin("fiscal", "fy", "fiscal_year") & calendar & ~fiscal)
    return F.coalesce(wrong & (F.size(names) > 0), F.lit(False))


def recomputed(values: Column, operation: Column) -> Column:
    """An operation over an array of values; null where it isn't one of these or can't be computed."""
    n, total = F.size(values), F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    a, b = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    logs = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.ln(x))
    pair = n == 2
    return (
        F.when(n == 0, None).when(operation == "sum", total).when(operation.isin("mean", "average"), total / n)
        .when((operation == "geometric_mean") & F.forall(values, lambda x: x > 0), F.exp(logs / n))
        .when((operation == "percent_change") & pair & (a != 0), (b - a) / F.abs(a) * 100)
        .when((operation == "difference") & pair, b - a).when((operation == "ratio") & pair & (b != 0), a / b)
    )


def submission_fails(answer: Column, values: Column, operation: Column) -> Column:
    """Whether a submitted number differs from what its own values give by over a hundredth, and over 0.01."""
    got, want = F.translate(answer, ",%", "").try_cast("double"), recomputed(values, operation)
    return F.coalesce(F.abs(want - got) > F.greatest(F.abs(want) * 0.01, F.lit(0.01)), F.lit(False))


def header_parts(path: Column) -> Column:
    """A column path without the parts that a table reader makes up for empty header cells."""
    parts = F.filter(F.split(path, " > "), lambda p: ~p.rlike(r"^Unnamed: \d+(_level_\d+)?$") & (F.lower(p) != "nan") & (F.trim(p) != ""))
    return F.array_join(parts, " > ")


def month_cycle(names: Column) -> Column:
    """Whether labels begin with three or more months in a row of the year's cycle, wherever it begins."""
    m = F.transform(names, labels.leading_month)
    end = F.coalesce(F.nullif(F.array_position(F.transform(m, lambda x: x.isNull()), True), F.lit(0).cast("long")) - 1, F.size(m).cast("long"))
    run = F.slice(m, F.lit(1), F.greatest(end.cast("int"), F.lit(0)))
    steps = F.zip_with(F.slice(run, F.lit(2), F.greatest(F.size(run) - 1, F.lit(0))), run, lambda b, a: b.isNull() | (b == a % 12 + 1))
    return (end >= 3) & F.forall(steps, lambda ok: ok)


def chosen_hint(hint: Column, keyword: Column, label: Column) -> Column:
    """The first of hint, keyword and label that says something, 120 characters at most."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.left(F.coalesce(some(hint), some(keyword), some(label)), F.lit(120))


def year_total(label: Column) -> Column:
    """A row of a whole year: a bare year, or a fiscal year by name."""
    t = F.trim(label)
    return t.rlike(r"^\d{4}$") | t.rlike(r"(?i)^(fiscal\s+year|fy|fiscal)\s+\d{4}")


def month_row(label: Column) -> Column:
    """A row of a month: its label begins with a month's name, perhaps after a year."""
    return labels.leading_month(F.regexp_replace(F.trim(label), r"^\d{4}\s*-\s*", "")).isNotNull()


def fits_granularity(label: Column, granularity: Column) -> Column:
    """Whole years don't belong to all months of a year, nor months to years; every other row does."""
    return F.when(granularity == "monthly_all", ~year_total(label)).when(granularity.isin("annual", "multi_year_annual"), ~month_row(label)).otherwise(F.lit(True))
