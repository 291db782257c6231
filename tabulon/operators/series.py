"""Price and exchange-rate series: look-ups by date and what is computed with them. Series are parameters, small tables whose
size is checked before they are sent to executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 100_000  # rows of a series up to which it is broadcast: centuries of days

#: A word of a request and the quote currency that it means, in the order of trial; the base is the dollar.
CURRENCY_WORDS = (
    ("JPY", "jpy"), ("YEN", "jpy"), ("JAPAN", "jpy"), ("GBP", "gbp"), ("STERLING", "gbp"), ("POUND", "gbp"), ("CAD", "cad"), ("CANAD", "cad"),
    ("EUR", "eur"), ("INR", "inr"), ("RUPEE", "inr"), ("INDIA", "inr"), ("DEM", "dem"), ("MARK", "dem"), ("CHF", "chf"), ("FRANC", "chf"),
)


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def annual(monthly: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """year, level: the stated annual level where there is one, else the mean of the months to one place."""
    means = monthly.groupBy("year").agg(F.round(F.avg("level"), 1).alias("mean"))
    if stated is None:
        return means.select("year", F.col("mean").alias("level"))
    return means.join(stated.select("year", F.col("level").alias("own")), "year", "full").select("year", F.coalesce("own", "mean").alias("level"))


def price_adjusted(rows: DataFrame, levels: DataFrame, value: str, source: str, target: str) -> DataFrame:
    """Adds factor (to six places) and adjusted (to four): a value of one year at another year's price level; null where a year
    has no level."""
    side = _side(levels)
    at = lambda c, name: side.select(F.col("year").alias(f"_{c}"), F.col("level").alias(name))
    joined = rows.join(at(source, "_from"), F.col(source) == F.col(f"_{source}"), "left").join(at(target, "_to"), F.col(target) == F.col(f"_{target}"), "left")
    factor = F.try_divide("_to", "_from")
    return joined.select(*rows.columns, F.round(factor, 6).alias("factor"), F.round(F.col(value) * factor, 4).alias("adjusted"))


def dollars_of(question: Column) -> Column:
    """The year whose dollars a question asks for, if it speaks of constant or real dollars or of inflation."""
    q = F.lower(question)
    year = F.regexp_extract(q, r"in\s+((?:19|20)\d{2})\s+dollars", 1)
    speaks = q.contains("constant dollar") | q.contains("real dollar") | q.contains("adjusted for inflation")
    return F.when(speaks & (year != ""), year.cast("int"))


def adjusted_by_question(rows: DataFrame, levels: DataFrame, question: str, answer: str, year: str) -> DataFrame:
    """Adds adjusted: the answer in the dollars that the question asks for, to two places; else the answer as it is."""
    asked = rows.withColumn("_asked", dollars_of(F.col(question)))
    side = _side(levels)
    to, since = side.select(F.col("year").alias("_to_year"), F.col("level").alias("_to")), side.select(F.col("year").alias("_from_year"), F.col("level").alias("_from"))
    joined = asked.join(to, F.col("_asked") == F.col("_to_year"), "left").join(since, F.col(year) == F.col("_from_year"), "left")
    return joined.select(*rows.columns, F.coalesce(F.round(F.col(answer) * F.col("_to") / F.col("_from"), 2), F.col(answer)).alias("adjusted"))


def currencies(text: Column) -> Column:
    """The quote currencies that a request may mean, in the order of trial."""
    t = F.upper(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.filter(F.array(*(F.when(t.contains(w), F.lit(c)) for w, c in CURRENCY_WORDS)), lambda x: x.isNotNull()))


def stated_day(text: Column) -> Column:
    """struct(month, day) of 'March 31' and the like; null where a text has none."""
    found = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+(\d{1,2})"
    word, day = (F.regexp_extract(text, found, i) for i in (1, 2))
    month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(word)) + 2) / 3
    return F.when(word != "", F.struct(month.cast("int").alias("month"), day.cast("int").alias("day")))


def exchange_rate(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """Requests (id, text, year, month) -> id, rate. A day in the text wins over the month asked for, January the first stands for
    what is missing; a day without a rate takes that of the first of its month; of several currencies the first that
    has a rate. rates: quote, year, month, day, rate."""
    day = stated_day(F.col("text"))
    wanted = requests.select("id", "year", F.coalesce(day["month"], F.col("month"), F.lit(1)).alias("month"), F.coalesce(day["day"], F.lit(1)).alias("day"), F.posexplode(currencies(F.col("text"))).alias("place", "quote"))
    side = _side(rates.where(F.col("quote").isin(*{c for _, c in CURRENCY_WORDS})))
    found = wanted.join(side.withColumnRenamed("day", "_day"), ["quote", "year", "month"]).where((F.col("_day") == F.col("day")) | (F.col("_day") == 1))
    best = found.groupBy("id").agg(F.min(F.struct("place", (F.col("_day") != F.col("day")).alias("other"), "rate")).alias("b"))
    return requests.select("id").join(best, "id", "left").select("id", F.col("b.rate").alias("rate"))
