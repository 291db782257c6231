"""Piped tables in plain text: blocks of piped lines, their sections, how well a section answers, and flat entries of grids."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.functions import answers, labels, numbers
from tabulon.operators import grid, hints
from tabulon.session import ship

EMPTY = ("nan", "", "-")  #: fixed values: cells of a section's line


def cells_of(line: Column) -> Column:
    """Trimmed cells between pipes, without the empty ones outside the outer pipes."""
    c = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    first = (F.get(c, F.lit(0)) == "").cast("int")
    last = ((F.element_at(c, -1) == "") & (F.size(c) > first)).cast("int")
    return F.slice(c, first + 1, F.size(c) - first - last)


def sections(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block, section, label, header, start, lines): blocks of three piped lines at least; the first line is the header, a
    line of dashes after it is dropped. A line with a label and almost nothing else begins a section; a block of such lines
    only is one section of all of them. Lines are windowed by document, so no list is longer than a section."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    piped = F.contains("line", F.lit("|")) & (F.trim("line") != "|")
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    b = lines.withColumn("block", F.sum((~piped).cast("int")).over(upto("id"))).where(piped).withColumn("cells", cells_of(F.col("line")))
    whole = Window.partitionBy("id", "block")
    some = F.filter("cells", lambda x: x != "")
    dashes = (F.size(some) > 0) & F.forall(some, lambda x: x.rlike("^-+$"))
    b = b.withColumn("i", F.row_number().over(whole.orderBy("n")) - 1).withColumn("size", F.count("*").over(whole)).withColumn("header", F.first("line").over(upto("id", "block"))).withColumn("dashes", dashes)
    skip = F.max(F.when((F.col("i") == 1) & F.col("dashes"), 1).otherwise(0)).over(whole)
    b = b.withColumn("skip", skip).where((F.col("size") >= 3) & (F.col("i") > F.col("skip")))
    label, n = F.get("cells", F.lit(0)), F.size("cells")
    nothing = F.size(F.filter(F.slice("cells", 2, F.greatest(n - 1, F.lit(0))), lambda x: F.lower(x).isin(*EMPTY)))
    b = b.withColumn("head", (n >= 2) & ~F.lower(label).isin("nan", "") & (nothing >= (n - 1) * 0.8))
    b = b.withColumn("bare", F.max((~F.col("head")).cast("int")).over(whole) == 0).withColumn("label", F.when(F.col("head") & ~F.col("bare"), label))
    b = b.withColumn("section", F.when(F.col("bare"), 0).otherwise(F.sum(F.col("head").cast("int")).over(upto("id", "block"))))
    data = F.when(F.col("bare") & ~F.col("dashes") | ~F.col("head"), F.struct("n", "line"))
    out = b.groupBy("id", "block", "section", "header").agg(F.coalesce(F.max("label"), F.lit("")).alias("label"), F.min("n").alias("start"), F.array_sort(F.collect_list(data)).alias("l"))
    return out.where(F.size("l") > 0).select("id", "block", "section", "label", "header", "start", F.transform("l", lambda x: x["line"]).alias("lines"))


def _split(line: str) -> list[str]:
    out = [c.strip() for c in line.split("|")]
    out = out[1:] if out[0] == "" else out
    return out[:-1] if out and out[-1] == "" else out


#: A number as tables print it: a revision letter before or after, brackets or a sign, separators, a footnote at the end.
_PRINTED = re.compile(r"(?:[rpe]/\s*)?[-+($\s]*((?:\d[\d,]*)?\.?\d[\d,]*\.?)\s*%?\)?\s*[rpe]?(?:\s*\d+/)?")


def _large(cell: str) -> bool:
    found = _PRINTED.fullmatch(cell.strip())
    return bool(found) and float(found[1].replace(",", "")) >= 10


def _months(rows: list[str], year: int) -> int:
    """Rows from 'year-' on that begin with a month, up to the next year."""
    n, inside = 0, False
    for label in rows:
        if f"{year}-" in label:
            n, inside = n + 1, True
        elif inside and re.match(r"\d{4}", label):
            break
        elif inside and label[:3] in labels.MONTH_WORDS and re.match(r"[a-z]{3}\.|" + "|".join(labels.MONTHS), label):
            n += 1
    return n


def score(label: str, headers: list[str], lines: list[str], terms: list[str], years: list[int]) -> float:
    """Weights are fixed values: likeness to the label 40 and to each header 15, a row with a term 5, a year 20, ten of its months
    40, numbers 15 (none: -20), two terms 25 and three 50."""
    rows = [_split(x) for x in lines]
    firsts = [r[0].lower() if r else "" for r in rows]
    out = 0.0
    for weight, least, names in ((40, 0.9, [label] if label else []), (15, 0.85, headers)):
        for name in (x.lower() for x in names):
            for t in terms:
                inside = t in name or (weight == 40 and name in t)
                like = max(SequenceMatcher(None, t, name).ratio(), least if inside else 0.0)
                out += weight * like if like >= 0.5 else 0.0
    out += 5 * sum(any(t in f for t in terms) for f in firsts[:20])
    text = "\n".join(lines)
    out += sum(20 * (str(y) in text) + 40 * (_months(firsts, y) >= 10) for y in years)
    numeric = sum(_large(c) for r in rows[:10] for c in r[1:])
    out += 15 if numeric >= 5 else -20 if numeric == 0 else 0
    seen = " ".join([label, *headers, *lines[:5]]).lower()
    shared = len({t for t in terms if t in seen})
    return out + (50 if shared >= 3 else 25 if shared == 2 else 0)


def scored(found: DataFrame, terms: list[str], years: list[int]) -> DataFrame:
    """Adds score: how well each section answers the terms and what means the same."""
    ship(found.sparkSession)
    asked = list(dict.fromkeys(x for t in terms for x in [t.lower(), *(s for p in hints.phrases(t) for s in hints.synonyms(p))]))

    @pandas_udf("double")
    def rate(label: pd.Series, headers: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([score(a, list(b), list(c), asked, years) for a, b, c in zip(label, headers, lines, strict=True)], dtype=float)

    headers = F.transform(cells_of(F.col("header")), answers.header_parts)
    return found.withColumn("score", rate("label", headers, "lines"))


def flat_entries(g: DataFrame) -> DataFrame:
    """(id, table_no, row_label, column, value, numeric_value) of cells that hold something; dots that lead from a label to its
    values are taken off."""
    key = ["id", "table_no"]
    bare = lambda c: F.trim(F.regexp_replace(c, r"[\s.]*\.{2,}[\s.]*$", ""))
    names = g.where("not is_header_row and col_index = 0").select(*key, "row_index", bare("text").alias("row_label"))
    cells = g.where("not is_header_row and col_index > 0 and text <> ''").join(names, [*key, "row_index"]).join(grid.column_paths(g), [*key, "col_index"])
    return numbers.with_cells(cells.select(*key, "row_label", F.col("col_path").alias("column"), F.col("text").alias("value")), "value").select(*key, "row_label", "column", "value", "numeric_value")


def year_groups(g: DataFrame, issues: DataFrame) -> DataFrame:
    """Tables whose columns repeat in groups over blocks of twelve month rows, each group of a block being a year: (id, block,
    part, first_col, last_col, year), for issues (id, file_year). A table's last year is its issue's; of the last block only as
    many groups count as have ten months with a value. Footnote numbers don't make columns differ."""
    text = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s*\d+/\s*$", ""))
    head = g.where("table_no = 0 and row_index = 0 and col_index > 0").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "text"))), lambda x: text(x["text"])).alias("names"))
    again = F.transform("names", lambda x, i: F.when(F.array_contains(F.slice("names", F.lit(1), i), x), i))
    head = head.where(F.size("names") >= 3).withColumn("size", F.array_min(F.filter(again, lambda x: x.isNotNull()))).where("size is not null and size(names) % size = 0")
    head = head.where(F.forall(F.transform("names", lambda x, i: x == F.get("names", i % F.col("size"))), lambda x: x)).select("id", "size", (F.size("names") / F.col("size")).cast("int").alias("groups"))
    months = g.where("table_no = 0 and not is_header_row and col_index = 0").where(F.rtrim(F.regexp_replace(F.lower(F.trim("text")), r"\.$", "")).isin(*labels.MONTH_WORDS)).select("id", "row_index")
    order = Window.partitionBy("id")
    months = months.withColumn("back", F.row_number().over(order.orderBy(F.desc("row_index")))).withColumn("blocks", F.floor(F.count("*").over(order) / 12).cast("int")).where("back <= 12 and blocks > 0")
    full = g.where("table_no = 0 and col_index > 0").where(~F.lower(F.trim("text")).isin(*EMPTY, "...")).join(months, ["id", "row_index"]).join(head, "id")
    each = full.groupBy("id", "size", "groups", "blocks", F.floor((F.col("col_index") - 1) / F.col("size")).alias("part")).agg(F.countDistinct("row_index").alias("n"))
    t = each.groupBy("id", "size", "groups", "blocks").agg(F.count_if(F.col("n") >= 10).cast("int").alias("active")).where("active > 0").join(issues, "id").where("file_year is not null")
    places = t.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here = F.when(F.col("block") == F.col("blocks") - 1, F.col("active")).otherwise(F.col("groups"))
    places = places.withColumn("part", F.explode(F.sequence(F.lit(0), here - 1)))
    start = F.col("file_year") - ((F.col("blocks") - 1) * F.col("groups") + F.col("active")) + 1
    return places.select("id", (F.col("block") + 1).alias("block"), (F.col("part") + 1).alias("part"), (F.col("part") * F.col("size") + 1).alias("first_col"), ((F.col("part") + 1) * F.col("size")).alias("last_col"), (start + F.col("block") * F.col("groups") + F.col("part")).alias("year"))
