"""HTML tables to grids: an Arrow function that honours row and column spans, and column and row paths over its rows.

A cell's text stands at its origin; the cells that its spans extend over are empty, but in column 0 they repeat the
label. Rows of header cells only are header rows. Indents come from the first cell's left padding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID = "table_no int, row_index int, col_index int, text string, is_origin boolean, is_header_row boolean, indent int"


#: Markup of nothing but plain tags of tables and texts: most tables are, and need no parser of everything else.
_TOKEN = r"""<(/?)(table|tr|td|th|b|html|body)(?: (rowspan|colspan)=("[0-9]+"|'[0-9]+'|[0-9]+))?>|([^<&]+)"""
_TOKENS, _PLAIN = re.compile(_TOKEN), re.compile(rf"(?:{_TOKEN})*+")
GRID_ROWS = 20_000  #: rows of a batch that is handed on


class _Cells(HTMLParser):
    """Collects (table, row, [(tag, text, rowspan, colspan, padding)]); nested tables add their text to the outer cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[dict]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
            self.cell = None
        elif self.depth == 1 and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            a = dict(attrs)
            span = lambda k: int(a[k]) if (a.get(k) or "").strip().isdigit() and int(a[k]) > 0 else 1
            pad = re.search(r"padding-left:\s*(\d+)px", a.get("style") or "")
            self.cell = {"head": tag == "th", "text": [], "rows": min(span("rowspan"), 1000), "cols": min(span("colspan"), 1000), "pad": int(pad[1]) if pad else 0}
            self.tables[-1][-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell["text"].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
            self.cell = self.cell if self.depth else None
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell["text"].append(data)

    def read(self, html: str) -> None:
        if not _PLAIN.fullmatch(html):
            self.feed(html)
            self.close()
            return
        for end, tag, name, value, text in _TOKENS.findall(html):
            if text:
                self.handle_data(text)
            elif end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, [(name, value.strip("\"'"))] if name else [])


def grids(html: str | None) -> Iterator[tuple]:
    parser = _Cells()
    parser.read(html or "")
    for t, rows in enumerate(parser.tables):
        if all(cell["rows"] == 1 == cell["cols"] for cells in rows for cell in cells):  # nothing extends over another cell
            width = max((len(cells) for cells in rows), default=0)
            for r, cells in enumerate(rows):
                header, pad = bool(cells) and all([cell["head"] for cell in cells]), min(6, cells[0]["pad"] // 10) if cells else 0
                for c, cell in enumerate(cells):
                    yield t, r, c, " ".join("".join(cell["text"]).split()), True, header, pad
                for c in range(len(cells), width):
                    yield t, r, c, "", False, header, pad
            continue
        taken: dict[tuple[int, int], tuple[str, bool]] = {}
        heads: dict[int, list[bool]] = {}
        indent: dict[int, int] = {}
        for r, cells in enumerate(rows):
            c = 0
            for cell in cells:
                while (r, c) in taken:
                    c += 1
                text = " ".join("".join(cell["text"]).split())
                heads.setdefault(r, []).append(cell["head"])
                if cell is cells[0]:
                    indent[r] = min(6, cell["pad"] // 10)
                for i in range(min(cell["rows"], len(rows) - r)):
                    for j in range(cell["cols"]):
                        own = i == 0 and j == 0
                        taken.setdefault((r + i, c + j), (text if own or (c + j == 0 and j == 0) else "", own))
                c += cell["cols"]
        width = max((c for _, c in taken), default=-1) + 1
        for r in range(len(rows)):
            header = bool(heads.get(r)) and all(heads[r])
            for c in range(width):
                text, origin = taken.get((r, c), ("", False))
                yield t, r, c, text, origin, header, indent.get(r, 0)


def _gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int32())
    names = ["id", *(f.split()[0] for f in GRID.split(", "))]
    for b in batches:
        at: list[int] = []
        rows: list[tuple] = []

        def out(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

        for i, html in enumerate(b.column(1)):
            own = list(grids(html.as_py()))
            rows += own
            at += [i] * len(own)
            if len(rows) >= GRID_ROWS:
                yield out(b, at, rows)
                at, rows = [], []
        yield out(b, at, rows)


def html_grid(spark: SparkSession, pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_no, row_index, col_index, text, is_origin, is_header_row, indent) of every table of every page."""
    from tabulon.session import ship

    ship(spark)
    wanted = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("lower(html) like '%<table%'")
    return wanted.mapInArrow(_gridded, f"id {wanted.schema['id'].dataType.simpleString()}, {GRID}")


def column_paths(grid: DataFrame) -> DataFrame:
    """Paths of the header rows that stand on top: each row's last text to the left or here, equal neighbours once, joined by
    ' > '. Without header rows the first row is the header."""
    key = ["id", "table_no"]
    first_data = F.min(F.when(~F.col("is_header_row"), F.col("row_index"))).over(Window.partitionBy(*key))
    head = grid.withColumn("top", F.coalesce(first_data, F.lit(1 << 30))).where((F.col("row_index") < F.col("top")) | ((F.col("top") == 0) & (F.col("row_index") == 0)))
    left = Window.partitionBy(*key, "row_index").orderBy("col_index").rowsBetween(Window.unboundedPreceding, 0)
    filled = head.withColumn("part", F.last(F.when(F.col("text") != "", F.col("text")), ignorenulls=True).over(left))
    parts = filled.groupBy(*key, "col_index").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("row_index", "part")))), lambda x: x["part"]).alias("p"))
    once = F.filter("p", lambda x, i: (i == 0) | (x != F.get("p", i - 1)))
    return parts.select(*key, "col_index", F.array_join(once, " > ").alias("col_path"), F.coalesce(F.get("p", F.size("p") - 1), F.lit("")).alias("col_leaf"))


def row_entries(grid: DataFrame) -> DataFrame:
    """Labels of data rows, whether a row is a section (a label with a letter and no data), and the path of sections above:
    by indent where rows are indented, else the last section."""
    key = ["id", "table_no"]
    rows = grid.where("not is_header_row").groupBy(*key, "row_index").agg(F.max(F.when(F.col("col_index") == 0, F.col("text"))).alias("label"), F.max("indent").alias("indent"), F.max(F.when((F.col("col_index") > 0) & (F.col("text") != ""), 1).otherwise(0)).alias("has_data"))
    rows = rows.where("label <> ''").withColumn("is_section", ((F.col("has_data") == 0) & F.col("label").rlike(r"\p{L}")).cast("int"))
    # one fold over a table's rows: a section closes those at its level or further in
    stack = "array<struct<indent:int,label:string>>"
    one = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row_index", "label", "indent", "is_section"))).alias("r"))

    def step(acc: Column, r: Column) -> Column:
        section = r["is_section"] == 1
        outer = F.filter(acc["open"], lambda s: s["indent"] < r["indent"])
        above = F.filter(acc["open"], lambda s: (s["indent"] < r["indent"]) | ((r["indent"] == 0) & (s["indent"] == 0) & ~section))
        path = F.array_join(F.concat(F.transform(above, lambda s: s["label"]), F.array(r["label"])), " > ")
        now = F.when(section, F.concat(outer, F.array(F.struct(r["indent"].alias("indent"), r["label"].alias("label"))))).otherwise(acc["open"])
        return F.struct(now.cast(stack).alias("open"), F.concat(acc["paths"], F.array(path)).alias("paths"))

    start = F.struct(F.array().cast(stack).alias("open"), F.array().cast("array<string>").alias("paths"))
    told = one.withColumn("p", F.aggregate("r", start, step)["paths"]).select(*key, F.explode(F.arrays_zip("r", "p")).alias("x"))
    return told.select(*key, "x.r.row_index", F.col("x.r.label").alias("row_leaf"), "x.r.indent", "x.r.is_section", F.col("x.p").alias("row_path"))


def invariants(grid: DataFrame) -> DataFrame:
    """Origins against cells of each table."""
    return grid.groupBy("id", "table_no").agg(F.count_if("is_origin").alias("n_origin_cells"), (F.max("row_index") + 1).alias("n_rows"), (F.max("col_index") + 1).alias("n_cols"), F.count("*").alias("n_cells"))


def rendered(grid: DataFrame) -> DataFrame:
    """A table as lines of cells joined by ' | '."""
    lines = grid.groupBy("id", "table_no", "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "text"))), lambda x: x["text"]), " | ").alias("line"))
    return lines.groupBy("id", "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]), "\n").alias("text"))
