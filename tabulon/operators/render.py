"""Tables as text: pipes, a line a column for wide ones, a line a cell under its row's path, and sections of piped text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import labels
from tabulon.operators import grid
from tabulon.sources.ledger import Ledger

WIDE = 8  #: fixed value: columns from which a table is read by columns


def _lines(df: DataFrame, keys: list[str], order: list[str], line: Column, sep: str, out: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["line"]), sep).alias(out))


def row_major(ledger: Ledger, most: int | None = None) -> DataFrame:
    """(table_id, text): 'ROW: path', then 'column = value' for each cell that isn't empty; sections give no lines. With most,
    the first rows of a table only."""
    rows = ledger.rows.where("is_section_header = 0")
    rows = rows.where(F.col("row_index") <= most) if most else rows
    c = ledger.columns.select("table_id", F.col("id").alias("col_id"), "col_index", "col_path")
    x = ledger.cells.where("trim(raw_value) <> ''").select("table_id", "row_id", "col_id", "raw_value").join(c, ["table_id", "col_id"])
    each = _lines(x, ["table_id", "row_id"], ["col_index"], F.concat_ws(" = ", "col_path", "raw_value"), "\n", "cells")
    r = rows.select("table_id", F.col("id").alias("row_id"), "row_index", "row_path").join(each, ["table_id", "row_id"])
    return _lines(r, ["table_id"], ["row_index"], F.concat(F.lit("ROW: "), "row_path", F.lit("\n"), "cells"), "\n", "text")


def readable(g: DataFrame, most: int = 200) -> DataFrame:
    """(id, table_no, vertical, text): piped lines, or for tables of WIDE columns and more each row's label over a line for each of
    its columns, months with their number; at most most data rows."""
    key = ["id", "table_no"]
    g = g.where(F.col("row_index") < most + 1)
    size = g.groupBy(*key).agg((F.max("col_index") + 1 >= WIDE).alias("vertical"))
    paths = grid.column_paths(g).select(*key, "col_index", labels.annotated_month(F.col("col_path")).alias("path"))
    body = g.where("not is_header_row")
    names = body.where("col_index = 0").select(*key, "row_index", F.col("text").alias("name"))
    cells = body.where("col_index > 0 and text <> ''").join(paths, [*key, "col_index"])
    each = _lines(cells, [*key, "row_index"], ["col_index"], F.concat(F.lit("  "), "path", F.lit(": "), "text"), "\n", "cells")
    down = _lines(names.join(each, [*key, "row_index"], "left"), key, ["row_index"], F.concat_ws("\n", "name", "cells"), "\n", "down")
    across = grid.rendered(g)
    return size.join(across, key).join(down, key, "left").select(*key, "vertical", F.when(F.col("vertical"), F.col("down")).otherwise(F.col("text")).alias("text"))
