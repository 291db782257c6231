"""A guarded SQL endpoint and an evaluator of arithmetic over named values: neither runs code of its input."""

from __future__ import annotations

import ast
import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORBIDDEN = r"\b(insert|update|delete|drop|create|alter|replace|truncate|merge|attach|pragma|load|refresh|cache|uncache|set|reset|add|call|use|grant|revoke)\b"
MOST_ROWS, MOST_CHARS = 200, 200


class Refused(ValueError):
    pass


def checked(text: str) -> str:
    """The statement if it is a single SELECT or WITH without words that change anything; strings and comments aside."""
    s = text.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'", "''", re.sub(r"--[^\n]*|/\*.*?\*/", " ", s, flags=re.S))
    if not re.match(r"(?i)(select|with)\b", bare):
        raise Refused("only SELECT or WITH")
    if ";" in bare:
        raise Refused("one statement only")
    if m := re.search(FORBIDDEN, bare, re.I):
        raise Refused(f"{m[1].lower()} isn't allowed")
    return s


def run_sql(spark: SparkSession, text: str, most: int = MOST_ROWS) -> DataFrame:
    """At most so many rows, long strings cut. The analysed plan must be a query: commands have no place in it."""
    df = spark.sql(checked(text))
    if "Command" in df._jdf.queryExecution().analyzed().getClass().getSimpleName():
        raise Refused("not a query")
    cut = [F.left(f"`{c}`", F.lit(MOST_CHARS)).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes]
    return df.select(*cut).limit(min(most, MOST_ROWS))


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Pow: lambda a, b: F.pow(a, b), ast.Div: lambda a, b: F.try_divide(a, b), ast.Mod: operator.mod}
_CALLS = {
    "abs": lambda a: F.abs(a[0]), "min": lambda a: F.least(*a), "max": lambda a: F.greatest(*a), "sum": lambda a: reduce(operator.add, a), "len": lambda a: F.lit(len(a)), "round": lambda a: F.round(a[0]), "float": lambda a: a[0].cast("double"), "int": lambda a: a[0].cast("long"), "pow": lambda a: F.pow(a[0], a[1]),
    "sqrt": lambda a: F.sqrt(a[0]), "ln": lambda a: F.ln(a[0]), "log10": lambda a: F.log10(a[0]), "exp": lambda a: F.exp(a[0]),
}


def expression(text: str, names: set[str]) -> Column:
    """Arithmetic over columns and numbers, and calls of a few functions; a list is the arguments of a call. Division by zero is
    null."""

    def go(n: ast.AST) -> Column:
        match n:
            case ast.Expression(body=b):
                return go(b)
            case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
                return F.lit(float(v))
            case ast.Name(id=x) if x in names:
                return F.col(f"`{x}`").cast("double")
            case ast.BinOp(left=a, op=o, right=b) if type(o) in _BINARY:
                return _BINARY[type(o)](go(a), go(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -go(a)
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return go(a)
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in _CALLS and args:
                flat = [e for a in args for e in (a.elts if isinstance(a, (ast.List, ast.Tuple)) else [a])]
                return _CALLS[f]([go(a) for a in flat])
        raise Refused(f"not allowed: {ast.dump(n)[:60]}")

    try:
        return go(ast.parse(text, mode="eval"))
    except SyntaxError as e:
        raise Refused(str(e)) from e
