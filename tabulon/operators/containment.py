"""Containment joins: which labels hold a hint's tokens, or its text. Neither side is compared with the whole other: a label that
holds a hint holds its rarest gram, so that alone is joined on, and what meets is looked at. Where some tokens may be
missing, one of the missing + 1 rarest is there.

Hints and labels are distinct texts; what carries them is joined to the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators import search


def met(hints: DataFrame, labels: DataFrame, grams: str, picks: Column | int = 1) -> DataFrame:
    """Rows of hints and of labels that share one of the hint's rarest grams, once for each that they share. Both have grams,
    distinct ones; picks: how many of the rarest count. The columns of a hint travel once a pick, those of a label once a gram."""
    posted = labels.select(*labels.columns, F.explode(grams).alias("_gram")).drop(grams).withColumnRenamed("_gram", "_g")
    often = posted.groupBy("_g").agg(F.count("*").alias("_often"))
    each = hints.select("hint", F.explode(grams).alias("_g")).join(often, "_g", "left")
    ranked = each.groupBy("hint").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_often", F.lit(0)).alias("_often"), "_g"))).alias("_ranked"))  # a hint's own grams
    picked = hints.join(ranked, "hint").withColumn("_g", F.explode(F.slice("_ranked", F.lit(1), picks if isinstance(picks, Column) else F.lit(picks)))).withColumn("_g", F.col("_g._g"))
    return picked.drop("_ranked", grams).join(posted, "_g").drop("_g")


def by_tokens(hints: DataFrame, labels: DataFrame, missing: Column | None = None) -> DataFrame:
    """(hint, label, n_tokens, n_shared): labels that have all distinct tokens of a hint, or all but some, a number that may depend on
    n_tokens. Hints and labels have a column of that name; hints without tokens are in nothing."""
    h = hints.select("hint").distinct().withColumn("own", F.array_distinct(search.tokens(F.col("hint")))).withColumn("n_tokens", F.size("own")).where("n_tokens > 0")
    lacks = F.least(missing, F.col("n_tokens") - 1) if missing is not None else F.lit(0)
    h = h.withColumn("lacks", lacks.cast("int")).withColumn("grams", F.col("own"))
    labels = labels.select("label").distinct().withColumn("theirs", F.array_distinct(search.tokens(F.col("label")))).withColumn("grams", F.col("theirs"))
    pairs = met(h, labels, "grams", F.col("lacks") + 1).withColumn("n_shared", F.size(F.array_intersect("own", "theirs")))
    return pairs.where(F.col("n_shared") >= F.col("n_tokens") - F.col("lacks")).select("hint", "label", "n_tokens", "n_shared").distinct()


def trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def by_text(hints: DataFrame, labels: DataFrame) -> DataFrame:
    """(hint, label): labels that hold a hint of three characters or more as it stands."""
    of = lambda df, c: df.select(c).distinct().where(F.length(c) >= 3).withColumn("grams", trigrams(F.col(c)))
    return met(of(hints, "hint"), of(labels, "label"), "grams").where(F.contains("label", "hint")).select("hint", "label").distinct()


#: Footnote marks before a slash, fixed values.
_MARKS = r"(?i)\b[1-9]\s*/|\b[rpe]\s*/"


def plain(text: Column) -> Column:
    """Lower case, without footnote marks and punctuation, single spaces."""
    out = F.regexp_replace(F.lower(text), _MARKS, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def named(hints: DataFrame, labels: DataFrame) -> DataFrame:
    """(hint, label) of plain texts: a label holds the hint as it stands, or all its words of three letters or more."""
    long = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) >= 3)
    h = hints.select("hint").distinct().withColumn("own", F.array_distinct(long(F.col("hint")))).where(F.size("own") > 0).withColumn("grams", F.col("own"))
    theirs = labels.select("label").distinct().withColumn("theirs", F.array_distinct(long(F.col("label")))).withColumn("grams", F.col("theirs"))
    tokens = met(h, theirs, "grams").where(F.size(F.array_except("own", "theirs")) == 0).select("hint", "label")
    return tokens.union(by_text(h, labels)).distinct()


def validated(specs: DataFrame, scope: DataFrame, rows: DataFrame, columns: DataFrame, coverage: DataFrame) -> DataFrame:
    """uid, request, code of each spec against the tables it is about: OK, COHORT, EMPTY, YEAR_MISS, ROW_MISS or COL_MISS, the first
    that holds in the order that a spec is looked at.

    specs: uid, request, source, cohort, label, row_hint, alternatives, column_hint, years; scope: uid, table_id; rows, columns: table_id,
    label; coverage: table_id, year. A spec's hints are held against the labels of its own tables only, by way of pairs of distinct
    hints and labels."""
    s = specs.withColumn("_rows", F.filter(F.transform(F.concat(F.array("row_hint"), F.coalesce("alternatives", F.array())), plain), lambda h: F.coalesce(h, F.lit("")) != "")).withColumn("_column", plain(F.col("column_hint")))
    keys = ["uid", "request"]
    scope = scope.select("uid", "table_id").distinct()

    def found(asked: DataFrame, labels: DataFrame, out: str) -> DataFrame:
        own = labels.select("table_id", plain(F.col("label")).alias("label")).distinct()
        here = scope.join(own, "table_id").select("uid", "label").distinct()
        pairs = named(asked, own)
        return asked.join(pairs, "hint").join(here, ["uid", "label"]).select(*keys).distinct().withColumn(out, F.lit(True))

    row_ok = found(s.select(*keys, F.explode("_rows").alias("hint")), rows, "row_ok")
    column_ok = found(s.where("_column <> ''").select(*keys, F.col("_column").alias("hint")), columns, "column_ok")
    covered = scope.join(coverage, "table_id").select("uid", "year").distinct()
    year_ok = s.select(*keys, F.explode("years").alias("year")).join(covered, ["uid", "year"]).select(*keys).distinct().withColumn("year_ok", F.lit(True))
    j = s.join(row_ok, keys, "left").join(column_ok, keys, "left").join(year_ok, keys, "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    code = (
        F.when(F.coalesce("source", F.lit("corpus")) != "corpus", "OK").when(F.coalesce("cohort", F.lit(False)), "COHORT").when(blank("row_hint") & blank("column_hint") & blank("label"), "EMPTY")
        .when((F.coalesce(F.size("years"), F.lit(0)) > 0) & F.col("year_ok").isNull(), "YEAR_MISS").when(~blank("row_hint") & F.col("row_ok").isNull(), "ROW_MISS").when(~blank("column_hint") & F.col("column_ok").isNull(), "COL_MISS").otherwise("OK")
    )
    return j.select(*keys, code.alias("code"))
