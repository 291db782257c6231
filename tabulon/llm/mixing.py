"""Mixing sources to target weights (operator 6).

Method: a time-varying curriculum. Each source has a weight schedule over training time 0 to 1; the integral of
its schedule is its cumulative token demand. Each document stands at a fixed place of its source's stream; inverting the
demand at that place gives the time, and so the position, at which the document is trained on. Documents are then
range-sorted by position.

Targets: sources share ``share`` times all words by weight; a source's target stops at ``most`` times its own words, and
the excess is shared again by weight among the others until none is above. The schedule of a source moves linearly
from (1 + slope) to (1 - slope) times its mean rate, so the demand by time t is
target * (t + slope * t * (1 - t)), whose inverse is a root of a quadratic.

A source's stream is its documents in the order of a hash of their id, repeated; the mix takes its first ``target``
words. So each document is taken floor(target / size) or one more times, at most ``most`` times, a source's taken
words equal its target rounded down, and reruns agree.

Scale: hot sources aren't gathered: the stream order is a hash, so ranges of the hash, a fixed number, cut every source into
even blocks; places are sums over blocks plus sums inside a block. The table of sources goes through one task: a row a
source, so millions of sources would be its bound.

Defined results: null or blank texts have size 0 and take none; the null source is one source, last; sources by code
point; repeated rows are documents each (ties in the stream order are between equal ids and go by size); no words at
all: all targets 0; an empty table: no rows; only doc_id, text and source are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.llm.util import Scratch, running_start, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Slopes of the schedules, repeating by source: early, even, late.
SLOPES = (0.8, 0.0, -0.8)
RANGE_BITS = 12  # a source is cut into 2**12 ranges of its hash; the order of a stream doesn't depend on it
BROADCAST_ROWS = 1_000_000  # plans of at most this many rows (32 MB) are sent to all executors


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...], slopes: tuple[float, ...]) -> DataFrame:
    """source, source_size, slope, target of a table (source, source_size), one row a source.

    The capped sources are those whose cap lies lowest in relation to their weight, so one running sum over
    sources in that order finds the level at which the rest share: target = min(cap, level * weight)."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = F.row_number().over(order) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int") + 1)
    named = sizes.select("source", F.col("source_size").cast("double").alias("size"), pick(weights).alias("weight"), pick(slopes).alias("slope"))
    level = Window.orderBy(F.col("size") / F.col("weight"), F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    total = F.sum("size").over(all_rows) * share
    left = total - F.coalesce(F.sum(F.col("size") * most).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    own_level = left / weight_left
    capped = F.col("size") * most <= own_level * F.col("weight")
    marked = named.select("*", own_level.alias("level"), capped.alias("capped"))
    # in this order capped sources come first, so the level of the first that isn't holds for all that follow
    free_level = F.min(F.when(~F.col("capped"), F.struct(F.col("size") / F.col("weight"), F.col("level")))).over(all_rows)["level"]
    target = F.when(F.col("capped"), F.col("size") * most).otherwise(free_level * F.col("weight"))
    return marked.select("source", F.col("size").cast("long").alias("source_size"), "slope", F.coalesce(target, F.lit(0.0)).alias("target"))


def demand_time(place: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's cumulative demand reaches a place of its stream."""
    x = F.when(target > 0, F.least(place / target, F.lit(1.0))).otherwise(F.lit(0.0))
    b = slope + 1.0
    root = (b - F.sqrt(F.greatest(b * b - 4.0 * slope * x, F.lit(0.0)))) / (2.0 * slope)
    return F.when(slope == 0, x).otherwise(root)


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, keep: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies, position (0 to 1, null where none is
    taken), positions (of each copy) and the columns in keep, which should be small: they are shuffled with the sizes."""
    spark = docs.sparkSession
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")]
    rows = docs.select(*cols, *(F.col(c).alias(f"keep_{c}") for c in keep or []))
    rows = rows.withColumn("h", F.xxhash64(F.lit("mix"), "doc_id")).withColumn("block", F.shiftright("h", 64 - RANGE_BITS).cast("int"))
    rows = Scratch(spark, "mix").write(rows, "sized")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights, slopes)
    placed = running_start(rows, ["h", "doc_id", "size"], "size", "block", "place", ["source"])
    joined = placed.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    goal = F.floor(F.col("target") + 1e-6)
    through = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), goal - F.lit(k) * F.col("source_size") - F.col("place")))
    passes = [through(k).cast("long") for k in range(int(most))]
    taken = passes[0]
    for p in passes[1:]:
        taken = taken + p
    copies = sum((F.when(p > 0, 1).otherwise(0) for p in passes[1:]), F.when(passes[0] > 0, 1).otherwise(0))
    # each pass over a source asks for places of its own, further on in the source's demand
    at = [F.when(p > 0, demand_time((F.col("place") + k * F.col("source_size")).cast("double"), F.col("target"), F.col("slope"))) for k, p in enumerate(passes)]
    positions = F.filter(F.array(*at), lambda x: x.isNotNull())
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), copies.cast("int").alias("copies"), at[0].alias("position"), positions.alias("positions"), *(F.col(f"keep_{c}").alias(c) for c in keep or []))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of each, range-sorted by their first training position."""
    return mix(table(spark, sf_dir, "documents")).drop("positions").repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
