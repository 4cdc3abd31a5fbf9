"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]:
1 + a (2t - 1), with a slope a of its own.  Its integral t + a (t^2 - t), times
the source's target, is the source's cumulative token demand.  A source's
documents stand in a fixed hashed order, repeated; a document's place in that
sequence of words is put through the inverse of the demand, which gives its
training position.  The result is sorted by position in ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, words_of

WEIGHTS = (1, 2, 3)
#: Slope of the schedule of sources of each weight: light ones early, heavy ones late.
SLOPES = {1: -0.5, 2: 0.0, 3: 0.5}
MOST_REPEATS = 3
#: Rows of one source that are ordered in one task, about.
BUCKET_ROWS = 100_000
_KEYS = ["s_null", "s_key"]


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``: 0, 1, ... by code point of the source, null last, without sorting all in one task."""
    parts = sources.repartitionByRange("s_null", "s_key").withColumn("part", F.spark_partition_id())
    parts = materialise(parts, "ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("part").orderBy("s_null", "s_key")) - 1
    return parts.withColumn("own", own).join(F.broadcast(sizes), "part").withColumn("rank", F.col("own") + F.col("before")).drop("part", "own", "before")


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target (words) to (s_null, s_key, source_size)."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = materialise(_ranked(sources).withColumn("weight", weight).withColumn("most", MOST_REPEATS * F.col("source_size")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        # Sources that this level takes beyond their most stop there; the others share the rest.
        capped = F.col("weight") * F.lit(level) > F.col("most")
        rest, weights = ranked.agg(F.lit(total) - F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0)), F.sum(F.when(~capped, F.col("weight")))).first()
        now = rest / weights if weights else level
        if now == level:
            break
        level = now
    target = F.when(F.col("weight") * F.lit(level) > F.col("most"), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target).drop("most", "rank")


def demand(t: Column, slope: Column) -> Column:
    """Share of a source's tokens that its schedule asks for up to time t."""
    return t + slope * (t * t - t)


def inverse_demand(share: Column, slope: Column) -> Column:
    """The time at which ``demand`` reaches ``share``."""
    b = 1 - slope
    curved = (F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope)
    return F.when(slope == 0, share).otherwise(curved)


def plan(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, positions (one for each copy) and, on request, all columns as ``__doc``.

    Needs doc_id, text and source; other columns are ignored.  Null texts have
    size 0, a null source is a source of its own, after all others.  Documents
    of size 0 take no words, yet have a position if their place is reached.
    Repeated rows are documents of their own.  Rows are never joined by doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        *([F.struct(*[docs[c] for c in docs.columns]).alias("__doc")] if carry else []),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("source").isNull().alias("s_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s_key"),
        F.size(words_of(text)).cast("long").alias("size"),
        F.xxhash64("doc_id", text).alias("h"),
    )
    if not carry:
        rows = materialise(rows, "sizes")
    fine = F.pmod(F.shiftright("h", 20), F.lit(1 << 20))
    counts = rows.agg(F.count("*")).first()[0] if not carry else docs.count()
    buckets = max(256, counts // BUCKET_ROWS)
    rows = rows.withColumn("bucket", fine % buckets)
    sums = materialise(rows.groupBy(*_KEYS, "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    before = F.sum("bucket_size").over(Window.partitionBy(*_KEYS).orderBy("bucket")) - F.col("bucket_size")
    targets = source_targets(sums.groupBy(*_KEYS).agg(F.sum("bucket_size").alias("source_size")))
    slope = F.element_at(F.create_map(*[F.lit(x) for k, v in SLOPES.items() for x in (k, v)]), F.col("weight").cast("int"))
    info = sums.select(*_KEYS, "bucket", before.alias("before")).join(targets, _KEYS).withColumn("slope", slope)
    info = materialise(info.select(*_KEYS, "bucket", "before", "source_size", "target", "slope"), "offsets")

    order = Window.partitionBy(*_KEYS, "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(order)).join(info, [*_KEYS, "bucket"])
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    epoch = lambda j: j * F.col("source_size") + middle
    placed = placed.withColumn("at", F.array(*[epoch(j) for j in range(MOST_REPEATS)])).withColumn("at", F.filter("at", lambda x: x < F.col("target")))
    positions = F.transform("at", lambda x: inverse_demand(x / F.col("target"), F.col("slope")))
    taken = (F.size("at") * F.col("size")).cast("long")
    keep = ["__doc"] if carry else []
    return placed.select(*keep, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), positions.alias("positions"))


def mixture_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position), sorted by the position of the first copy; documents left out come last."""
    out = plan(docs).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it, with all their columns."""
    copies = plan(docs, carry=True).select("__doc", F.explode("positions").alias("position"))
    return copies.repartitionByRange("position").sortWithinPartitions("position").select("__doc.*")
