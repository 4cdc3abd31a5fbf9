"""Sharding by extendible hashing.

Documents have a 64-bit hash.  A bucket of depth d is the set of hashes with
the same d leading bits; while it holds more bytes than the limit it is split
on its next bit, and only it.  The directory maps the leading bits of the
deepest level to buckets.

Buckets are found from below: one histogram of bytes by leading bits, summed
pairwise level by level.  A leaf is a bucket that fits and whose parent does
not.  Buckets that are too large even at the histogram's level are looked at
again, alone, with more bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .shared import counted_join, materialise, shared_folder

MAX_BYTES = 32 << 20
#: A directory of so many rows at most is broadcast: some 20 MB, for about 100 GB of texts at MAX_BYTES.
BROADCAST_ROWS = 200_000
#: Bits by which the first histogram is finer than evenly filled shards would need.
SLACK_BITS = 6


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def _leaves(fine: DataFrame, bits: int, floor: int, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes) of the leaves over buckets (prefix, bytes, one) of depth ``bits``; none is shallower than ``floor``.

    ``one`` says that all rows of a bucket have one hash, so that bits can't split it.
    """
    level, depth, found = fine.select("prefix", "bytes", ((F.col("bytes") <= limit) | F.col("one")).alias("leaf")), bits, []
    while True:
        fits = F.col("bytes") <= limit
        if depth == floor or level.where(fits).isEmpty():
            found.append(level.where("leaf").select(F.lit(depth).alias("depth"), "prefix", F.col("bytes").alias("shard_bytes")))
            break
        up = level.groupBy(F.shiftrightunsigned("prefix", 1).alias("above")).agg(F.sum("bytes").alias("sum"))
        up = materialise(up, f"level-{depth - 1}")
        stay = level.withColumn("above", F.shiftrightunsigned("prefix", 1)).join(up.where(F.col("sum") > limit), "above").where("leaf")
        found.append(stay.select(F.lit(depth).alias("depth"), "prefix", F.col("bytes").alias("shard_bytes")))
        level, depth = up.select(F.col("above").alias("prefix"), F.col("sum").alias("bytes"), (F.col("sum") <= limit).alias("leaf")), depth - 1
    return reduce(DataFrame.unionByName, found)


def directory(rows: DataFrame, max_bytes: int = MAX_BYTES) -> list[tuple[int, DataFrame]]:
    """Directories (prefix, depth, shard, shard_bytes, n), by ascending number of bits, over rows (h, bytes).

    A row of ``rows`` is in the first directory that has its prefix; n is how many rows have it.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits, floor, out = min(58, max(1, (total // max_bytes).bit_length() + SLACK_BITS)), 0, []
    while True:
        fine = rows.groupBy(_prefix(F.col("h"), bits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), (F.min("h") == F.max("h")).alias("one"))
        fine = materialise(fine, f"histogram-{bits}")
        leaves = materialise(_leaves(fine, bits, floor, max_bytes), f"leaves-{bits}")
        lowest = leaves.agg(F.min("depth")).first()[0]
        if lowest is not None:
            above = F.explode(F.sequence(F.lit(lowest), F.lit(bits))).alias("depth")
            paths = fine.select("n", F.col("prefix").alias("fine"), above)
            # Fewer than 2^(bits - lowest) fine buckets meet in a leaf.
            paths = paths.withColumn("prefix", F.expr(f"shiftrightunsigned(fine, {bits} - depth)"))
            shard = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
            pages = paths.join(leaves, ["depth", "prefix"]).select(F.col("fine").alias("prefix"), "depth", shard.alias("shard"), "shard_bytes", "n")
            out.append((bits, materialise(pages, f"directory-{bits}")))
        large = fine.where((F.col("bytes") > max_bytes) & ~F.col("one")).select("prefix")
        if bits == 64 or large.isEmpty():
            return out
        rows = materialise(rows.withColumn("prefix", _prefix(F.col("h"), bits)).join(large, "prefix", "left_semi").drop("prefix"), f"rows-{bits}")
        floor, bits = bits + 1, min(64, bits + SLACK_BITS)


def _hashed(docs: DataFrame) -> DataFrame:
    """Columns h and bytes of each row, and all of its own in ``__doc``."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    own = F.struct(*[docs[c] for c in docs.columns]).alias("__doc")
    return docs.select(own, F.xxhash64(docs["doc_id"].cast("long"), text).alias("h"), F.octet_length(text).cast("long").alias("bytes"))


def _paged(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Rows of buckets of one hash over the limit: cut into pages that fit, a row at least each.

    Such rows are equal, so any of them can be on any page.  They are numbered
    by the part of a written table that they are in, so that not even copies of
    a third of all rows meet in one task.
    """
    rows = materialise(rows.drop("page", "shard_bytes").withColumn("__part", F.spark_partition_id()), "over")
    parts = materialise(rows.groupBy("h", "__part").agg(F.count("*").alias("n"), F.max("bytes").alias("largest")), "parts")
    by_hash = Window.partitionBy("h")
    before = F.sum("n").over(by_hash.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    each = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest(F.max("largest").over(by_hash), F.lit(1))))
    parts = parts.select("h", "__part", F.coalesce(before, F.lit(0)).alias("before"), each.alias("each"))
    own = F.row_number().over(Window.partitionBy("h", "__part").orderBy("bytes")) - 1
    paged = rows.withColumn("own", own).join(parts, ["h", "__part"])
    paged = paged.withColumn("page", F.floor((F.col("own") + F.col("before")) / F.col("each")).cast("int"))
    paged = materialise(paged.drop("own", "before", "each", "__part"), "paged")
    sums = paged.groupBy("h", "page").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("n"))
    return counted_join(paged, materialise(sums, "pages"), ["h", "page"], "n", ["h", "page"])


def _placed(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Adds shard, depth, page and shard_bytes to rows with columns h and bytes."""
    found = rows
    places = directory(materialise(rows.select("h", "bytes"), "rows"), max_bytes)
    for i, (bits, pages) in enumerate(places):
        pages = pages.select("prefix", "n", F.struct("shard", "depth", "shard_bytes").alias(f"at{i}"))
        found = found.withColumn("prefix", _prefix(F.col("h"), bits))
        if pages.count() <= BROADCAST_ROWS:
            found = found.join(F.broadcast(pages.drop("n")), "prefix", "left").drop("prefix")
        else:
            found = counted_join(found, pages, ["prefix"], "n", ["h"]).drop("prefix")
    names = [f"at{i}" for i in range(len(places))]
    at = F.coalesce(*names) if names else F.struct(F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"))
    found = found.withColumn("at", at).select(*rows.columns, "at.shard", "at.depth", "at.shard_bytes").withColumn("page", F.lit(0))
    if not names or _fit(places, max_bytes):
        return found
    over = F.col("shard_bytes") > max_bytes
    return found.where(~over).unionByName(_paged(found.where(over), max_bytes))


def _fit(places: list[tuple[int, DataFrame]], max_bytes: int) -> bool:
    """Whether no bucket of one hash is over the limit."""
    return all(pages.where(F.col("shard_bytes") > max_bytes).isEmpty() for _, pages in places)


def shards(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes, shard (its leading bits), depth, page, shard_bytes.

    A document's bytes are those of its text in UTF-8; null is empty.  Only
    doc_id and text are read.  A bucket of one hash, which is one document or
    repeated rows of it, can't be split by bits: if it is over the limit its
    rows go to pages 0, 1, ..., each within the limit unless it is one row.
    shard_bytes are the bytes of the row's shard and page.  An empty table has
    no shards.
    """
    rows = _hashed(docs.select("doc_id", "text")).select(F.col("__doc.doc_id").cast("long").alias("doc_id"), "h", "bytes")
    return _placed(materialise(rows, "hashes"), max_bytes).select("doc_id", F.col("bytes").alias("n_bytes"), "shard", "depth", "page", "shard_bytes")


def file_order(docs: DataFrame) -> Column:
    """A long that grows along a written table: by the number in its files' names, then by row.

    Parts are written in order, so of a table sorted in ranges this is the sort
    order.  Of rows that come from no file it is the order of their partitions.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    return F.shiftleft(part, 40) + F.col("_metadata.row_index")


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> list[str]:
    """Writes all rows and columns of ``docs`` as Parquet, a folder for each shard and page; returns the names of the three columns it adds.

    Those are shard (the letter b and the shard's bits), page, and seq, the
    row's place in the order of ``docs`` (see ``file_order``), by which a file
    is sorted; with underscores before them where ``docs`` has such a column.
    Rows are placed by their own text, so doc_ids may repeat or be null;
    repeated rows are all written.  An empty table writes no folder.
    """
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("shard", "page", "seq"):
        while name in taken:
            name = "_" + name
        names.append(name)
    placed = _placed(_hashed(docs.select("*", file_order(docs).alias(names[2]))), max_bytes)
    placed = placed.select("__doc.*", F.concat(F.lit("b"), "shard").alias(names[0]), F.col("page").alias(names[1]))
    placed.repartition(*names[:2]).sortWithinPartitions(*names).write.partitionBy(*names[:2]).parquet(path)
    return names


def read_shards(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A written table with the columns of ``schema`` (folder columns included); no rows where nothing was written."""
    return spark.read.schema(schema).parquet(path)


def sharded(docs: DataFrame, max_bytes: int = MAX_BYTES, path: str | None = None) -> DataFrame:
    """Writes the shards of ``docs``, with all its columns, to ``path`` (a new folder of the shared one) and returns what reading them gives: the columns of ``shards``, from the files."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/shards"
    shard, page, _ = write_shards(docs, path, max_bytes)
    own = [f for f in docs.schema.fields if f.name in ("doc_id", "text")]
    rows = read_shards(spark, path, StructType([*own, StructField(shard, StringType()), StructField(page, IntegerType())]))
    bytes_ = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_.alias("n_bytes"), F.expr(f"substring(`{shard}`, 2)").alias("shard"), F.col(page).alias("page"))
    sums = materialise(rows.groupBy("shard", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("n")), "sums")
    out = counted_join(rows, sums, ["shard", "page"], "n", ["doc_id"])
    return out.select("doc_id", "n_bytes", "shard", F.length("shard").alias("depth"), "page", "shard_bytes")
