"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs), bucketed and sorted by the 128-bit hash
of a line's key.  Batches of documents arrive one after another.  The hashes of
a batch are merge-anti-joined with the runs, which drops those that a run
already has in ``min_docs`` documents; the rest is a run of level 0.  ``fanout``
runs of a level are merged into one of the next, so n batches leave about
fanout * log(n) runs and a hash is rewritten log(n) times.  Batches and runs
have the same buckets, so neither the joins nor the merging of two runs shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANKS, counted_join, lower_ascii, materialise, shared_folder

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2
#: Documents for each bucket of a run, about.
BUCKET_DOCS = 50_000


class LineRuns:
    """The levelled runs of one corpus, as external tables in a folder that all executors share.

    Within ``with``; its end drops the tables' names.  A count is of the
    documents of all batches, but for hashes that had ``min_docs`` before a
    batch came: for these it is at least ``min_docs``.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int, buckets: int = 8, fanout: int = FANOUT):
        self.spark, self.path, self.min_docs, self.buckets, self.fanout = spark, path, min_docs, buckets, fanout
        self.levels: list[list[str]] = []
        self.names: list[str] = []
        self.compactions = 0

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def table(self, rows: DataFrame, *by: str) -> str:
        """Writes rows as a table of this run's buckets, with a folder for each value of ``by``."""
        name = f"lexmill_{uuid.uuid4().hex}"
        self.names.append(name)
        writer = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}")
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)
        return name

    def inbox(self, counted: DataFrame) -> DataFrame:
        """Rows (batch, h1, h2, n_docs) in the buckets of the runs, so that each batch can be read alone."""
        return self.spark.table(self.table(counted.repartition(self.buckets, "h1", "h2"), "batch"))

    def add(self, counts: DataFrame) -> None:
        """Takes a batch (h1, h2, n_docs): hashes that no run has in ``min_docs`` documents become a run; full levels are merged."""
        for name in self._runs():
            known = self.spark.table(name).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            counts = counts.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        self._place(0, self.table(counts.select("h1", "h2", "n_docs")))

    def merged(self) -> DataFrame:
        """(h1, h2, n_docs) over all runs."""
        return self._merge(self._runs())

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merge(self, names: list[str]) -> DataFrame:
        # Merge joins, not a union with an aggregate: without a shuffle, that one has left equal hashes of two bucketed tables apart.
        out = self.spark.table(names[0]).select("h1", "h2", "n_docs") if names else self.spark.createDataFrame([], "h1 long, h2 long, n_docs long")
        for name in names[1:]:
            other = self.spark.table(name).select("h1", "h2", F.col("n_docs").alias("more")).hint("merge")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            out = out.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", total.cast("long").alias("n_docs"))
        return out

    def _place(self, level: int, name: str) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = self.table(self._merge(self.levels[level]))
            self.compactions += 1
            self.levels[level] = []
            self._place(level + 1, merged)


def line_keys(lines: Column) -> Column:
    """The keys of an array of lines: blanks stripped at both ends, A-Z lower-cased."""
    return F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))


def _key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256, kept_text.

    Lines whose key has at least ``min_chars`` code points and occurs in at
    least ``min_docs`` documents go, in every document.  A row is a document,
    also where a doc_id repeats or is null.  Needs doc_id and text; other
    columns are ignored.  A null or empty text is one empty line.  Batches are
    dealt by a hash of the row; their number changes the runs, not the result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Rows are numbered within a written table, so that rows that repeat have numbers of their own, also when a task runs again.
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), "rows")
    lines = F.split(lower_ascii(F.col("text")), "\n", -1)
    keyed = rows.select(F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch"), F.array_distinct(line_keys(lines)).alias("keys"))
    each = keyed.select("batch", F.explode("keys").alias("key")).where(F.length("key") >= min_chars)
    counted = each.select("batch", *_key_hashes(F.col("key"))).groupBy("batch", "h1", "h2").agg(F.count("*").alias("n_docs"))
    path = shared_folder(spark)
    with LineRuns(spark, path, min_docs, max(8, min(4096, rows.count() // BUCKET_DOCS)), fanout) as runs:
        arriving = runs.inbox(counted)
        for b in range(batches):
            runs.add(arriving.where(F.col("batch") == b).drop("batch"))
        runs.merged().where(F.col("n_docs") >= min_docs).write.parquet(f"{path}/common")
    common = spark.read.schema("h1 long, h2 long, n_docs long").parquet(f"{path}/common").withColumn("common", F.lit(True))

    placed = rows.select("row", F.posexplode(line_keys(lines)).alias("at", "key")).where(F.length("key") >= min_chars)
    placed = placed.select("row", "at", *_key_hashes(F.col("key")))
    gone = counted_join(placed, common, ["h1", "h2"], "n_docs", ["row", "at"]).where("common")
    per_row = gone.groupBy("row").agg(F.collect_set("at").alias("gone"))
    joined = rows.join(per_row, "row", "left").select("doc_id", "text", "gone")
    split = joined.select("doc_id", F.split("text", "\n", -1).alias("lines"), "text", "gone")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n"))
    out = split.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return out.select("doc_id", "n_lines", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")
