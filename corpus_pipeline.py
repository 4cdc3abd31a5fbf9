"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

ORACLE_SQL is None: SQL has no shingle components and no Jensen-Shannon verdicts
to the last bit; tests/llm/test_pipeline.py holds every stage's rows, and the
whole run, against plain Python instead.  The mix is written in the order of
its curriculum, and the shards keep that order in their column ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontam, mixing, nearcopies, quality, sharding
from lexmill.llm.shared import materialise, table

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the least doc_id: op8's SimHash, and MinHash for what its bits miss, find them, a similarity of 0.8 or more of shingles of 5 words decides."""
    return nearcopies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a window of a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix of its source takes it; the order is that of the written rows."""
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards, with all columns and in training order, and returns every copy's place in them: doc_id, n_bytes, shard, depth, page, shard_bytes."""
    return sharding.sharded(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table; all other stages are written to the shared folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
