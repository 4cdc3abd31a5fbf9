"""Term counts over documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Profile, tokenize


def arriving_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(path)


def term_counts(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(term, cnt) over all documents so far; for output mode complete or update."""
    return docs.select(F.explode(tokenize(F.col("text"), profile)).alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))
