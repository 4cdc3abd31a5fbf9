"""What several operators of this subpackage share: tables, the shared folder, joins on counted keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space in every contract of this subpackage.
BLANKS = " \t\n\x0b\x0c\r"
#: Most rows that ``counted_join`` broadcasts.
HOT_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests), a new temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lexmill-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The runs of characters that are not blank."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+", -1))


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, spread: list[str]) -> DataFrame:
    """Left join that no hot key can skew.

    ``right`` has unique keys and, in ``count``, how many rows of ``left`` each
    has at most.  At most HOT_ROWS keys can hold 1/HOT_ROWS of all counts each;
    those are broadcast.  All other keys meet in a shuffle, in which the rows
    that the broadcast has served are spread by a hash of ``spread``.  Columns
    of ``left`` must not begin with ``__``.
    """
    values = [c for c in right.columns if c not in keys and c != count]
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) * HOT_ROWS >= F.lit(total)).select(*keys, F.struct(*values).alias("__hot"))
    cold = right.where(F.col(count) * HOT_ROWS < F.lit(total)).select(*keys, F.lit(0).alias("__salt"), F.struct(*values).alias("__cold"))
    served = left.join(F.broadcast(hot), keys, "left")
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(4093)).cast("int"))
    found = F.coalesce("__hot", "__cold")
    return (
        served.withColumn("__salt", salt)
        .join(cold, [*keys, "__salt"], "left")
        .select(*left.columns, *[found[v].alias(v) for v in values])
    )
