"""Keyword in context and contexts of term families."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Profile, apply_profile
from .lexicon import dealt

#: Texts whose lists of runs are made at once.
TEXTS_AT_ONCE = 2000


def _hits(text: Column, pattern: str, limit: int) -> Column:
    """Array of the first ``limit`` (start, match), code-point offsets from 0."""
    pieces, found = F.split(text, pattern, -1), F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, limit)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("hits"))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
        F.concat(a["hits"], F.array(F.struct((a["at"] + F.length(x["p"])).alias("start"), x["m"].alias("match")))).alias("hits"),
    )
    zipped = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(zipped, begin, step)["hits"]


def _contexts(rows: DataFrame, width: int) -> DataFrame:
    """Adds left and right context to (text, start, match)."""
    left, right = _around(F.col("text"), F.struct("start", "match"), width)
    return rows.withColumn("left", left).withColumn("right", right)


def _around(text: Column, hit: Column, width: int) -> tuple[Column, Column]:
    low, end = F.greatest(F.lit(0), hit["start"] - width), hit["start"] + F.length(hit["match"])
    return F.substring(text, low + 1, hit["start"] - low), F.substring(text, end + 1, F.lit(width))


def kwic(docs: DataFrame, query: str, width: int = 72, limit: int = 100) -> DataFrame:
    """The first hits of a literal, in any case, by document and place: id, start, left, match, right.

    The query is stripped; an empty one has no hits.  Hits are cut out of each
    text before any are compared, so what goes to one task are at most
    ``limit`` hits from each other task, not texts.
    """
    query = query.strip()
    pattern = "(?iu)" + re.escape(query)
    docs = docs.where(F.col("text").rlike(pattern)) if query else docs.where(F.lit(False))
    rows = docs.select("id", "text", _hits(F.col("text"), pattern, limit).alias("hits"))

    def cut(hit: Column) -> Column:
        left, right = _around(F.col("text"), hit, width)
        return F.struct(hit["start"].alias("start"), left.alias("left"), hit["match"].alias("match"), right.alias("right"))

    return rows.select("id", F.explode(F.transform("hits", cut)).alias("h")).select("id", "h.*").orderBy("id", "start").limit(limit)


@cache
def _case_pairs() -> tuple[str, str]:
    """Characters that matching in any case takes for others than their lower case, and those."""
    pairs = []
    for c in map(chr, range(0x80, 0x10000)):
        if not "\ud800" <= c <= "\udfff":
            upper = c.upper() if len(c.upper()) == 1 else c
            low = upper.lower() if len(upper.lower()) == 1 else upper.lower()[:1]
            if low != c.lower():
                pairs.append((c, low))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """A text's characters, alike for texts that differ in case."""
    return F.lower(F.translate(text, *_case_pairs()))


def grams(text: str) -> np.ndarray:
    """The distinct runs of three characters of a folded text, a long each."""
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(at[:-2] << 42 | at[1:-1] << 21 | at[2:])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ids): rows of each some thousand texts (id, t), a list of ids for each run that they have."""
    for batch in batches:
        for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(low, TEXTS_AT_ONCE)
            found = [grams(x or "") for x in part.column("t").to_pylist()]
            ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False).astype(np.int64), [len(x) for x in found])
            runs = np.concatenate(found)
            order = np.argsort(runs, kind="stable")
            runs, ids = runs[order], ids[order]
            cuts = np.flatnonzero(np.diff(runs, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(runs)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(runs[cuts]), lists], ["gram", "ids"])


@dataclass
class GramIndex:
    """Which documents have which runs of three characters, as two bucketed tables in a folder that all executors share.

    postings (gram, ids) by gram, some thousand texts a row, texts (id, text)
    by id.  ``drop`` forgets their names; the folder is the caller's.
    """

    spark: SparkSession
    postings: str
    texts: str

    #: Candidates whose ids are put into the filter of the texts' scan, so that other buckets and row groups are not read.
    FEW = 1000

    def drop(self) -> None:
        for name in (self.postings, self.texts):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def candidates(self, query: str) -> DataFrame:
        """(id) of the documents that have every run of three of the query, so all in which it can be found."""
        wanted = grams(self.spark.range(1).select(folded(F.lit(query)).alias("t")).first().t).tolist()
        held = self.spark.table(self.postings).where(F.col("gram").isin(wanted)).select("gram", F.explode("ids").alias("id"))
        return held.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("id")

    def kwic(self, query: str, width: int = 72, limit: int = 100) -> DataFrame:
        """As ``kwic`` over the texts, of which only candidates are read; a query of fewer than three characters reads all."""
        query, texts = query.strip(), self.spark.table(self.texts)
        if len(query) >= 3:
            found = self.candidates(query).persist()
            few = [r.id for r in found.limit(self.FEW + 1).collect()]
            texts = texts.where(F.col("id").isin(few) | F.col("id").isNull()) if len(few) <= self.FEW else texts.join(found, "id").unionByName(texts.where("id is null"))
        return kwic(texts, query, width, limit)


def gram_index(docs: DataFrame, path: str, buckets: int = 16) -> GramIndex:
    """Writes the index of (id, text) to ``path``; texts without an id are looked through by every query.

    The runs of some thousand texts leave their task as one list each, so that
    what is shuffled and sorted are a few rows for each run, not one for each
    text that has it.
    """
    spark, key = docs.sparkSession, uuid.uuid4().hex
    postings, texts = f"lexmill_grams_{key}", f"lexmill_texts_{key}"

    def write(rows: DataFrame, by: str, name: str) -> None:
        rows.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", f"{path}/{name}").saveAsTable(name)

    write(docs.select("id", "text"), "id", texts)
    known = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), folded(F.coalesce("text", F.lit(""))).alias("t"))
    write(dealt(known, text="t").mapInArrow(_postings, "gram long, ids array<long>"), "gram", postings)
    return GramIndex(spark, postings, texts)


def family_contexts(docs: DataFrame, families: dict[str, list[str]], profile: Profile = Profile(), width: int = 58, limit: int = 3) -> DataFrame:
    """The first contexts of each family's aliases in each document, at letter boundaries, longest alias first."""
    one_line = docs.select("id", apply_profile(F.col("text"), profile, one_line=True).alias("text"))
    cases = []
    for name, aliases in families.items():
        words = "|".join(re.escape(a) for a in sorted(set(aliases), key=lambda a: (-len(a), a)))
        cases.append(F.struct(F.lit(name).alias("family"), _hits(F.col("text"), rf"(?iu)(?<![\p{{L}}\p{{Nl}}\p{{No}}])(?:{words})(?![\p{{L}}\p{{Nl}}\p{{No}}])", limit).alias("hits")))
    rows = one_line.select("id", "text", F.explode(F.array(*cases)).alias("c")).select("id", "text", "c.family", F.posexplode("c.hits").alias("idx", "h"))
    rows = rows.where(F.col("idx") < limit).select("id", "text", "family", "idx", "h.*")
    return _contexts(rows, width).select("family", "id", "idx", "left", "match", "right")


def feature_contexts(docs: DataFrame, feature: str, left_id: int, right_id: int, width: int = 72) -> DataFrame:
    """Contexts of a feature in the two documents that it sets apart."""
    return kwic(docs.where(F.col("id").isin(left_id, right_id)), feature, width)


def evidence(docs: DataFrame, lemmas: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(id, text, lemma_text): the text by the profile and the lemmas of (id, tokens), if any, joined by spaces."""
    rows = docs.select("id", apply_profile(F.col("text"), profile).alias("text")).join(lemmas.select("id", "tokens"), "id", "left")
    return rows.select("id", "text", F.coalesce(F.array_join("tokens", " "), F.lit("")).alias("lemma_text"))
