"""Similar passages of different documents by TF-IDF cosine."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Profile, half_up, is_content, tokenize
from .lexicon import STOP, passage_rows

THRESHOLD = 0.08
#: Thresholds that the search for the best pairs goes down by, before its own.
STEPS = (1.0, 0.9, 0.6, 0.3, 0.15)
#: From this threshold on, nearly all pairs have the same terms.
CLOSE = 0.999
#: Entries of a term's list that meet in one group; longer lists are cut into blocks that meet pairwise.
BLOCK = 2000
PLACE = ["id", "passage_idx"]
#: Most distinct terms whose df is broadcast, some 60 MB.
WORDS_SENT = 1_000_000
#: Most pairs of classes whose names are broadcast, so that only their terms are shuffled.
PAIRS_SENT = 200_000


def passage_terms(docs: DataFrame, profile: Profile = Profile(), stop_words: tuple[str, ...] = STOP) -> DataFrame:
    """(id, passage_idx, term, tf)."""
    each = passage_rows(docs).select("id", "passage_idx", F.explode(tokenize(F.col("passage"), profile)).alias("term"))
    return each.where(is_content(F.col("term"), stop_words)).groupBy("id", "passage_idx", "term").agg(F.count("*").alias("tf"))


def tfidf(terms: DataFrame, path: str | None = None) -> DataFrame:
    """Adds df and weight tf (ln((N + 1) / (df + 1)) + 1), N being the passages with any term.

    With ``path``, a new folder that all executors share, terms are cut and
    counted once and written there, and up to WORDS_SENT distinct ones go to
    all tasks, so that terms aren't shuffled for their df.
    """
    if path:
        terms.write.parquet(path)
        terms = terms.sparkSession.read.parquet(path)
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    if path:
        df = df.persist()
        df = F.broadcast(df) if df.count() <= WORDS_SENT else df
    total = terms.select("id", "passage_idx").distinct().agg(F.count("*").alias("total"))
    weighed = terms.join(df, "term").join(F.broadcast(total))
    return weighed.withColumn("weight", F.col("tf") * (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1)).drop("total")


@dataclass
class Index:
    """Distinct passages and who has them.

    classes: (cls, terms, low, high), cls a hash of the terms and their
    numbers, terms (df, term, u) by rarity, u their shares of a vector of
    length 1, low and high the first and the last document that has it.
    members: (cls, id, passage_idx) of every passage with a term.
    """

    classes: DataFrame
    members: DataFrame
    path: str | None = None


def _stored(df: DataFrame, path: str | None, name: str) -> DataFrame:
    """The table kept for further passes, without its plan: written under ``path``, or without one held by the executors."""
    if path is None:
        return df.localCheckpoint()
    at = f"{path}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def index(docs: DataFrame, profile: Profile = Profile(), stop_words: tuple[str, ...] = STOP, path: str | None = None) -> Index:
    """Passages of the same terms, as often each, are one class: copies are compared once, however many there are.

    Passages are cut once.  They are shuffled as lines of their terms, and
    classes are stored without weights, which are worked out where they are
    read; with ``path``, a new folder that all executors share, both are
    files there.
    """
    each = passage_terms(docs, profile, stop_words)
    bags = each.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("w"))
    bags = bags.select(*PLACE, F.array_join(F.transform("w", lambda x: F.concat_ws(":", x["term"], x["tf"])), " ").alias("bag"))
    own = F.base64(F.unhex(F.left(F.sha2("bag", 256), F.lit(32))))
    bags = _stored(bags.select(own.alias("cls"), *PLACE, "bag"), path, "bags")
    members = bags.select("cls", *PLACE)
    count = members.count()
    # Terms have no colon nor blank.
    parts = F.transform(F.split("bag", " ", -1), lambda x: F.struct(F.substring_index(x, ":", 1).alias("term"), F.substring_index(x, ":", -1).cast("long").alias("tf")))
    df = bags.select(F.explode(parts["term"]).alias("term")).groupBy("term").agg(F.count("*").alias("df")).persist()
    words = F.broadcast(df) if df.count() <= WORDS_SENT else df
    first = bags.groupBy("cls").agg(F.first("bag").alias("bag"), F.min("id").alias("low"), F.max("id").alias("high"))
    rows = first.select("cls", "low", "high", F.explode(parts).alias("x")).select("cls", "low", "high", "x.*").join(words, "term")
    weight = lambda x: x["tf"] * (F.log((F.lit(count) + 1) / (x["df"] + 1)) + 1)
    w = rows.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "term", "tf"))).alias("w"), F.min("low").alias("low"), F.min("high").alias("high"))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda total, x: total + weight(x) * weight(x)))
    classes = _stored(w.withColumn("norm", norm), path, "classes")
    if path:
        df.unpersist()
    unit = F.transform("w", lambda x: F.struct(x["df"].alias("df"), x["term"].alias("term"), (weight(x) / F.col("norm")).alias("u")))
    return Index(classes.select("cls", unit.alias("terms"), "low", "high"), members, path)


def prefix(terms: Column, threshold: float) -> Column:
    """The rarest terms of a vector, as many as leave a rest of a length below the threshold.

    Two vectors that reach the threshold share one of both their prefixes: else
    all that they share would lie in the rest of one of them.
    """
    limit = threshold * threshold * (1 - 1e-9)
    start = F.struct(F.lit(1.0).alias("rest"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(a["rest"] < limit, a).otherwise(F.struct((a["rest"] - x["u"] * x["u"]).alias("rest"), (a["n"] + 1).alias("n")))
    return F.slice(terms, F.lit(1), F.aggregate(terms, start, step)["n"])


def candidate_pairs(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: classes that share a term of both prefixes.

    A term's list is cut into blocks by its length; each pair of blocks is a
    group of its own, so that a frequent term is no single task's.
    """
    lists = classes.select("cls", F.explode(F.transform(prefix(F.col("terms"), threshold), lambda x: x["term"])).alias("term"))
    sizes = lists.groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = lists.join(sizes, "term").select("term", "cls", parts.alias("parts"), F.pmod(F.xxhash64("cls"), parts).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.select("term", F.col("cls").alias("a"), F.col("own").alias("i"), every.alias("j"))
    right = dealt.select("term", F.col("cls").alias("b"), F.col("own").alias("j"), every.alias("i"))
    return left.join(right, ["term", "i", "j"]).where("a < b").select("a", "b").distinct()


def close_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: classes that can reach a threshold near 1.

    Vectors of length 1 that do lie within sqrt(2 - 2 threshold) of each
    other, so that a share above that is one of a term that both have.
    Classes with such shares alone meet only where their terms are the same;
    the others, very long passages, meet all by their prefixes.
    """
    reach = math.sqrt(2 - 2 * threshold) * (1 + 1e-6)
    full = classes.withColumn("full", F.forall("terms", lambda x: x["u"] > reach))
    # Whoever meets by a hash is compared exactly.
    same = F.xxhash64(F.array_join(F.transform("terms", lambda x: x["term"]), " "))
    keyed = full.where("full").select("cls", same.alias("same"))
    equal = keyed.withColumnRenamed("cls", "a").join(keyed.withColumnRenamed("cls", "b"), "same").where("a < b").select("a", "b")
    lists = full.select("cls", "full", F.explode(prefix(F.col("terms"), threshold)).alias("x")).select("cls", "full", "x.term", "x.u")
    left, right = lists.where("not full").alias("l"), lists.alias("r")
    met = left.join(right, (F.col("l.term") == F.col("r.term")) & (F.col("l.cls") != F.col("r.cls")) & (F.abs(F.col("l.u") - F.col("r.u")) <= reach))
    return equal.unionByName(met.select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b")).distinct())


def _of_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes of few pairs (a, b)."""
    return classes.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "cls", "left_semi")


def similar_classes(classes: DataFrame, threshold: float, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """(a, b, s) of the pairs of different classes whose cosine is at least the threshold."""
    # Terms by name for the dot product; a class's own terms are distinct.
    bag = F.map_from_entries(F.transform("terms", lambda x: F.struct(x["term"], x["u"])))
    found = _stored(close_pairs(classes, threshold) if threshold >= CLOSE else candidate_pairs(classes, threshold, block), path, "candidates")
    if found.count() <= PAIRS_SENT:
        classes = _of_pairs(classes, found)
    pairs = found.join(classes.select(F.col("cls").alias("a"), F.col("terms").alias("ta")), "a")
    pairs = pairs.join(classes.select(F.col("cls").alias("b"), bag.alias("tb")), "b")
    s = F.aggregate("ta", F.lit(0.0), lambda total, x: total + x["u"] * F.coalesce(F.col("tb")[x["term"]], F.lit(0.0)))
    return pairs.select("a", "b", s.alias("s")).where(F.col("s") >= threshold)


def _first_members(members: DataFrame, k: int) -> DataFrame:
    """Members of each class that can be in one of the first k pairs: of its first k + 1 documents, the first k passages each."""
    own = F.row_number().over(Window.partitionBy("cls", "id").orderBy("passage_idx"))
    found = members.withColumn("own", own).where(F.col("own") <= k)
    doc = F.dense_rank().over(Window.partitionBy("cls").orderBy("id"))
    return found.withColumn("doc", doc).where(F.col("doc") <= k + 1).select("cls", *PLACE)


def _foremost(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of classes that can hold one of the first k pairs of passages.

    Every pair of classes has a pair of passages that begins with the first
    document of both, so that those behind the k-th by similarity and that
    document hold none.
    """
    last = pairs.orderBy(F.desc("similarity"), "begin").limit(k).agg(F.count("*").alias("n"), F.max(F.struct((-F.col("similarity")).alias("s"), "begin")).alias("last")).first()
    if last.n < k:
        return pairs
    return pairs.where((F.col("similarity") > -last["last"].s) | ((F.col("similarity") == -last["last"].s) & (F.col("begin") <= last["last"].begin)))


def best_pairs(found: Index, k: int, threshold: float) -> DataFrame:
    """(id, passage_idx, id2, idx2, a, b, similarity): the k most similar passage pairs of different documents of at least the threshold, first places first among equals."""
    ends = lambda name: found.classes.select(F.col("cls").alias(name), F.col("low").alias(f"low_{name}"), F.col("high").alias(f"high_{name}"))
    other = similar_classes(found.classes, threshold, path=found.path).join(ends("a"), "a").join(ends("b"), "b")
    # Classes of one and the same document alone give no pair.
    other = other.where("least(low_a, low_b) < greatest(high_a, high_b)").select("a", "b", "s", F.least("low_a", "low_b").alias("begin"))
    copies = found.classes.where("low < high").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("s"), F.col("low").alias("begin"))
    pairs = _stored(other.unionByName(copies).select("a", "b", half_up(F.col("s"), 4).alias("similarity"), "begin"), found.path, "pairs")
    pairs = _foremost(pairs, k)
    own = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("cls")).distinct()
    first = _first_members(found.members.join(own, "cls", "left_semi"), k)
    both = pairs.join(first.withColumnRenamed("cls", "a"), "a").join(first.select(F.col("cls").alias("b"), F.col("id").alias("id2"), F.col("passage_idx").alias("idx2")), "b")
    # Classes come in order of their names; the pair, in that of its documents.
    low = F.col("id") < F.col("id2")
    names = [F.when(low, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("id", "id2"), ("passage_idx", "idx2"), ("a", "b"))]
    other = [F.when(low, F.col(y)).otherwise(F.col(x)).alias(y) for x, y in (("id", "id2"), ("passage_idx", "idx2"), ("a", "b"))]
    # Copies meet in both orders, of which one is kept.
    both = both.where("id < id2 or (a <> b and id > id2)").select(*names, *other, "similarity")
    return both.orderBy(F.desc("similarity"), "id", "passage_idx", "id2", "idx2").limit(k)


def similar(docs: DataFrame, k: int = 30, threshold: float = THRESHOLD, profile: Profile = Profile(), stop_words: tuple[str, ...] = STOP, path: str | None = None) -> DataFrame:
    """The k most similar passage pairs of different documents, with their ten heaviest shared terms.

    The search begins at a high threshold, where prefixes are short, and goes
    down only while there are fewer than k pairs: all pairs above a threshold
    are found, so k of them are the best k.  Thresholds lie where rounding does.
    With ``path``, a new folder that all executors share, passages and classes
    are stored there.
    """
    found = index(docs, profile, stop_words, path)
    for step in [*(x - 5e-5 for x in STEPS if x > threshold), threshold]:
        top = best_pairs(found, k, step).persist()
        if top.count() >= k:
            break
    own = _of_pairs(found.classes, top)
    terms = lambda cls, name: own.select(F.col("cls").alias(cls), F.col("terms").alias(name))
    rows = F.broadcast(top).join(terms("a", "ta"), "a").join(terms("b", "tb"), "b")
    bag = F.map_from_entries(F.transform("tb", lambda x: F.struct(x["term"], x["u"])))
    rows = rows.select("id", "passage_idx", "id2", "idx2", "similarity", "ta", bag.alias("tb"))
    shared = F.filter(F.transform("ta", lambda x: F.struct((-x["u"] * F.col("tb")[x["term"]]).alias("x"), x["term"].alias("term"))), lambda x: x["x"].isNotNull())
    listed = F.transform(F.slice(F.sort_array(shared), 1, 10), lambda x: x["term"])
    out = rows.select("id", "passage_idx", "id2", "idx2", "similarity", listed.alias("shared_terms"))
    return out.orderBy(F.desc("similarity"), "id", "passage_idx", "id2", "idx2")
