"""Tokens in long form and what counts them: frequencies, summaries, collocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MODERN_FUNCTION_WORDS, TOKEN, Profile, fold, half_up, is_content, passages, tokenize, trigrams

STOP = MODERN_FUNCTION_WORDS
#: Bytes of text that are dealt to one task, about: what its tokens take then doesn't grow with the corpus.
TASK_BYTES = 8 << 20


def dealt(docs: DataFrame, task_bytes: int | None = None, text: str = "text") -> DataFrame:
    """Documents dealt by id, about TASK_BYTES or ``task_bytes`` of text a task: what is counted, ranked or looked up by document after this needs no further shuffle of tokens."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (task_bytes or TASK_BYTES))), "id")


def by_document(docs: DataFrame) -> DataFrame:
    """id and text, dealt by id."""
    return dealt(docs.select("id", "text"))


def tokens(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(id, pos, term)."""
    return by_document(docs).select("id", F.posexplode(tokenize(F.col("text"), profile)).alias("pos", "term"))


def token_offsets(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(id, pos, term, start, end): tokens with their places in the folded text, in code points from 0."""
    folded = by_document(docs).select("id", fold(F.col("text"), profile).alias("t"))
    gaps, terms = F.split("t", TOKEN, -1), F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0))
    each = folded.select("id", F.posexplode(F.zip_with(terms, F.slice(gaps, F.lit(1), F.size(terms)), lambda t, g: F.struct(t.alias("term"), F.length(g).alias("gap")))).alias("pos", "x")).select("id", "pos", "x.*")
    end = F.sum(F.col("gap") + F.length("term")).over(Window.partitionBy("id").orderBy("pos"))
    return each.withColumn("end", end).select("id", "pos", "term", (F.col("end") - F.length("term")).alias("start"), "end")


def counts(toks: DataFrame) -> DataFrame:
    """(id, term, cnt, first_pos)."""
    return toks.groupBy("id", "term").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))


def top_per_document(cnts: DataFrame, k: int = 18) -> DataFrame:
    """The k most frequent terms of each document, ties by first place."""
    w = Window.partitionBy("id").orderBy(F.desc("cnt"), "first_pos")
    return cnts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "term", "cnt", "rank")


def content(df: DataFrame, stop_words: tuple[str, ...] = STOP) -> DataFrame:
    return df.where(is_content(F.col("term"), stop_words))


def frequency_table(docs: DataFrame, content_only: bool = False, k: int = 18, profile: Profile = Profile(), stop_words: tuple[str, ...] = STOP) -> DataFrame:
    """(id, term, cnt, per_1000, rank): the most frequent terms with their rate in all of the document's tokens."""
    each = counts(tokens(docs, profile))
    sizes = each.groupBy("id").agg(F.sum("cnt").alias("n"))
    top = top_per_document(content(each, stop_words) if content_only else each, k).join(sizes, "id")
    return top.select("id", "term", "cnt", half_up(1000.0 * F.col("cnt") / F.col("n"), 3).alias("per_1000"), "rank")


def corpus_top(toks: DataFrame, k: int = 100) -> DataFrame:
    """The corpus's k most frequent terms, ties by first document and place."""
    each = toks.groupBy("term").agg(F.count("*").alias("cnt"), F.min(F.struct("id", "pos")).alias("first"))
    return each.orderBy(F.desc("cnt"), "first").limit(k).select("term", "cnt")


def trigram_counts(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    grams = by_document(docs).select("id", F.posexplode(trigrams(F.col("text"), profile)).alias("pos", "term"))
    return counts(grams)


def passage_rows(docs: DataFrame) -> DataFrame:
    """(id, passage_idx, passage)."""
    return by_document(docs).select("id", F.posexplode(passages(F.col("text"))).alias("passage_idx", "passage"))


def moving_type_ratio(places: Column, n: Column, window: int = 50) -> Column:
    """The mean share of types over all windows of so many tokens; ``places`` are (term, pos) sorted, n their number.

    A token is new in the windows that hold it but not its previous occurrence;
    these begin within an interval.  Sorted, the previous occurrence is the
    neighbour before, so one sort within the row does it.  Needs ``places`` as
    a column, since it is laid beside itself.
    """
    shifted = F.concat(F.array(F.lit(None).cast("struct<term:string,pos:int>")), places)
    # Of a pair only the gap's end is kept: the place after the previous occurrence, 0 where there is none.
    after = F.zip_with(places, F.slice(shifted, F.lit(1), F.greatest(F.size(places), F.lit(1))), lambda x, y: F.struct(x["pos"].alias("pos"), F.when(x["term"] == y["term"], y["pos"] + 1).otherwise(0).alias("free")))
    windows = lambda x: F.greatest(F.lit(0), F.least(x["pos"], n - window) - F.greatest(x["free"], x["pos"] - (window - 1)) + 1)
    new = F.aggregate(after, F.lit(0).cast("long"), lambda total, x: total + windows(x))
    return new / ((n - window + 1) * float(window))


def summary(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """One row a document: counts, mean lengths, type ratios and warnings. All of it comes from the row itself; texts are dealt out once, as files may have few row groups."""
    rows = by_document(docs).select("id", F.size(passages(F.col("text"))).cast("long").alias("sentence_count"), tokenize(F.col("text"), profile).alias("t"))
    placed = F.transform("t", lambda x, i: F.struct(x.alias("term"), i.alias("pos")))
    letters = F.length(F.array_join("t", "")).cast("long")
    rows = rows.select("id", "sentence_count", F.size("t").alias("n"), letters.alias("letters"), F.size(F.array_distinct("t")).cast("long").alias("type_count"), F.array_sort(placed).alias("places"))
    mattr = F.when(F.col("n") > 50, moving_type_ratio(F.col("places"), F.col("n")))
    n = F.col("n").cast("double")
    ratio = lambda a, b, d: F.when(b > 0, half_up(a / b, d)).otherwise(0.0)
    return rows.select(
        "id",
        F.col("n").cast("long").alias("token_count"),
        "type_count",
        "sentence_count",
        ratio(F.col("letters"), n, 2).alias("average_word_length"),
        ratio(n, F.col("sentence_count"), 2).alias("average_sentence_length"),
        ratio(F.col("type_count"), n, 4).alias("ttr"),
        half_up(F.coalesce(mattr, F.when(F.col("n") > 0, F.col("type_count") / n), F.lit(0.0)), 4).alias("mattr_50"),
        (F.col("n") < 1000).alias("few_tokens"),
        (F.col("sentence_count") < 3).alias("few_passages"),
    )


def log_dice(c: Column, total: Column) -> Column:
    return half_up(14 + F.log2(2.0 * c / total), 2)


def collocations(docs: DataFrame, k: int = 15, window: int = 5, profile: Profile = Profile(), stop_words: tuple[str, ...] = STOP) -> DataFrame:
    """(id, left, right, cnt, log_dice, rank): the k best pairs of content words within ``window`` tokens, the first seen first among equals.

    The words after each token come from the document's array, laid beside
    itself at each distance, so there is no join of positions.  A pair is first
    seen at its earliest left word, at the nearest distance of that.  At
    distance 0 a word meets itself: these pairs count single words, and sorts
    within the document bring their counts to both sides.
    """
    arrays = by_document(docs).select("id", tokenize(F.col("text"), profile).alias("terms"))
    placed = arrays.select("id", F.transform("terms", lambda t, i: F.struct(i.alias("pos"), t.alias("term"))).alias("terms"))

    def beside(d: int) -> Column:
        later = F.slice("terms", F.lit(d + 1), F.greatest(F.size("terms"), F.lit(1)))
        return F.zip_with("terms", later, lambda a, b: F.struct(a["pos"].alias("pos"), F.lit(d).alias("distance"), a["term"].alias("term"), b["term"].alias("other")))

    near = placed.select("id", F.explode(F.flatten(F.array(*[beside(d) for d in range(window + 1)]))).alias("p")).select("id", "p.*")
    near = near.where(is_content(F.col("term"), stop_words) & is_content(F.col("other"), stop_words) & ((F.col("other") != F.col("term")) | (F.col("distance") == 0)))
    # One number, as a struct's least would sort all pairs instead of hashing them.
    first = F.min(F.col("pos").cast("long") * (window + 1) + F.col("distance")).alias("first")
    pairs = near.groupBy("id", F.least("term", "other").alias("left"), F.greatest("term", "other").alias("right")).agg(F.count("*").alias("cnt"), first)
    single = F.col("left") == F.col("right")
    pairs = pairs.where((F.col("cnt") >= 2) | single)
    for side in ("left", "right"):
        pairs = pairs.withColumn(f"n_{side}", F.max(F.when(single, F.col("cnt"))).over(Window.partitionBy("id", side)))
    pairs = pairs.where(~single).withColumn("log_dice", log_dice(F.col("cnt"), F.col("n_left") + F.col("n_right")))
    w = Window.partitionBy("id").orderBy(F.desc("log_dice"), F.desc("cnt"), "first")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "left", "right", "cnt", "log_dice", "rank")
