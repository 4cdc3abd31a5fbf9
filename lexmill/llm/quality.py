"""Document quality by the divergence of its histograms from its language's, with DataFrame functions alone.

A document has a histogram of character classes and one of its language's most
common words.  Each is held against the language's, pooled over all documents,
by Jensen-Shannon distance.  Everything about a document is computed in its
own row, so texts are not shuffled; only word counts are, after partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, materialise, words_of

MIN_WORDS = 50
WINDOW = 3
COMMON_WORDS = 24
MAX_CLASS_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.45
#: A text in a known language with none of its common words has a distance of its own, less than MAX_WORD_DISTANCE (0.35 where they hold 22 % of
#: all words).  Texts of MIN_WORDS_FOR_ABSENCE words that come this near to it lack the language's words; of shorter ones, clean texts can too.
MAX_ABSENCE, MIN_WORDS_FOR_ABSENCE = 0.9, 100
#: Documents with fewer characters, or words, are not held against the histogram of classes, or words.
MIN_CHARS_FOR_CLASSES, MIN_WORDS_FOR_COMMON = 200, 50

#: Character classes within ``special``, as Java patterns; blanks, bytes beyond the first of a character, and the rest are three more.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "mark": "[.,;:!?'\"()-]"}
_POOLED = "\x00"
#: Buckets by hash that a language's common words are looked up in; most hold none or one.
BUCKETS = 256
#: Slots of tasks that a language's words are ranked in before they are ranked together.
SLOTS = 32


def _repeated_words(n: int = WINDOW) -> list:
    """Steps (name, Column) from ``words`` to ``n_repeat_words``.

    Windows become longs, a hash above and the place below, and are sorted;
    neighbours of equal hash are compared word by word.
    """
    place = lambda x: x.bitwiseAND(F.col("low_mask"))
    word = lambda i: F.get(F.col("words"), i)

    def same(x: Column, y: Column) -> Column:
        equal = x.bitwiseXOR(y).bitwiseAND(F.col("high_mask")) == 0
        for k in range(n):
            equal = equal & (word(place(x).cast("int") + k) == word(place(y).cast("int") + k))
        return equal  # null beyond the ends, which filters drop

    count = F.size("words") - (n - 1)
    windows = F.arrays_zip(*[F.slice("words", k + 1, F.greatest(count, F.lit(0))) for k in range(n)])
    packed = F.transform(windows, lambda w, i: F.xxhash64(w).bitwiseAND(F.col("high_mask")).bitwiseOR(i.cast("long")))
    near = lambda j: F.get(F.col("packed"), j)
    # Most windows are unlike the next one; the others' successors are looked for only where there are any.
    before = F.filter("packed", lambda x, j: same(x, near(j + 1)))
    after = F.when(F.size("before") > 0, F.filter("packed", lambda x, j: same(x, near(j - 1)))).otherwise(F.col("before"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda a, p: F.struct((p + n).alias("end"), (a["n"] + n - F.greatest(F.lit(0).cast("long"), a["end"] - p)).alias("n"))
    return [
        # 2^k - 1 for the least k with 2^k > number of words: the places' bits.
        ("low_mask", F.expr(f"shiftleft(1L, length(bin(size(words) + {n}))) - 1L")),
        ("high_mask", F.bitwise_not("low_mask")),
        ("packed", F.when(count > 0, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))),
        ("before", before),
        ("repeated", F.array_union("before", after)),
        ("n_repeat_words", F.aggregate(F.sort_array(F.transform("repeated", place)), start, add)["n"]),
    ]


def _word_chars() -> Column:
    """Code points of ``words``."""
    return F.length(F.array_join("words", "")).cast("long")


def _special(text: str = "text") -> Column:
    """What is left of a text without a-z, blanks and characters beyond ASCII: a short text to count classes in."""
    return F.regexp_replace(text, "[a-z\\x20\\x09-\\x0D\\x{80}-\\x{10FFFF}]+", "")


def _class_counts() -> list[Column]:
    """Counts by class of ``text``, given ``special``, ``n_chars`` and ``word_chars``."""
    own = [F.regexp_count("special", F.lit(p)).cast("long") for p in CLASSES.values()]
    blank = F.col("n_chars") - F.col("word_chars")
    rest = F.col("word_chars")
    for c in own:
        rest = rest - c
    return [*own, blank, F.octet_length("text") - F.col("n_chars"), rest]


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(BUCKETS - 1))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, to base 2, of two arrays of shares."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def _shares(counts: Column, total: Column) -> Column:
    """Counts as shares of ``total``, which should be a plain column: it is read for each element."""
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def _base(docs: DataFrame) -> DataFrame:
    """doc columns as __doc, language, text and words."""
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("__doc"),
        F.coalesce(F.col("lang").cast("string"), F.lit(_POOLED)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.withColumn("words", words_of(F.col("text")))


def language_references(docs: DataFrame, common_words: int = COMMON_WORDS) -> DataFrame:
    """(lang, common, word_shares, class_shares), a row for each language and one pooled over all documents.

    Every document counts.  Of equally frequent words the first by code point is taken.
    """
    base = _base(docs)
    words = base.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = materialise(words, "words")
    # Classes are counted once for each distinct word, times its number; blanks are all other characters.
    names = [f"c{i}" for i in range(len(CLASSES) + 3)]
    size = F.length("word").cast("long")
    parts = words.select("lang", "n", F.col("word").alias("text"), _special("word").alias("special"), size.alias("n_chars"), size.alias("word_chars"))
    parts = parts.select("lang", *[(F.col("n") * c).alias(x) for c, x in zip(_class_counts(), names, strict=True)], (F.col("n") * F.col("n_chars")).alias("word_chars"))
    parts = parts.groupBy("lang").agg(*[F.sum(x).alias(x) for x in [*names, "word_chars"]])
    counts = base.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("n_chars"), F.count("*").alias("docs"))
    blank = names[len(CLASSES)]
    counts = counts.join(parts, "lang", "left").withColumn(blank, F.col("n_chars") - F.coalesce("word_chars", F.lit(0)))
    counts = materialise(counts.select("lang", *[F.coalesce(x, F.lit(0)).alias(x) for x in names], "docs"), "classes")
    kept = counts.where(F.col("lang") != _POOLED)
    pooled = counts.agg(*[F.sum(x).alias(x) for x in names]).select(F.lit(_POOLED).alias("lang"), *names)
    classes = kept.select("lang", *names).unionByName(pooled)
    classes = classes.withColumn("total", sum((F.col(x) for x in names), F.lit(0))).select("lang", _shares(F.array(*names), F.col("total")).alias("class_shares"))

    # Ranked within slots of tasks first, so that a language's last ranking has SLOTS * common_words rows at most, however many tasks there are.
    top = words.where(F.col("lang") != _POOLED).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS)))
    for keys in (["lang", "slot"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
        top = top.withColumn("rank", rank).where(F.col("rank") <= common_words)
    top = materialise(top.drop("slot"), "top")
    # A word is at least as frequent in all languages as in one, so no word of the pooled list is rarer than a language's last one.
    least = top.where(F.col("rank") == common_words).agg(F.max("n")).first()[0] or 0
    all_words = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(common_words)
    top = top.drop("rank")
    top = top.unionByName(all_words.select(F.lit(_POOLED).alias("lang"), "word", "n"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("lang") != _POOLED)
    totals = totals.unionByName(words.agg(F.sum("n").alias("total")).select(F.lit(_POOLED).alias("lang"), "total"))
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "word")), False).alias("top"))
    listed = listed.join(totals, "lang").select("lang", F.col("top.word").alias("common"), F.transform("top", lambda x: x["n"] / F.col("total")).alias("word_shares"))
    return classes.join(listed, "lang", "left").select(
        "lang",
        F.coalesce("common", F.array().cast("array<string>")).alias("common"),
        F.coalesce("word_shares", F.array().cast("array<double>")).alias("word_shares"),
        "class_shares",
    )


def judge(docs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """All rows with ``__doc`` (their columns as a struct), the figures, distances and verdicts.

    Needs doc_id, text and lang.  Null texts are empty.  A null
    language uses the histograms pooled over all documents.
    """
    refs = references if references is not None else language_references(docs)
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.filter("common", lambda w: _bucket(w) == b))
    # The distance of a text without any common word; null for the pooled histogram, whose words are no sign of a text's own language.
    other = F.lit(1.0) - F.aggregate("word_shares", F.lit(0.0), lambda s, x: s + x)
    none = F.concat(F.transform("word_shares", lambda x: F.lit(0.0)), F.array(F.lit(1.0)))
    absent = F.when(F.col("lang") != _POOLED, _distance(none, F.concat("word_shares", F.array(other)))).alias("absent")
    refs = materialise(refs.select("lang", F.struct("common", buckets.alias("buckets"), "word_shares", "class_shares", absent).alias("ref")), "references")
    known = F.broadcast(refs.where(F.col("lang") != _POOLED).select("lang", F.col("ref").alias("__own")))
    pooled = F.broadcast(refs.where(F.col("lang") == _POOLED).select(F.col("ref").alias("__pooled"), F.lit(1).alias("__one")))
    rows = _base(docs).withColumn("__one", F.lit(1)).join(known, "lang", "left").join(pooled, "__one", "left")
    rows = rows.withColumn("ref", F.coalesce("__own", "__pooled")).drop("__own", "__pooled", "__one").withColumn("buckets", F.col("ref.buckets"))
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": _word_chars(),
            "special": _special(),
            "lines": F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        }
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    rows = rows.withColumn("n_symbols", F.regexp_count("special", F.lit(CLASSES["symbol"])).cast("long"))
    for name, column in _repeated_words():
        rows = rows.withColumn(name, column)
    rows = rows.drop("low_mask", "high_mask", "packed", "before", "repeated")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("classes", F.array(*[c.cast("long") for c in _class_counts()]))
    # All classes' sum: bytes beyond the first of a character are a class of their own.
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("class_shares", _shares(F.col("classes"), F.col("n_bytes")))
    rows = rows.withColumn("class_distance", _distance(F.col("class_shares"), F.col("ref.class_shares"))).drop("special", "classes", "class_shares")
    rows = rows.withColumn("common", F.filter("words", lambda w: F.array_contains(F.get("buckets", _bucket(w)), w)))
    rows = rows.drop("words", "buckets")
    found = F.transform("ref.common", lambda r: (F.size("common") - F.size(F.array_remove("common", r))).cast("long"))
    rows = rows.withColumn("own", found)
    rest = F.col("n_words") - F.size("common")
    other = F.lit(1.0) - F.aggregate("ref.word_shares", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("own", F.concat("own", F.array(rest.cast("long")))).withColumn("own_shares", _shares(F.col("own"), F.col("n_words")))
    rows = rows.withColumn("word_distance", _distance(F.col("own_shares"), F.concat("ref.word_shares", F.array(other)))).drop("common", "own", "own_shares")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd_class = (F.col("n_chars") >= MIN_CHARS_FOR_CLASSES) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    odd_words = (F.col("n_words") >= MIN_WORDS_FOR_COMMON) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    lacking = (F.col("n_words") >= MIN_WORDS_FOR_ABSENCE) & (F.col("word_distance") > MAX_ABSENCE * F.col("ref.absent"))
    odd_words = odd_words | F.coalesce(lacking, F.lit(False))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~(failed | odd_class | odd_words)).drop("ref", "text", "n_chars", "n_bytes")


def quality_report(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and both distances.

    Repeated rows give repeated rows, an empty table none; columns other than
    doc_id, text and lang are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    return judge(docs).select(F.col("__doc.doc_id").cast("long").alias("doc_id"), *names)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    # A filter on a column that is not deterministic is not pushed down, which would copy the steps above into it again and again.
    held = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return judge(docs).withColumn("kept", held).where("kept").select("__doc.*")
