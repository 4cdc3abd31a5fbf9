"""Term families: counts by document and author, rates, layers."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Profile, apply_profile, half_up, tokenize
from .concordance import family_contexts


@dataclass(frozen=True)
class Family:
    """An entry of a vocabulary: written forms, and the lemmas that stand for them in parsed texts."""

    id: str
    aliases: tuple[str, ...]
    lemmas: tuple[str, ...] = field(default=())
    label: str = ""
    description: str = ""

    def terms(self, layer: str) -> tuple[str, ...]:
        """What is counted in a layer of tokens: lemmas in one of lemmas, if there are any, else the written forms."""
        return self.lemmas if layer.startswith("lemmas") and self.lemmas else self.aliases


def load_families(spark, path: str) -> list[Family]:
    """Families of a JSON file {families: [{id, label, description, lemmas, aliases}]}, in its order, validated."""
    content = json.loads(bytes(spark.read.format("binaryFile").load(path).first().content).decode("utf-8"))
    if not isinstance(content, dict) or not isinstance(content.get("families"), list) or not content["families"]:
        raise ValueError("the vocabulary has no list of families")
    out: list[Family] = []
    for f in content["families"]:
        bare = lambda key: tuple(str(x).strip() for x in f.get(key) or [] if str(x).strip())  # noqa: B023, E731
        name, label = str(f.get("id", "")).strip(), str(f.get("label", "")).strip()
        if not name or not bare("aliases") or name in (x.id for x in out):
            raise ValueError(f"family {name!r} has no id or aliases, or its id is repeated")
        out.append(Family(name, bare("aliases"), bare("lemmas"), label or name, str(f.get("description", "")).strip()))
    return out


def parse_terms(requested: str | list[str]) -> list[str]:
    parts = re.split(r"[,;\n]+", requested) if isinstance(requested, str) else requested
    return [str(p).strip() for p in parts if str(p).strip()]


def select_families(spark, families: list[Family], requested: str | list[str], profile: Profile = Profile()) -> list[Family]:
    """Families that a requested term names by id, label or alias, compared by the profile; terms that are no alias become families of their own.

    Nothing requested means all.  The vocabulary and the request are the
    caller's own, of the driver.
    """
    wanted = parse_terms(requested)
    if not wanted:
        return list(families)
    words = sorted({*wanted, *(w for f in families for w in (f.id, f.label, *f.aliases))})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", apply_profile(F.col("w"), profile).alias("p")).collect()
    plain = {r.w: r.p for r in rows}
    asked = {plain[w] for w in wanted}
    out = [f for f in families if asked & {plain[w] for w in (f.id, f.label, *f.aliases)}]
    known, seen = {plain[a] for f in families for a in f.aliases}, {f.id for f in out}
    for term in wanted:
        name = re.sub("[^a-z0-9]+", "_", plain[term]).strip("_") or "term"
        if plain[term] not in known and name not in seen:
            seen.add(name)
            out.append(Family(f"custom_{name}", (term,), (term,), term, "given by hand"))
    return out


@dataclass
class Trie:
    """A vocabulary's token sequences as a trie.

    first: the tokens that begin a sequence, on the driver, as the vocabulary is.
    edges: (level, node, token, child), the root being node 0 of level 1.
    ends: (node, owner) for every owner of a sequence that ends in the node.
    """

    first: list[str]
    edges: DataFrame
    ends: DataFrame
    depth: int


def trie(spark, wanted: list[tuple[str, str]], profile: Profile = Profile()) -> Trie:
    """The trie of (owner, text); an owner's equal sequences count once, texts without tokens not at all."""
    rows = spark.createDataFrame(wanted, "owner string, text string").select("owner", tokenize(F.col("text"), profile).alias("t"))
    nodes: dict[tuple[str, ...], int] = {(): 0}
    ends: set[tuple[int, str]] = set()
    for owner, t in rows.where(F.size("t") > 0).collect():
        for n in range(1, len(t) + 1):
            nodes.setdefault(tuple(t[:n]), len(nodes))
        ends.add((nodes[tuple(t)], owner))
    edges = [(len(t), nodes[t[:-1]], t[-1], child) for t, child in nodes.items() if t]
    return Trie(
        sorted(t[0] for t in nodes if len(t) == 1),
        spark.createDataFrame(edges, "level int, node int, token string, child int"),
        spark.createDataFrame(sorted(ends), "node int, owner string"),
        max(map(len, nodes)),
    )


def candidates(rows: DataFrame, found: Trie, keys: list[str]) -> DataFrame:
    """(*keys, w): for each place of ``t`` whose token begins a sequence, the tokens from there, as many as the longest has.

    Places are chosen within the row, before anything is exploded; a row
    without any keeps one, with w null.
    """
    near = F.filter(F.transform("t", lambda x, i: F.when(x.isin(*found.first), i + 1)), lambda i: i.isNotNull())
    return rows.select(*keys, F.explode_outer(F.transform(near, lambda i: F.slice(F.col("t"), i, F.lit(found.depth)))).alias("w"))


def matches(rows: DataFrame, found: Trie, keys: list[str]) -> DataFrame:
    """(*keys, owner), a row for each place of ``t`` and sequence that begins there; other places and rows without any have owner null.

    ``rows`` has a column ``t`` of tokens.  Every place walks down the trie, a
    join with the small table of edges a level; all sequences that it passes
    the end of are matches, so they may overlap and hold one another.
    """
    walk = candidates(rows, found, keys).withColumn("n0", F.lit(0))
    for level in range(1, found.depth + 1):
        # The vocabulary is the caller's own, from the driver.
        step = found.edges.where(F.col("level") == level).select(F.col("node").alias(f"n{level - 1}"), F.col("token").alias("next"), F.col("child").alias(f"n{level}"))
        walk = walk.withColumn("next", F.get("w", F.lit(level - 1))).join(F.broadcast(step), [f"n{level - 1}", "next"], "left")
    passed = F.filter(F.array(*[f"n{level}" for level in range(found.depth + 1)]), lambda n: n > 0)
    return walk.select(*keys, F.explode_outer(passed).alias("node")).join(F.broadcast(found.ends), "node", "left").select(*keys, "owner")


def _tokenised(docs: DataFrame, profile: Profile, *keep: str) -> DataFrame:
    # Dealt by id, so that what is counted by document needs no further shuffle.
    return docs.select("id", *keep, "text").repartition("id").select("id", *keep, tokenize(F.col("text"), profile).alias("t"))


def _hits(rows: DataFrame, wanted: list[tuple[str, str]], profile: Profile) -> DataFrame:
    """(id, owner, cnt) over rows (id, t)."""
    each = matches(rows, trie(rows.sparkSession, wanted, profile), ["id"]).where("owner IS NOT NULL")
    return each.groupBy("id", "owner").agg(F.count("*").alias("cnt"))


def family_hits(docs: DataFrame, families: dict[str, list[str]], profile: Profile = Profile()) -> DataFrame:
    """(id, family, cnt), overlapping matches and parts of longer ones counted."""
    return _hits(_tokenised(docs, profile), [(k, a) for k, v in families.items() for a in v], profile).withColumnRenamed("owner", "family")


def _zeros_too(rows: DataFrame, found: Trie, keys: list[str], owners: Column) -> DataFrame:
    """(*keys, owner, cnt) for every row and each of its ``owners``, an array over the keys; only counts are shuffled."""
    counted = matches(rows, found, keys).groupBy(*keys, "owner").agg(F.count("*").alias("cnt"))
    own = F.filter(F.collect_list(F.struct("owner", "cnt")), lambda x: x["owner"].isNotNull())
    grid = counted.groupBy(*keys).agg(F.map_from_entries(own).alias("counts")).select(*keys, "counts", F.explode(owners).alias("owner"))
    return grid.select(*keys, "owner", F.coalesce(F.col("counts")[F.col("owner")], F.lit(0)).alias("cnt"))


def family_counts(docs: DataFrame, families: dict[str, list[str]], profile: Profile = Profile()) -> DataFrame:
    """(family, id, author, cnt, per_1000) for every family and document, zeros included; texts are read and folded once."""
    found = trie(docs.sparkSession, [(k, a) for k, v in families.items() for a in v], profile)
    rows = _tokenised(docs, profile, "author").withColumn("n", F.size("t"))
    grid = _zeros_too(rows, found, ["id", "author", "n"], F.array(*map(F.lit, families)).cast("array<string>"))
    per_1000 = half_up(1000.0 * F.col("cnt") / F.greatest("n", F.lit(1)), 3)
    return grid.select(F.col("owner").alias("family"), "id", "author", "cnt", per_1000.alias("per_1000"))


def by_author(per_document: DataFrame) -> DataFrame:
    """(author, family, cnt, documents): zeros included; an empty author is named as not stated."""
    author = F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("not stated"))
    return per_document.groupBy(author.alias("author"), "family").agg(F.sum("cnt").alias("cnt"), F.count_if(F.col("cnt") > 0).alias("documents"))


def in_order(family: Column, families: list[str]) -> Column:
    """A family's place in the vocabulary."""
    return F.array_position(F.array(*map(F.lit, families)).cast("array<string>"), family)


def totals(per_document: DataFrame, families: list[str]) -> DataFrame:
    """(family, total), the largest first, equal ones in the vocabulary's order."""
    return per_document.groupBy("family").agg(F.sum("cnt").alias("total")).orderBy(F.desc("total"), in_order(F.col("family"), families))


def highlight_forms(pairs: DataFrame, families: list[Family], profile: Profile = Profile()) -> DataFrame:
    """(id, family, forms): for documents with parsed (id, form, lemma), the forms whose lemma a family has, longest first, then by code point."""
    spark = pairs.sparkSession
    rows = [(f.id, x) for f in families for x in f.lemmas]
    lemmas = spark.createDataFrame(rows, "family string, text string").select("family", F.explode(tokenize(F.col("text"), profile)).alias("lemma")).distinct()
    found = pairs.join(F.broadcast(lemmas), "lemma").select("id", "family", "form").distinct()
    ordered = F.sort_array(F.collect_list(F.struct((-F.length("form")).alias("n"), "form")))
    return found.groupBy("id", "family").agg(F.transform(ordered, lambda x: x["form"]).alias("forms"))


def report(docs: DataFrame, layers: DataFrame, families: list[Family], profile: Profile = Profile(), contexts: int = 3) -> DataFrame:
    """A row for each family and document, families by their total, most first, and else in the vocabulary's order.

    ``layers`` is (id, source, tokens).  Columns: family, label, total, place
    (the family's), id, title, author, source, terms (those counted there),
    cnt, per_1000, contexts (of the aliases in the text).  Zero counts stay.
    """
    spark = docs.sparkSession
    kinds = [(f.id, f.label or f.id, i, kind, list(f.terms(kind))) for i, f in enumerate(families) for kind in ("forms", "lemmas")]
    named = spark.createDataFrame(kinds, "family string, label string, place int, kind string, terms array<string>")
    owner = lambda kind, family: f"{kind}\0{family}"
    found = trie(spark, [(owner(kind, family), text) for family, _, _, kind, terms in kinds for text in terms], profile)
    kind = F.when(F.col("source").startswith("lemmas"), "lemmas").otherwise("forms")
    rows = docs.select("id", "title", "author").join(layers.select("id", "source", F.col("tokens").alias("t")), "id").withColumn("kind", kind).withColumn("n", F.size("t"))
    keys = ["id", "title", "author", "source", "kind", "n"]
    own = lambda kind: F.array(*[F.lit(owner(kind, f.id)) for f in families]).cast("array<string>")
    grid = _zeros_too(rows, found, keys, F.when(F.col("kind") == "lemmas", own("lemmas")).otherwise(own("forms")))
    grid = grid.withColumn("family", F.split("owner", "\0")[1]).join(F.broadcast(named), ["kind", "family"])
    near = family_contexts(docs, {f.id: list(f.aliases) for f in families}, profile, limit=contexts)
    near = near.groupBy("family", "id").agg(F.sort_array(F.collect_list(F.struct("idx", "left", "match", "right"))).alias("contexts"))
    sums = grid.groupBy("family").agg(F.sum("cnt").alias("total"))
    out = grid.join(F.broadcast(sums), "family").join(near, ["family", "id"], "left")
    shown = ["family", "label", "total", "place", "id", "title", "author", "source", "terms", "cnt", half_up(1000.0 * F.col("cnt") / F.greatest("n", F.lit(1)), 3).alias("per_1000"), "contexts"]
    return out.orderBy(F.desc("total"), "place", "id").select(*shown)


def author_report(per_document: DataFrame) -> DataFrame:
    """(author, total, documents, families): authors by their total, first seen first among equals; families with their counts, equal ones in the vocabulary's order, zeros included."""
    author = F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("not stated"))
    each = per_document.withColumn("author", author).groupBy("author", "family", "place").agg(F.sum("cnt").alias("cnt"), F.min("id").alias("first"), F.count("*").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("order"), "place", "family", "cnt")))
    out = each.groupBy("author").agg(F.sum("cnt").alias("total"), F.max("n").alias("documents"), F.min("first").alias("first"), F.transform(listed, lambda x: F.struct(x["family"].alias("family"), x["cnt"].alias("cnt"))).alias("families"))
    return out.orderBy(F.desc("total"), "first").select("author", "total", "documents", "families")


def shown_families(totals_: DataFrame, families: list[str], first: int = 8) -> DataFrame:
    """Families with hits; where none has any, the first ones of the vocabulary."""
    hit = totals_.where("total > 0")
    return totals_.orderBy(in_order(F.col("family"), families)).limit(first) if hit.isEmpty() else hit


def documents_with_hits(per_document: DataFrame, family: str) -> DataFrame:
    return per_document.where((F.col("family") == family) & (F.col("cnt") > 0)).orderBy(F.desc("cnt"), "id")


def top_total(totals_: DataFrame, k: int = 6) -> DataFrame:
    """(total): the sum over the k families with most hits."""
    return totals_.orderBy(F.desc("total"), "family").limit(k).agg(F.sum("total").alias("total"))


def counted_terms(docs: DataFrame, families: dict[str, list[str]], profile: Profile = Profile(), k: int = 8) -> DataFrame:
    """(family, term, cnt, rank): each family's k most counted token sequences in the corpus."""
    texts = sorted({(f, a) for f, v in families.items() for a in v})
    split = docs.sparkSession.createDataFrame(texts, "family string, text string").select("family", F.array_join(tokenize(F.col("text"), profile), " ").alias("term"))
    wanted = [(f"{r.family}\0{r.term}", r.term) for r in split.where("term <> ''").distinct().collect()]  # the caller's own vocabulary
    hits = _hits(_tokenised(docs, profile), wanted, profile).groupBy("owner").agg(F.sum("cnt").alias("cnt"))
    rows = hits.select(F.split("owner", "\0")[0].alias("family"), F.split("owner", "\0")[1].alias("term"), "cnt")
    w = Window.partitionBy("family").orderBy(F.desc("cnt"), "term")  # a family has as many terms as the caller gave it
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
