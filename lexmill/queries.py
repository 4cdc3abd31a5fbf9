"""Queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import TOKEN, Profile, apply_profile, normalize_whitespace
from .operators import conllu, concordance, corpus, diff, features, lexicon, linkage, nearest, passages, terms, views
from .sources import datasources, exports

#: A vocabulary for the test data: single words, a sequence, and one that never occurs.
FAMILIES = {"articles": ["the", "der", "die", "la", "le"], "joining": ["and", "und", "et", "of the", "in the"], "place": ["in", "on", "de la"], "absent": ["zzyzx"]}
KWIC_QUERY, SEARCH, ORDER = "tion of", "src1", [30, 10, 20, 10]
Query = Callable[[SparkSession, str], DataFrame]
docs = corpus.load


def shared_folder(s: SparkSession) -> str:
    """A new folder in that of ``spark.checkpoint.dir``, or of the warehouse where that is unset."""
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir() or s.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/lexmill-{uuid.uuid4().hex}"


def _features(kind: str, number: int = 100) -> Query:
    return lambda s, d: _plain(features.feature_table(docs(s, d), kind, number)).select("id", "feature", "feature_rank", _six("freq"))


def _six(name: str):
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("feature_rank", F.col("feature_rank").cast("long")) if "feature_rank" in df.columns else df


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Runs made of events: every event a run over three documents."""
    e = s.read.parquet(f"{d}/events.parquet")
    ids = F.to_json(F.array(*[F.pmod(F.col("event_id") * k, F.lit(200)) for k in (1, 7, 13)]))
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), ids.alias("document_ids"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def _spans(s: SparkSession, d: str) -> DataFrame:
    """Annotations made of events: three overlapping spans in every document's events."""
    e = s.read.parquet(f"{d}/events.parquet")
    start = F.pmod(F.col("event_id") * 31, F.lit(997)).cast("int")
    return e.select(F.col("event_id").alias("id"), F.pmod("event_id", F.lit(500)).alias("document_id"), start.alias("start_offset"), (start + 5 + F.pmod("event_id", F.lit(40)).cast("int")).alias("end_offset"))


#: Two groups of documents whose shared terms are asked for.
GROUPS = ([1, 2, 3, 4, 5], [6, 7, 8, 9])
VOCABULARY = [terms.Family(k, tuple(v), (), k.title()) for k, v in FAMILIES.items()]


def _layers(s: SparkSession, d: str) -> DataFrame:
    return conllu.token_layer(conllu.to_conllu(docs(s, d)), parser="rules")


def _report(s: SparkSession, d: str) -> DataFrame:
    return terms.report(docs(s, d), conllu.token_layer(docs(s, d), parser="forms"), VOCABULARY)


def _nearest(s: SparkSession, d: str) -> DataFrame:
    table = features.feature_table(docs(s, d))
    near = nearest.nearest_pairs(table, 8, shared_folder(s))
    return views.distance_table(near, features.contributors(table, near)).withColumn("features", F.array_join("features", " "))


def _content_table(s: SparkSession, d: str) -> DataFrame:
    return features.feature_table(docs(s, d), "content", 120)


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return conllu.read_conllu(conllu.to_conllu(docs(s, d)))


def sentences_of_ten(found: DataFrame) -> DataFrame:
    """(conllu): documents as sentences of ten tokens with relations and features by place, the first word of each heading a range."""
    each = lexicon.by_document(found).select("id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "form"))
    at = (F.col("pos") % 10 + 1).alias("at")
    relation = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("pos") % 10 + 1).cast("int"))
    head = F.when(F.col("pos") % 10 == 1, "0").otherwise("2")
    line = F.concat_ws("\t", at.cast("string"), "form", F.lower("form"), F.lit("X"), F.lit("_"), F.when(at == 1, "Case=Nom|Number=Sing|Case=Acc").otherwise("_"), head, relation, F.lit("_"), F.lit("_"))
    line = F.when(at == 1, F.concat(F.lit("1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n"), line, F.lit("\n1.1\te\t_\t_\t_\t_\t_\t_\t_\t_"))).otherwise(line)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    blocks = each.groupBy("id", F.floor(F.col("pos") / 10).alias("sent")).agg(F.array_join(lines, "\n").alias("block"))
    block = F.concat(F.lit("# sent_id = "), "id", F.lit("-"), "sent", F.lit("\n"), "block", F.lit("\n\n"))
    # A file for each document.
    texts = blocks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sent", block.alias("block")))).alias("b"))
    return texts.select(F.array_join(F.transform("b", lambda x: x["block"]), "").alias("conllu"))


def _written_overview(s: SparkSession, d: str) -> DataFrame:
    """Documents written as compressed CoNLL-U files, as plain ones take seven times the text, and read again, with the words of each sentence's parts and the subject's features."""
    path = f"{shared_folder(s)}/conllu"
    datasources.write_files(sentences_of_ten(docs(s, d)), path, ".conllu.gz")
    parsed = conllu.read_conllu(datasources.read_sentences(s, path, 1 << 16).select(F.col("sent_id").alias("id"), "conllu"))
    subject = parsed.where("token_id = 1").select("id", conllu.feature_label(F.col("features")).alias("features"))
    return conllu.overview(parsed).join(subject, "id").select("id", "bucket", "forms", "features")


#: Relations of the ten tokens of a sentence, for the query of written files.
RELATIONS = ("nsubj", "root", "obj", "dep", "advcl", "dep", "obl:arg", "nsubj:pass", "punct", "xcomp")

QUERIES: dict[str, Query] = {
    "doc_search": lambda s, d: corpus.search(docs(s, d), SEARCH).select("id", "title"),
    "doc_request_order": lambda s, d: corpus.in_request_order(docs(s, d), ORDER).select("pos", "id", "title"),
    "doc_by_ids": lambda s, d: corpus.by_ids(docs(s, d), ORDER).select("id", "title"),
    "doc_lookup": lambda s, d: corpus.by_id(docs(s, d), 7).select("id", "title", "author", "genre", F.md5("text").alias("text_md5")),
    "doc_warnings": lambda s, d: corpus.warnings(docs(s, d)),
    "annotations_of_document": lambda s, d: corpus.annotations_of(_spans(s, d), 7),
    "run_lookup": lambda s, d: corpus.run_by_id(_runs(s, d).withColumn("parameters", F.lit("{broken")), 11).select("id", "kind", F.array_join(F.transform("document_ids", lambda x: x.cast("string")), ",").alias("ids"), F.coalesce(F.json_array_length(F.to_json("parameters")), F.size(F.json_object_keys(F.to_json("parameters")))).cast("long").alias("n_parameters")),
    "token_offsets": lambda s, d: lexicon.token_offsets(docs(s, d)).select("id", F.col("pos").cast("long").alias("pos"), "term", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")),
    "frequency_rates": lambda s, d: lexicon.frequency_table(docs(s, d), content_only=True),
    "lemma_layers": lambda s, d: _layers(s, d).select("id", "source", "coverage", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("md5")),
    "form_lemma_pairs": lambda s, d: conllu.form_lemma_pairs(conllu.to_conllu(docs(s, d))).groupBy("form", "lemma").agg(F.count("*").alias("cnt")),
    "term_report": lambda s, d: _report(s, d).select("family", "label", "total", "id", "title", "source", "cnt", "per_1000"),
    "term_authors": lambda s, d: terms.author_report(_report(s, d)).select("author", "total", "documents", F.array_join(F.transform("families", lambda x: F.concat(x["family"], F.lit("="), x["cnt"])), ",").alias("families")),
    "term_top_total": lambda s, d: terms.top_total(terms.totals(terms.family_counts(docs(s, d), FAMILIES), list(FAMILIES)), 2),
    "term_counted": lambda s, d: terms.counted_terms(docs(s, d), FAMILIES, k=2),
    "nearest_pairs_top8": _nearest,
    "affinity_top8": lambda s, d: views.affinity_table(nearest.nearest_pairs(_content_table(s, d), 8, shared_folder(s), "cosine")),
    "affinity_close": lambda s, d: nearest.pairs_within(_content_table(s, d), 0.05, shared_folder(s), measures=("cosine",)),
    "shared_cluster_terms": lambda s, d: features.shared_terms(lexicon.content(lexicon.counts(lexicon.tokens(docs(s, d)))), *GROUPS),
    "corpus_text": lambda s, d: exports.corpus_text(docs(s, d).where(F.col("id").isin(ORDER))).select(F.md5("text").alias("md5")),
    "doc_serialized": lambda s, d: corpus.serialized(docs(s, d)),
    "text_normalized": lambda s, d: docs(s, d).select("id", F.md5(apply_profile(F.col("text"), Profile(j_to_i=True, v_to_u=True))).alias("md5")),
    "token_frequency_top18": lambda s, d: lexicon.top_per_document(lexicon.counts(lexicon.tokens(docs(s, d)))),
    "content_frequency_top18": lambda s, d: lexicon.top_per_document(lexicon.counts(lexicon.content(lexicon.tokens(docs(s, d))))),
    "corpus_frequency_top100": lambda s, d: lexicon.corpus_top(lexicon.tokens(docs(s, d))),
    "char_trigrams_top20": lambda s, d: lexicon.top_per_document(lexicon.trigram_counts(docs(s, d)), 20),
    "passages": lambda s, d: lexicon.passage_rows(docs(s, d)).select("id", F.col("passage_idx").cast("long").alias("passage_idx"), F.md5("passage").alias("md5")),
    "lexicon_summary": lambda s, d: lexicon.summary(docs(s, d)),
    "collocations_top15": lambda s, d: lexicon.collocations(docs(s, d)),
    "kwic": lambda s, d: concordance.kwic(docs(s, d), KWIC_QUERY),
    "kwic_indexed": lambda s, d: concordance.gram_index(docs(s, d), shared_folder(s)).kwic(KWIC_QUERY),
    "term_family_counts": lambda s, d: terms.family_counts(docs(s, d), FAMILIES),
    "term_family_by_author": lambda s, d: terms.by_author(terms.family_counts(docs(s, d), FAMILIES)),
    "term_family_totals": lambda s, d: terms.totals(terms.family_counts(docs(s, d), FAMILIES), list(FAMILIES)),
    "term_contexts": lambda s, d: concordance.family_contexts(docs(s, d), FAMILIES),
    "feature_table_words": _features("words"),
    "feature_table_function": _features("function"),
    "feature_table_char3": _features("char3"),
    "feature_zscores": lambda s, d: features.zscores(features.feature_table(docs(s, d))).select("id", "feature", (F.floor(F.col("z") * 1e4 + 0.5) / 1e4).alias("z")),
    "document_profiles": lambda s, d: features.document_profiles(features.feature_table(docs(s, d))),
    "delta_cosine_pairs": lambda s, d: features.pair_distances(features.feature_table(docs(s, d))),
    "affinity_pairs": lambda s, d: features.pair_distances(_content_table(s, d), ("cosine",)).select("left_id", "right_id", "cosine", F.greatest(F.lit(0.0), 1 - F.col("cosine")).alias("affinity")),
    "auto_feature_count": lambda s, d: features.auto_feature_count(docs(s, d)),
    "pca_points": lambda s, d: features.pca(features.feature_table(docs(s, d)))[0],
    "pca_loadings": lambda s, d: features.pca(features.feature_table(docs(s, d)))[1],
    "cluster_merges": lambda s, d: linkage.merges(_content_table(s, d), features.feature_counts(docs(s, d), "content")[0], folder=shared_folder(s)),
    "tfidf_terms": lambda s, d: passages.tfidf(passages.passage_terms(docs(s, d)), shared_folder(s)).select("id", F.col("passage_idx").cast("long").alias("passage_idx"), "term", "tf", "df", (F.floor(F.col("weight") * 1e4 + 0.5) / 1e4).alias("weight")),
    "similar_passages_top30": lambda s, d: passages.similar(docs(s, d), path=shared_folder(s)).select("id", F.col("passage_idx").cast("long").alias("passage_idx"), "id2", F.col("idx2").cast("long").alias("idx2"), "similarity", F.array_join("shared_terms", " ").alias("shared_terms")),
    "text_diff": lambda s, d: diff.diff(diff.nearest_copies(docs(s, d))),
    "rule_lemmas": lambda s, d: conllu.parse_tokens(docs(s, d)).groupBy("lemma").agg(F.count("*").alias("cnt")),
    "conllu_tokens": lambda s, d: _parsed(s, d).select("id", F.col("token_id").cast("long").alias("token_id"), "form", "lemma", F.col("head").cast("long").alias("head"), "relation"),
    "head_lookup": lambda s, d: conllu.heads(_parsed(s, d).select("id", "sent", "token_id", "form", "head")).select("id", F.col("token_id").cast("long").alias("token_id"), "form", "head_form"),
    "sentence_overview": lambda s, d: conllu.overview(_parsed(s, d)).select("id", "bucket", "forms"),
    "conllu_files": _written_overview,
    "annotation_spans": lambda s, d: corpus.merged_spans(_spans(s, d)),
    "tei_export": lambda s, d: exports.tei(docs(s, d)).select("id", F.md5("xml").alias("md5")),
    "text_export": lambda s, d: exports.text_files(docs(s, d)).select("id", "file_name", F.md5("content").alias("md5")),
    "run_history": lambda s, d: corpus.run_history(_runs(s, d), docs(s, d)).select("run_id", "kind", "created_at", F.array_join("titles", ",").alias("titles")),
    "project_audit": lambda s, d: corpus.project_audit(docs(s, d).withColumn("source_name", F.col("author")), SEARCH.upper()).select("documents", "name_in_documents"),
    "corpus_audit": lambda s, d: corpus.audit(docs(s, d)),
}

_STOP = "(" + ", ".join(f"'{w}'" for w in lexicon.STOP) + ")"
_FOLD = "replace(lower(coalesce(text, '')), 'ß', 'ss')"
_ARR = r"arr AS (SELECT doc_id AS id, source AS author, regexp_extract_all(" + _FOLD + r", '[\p{L}\p{Nl}\p{No}]+') AS t FROM documents)"
_TOK = _ARR + ", tok AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM arr)"
_CNT = _TOK + ", cnt AS (SELECT id, term, count(*) AS cnt, min(pos) AS first_pos FROM tok GROUP BY id, term)"
_DOCS = "docs AS (SELECT doc_id AS id, 'doc ' || doc_id AS title, source AS author, lang AS genre, coalesce(text, '') AS text FROM documents)"
_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\s*\n\s*\n\s*', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_TOP = "SELECT id, term, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cnt DESC, first_pos) AS rank FROM {0}) WHERE rank <= {1}"
_GRAMS = r""", line AS (SELECT doc_id AS id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\s+', ' ', 'g')) AS s FROM documents),
    gram AS (SELECT id, substr(s, i, 3) AS term, i AS pos FROM (SELECT id, s, unnest(generate_series(1, length(s) - 2)) AS i FROM line) WHERE trim(substr(s, i, 3)) <> ''),
    gcnt AS (SELECT id, term, count(*) AS cnt, min(pos) AS first_pos FROM gram GROUP BY id, term)"""
_PASSAGES = r"""first AS (SELECT doc_id AS id, coalesce(text, '') AS text,
        string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n\n+') AS p,
        string_split_regex(regexp_replace(coalesce(text, ''), '([.;])[ \t]*\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+') AS q FROM documents),
    kept AS (SELECT id, list_filter(list_transform(p, lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: len(regexp_extract_all(x, '[\p{L}\p{Nl}\p{No}]+')) >= 5) AS p,
        list_filter(list_transform(q, lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: len(regexp_extract_all(x, '[\p{L}\p{Nl}\p{No}]+')) >= 5) AS q FROM first),
    psg AS (SELECT id, CASE WHEN len(p) >= 2 THEN p ELSE q END AS p FROM kept)"""


def _feature_sql(cnt: str, where: str, scale: str, number: int, size: str | None = None) -> str:
    return f"""top AS (SELECT term, row_number() OVER (ORDER BY sum(cnt) DESC, min((id, first_pos))) - 1 AS feature_rank FROM {cnt} WHERE {where} GROUP BY term
            QUALIFY feature_rank < {number}),
        size AS (SELECT d.doc_id AS id, coalesce(sum(c.cnt), 0) AS size FROM documents d LEFT JOIN {size or cnt} c ON c.id = d.doc_id GROUP BY 1),
        feat AS (SELECT s.id, t.term AS feature, t.feature_rank, coalesce(c.cnt, 0) AS cnt, coalesce(c.cnt, 0) * {scale} / greatest(s.size, 1) AS freq
            FROM size s CROSS JOIN top t LEFT JOIN {cnt} c ON c.id = s.id AND c.term = t.term)"""


_FAMILY = "(VALUES " + ", ".join(f"('{k}', '{a}', {len(a.split())})" for k, v in FAMILIES.items() for a in v) + ") AS v(family, term, n)"
_FAM = f"""{_ARR}, grams AS (SELECT id, n, array_to_string(t[i:i + n - 1], ' ') AS term FROM (SELECT id, t, n, unnest(generate_series(1, len(t) - n + 1)) AS i FROM arr, (VALUES (1), (2)) AS s(n))),
    hits AS (SELECT g.id, v.family, count(*) AS cnt FROM grams g JOIN {_FAMILY} USING (n, term) GROUP BY ALL),
    fam AS (SELECT f.family, a.id, a.author, coalesce(h.cnt, 0) AS cnt, floor(1000.0::DOUBLE * coalesce(h.cnt, 0) / greatest(len(a.t), 1) * 1000 + 0.5) / 1000 AS per_1000
        FROM arr a CROSS JOIN (SELECT DISTINCT family FROM {_FAMILY}) f LEFT JOIN hits h ON h.id = a.id AND h.family = f.family)"""
_Z = _CNT + ", " + _feature_sql("cnt", "true", "1000.0::DOUBLE", 100) + ", z AS (SELECT *, CASE WHEN stddev_pop(freq) OVER w > 1e-12 THEN (freq - avg(freq) OVER w) / stddev_pop(freq) OVER w ELSE 0 END AS z FROM feat WINDOW w AS (PARTITION BY feature))"
_PAIRS = """sums AS (SELECT a.id AS left_id, b.id AS right_id, floor(sum(floor(abs(a.z - b.z) * 1e4 + 0.5)) / count(*) + 0.5) / 1e4 AS delta,
        sum(a.cnt * b.cnt)::DOUBLE AS dot, sqrt(sum(a.cnt * a.cnt)::DOUBLE * sum(b.cnt * b.cnt)::DOUBLE) AS root FROM z a JOIN z b ON a.feature = b.feature AND a.id < b.id GROUP BY a.id, b.id),
        pairs AS (SELECT left_id, right_id, delta, CASE WHEN root > 0 THEN floor(1e4 * (root - dot) / root + 0.5) / 1e4 ELSE 1 END AS cosine FROM sums)"""
_AFFINITY = f"{_CNT}, con AS (SELECT * FROM cnt WHERE length(term) > 2 AND term NOT IN {_STOP}), " + _feature_sql("con", "true", "1000.0::DOUBLE", 120) + ", z AS (SELECT *, 0.0::DOUBLE AS z FROM feat), " + _PAIRS
_TFIDF = f"""{_PASSAGES}, e AS (SELECT id, generate_subscripts(p, 1) - 1 AS passage_idx, unnest(p) AS s FROM psg),
    w AS (SELECT id, passage_idx, unnest(regexp_extract_all(replace(lower(s), 'ß', 'ss'), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS term FROM e),
    tf AS (SELECT id, passage_idx, term, count(*) AS tf FROM w WHERE length(term) > 2 AND term NOT IN {_STOP} GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT id, passage_idx FROM tf))"""
_LEMMA = (
    "CASE " + " ".join(f"WHEN v = '{k}' THEN '{x}'" for k, x in conllu.LEMMAS.items())
    + "".join(f" WHEN length(v) > 6 AND v LIKE '%{e}' THEN left(v, length(v) - {len(e)}) || '{r}'" for e, r in conllu.ENDINGS)
    + "".join(f" WHEN length(v) > 5 AND v LIKE '%{e}' THEN left(v, length(v) - {len(e)})" for e in conllu.ENCLITICS)
    + " ELSE v END"
)
_PARSED = rf"""forms AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS t FROM documents),
    each AS (SELECT id, unnest(t) AS form, generate_subscripts(t, 1) AS token_id FROM forms),
    parsed AS (SELECT id, token_id, form, {_LEMMA} AS lemma, token_id - 1 AS head, CASE WHEN token_id = 1 THEN 'root' ELSE 'dep' END AS relation
        FROM (SELECT *, replace(replace(lower(form), 'ß', 'ss'), 'j', 'i') AS v FROM each))"""
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

SQL: dict[str, str] = {
    "doc_search": f"WITH {_DOCS} SELECT id, title FROM docs WHERE contains(lower(concat_ws(' ', title, author, genre, '')), '{SEARCH}')",
    "doc_request_order": f"WITH {_DOCS} SELECT w.pos, d.id, d.title FROM docs d JOIN (VALUES " + ", ".join(f"({i}, {x})" for i, x in enumerate(ORDER)) + ") AS w(pos, id) ON w.id = d.id",
    "doc_serialized": f"WITH {_ARR}, {_DOCS} SELECT d.id, d.title, coalesce(d.author, '') AS author, coalesce(d.genre, '') AS genre, '' AS date_label, '' AS period, '' AS place, '' AS witness, '' AS source_name, '' AS source_hash, '' AS source_type, '' AS notes, '' AS created_at, '' AS conllu_source, false AS is_demo, len(a.t) AS token_count, false AS has_syntax, md5({_WS.format('d.text')}) AS text_md5 FROM docs d JOIN arr a ON a.id = d.id",
    "text_normalized": f"SELECT doc_id AS id, md5({_WS.format('translate(' + _FOLD + ', ' + chr(39) + 'jJvV' + chr(39) + ', ' + chr(39) + 'iIuU' + chr(39) + ')')}) AS md5 FROM documents",
    "token_frequency_top18": f"WITH {_CNT} {_TOP.format('cnt', 18)}",
    "content_frequency_top18": f"WITH {_CNT}, c AS (SELECT * FROM cnt WHERE length(term) > 2 AND term NOT IN {_STOP}) {_TOP.format('c', 18)}",
    "corpus_frequency_top100": f"WITH {_TOK} SELECT term, count(*) AS cnt FROM tok GROUP BY term ORDER BY cnt DESC, min((id, pos)) LIMIT 100",
    "char_trigrams_top20": f"WITH {_TOK}{_GRAMS} {_TOP.format('gcnt', 20)}",
    "passages": f"WITH {_PASSAGES} SELECT id, generate_subscripts(p, 1) - 1 AS passage_idx, md5(unnest(p)) AS md5 FROM psg",
    "lexicon_summary": f"""WITH {_CNT}, {_PASSAGES},
        seen AS (SELECT t.id, t.pos, coalesce(lag(t.pos) OVER (PARTITION BY t.id, t.term ORDER BY t.pos), -1) AS q, len(a.t) AS n FROM tok t JOIN arr a ON a.id = t.id),
        m AS (SELECT id, CASE WHEN any_value(n) <= 50 THEN count(*) FILTER (q = -1) / any_value(n)
            ELSE sum(greatest(0, least(pos, n - 50) - greatest(q + 1, pos - 49, 0) + 1)) / ((any_value(n) - 49) * 50.0::DOUBLE) END AS mattr FROM seen GROUP BY id),
        f AS (SELECT id, count(*) AS types, sum(cnt * length(term)) AS letters FROM cnt GROUP BY id)
        SELECT a.id, len(a.t) AS token_count, coalesce(f.types, 0) AS type_count, len(p.p) AS sentence_count,
            CASE WHEN len(a.t) > 0 THEN floor(f.letters / len(a.t)::DOUBLE * 100 + 0.5) / 100 ELSE 0 END AS average_word_length,
            CASE WHEN len(p.p) > 0 THEN floor(len(a.t)::DOUBLE / len(p.p) * 100 + 0.5) / 100 ELSE 0 END AS average_sentence_length,
            CASE WHEN len(a.t) > 0 THEN floor(f.types / len(a.t)::DOUBLE * 10000 + 0.5) / 10000 ELSE 0 END AS ttr,
            floor(coalesce(m.mattr, 0) * 10000 + 0.5) / 10000 AS mattr_50, len(a.t) < 1000 AS few_tokens, len(p.p) < 3 AS few_passages
        FROM arr a JOIN psg p ON p.id = a.id LEFT JOIN f ON f.id = a.id LEFT JOIN m ON m.id = a.id""",
    "collocations_top15": f"""WITH {_CNT}, c AS (SELECT * FROM tok WHERE length(term) > 2 AND term NOT IN {_STOP}),
        pairs AS (SELECT a.id, least(a.term, b.term) AS "left", greatest(a.term, b.term) AS "right", count(*) AS cnt, min((a.pos, b.pos)) AS first
            FROM c a JOIN c b ON a.id = b.id AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 AND a.term <> b.term GROUP BY ALL HAVING count(*) >= 2),
        s AS (SELECT p.*, floor((14 + log2(2.0::DOUBLE * p.cnt / (l.cnt + r.cnt))) * 100 + 0.5) / 100 AS log_dice
            FROM pairs p JOIN cnt l ON l.id = p.id AND l.term = p."left" JOIN cnt r ON r.id = p.id AND r.term = p."right")
        SELECT * EXCLUDE (first) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY log_dice DESC, cnt DESC, first) AS rank FROM s) WHERE rank <= 15""",
    "term_family_counts": f"WITH {_FAM} SELECT * FROM fam",
    "term_family_by_author": f"WITH {_FAM} SELECT coalesce(nullif(author, ''), 'not stated') AS author, family, sum(cnt)::BIGINT AS cnt, count(*) FILTER (cnt > 0) AS documents FROM fam GROUP BY 1, 2",
    "term_family_totals": f"WITH {_FAM} SELECT family, sum(cnt)::BIGINT AS total FROM fam GROUP BY 1",
    "feature_table_words": f"WITH {_CNT}, {_feature_sql('cnt', 'true', '1000.0::DOUBLE', 100)} SELECT id, feature, feature_rank, floor(freq * 1e6 + 0.5) / 1e6 AS freq FROM feat",
    "feature_table_function": f"WITH {_CNT}, fun AS (SELECT * FROM cnt WHERE term IN {_STOP}), {_feature_sql('fun', 'true', '1000.0::DOUBLE', 100, 'cnt')} SELECT id, feature, feature_rank, floor(freq * 1e6 + 0.5) / 1e6 AS freq FROM feat",
    "feature_table_char3": f"WITH {_TOK}{_GRAMS}, {_feature_sql('gcnt', 'true', '10000.0::DOUBLE', 100)} SELECT id, feature, feature_rank, floor(freq * 1e6 + 0.5) / 1e6 AS freq FROM feat",
    "feature_zscores": f"WITH {_Z} SELECT id, feature, floor(z * 1e4 + 0.5) / 1e4 AS z FROM z",
    "document_profiles": f"WITH {_CNT}, {_feature_sql('cnt', 'true', '1000.0::DOUBLE', 100)} SELECT id, feature, value, rank FROM (SELECT id, feature, floor(freq * 1000 + 0.5) / 1000 AS value, row_number() OVER (PARTITION BY id ORDER BY floor(freq * 1000 + 0.5) / 1000 DESC, feature_rank) AS rank FROM feat WHERE freq > 0) WHERE rank <= 10",
    "tfidf_terms": f"WITH {_TFIDF} SELECT tf.id, tf.passage_idx, tf.term, tf.tf, df.df, floor(tf.tf * (ln((n.n + 1) / (df.df + 1)) + 1) * 1e4 + 0.5) / 1e4 AS weight FROM tf JOIN df USING (term), n",
    "rule_lemmas": f"WITH {_PARSED} SELECT lemma, count(*) AS cnt FROM parsed GROUP BY lemma",
    "conllu_tokens": f"WITH {_PARSED} SELECT id, token_id, form, lemma, head, relation FROM parsed",
    "head_lookup": f"WITH {_PARSED} SELECT a.id, a.token_id, a.form, b.form AS head_form FROM parsed a LEFT JOIN parsed b ON b.id = a.id AND b.token_id = a.head",
    "sentence_overview": f"WITH {_PARSED} SELECT id, 'root' AS bucket, form AS forms FROM parsed WHERE token_id = 1",
    "tei_export": rf"""WITH {_DOCS}, n AS (SELECT *, list_transform(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S')), lambda p: '      <p>' || {_ESC.format('p')} || '</p>') AS body FROM docs)
        SELECT id, md5(concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<TEI xmlns="http://www.tei-c.org/ns/1.0">', chr(10), '  <teiHeader>', chr(10), '    <fileDesc>', chr(10), '      <titleStmt>', chr(10),
            '        <title>', {_ESC.format('title')}, '</title>', chr(10), '        <author>', CASE WHEN coalesce(author, '') = '' THEN 'ignoto' ELSE {_ESC.format('author')} END, '</author>', chr(10), '      </titleStmt>', chr(10),
            '      <publicationStmt>', chr(10), '        <p>{exports.PUBLICATION}</p>', chr(10), '      </publicationStmt>', chr(10), '      <sourceDesc>', chr(10), '        <msDesc>', chr(10), '          <msIdentifier>', chr(10),
            '            <settlement></settlement>', chr(10), '            <idno></idno>', chr(10), '          </msIdentifier>', chr(10), '          <history><origin><origDate></origDate></origin></history>', chr(10),
            '        </msDesc>', chr(10), '      </sourceDesc>', chr(10), '    </fileDesc>', chr(10), '    <profileDesc>', chr(10), '      <textClass><keywords><term>', {_ESC.format("coalesce(genre, '')")}, '</term></keywords></textClass>', chr(10),
            '    </profileDesc>', chr(10), '  </teiHeader>', chr(10), '  <text>', chr(10), '    <body>', chr(10), array_to_string(body, chr(10)), chr(10), '    </body>', chr(10), '  </text>', chr(10), '</TEI>', chr(10))) AS md5 FROM n""",
    "text_export": f"""WITH {_DOCS} SELECT id, 'doc_' || id || '.txt' AS file_name,
        md5('Title: ' || title || chr(10) || 'Author: ' || coalesce(nullif(author, ''), 'attribuzione non indicata') || chr(10) || 'Date: non indicata' || chr(10) || 'Genre: ' || coalesce(nullif(genre, ''), 'non indicato') || chr(10) || chr(10) || {_WS.format('text')}) AS md5 FROM docs""",
    "corpus_text": f"""WITH {_DOCS} SELECT md5(string_agg('Title: ' || title || chr(10) || 'Author: ' || coalesce(nullif(author, ''), 'attribuzione non indicata') || chr(10) || chr(10) || {_WS.format('text')}, chr(10) || chr(10) || '-----' || chr(10) || chr(10) ORDER BY id)) AS md5
        FROM docs WHERE id IN ({', '.join(map(str, ORDER))})""",
    "doc_by_ids": f"WITH {_DOCS} SELECT id, title FROM docs WHERE id IN ({', '.join(map(str, ORDER))})",
    "doc_warnings": f"""WITH {_ARR}, {_DOCS} SELECT * FROM (SELECT 'short' AS warning, (SELECT count(*) FROM arr WHERE len(t) < 1000) AS detail UNION ALL
        SELECT 'genres', (SELECT count(DISTINCT nullif(genre, '')) FROM docs)) WHERE detail > CASE warning WHEN 'short' THEN 0 ELSE 1 END""",
    "annotations_of_document": "SELECT event_id AS id, event_id % 500 AS document_id, (event_id * 31 % 997)::INT AS start_offset, (event_id * 31 % 997 + 5 + event_id % 40)::INT AS end_offset FROM events WHERE event_id % 500 = 7",
    "annotation_spans": """WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start_offset, end_offset, id) AS k FROM
            (SELECT event_id AS id, event_id % 500 AS document_id, (event_id * 31 % 997)::INT AS start_offset, (event_id * 31 % 997 + 5 + event_id % 40)::INT AS end_offset FROM events)),
        walk AS (SELECT *, true AS kept, end_offset AS upto FROM s WHERE k = 1 UNION ALL
            SELECT s.*, s.start_offset >= w.upto, CASE WHEN s.start_offset >= w.upto THEN s.end_offset ELSE w.upto END FROM walk w JOIN s ON s.document_id = w.document_id AND s.k = w.k + 1)
        SELECT document_id, start_offset, end_offset, id FROM walk WHERE kept""",
    "run_lookup": "SELECT event_id AS id, event_type AS kind, concat_ws(',', event_id % 200, event_id * 7 % 200, event_id * 13 % 200) AS ids, 0::BIGINT AS n_parameters FROM events WHERE event_id = 11",
    "kwic": f"""WITH {_DOCS}, p AS (SELECT id, text, string_split_regex(text, '(?i){KWIC_QUERY}') AS p FROM docs),
        h AS (SELECT id, text, list_sum(list_transform(p[1:i], lambda x: length(x)))::INT + (i - 1)::INT * {len(KWIC_QUERY)} AS start FROM (SELECT id, text, p, unnest(generate_series(1, len(p) - 1)) AS i FROM p))
        SELECT id, start, substr(text, greatest(start - 72, 0) + 1, least(start, 72)) AS "left", substr(text, start + 1, {len(KWIC_QUERY)}) AS "match", substr(text, start + {len(KWIC_QUERY) + 1}, 72) AS "right" FROM h ORDER BY id, start LIMIT 100""",
    "token_offsets": rf"""WITH {_ARR}, gaps AS (SELECT doc_id AS id, string_split_regex({_FOLD}, '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS g FROM documents),
        e AS (SELECT a.id, i - 1 AS pos, t[i] AS term, length(g[i]) AS gap FROM (SELECT arr.id, t, g, unnest(generate_series(1, len(t))) AS i FROM arr JOIN gaps USING (id)) a),
        f AS (SELECT *, sum(gap + length(term)) OVER (PARTITION BY id ORDER BY pos)::BIGINT AS "end" FROM e)
        SELECT id, pos, term, "end" - length(term) AS start, "end" FROM f""",
    "frequency_rates": f"""WITH {_CNT}, n AS (SELECT id, sum(cnt) AS n FROM cnt GROUP BY id), c AS (SELECT * FROM cnt WHERE length(term) > 2 AND term NOT IN {_STOP}), top AS ({_TOP.format('c', 18)})
        SELECT t.*, floor(1000.0::DOUBLE * cnt / n * 1000 + 0.5) / 1000 AS per_1000 FROM top t JOIN n USING (id)""",
    "lemma_layers": f"""WITH {_PARSED}, l AS (SELECT id, count(*) AS n, string_agg(lemma, ' ' ORDER BY token_id) AS s FROM parsed GROUP BY id)
        SELECT f.id, CASE WHEN n IS NULL THEN 'forms' ELSE 'lemmas_rules' END AS source, CASE WHEN n IS NULL THEN 'whole text' ELSE 'complete' END AS coverage, coalesce(n, 0) AS n, md5(coalesce(s, '')) AS md5 FROM forms f LEFT JOIN l ON l.id = f.id""",
    "form_lemma_pairs": f"WITH {_PARSED} SELECT replace(lower(form), 'ß', 'ss') AS form, lemma, count(*) AS cnt FROM parsed GROUP BY 1, 2",
    "term_report": f"""WITH {_FAM}, tot AS (SELECT family, sum(cnt)::BIGINT AS total FROM fam GROUP BY family)
        SELECT family, upper(family[1]) || family[2:] AS label, total, id, 'doc ' || id AS title, 'forms' AS source, cnt, per_1000 FROM fam JOIN tot USING (family)""",
    "term_authors": f"""WITH {_FAM}, e AS (SELECT coalesce(nullif(author, ''), 'not stated') AS author, family, sum(cnt)::BIGINT AS cnt, count(*) AS n FROM fam GROUP BY 1, 2)
        SELECT author, sum(cnt)::BIGINT AS total, max(n) AS documents, string_agg(family || '=' || cnt, ',' ORDER BY cnt DESC, list_position({list(FAMILIES)}, family)) AS families FROM e GROUP BY author""",
    "term_top_total": f"WITH {_FAM} SELECT sum(cnt)::BIGINT AS total FROM (SELECT sum(cnt) AS cnt FROM fam GROUP BY family ORDER BY cnt DESC, family LIMIT 2)",
    "term_counted": f"""{'WITH ' + _FAM}, each AS (SELECT v.family, g.term, count(*) AS cnt FROM grams g JOIN {_FAMILY} USING (n, term) GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY cnt DESC, term) AS rank FROM each) WHERE rank <= 2""",
    "delta_cosine_pairs": f"WITH {_Z}, {_PAIRS} SELECT * FROM pairs",
    "nearest_pairs_top8": f"""WITH {_Z}, {_PAIRS}, near AS (SELECT * FROM pairs ORDER BY delta, left_id, right_id LIMIT 8),
        c AS (SELECT n.*, a.feature, row_number() OVER (PARTITION BY n.left_id, n.right_id ORDER BY floor(abs(a.z - b.z) * 1e4 + 0.5) DESC, a.feature_rank) AS r
            FROM near n JOIN z a ON a.id = n.left_id JOIN z b ON b.id = n.right_id AND b.feature = a.feature)
        SELECT left_id, right_id, delta, cosine, string_agg(feature, ' ' ORDER BY r) AS features FROM c WHERE r <= 4 GROUP BY ALL""",
    "affinity_pairs": f"WITH {_AFFINITY} SELECT left_id, right_id, cosine, greatest(0, 1 - cosine) AS affinity FROM pairs",
    "affinity_top8": f"WITH {_AFFINITY} SELECT left_id, right_id, cosine, floor(1000 * greatest(0, 1 - cosine) + 0.5) / 10 AS similarity FROM pairs ORDER BY cosine, left_id, right_id LIMIT 8",
    "affinity_close": f"WITH {_AFFINITY} SELECT left_id, right_id, cosine FROM pairs WHERE cosine <= 0.05",
    "auto_feature_count": f"""WITH {_CNT}, c AS (SELECT * FROM cnt WHERE length(term) > 2 AND term NOT IN {_STOP}), size AS (SELECT a.id, coalesce(sum(c.cnt), 0) AS size FROM arr a LEFT JOIN c ON c.id = a.id GROUP BY a.id),
        m AS (SELECT size FROM size ORDER BY size, id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM size)), v AS (SELECT count(DISTINCT term) AS v FROM c)
        SELECT greatest(20, least(least(greatest(40, least(round_even(size * 0.12::DOUBLE, 0), 220)), v), 500))::BIGINT AS features FROM m, v""",
    "shared_cluster_terms": f"""WITH {_CNT}, c AS (SELECT * FROM cnt WHERE length(term) > 2 AND term NOT IN {_STOP}),
        a AS (SELECT term, sum(cnt) AS n FROM c WHERE id IN {tuple(GROUPS[0])} GROUP BY term), b AS (SELECT term, sum(cnt) AS n FROM c WHERE id IN {tuple(GROUPS[1])} GROUP BY term)
        SELECT term, least(a.n, b.n)::BIGINT AS cnt FROM a JOIN b USING (term) ORDER BY cnt DESC, term LIMIT 8""",
    "similar_passages_top30": f"""WITH {_TFIDF}, u AS (SELECT id, passage_idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY id, passage_idx)) AS u FROM
            (SELECT tf.*, tf.tf * (ln((n.n + 1) / (df.df + 1)) + 1) AS w FROM tf JOIN df USING (term), n)),
        s AS (SELECT a.id, a.passage_idx, b.id AS id2, b.passage_idx AS idx2, floor(sum(a.u * b.u) * 1e4 + 0.5) / 1e4 AS similarity FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.u * b.u) >= 0.08),
        top AS (SELECT * FROM s ORDER BY similarity DESC, id, passage_idx, id2, idx2 LIMIT 30),
        x AS (SELECT top.*, a.term, row_number() OVER (PARTITION BY top.id, top.passage_idx, top.id2, top.idx2 ORDER BY a.u * b.u DESC, a.term) AS r FROM top
            JOIN u a ON a.id = top.id AND a.passage_idx = top.passage_idx JOIN u b ON b.id = top.id2 AND b.passage_idx = top.idx2 AND b.term = a.term)
        SELECT id, passage_idx, id2, idx2, similarity, string_agg(term, ' ' ORDER BY r) AS shared_terms FROM x WHERE r <= 10 GROUP BY ALL""",
    "run_history": f"""WITH {_DOCS}, top AS (SELECT event_id AS id, event_type AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events ORDER BY created_at DESC, id DESC LIMIT 50)
        SELECT t.id AS run_id, t.kind, t.created_at, (SELECT string_agg(d.title, ',' ORDER BY k.pos) FROM (VALUES (0, 1), (1, 7), (2, 13)) AS k(pos, m) JOIN docs d ON d.id = (t.id * k.m) % 200) AS titles FROM top t""",
    "doc_lookup": f"WITH {_DOCS} SELECT id, title, author, genre, md5(d.text) AS text_md5 FROM docs d WHERE id = 7 LIMIT 1",
    "project_audit": f"WITH {_DOCS} SELECT count(*) AS documents, bool_or(regexp_matches(title, '(?i){SEARCH}') OR regexp_matches(coalesce(author, ''), '(?i){SEARCH}')) AS name_in_documents FROM docs",
    "corpus_audit": f"""WITH {_ARR}, {_DOCS} SELECT d.genre, count(*) AS documents, count(DISTINCT d.author) AS authors, count(*) FILTER (len(a.t) < 1000) AS short_documents,
        bool_or(regexp_matches(d.title || ' ' || d.author, '(?i)src1')) AS has_name FROM docs d JOIN arr a ON a.id = d.id GROUP BY d.genre""",
}
SQL["kwic_indexed"] = SQL["kwic"]
_BUCKETS = {"nsubj": "subject", "root": "root", "obj": "object", "obl:arg": "object", "advcl": "subordinate", "nsubj:pass": "subject", "xcomp": "subordinate"}
SQL["conllu_files"] = rf"""WITH forms AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS t FROM documents),
    each AS (SELECT id, unnest(t) AS form, generate_subscripts(t, 1) - 1 AS pos FROM forms),
    named AS (SELECT id || '-' || pos // 10 AS id, pos, form, CASE pos % 10 {" ".join(f"WHEN {i} THEN '{_BUCKETS[r]}'" for i, r in enumerate(RELATIONS) if r in _BUCKETS)} END AS bucket FROM each)
    SELECT id, bucket, string_agg(form, ' ' ORDER BY pos) AS forms, 'numero: singolare · caso: accusativo' AS features FROM named WHERE bucket IS NOT NULL GROUP BY id, bucket"""
