"""Queries of this subpackage, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, contraction, decontam, kmeans, langid, line_dedup, mixing, quality, sharding, simhash, substring, token_counts, warc
from .shared import table

#: The vocabulary that op10 counts with and op13 encodes with.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _content(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match", "spans")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_token_counts(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    return token_counts.recount(table(spark, sf_dir, "documents"), _content(spark, ranks))


def op11_weighted_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_report(table(spark, sf_dir, "embeddings"))


def op12_release_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contraction.replay(table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), _content(spark, ranks))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_weighted_kmeans": op11_weighted_kmeans,
    "op12_release_replay": op12_release_replay,
    "op13_byte_bpe": op13_byte_bpe,
}


def _lloyd_sql(rounds: int = kmeans.ROUNDS) -> str:
    """Lloyd's rounds as one common table expression each: components (doc, j, x) against centroids (k, j, c)."""
    steps = [
        """rows AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), x AS MATERIALIZED (
            SELECT i, unnest(range(64)) AS j, unnest(q) AS x FROM rows
        ), seeds AS (
            SELECT row_number() OVER (ORDER BY key, q) - 1 AS k, q
            FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS key, q FROM rows ORDER BY key, q LIMIT 40)
        ), c0 AS MATERIALIZED (
            SELECT k, unnest(range(64)) AS j, unnest(q) AS c FROM seeds
        )"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT i, arg_min(k, (d, k)) AS k, min(d) AS d
            FROM (SELECT i, k, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (j) GROUP BY i, k) GROUP BY i
        )""")
        if r < rounds:
            # Division of whole numbers rounds to zero, so what is below zero needs one less.
            steps.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT c.k, c.j, CASE WHEN m.n IS NULL THEN c.c WHEN m.s % m.n < 0 THEN m.s // m.n - 1 ELSE m.s // m.n END AS c
                FROM c{r} c LEFT JOIN (SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (i) GROUP BY k, j) m ON c.k = m.k AND c.j = m.j
            )""")
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
        SELECT r.vec_id, a.k::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
               (sum(a.d) OVER ())::BIGINT AS inertia, s.sha AS centroid_sha256
        FROM rows r JOIN a{rounds} a USING (i)
        JOIN (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY j)) AS sha FROM c{rounds} GROUP BY k) s USING (k)
    """
    )


SQL: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, line,
                   trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
        ), common AS (
            SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), marked AS (
            SELECT l.doc_id, l.i, l.line, c.key IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op4_decontamination": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
        ), wanted AS (
            SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w
            FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(generate_series(1, len(words) - least(len(words), 10) + 1)) AS i
                  FROM items WHERE len(words) > 0)
        ), sizes AS (
            SELECT DISTINCT n FROM wanted
        ), windows AS (
            SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS w
            FROM (SELECT doc_id, n, words, unnest(generate_series(1, len(words) - n + 1)) AS i FROM docs, sizes)
        ), found AS (
            SELECT doc_id, i, n, item_id FROM windows JOIN wanted USING (n, w)
        ), hits AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(generate_series(0, n - 1)) AS k FROM found) GROUP BY doc_id
        ), leaks AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.words) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
               sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN leaks l ON d.doc_id = l.doc_id
    """,
    "op7_warc": r"""
        WITH payloads AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), digits AS (
            SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31), 1), '' ORDER BY i) AS digest
            FROM (SELECT DISTINCT h FROM payloads), (SELECT unnest(generate_series(0, 31)) AS i) GROUP BY h
        ), firsts AS (
            SELECT h, min(page_id) AS first FROM payloads GROUP BY h
        )
        SELECT p.page_id, p.payload_bytes, d.digest AS payload_digest,
               CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
        FROM payloads p JOIN digits d USING (h) JOIN firsts f USING (h)
    """,
    "op9_substring_dedup": r"""
        WITH docs AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w
            FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM docs)
        ), firsts AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM windows) WHERE first < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS i FROM firsts, generate_series(0, 12) AS t(k)
        ), words AS (
            SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs
        ), kept AS (
            SELECT w.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
                   coalesce(string_agg(w.w, ' ' ORDER BY w.i) FILTER (g.i IS NULL), '') AS kept
            FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
        )
        SELECT d.doc_id, len(d.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op11_weighted_kmeans": _lloyd_sql(),
    # CRC-32 by its table of 256 steps; turns of all conversations from place to place, each with the deliveries before it.
    "op12_release_replay": r"""
        WITH RECURSIVE steps AS (
            SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
        ), turns AS (
            SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations
        ), strings AS (
            SELECT conv_id, p, -1 AS k, text AS s FROM turns
            UNION ALL SELECT conv_id, p, k, k || ':' || coalesce(conv_id::VARCHAR, '') || ':' || coalesce(turn::VARCHAR, '') FROM turns, range(9) AS r(k)
        ), bytes AS (
            SELECT conv_id, p, k, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda b: ('0x' || b)::BIGINT) AS b FROM strings
        ), hashes AS (
            SELECT conv_id, p, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, steps
        ), facts AS (
            SELECT conv_id, p, 7 * p AS arrival, any_value(h) FILTER (k = 0) % 5 AS distance, any_value(h) FILTER (k = 1) % 101 < 50 AS faulty,
                   7 * p + any_value(h) FILTER (k = 2) % 101 AS repair, any_value(h) FILTER (k = -1) AS crc,
                   list(h % 3 <> 0 ORDER BY k) FILTER (k >= 3) AS good
            FROM hashes GROUP BY conv_id, p
        ), played AS (
            SELECT conv_id, -1::BIGINT AS p, ''::VARCHAR AS status, 0 AS attempts, NULL::BIGINT AS first_at, NULL::BIGINT AS last_at, 0::BIGINT AS crc, []::BIGINT[] AS past
            FROM (SELECT DISTINCT conv_id FROM turns)
            UNION ALL
            SELECT conv_id, p, status, CASE status WHEN 'blocked' THEN 0 ELSE coalesce(nth, 6) END, first_at,
                   first_at + [0, 20, 60, 140, 300, 620][coalesce(nth, 6)], crc,
                   list_append(past, CASE status WHEN 'delivered' THEN first_at + [0, 20, 60, 140, 300, 620][nth] END)
            FROM (
                SELECT *, CASE WHEN first_at IS NULL THEN 'blocked' WHEN nth IS NULL THEN 'dead' ELSE 'delivered' END AS status
                FROM (
                    SELECT *, CASE WHEN first_at IS NULL THEN NULL WHEN NOT faulty THEN 1
                              ELSE list_filter([1, 2, 3, 4, 5, 6], lambda a: good[a] AND first_at + [0, 20, 60, 140, 300, 620][a] >= repair)[1] END AS nth
                    FROM (
                        SELECT f.*, m.past, CASE WHEN f.distance = 0 OR f.distance > f.p THEN f.arrival
                                                 WHEN m.past[f.p - f.distance + 1] IS NOT NULL THEN greatest(f.arrival, m.past[f.p - f.distance + 1]) END AS first_at
                        FROM played m JOIN facts f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.p = m.p + 1
                    )
                )
            )
        ), released AS (
            SELECT conv_id, p, row_number() OVER w AS release_no, crc, last_at FROM played WHERE status = 'delivered'
            WINDOW w AS (PARTITION BY conv_id ORDER BY last_at, p)
        ), states AS (
            SELECT conv_id, p, release_no, (sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no))::BIGINT AS state FROM released
        )
        SELECT t.conv_id, t.turn, m.status, m.attempts, m.first_at, m.last_at, s.release_no, s.state
        FROM turns t JOIN played m ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.p = t.p
        LEFT JOIN states s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.p = t.p
    """,
}
