"""The pipeline's stages and the whole of it against plain Python: which rows stay, how often, in which order, in which shards."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from conftest import SF_DIR
from test_near_copies import brute_kept

from lexmill.llm import mixing, quality, sharding
from lexmill.llm.shared import materialise, shared_folder, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute_contaminated(texts, items):
    """doc_ids of texts with a window of an item: ten words in a row, or all of a shorter one."""
    wanted = defaultdict(set)
    for item in items:
        words = words_of(item)
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            wanted[n].add(tuple(words[i : i + n]))
    out = set()
    for d, text in texts.items():
        words = words_of(text)
        if any(tuple(words[i : i + n]) in found for n, found in wanted.items() for i in range(len(words) - n + 1)):
            out.add(d)
    return out


@pytest.fixture(scope="module")
def whole(spark):
    """Every stage's rows over the whole table, by its name."""
    docs, out = table(spark, SF_DIR, "documents").select(*[c.split()[0] for c in SCHEMA.split(", ")]), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = out[name] = materialise(stage(spark, docs, SF_DIR), name)
        assert docs.columns == out["documents"].columns
    return out


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_rejected_documents_go(spark, whole):
    kept = {r.doc_id for r in quality.quality_report(whole["documents"]).collect() if r.kept}
    assert 0 < len(kept) < whole["documents"].count()
    assert rows_of(whole["quality"]) == Counter({r: n for r, n in rows_of(whole["documents"]).items() if r[0] in kept})


def test_one_of_each_group_of_near_copies_stays(whole):
    rows = whole["quality"].collect()
    kept = brute_kept({r.doc_id: r.text for r in rows})
    assert len(kept) < len(rows)
    assert rows_of(whole["near_duplicates"]) == Counter(tuple(r) for r in rows if r.doc_id in kept)


def test_contaminated_documents_go(spark, whole):
    rows = whole["near_duplicates"].collect()
    gone = brute_contaminated({r.doc_id: r.text for r in rows}, [r.text for r in table(spark, SF_DIR, "benchmark").collect()])
    assert gone
    assert rows_of(whole["decontamination"]) == Counter(tuple(r) for r in rows if r.doc_id not in gone)


def positions(docs):
    return {r.doc_id: sorted(r.positions) for r in mixing.plan(docs).collect()}


def test_each_document_is_as_often_in_the_mix_as_it_is_taken(whole):
    often = {d: len(p) for d, p in positions(whole["decontamination"]).items()}
    want = {tuple(r): often[r.doc_id] for r in whole["decontamination"].collect()}
    assert rows_of(whole["mixing"]) == Counter({r: n for r, n in want.items() if n}) and max(often.values()) > 1


def test_shards_hold_all_columns_in_the_order_of_the_curriculum(spark, whole):
    docs, path = whole["mixing"], f"{shared_folder(spark)}/shards"
    out = sharding.sharded(docs, 100_000, path).collect()
    back = sharding.read_shards(spark, path, SCHEMA + ", shard string, page int, seq long").collect()
    assert Counter(tuple(r)[:5] for r in back) == rows_of(docs)
    at, seen = positions(whole["decontamination"]), Counter()
    order = []
    for r in sorted(back, key=lambda r: r.seq):
        order.append(at[r.doc_id][seen[r.doc_id]])
        seen[r.doc_id] += 1
    assert order == sorted(order)
    for folder in {(r.shard, r.page) for r in back}:
        own = spark.read.parquet(f"{path}/shard={folder[0]}/page={folder[1]}")
        seqs = [r.seq for r in own.select("seq", "_metadata.row_index").orderBy("row_index").collect()]
        assert seqs == sorted(seqs)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.shard, r.page] += r.n_bytes
    assert len(sizes) > 4 and all(n <= 100_000 for n in sizes.values()) and all(r.shard_bytes == sizes[r.shard, r.page] for r in out)
    assert Counter((r.doc_id, "b" + r.shard, r.page) for r in out) == Counter((r.doc_id, r.shard, r.page) for r in back)


def test_the_run_is_its_stages_in_a_row(spark, whole):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "n_bytes", "shard", "depth", "page", "shard_bytes"]
    assert Counter((r.doc_id, r.n_bytes) for r in out.collect()) == Counter((r.doc_id, len((r.text or "").encode())) for r in whole["mixing"].collect())


def test_nulls_repeats_and_an_empty_table(spark):
    for rows in ([], [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (2, "", None, "s", 0), *[(3 + i, "plain words that say a thing or two " * 20, "en", "s", 9) for i in range(4)]]):
        folder = shared_folder(spark)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "one item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        kept = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
        assert kept <= {r[0] for r in rows}
