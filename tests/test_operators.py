"""Operators that SQL can't say, or that change tables, on made data."""

import difflib
import io
import json
import re
import unicodedata
import zipfile

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from lexmill import queries
from lexmill.functions import text as T
from lexmill.operators import concordance, conllu, corpus, diff, features, linkage, lexicon, terms, views
from lexmill.plans import pipeline, registry
from lexmill.sources import exports, importers

WORD = r"[^\W\d_]"


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def documents(spark, texts, **more):
    names = ["title", "author", "genre", "period", "place", "witness", "date_label", "conllu", "conllu_source"]
    values = [(i, t, *[more.get(n, {}).get(i, f"t{i}" if n == "title" else "") for n in names]) for i, t in enumerate(texts)]
    return rows(spark, values, "id long, text string, " + ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize("profile", [T.Profile(), T.Profile(lower=False), T.Profile(strip_marks=True), T.Profile(j_to_i=True, v_to_u=True)])
def test_folding_is_that_of_unicode(spark, profile):
    texts = ["café", "ﬁnis", "ὀδός ὈΔΌΣ ΣΣ", "STRAẞE Straße ſ", "İstanbul ı", "각", "Å Å", "plain Vivat Iuno", "", "ŉ ǰ ΰ", "ΰ"]

    def plain(t):
        t = unicodedata.normalize("NFC", t)
        t = t.casefold() if profile.lower else t
        t = t.translate(str.maketrans("jJ", "iI")) if profile.j_to_i else t
        t = t.translate(str.maketrans("vV", "uU")) if profile.v_to_u else t
        return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") if profile.strip_marks else t

    found = [r[0] for r in rows(spark, [(t,) for t in texts], "t string").select(T.fold(F.col("t"), profile)).collect()]
    assert found == [plain(t) for t in texts]


def test_latin_function_words_are_a_stop_list(spark):
    toks = lexicon.tokens(documents(spark, ["Terra autem et fundus sunt in pago"]))
    assert [r.term for r in lexicon.content(toks, T.LATIN_FUNCTION_WORDS).orderBy("pos").collect()] == ["terra", "fundus", "pago"]


def test_number_labels_and_marks(spark):
    one = rows(spark, [(1234.5, 12345.678, "a <b> Terra terram")], "a double, b double, t string")
    r = one.select(T.number_label(F.col("a"), 1), T.number_label(F.col("b"), 2), T.highlight_families(F.col("t"), ["terra", "terram"]), T.highlight(F.col("t"), ["terra"])).first()
    assert tuple(r) == ("1234,5", "12.345,68", "a &lt;b&gt; <mark>Terra</mark> <mark>terram</mark>", "a <b> <mark>Terra</mark> terram")
    assert [r[0] for r in one.select(T.units(F.col("t"))).collect()] == [["a", " ", "<b>", " ", "Terra", " ", "terram"]]


def test_aliases_are_counted_by_their_tokens(spark):
    docs = documents(spark, ["moneta d'oro e d'oro, oro", "niente"])
    found = {(r.family, r.id): r.cnt for r in terms.family_counts(docs, {"gold": ["d'oro", "oro"], "none": ["--"]}).collect()}
    assert found == {("gold", 0): 5, ("gold", 1): 0, ("none", 0): 0, ("none", 1): 0}


def brute_hits(tokens, families):
    return {k: sum(tokens[i : i + len(q)] == list(q) for q in {tuple(re.findall(WORD + "+", a.lower())) for a in v} - {()} for i in range(len(tokens))) for k, v in families.items()}


def test_a_trie_finds_sequences_that_overlap_and_hold_one_another(spark):
    families = {"a": ["x y x", "x y", "y", "x y x"], "b": ["y x y x", "z", "x x x"], "c": ["x", "q r"], "d": ["--"]}
    texts = ["x y x y x", "x x x x", "", "q q r", "z", "nothing here", "y x y x y x z z", "x y"]
    found = {(r.family, r.id): r.cnt for r in terms.family_counts(documents(spark, texts), families).collect()}
    for i, text in enumerate(texts):
        assert {k: found[k, i] for k in families} == brute_hits(re.findall(WORD + "+", text), families)
    tokens = documents(spark, texts).select("id", T.tokenize(F.col("text")).alias("t"))
    started = terms.candidates(tokens, terms.trie(spark, [(k, a) for k, v in families.items() for a in v]), ["id"]).where("w IS NOT NULL").count()
    assert started == sum(w in "xyzq" for t in texts for w in t.split() if len(w) == 1)
    assert terms.family_counts(documents(spark, ["a"]), {}).collect() == []


def test_equal_counts_keep_the_first_seen_order(spark):
    found = lexicon.collocations(documents(spark, ["zeta alpha mmmm zeta alpha mmmm"])).orderBy("rank").collect()
    assert [(r.left, r.right) for r in found] == [("alpha", "zeta"), ("mmmm", "zeta"), ("alpha", "mmmm")]
    docs = documents(spark, ["q z", "z q"], author={0: "late", 1: "early"})
    families = [terms.Family("zz", ("z",)), terms.Family("qq", ("q",))]
    report = terms.report(docs, conllu.token_layer(docs, parser="forms"), families)
    assert [r.family for r in report.collect()] == ["zz", "zz", "qq", "qq"]
    assert [(r.author, [x.family for x in r.families]) for r in terms.author_report(report).collect()] == [("late", ["zz", "qq"]), ("early", ["zz", "qq"])]
    assert [r.family for r in terms.totals(terms.family_counts(docs, {"zz": ["z"], "qq": ["q"]}), ["zz", "qq"]).collect()] == ["zz", "qq"]


@pytest.mark.parametrize("length", [0, 1, 49, 50, 51, 52, 300])
def test_moving_type_ratio(spark, length):
    tokens = [f"w{chr(97 + (i * i) % 23)}" for i in range(length)]
    r = lexicon.summary(documents(spark, [" ".join(tokens)])).first()
    windows = [len(set(tokens[i : i + 50])) / 50 for i in range(length - 49)] if length > 50 else [len(set(tokens)) / length] if length else [0]
    assert r.mattr_50 == pytest.approx(sum(windows) / len(windows), abs=6e-5) and r.type_count == len(set(tokens)) and r.token_count == length


def test_no_python_in_token_plans(spark):
    docs = corpus.load(spark, SF_DIR)
    for df in (lexicon.summary(docs), lexicon.counts(lexicon.tokens(docs)), terms.family_counts(docs, queries.FAMILIES), features.feature_table(docs)):
        assert "Python" not in df._jdf.queryExecution().toString()


def test_families_are_chosen_by_profile(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"families": [{"id": "land", "label": "Lànd", "aliases": [" terra ", "vinea"], "lemmas": ["terra"]}, {"id": "price", "aliases": ["pretium"]}]}))
    known = terms.load_families(spark, str(path))
    assert [(f.id, f.label, f.aliases, f.lemmas) for f in known] == [("land", "Lànd", ("terra", "vinea"), ("terra",)), ("price", "price", ("pretium",), ())]
    pick = lambda asked, **p: [f.id for f in terms.select_families(spark, known, asked, T.Profile(**p))]
    assert pick("") == ["land", "price"]
    assert pick("VINEA") == ["land"] and pick("uinea", v_to_u=True) == ["land"] and pick("LÀND; pretium") == ["land", "price", "custom_l_nd"]
    assert pick("novum verbum, price") == ["price", "custom_novum_verbum"]
    for broken in ({"families": []}, {"families": [{"id": "a"}]}, {"families": [{"id": "a", "aliases": ["x"]}, {"id": "a", "aliases": ["y"]}]}, []):
        path.write_text(json.dumps(broken))
        with pytest.raises(ValueError):
            terms.load_families(spark, str(path))


CONLLU = "# text = x\n1\tTerram\tterra\tNOUN\t_\tCase=Acc|Number=Sing|Case=Gen\t2\tobj\t_\t_\n2-3\tab\t_\t_\t_\t_\t_\t_\t_\t_\n2\tvendo\t_\tVERB\t_\t_\tx\troot\t_\t_\n3\tqui\tqui quis\tPRON\t_\tFoo=Bar\t2\tnsubj:pass\t_\t_\n4.1\te\te\t_\t_\t_\t_\t_\t_\t_\nshort\tline\n\n1\tet\tet\tCC\t_\t_\t0\tadvcl\t_\t_\n"


def test_layers_use_lemmas_of_words_without_heads(spark):
    docs = documents(spark, ["Terram vendo qui et", "nulla"], conllu={0: CONLLU})
    layers = {r.id: (r.source, r.coverage, r.tokens) for r in conllu.token_layer(docs).collect()}
    assert layers == {0: ("lemmas_conllu", "complete", ["terra", "vendo", "qui", "quis", "et"]), 1: ("forms", "whole text", ["nulla"])}
    assert {r.source for r in conllu.token_layer(docs, parser="forms").collect()} == {"forms"}
    assert [tuple(r)[2:] for r in conllu.form_lemma_pairs(docs).orderBy("line_no").collect()] == [("terram", "terra"), ("vendo", "vendo"), ("qui", "qui"), ("et", "et")]
    strict = conllu.read_conllu(docs).orderBy("sent", "token_id").collect()
    assert [(r.form, r.features) for r in strict] == [("Terram", {"Number": "Sing", "Case": "Gen"}), ("qui", {"Foo": "Bar"}), ("et", {})]
    assert {(r.sent, r.bucket): r.forms for r in conllu.overview(conllu.read_conllu(docs)).collect()} == {(0, "object"): "Terram", (0, "subject"): "qui", (1, "subordinate"): "et"}
    labels = conllu.read_conllu(docs).where("form <> 'et'").select("form", conllu.feature_label(F.col("features")).alias("l")).collect()
    assert {r.form: set(r.l.split(" · ")) for r in labels} == {"Terram": {"numero: singolare", "caso: genitivo"}, "qui": {"Foo: Bar"}}
    family = [terms.Family("land", ("terra", "fundus"), ("terra",), "Land"), terms.Family("none", ("zz",))]
    report = terms.report(docs, conllu.token_layer(docs), family).collect()
    assert [(r.family, r.id, r.total, r.cnt, r.terms, r.source) for r in report] == [("land", 0, 1, 1, ["terra"], "lemmas_conllu"), ("land", 1, 1, 0, ["terra", "fundus"], "forms"), ("none", 0, 0, 0, ["zz"], "lemmas_conllu"), ("none", 1, 0, 0, ["zz"], "forms")]
    assert [(r.id, r.family, r.forms) for r in terms.highlight_forms(conllu.form_lemma_pairs(docs), family).collect()] == [(0, "land", ["terram"])]
    evidence = concordance.evidence(docs, conllu.lemma_stream(docs)).orderBy("id").collect()
    assert [(r.text, r.lemma_text) for r in evidence] == [("terram vendo qui et", "terra vendo qui quis et"), ("nulla", "")]


def test_parses_are_attached_and_made(spark):
    docs = documents(spark, ["Terram vendo", "alia"])
    assert [r.conllu for r in conllu.attach(docs, 0, CONLLU).orderBy("id").collect()] == [CONLLU, ""]
    for number, parse in ((0, "nothing readable"), (9, CONLLU)):
        with pytest.raises(ValueError):
            conllu.attach(docs, number, parse)
    new, sentences = conllu.parse_stored(docs, 0, "rules")
    assert [r.lemma for r in sentences.orderBy("token_id").collect()] == ["terra", "vendo"] and new.where("conllu <> ''").count() == 1
    with pytest.raises(ValueError):
        conllu.parse_stored(docs, 0, "no such parser")
    assert [r[0] for r in rows(spark, [("a b\tc",), (" ",), (None,)], "v string").select(conllu.escape_field(F.col("v"))).collect()] == ["a_b_c", "_", "_"]


def test_changes_of_documents_annotations_and_runs(spark):
    docs = documents(spark, ["one", "two", "three"], conllu={0: "p", 1: "q"}).withColumn("source_hash", F.when(F.col("id") == 0, "h0").otherwise("h1"))
    notes = rows(spark, [(5, 0, 1, 2, "q", "nota", "", "certo", "")], "id long, document_id long, start_offset int, end_offset int, quote string, label string, body string, certainty string, source string")
    place = corpus.captured("one two", "two", "one ")
    with pytest.raises(ValueError):
        corpus.captured("one two", "twa", "one ")
    new = rows(spark, [(1, place["start_offset"], place["end_offset"], place["quote"]), (99, 0, 1, "x")], "document_id long, start_offset int, end_offset int, quote string")
    both = corpus.add_annotation(notes, docs, new)
    assert [tuple(r) for r in both.orderBy("id").collect()][1] == (6, 1, 4, 7, "two", "nota", "", "possibile", "")
    assert corpus.delete_annotation(both, 5).count() == 1
    with pytest.raises(ValueError):
        corpus.delete_annotation(both, 77)
    changed = {r.id: r for r in corpus.update_document(corpus.update_document(docs, 0, text="new", title="T"), 1, text="two").collect()}
    assert (changed[0].text, changed[0].title, changed[0].conllu) == ("new", "T", "") and changed[1].conllu == "q"
    for number, values in ((0, {"title": " "}), (0, {"text": ""}), (42, {"text": "x"})):
        with pytest.raises(ValueError):
            corpus.update_document(docs, number, **values)
    runs = rows(spark, [(1, "pipeline", "[0, 1]", '{"report_url": "/r"}', "a"), (2, "kwic", "broken", "{}", "b"), (3, "pipeline", "[2]", "{}", "c")], "id long, kind string, document_ids string, parameters string, created_at string")
    left, notes_left, runs_left, gone, hashes = corpus.delete_document(docs, both, runs, 0)
    assert (left.count(), notes_left.count(), sorted(r.id for r in runs_left.collect()), gone, hashes) == (2, 1, [2, 3], 1, ["h0"])
    assert corpus.delete_document(docs, both, runs, 1)[4] == []
    longer = corpus.append_run(runs, "new", [3, 1], {"b": 1, "a": "è"}).where("kind = 'new'").first()
    assert (longer.id, longer.document_ids, longer.parameters) == (4, "[3, 1]", '{"a": "è", "b": 1}')
    assert [r.id for r in corpus.report_runs(runs).collect()] == [1] and corpus.run_by_id(runs, 2).first().document_ids == []
    assert {r.id: r.run_status for r in corpus.with_status(rows(spark, [("a", "A"), ("b", "B")], "id string, label string"), rows(spark, [("a", "ok")], "id string, status string")).collect()} == {"a": "ok", "b": "missing"}
    assert [r.id for r in corpus.in_request_order(docs, [2, 0], strict=True, distinct=True).collect()] == [2, 0]
    for ids, flags in (([0, 9], {"strict": True}), ([0, 0], {"distinct": True})):
        with pytest.raises(ValueError):
            corpus.in_request_order(docs, ids, **flags)
    assert corpus.parse_ids("3, 1,x,,2") == [3, 1, 2]


def test_queries_are_stripped_and_empty_ones_have_no_hits(spark):
    docs = documents(spark, ["One two ONE 😀one", "none"])
    assert [(r.id, r.start, r.left, r.match, r.right) for r in concordance.kwic(docs, " one ", 4).collect()] == [(0, 0, "", "One", " two"), (0, 8, "two ", "ONE", " 😀on"), (0, 13, "NE 😀", "one", ""), (1, 1, "n", "one", "")]
    assert concordance.kwic(docs, "  ").collect() == [] and concordance.feature_contexts(docs, "none", 1, 7).count() == 1


def test_contexts_of_families_are_those_of_a_plain_search(spark):
    texts = {r.id: " ".join((r.text or "").lower().replace("ß", "ss").split()) for r in corpus.load(spark, SF_DIR).collect()}
    expected = set()
    for family, aliases in queries.FAMILIES.items():
        found = "|".join(re.escape(a) for a in sorted(set(aliases), key=lambda a: (-len(a), a)))
        for d, text in texts.items():
            for i, m in enumerate(re.finditer(rf"(?<!{WORD})(?:{found})(?!{WORD})", text)):
                if i == 3:
                    break
                expected.add((family, d, i, text[max(0, m.start() - 58) : m.start()], m[0], text[m.end() : m.end() + 58]))
    assert {tuple(r) for r in queries.QUERIES["term_contexts"](spark, SF_DIR).collect()} == expected


def test_diffs_are_those_of_whole_texts(spark):
    pairs = diff.nearest_copies(corpus.load(spark, SF_DIR)).collect()
    found = {(r.left_id, r.right_id): r for r in views.variant_total(queries.QUERIES["text_diff"](spark, SF_DIR)).collect()}
    squeeze = lambda t: "\n\n".join(x for x in (re.sub("[ \t]+", " ", p).strip() for p in re.split(r"\n\s*\n", unicodedata.normalize("NFC", t))) if x)
    assert len(found) == len(pairs) > 0
    for p in pairs:
        a, b = (re.findall(r"\s+|\S+", squeeze(t)) for t in (p.left_text, p.right_text))
        ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        r = found[p.left_id, p.right_id]
        assert (r.equal, r.replace, r.delete, r.insert) == tuple(sum(o[0] == t for o in ops) for t in ("equal", "replace", "delete", "insert"))
        assert r.variants == sum(o[0] != "equal" for o in ops) and "".join(s.left for s in r.segments) == squeeze(p.left_text)


def test_merges_are_those_of_average_linkage(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1000, (14, 6))
    table = rows(spark, [(i, f"f{j}", j, int(x[i, j])) for i in range(14) for j in range(6)], "id long, feature string, feature_rank int, cnt long")
    cosine = lambda i, j: np.floor((1 - x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))) * 1e4 + 0.5) / 1e4
    groups, expected = [[i] for i in range(14)], []
    while len(groups) > 1:
        d = {(a, b): np.mean([cosine(i, j) for i in groups[a] for j in groups[b]]) for a in range(len(groups)) for b in range(a)}
        a, b = min(d, key=lambda k: (round(d[k], 9), k[1], k[0]))
        expected.append((sorted([sorted(groups[a]), sorted(groups[b])]), round(float(d[a, b]), 4)))
        groups[b] = groups[b] + groups.pop(a)
    found = [(sorted([sorted(r.left), sorted(r.right)]), r.distance) for r in linkage.merges(table).orderBy("step").collect()]
    assert [m for m, _ in found] == [m for m, _ in expected] and np.allclose([d for _, d in found], [d for _, d in expected], atol=1.01e-4)


def test_views_of_results(spark):
    pairs = rows(spark, [(1, 2, 0.5, 0.2), (1, 3, 0.25, 0.9), (2, 3, 0.75, 1.5)], "left_id long, right_id long, delta double, cosine double")
    why = rows(spark, [(1, 3, "a", 2), (1, 3, "b", 1), (1, 3, "c", 5)], "left_id long, right_id long, feature string, rank int")
    assert [(r.left_id, r.right_id, r.features) for r in views.distance_table(pairs, why, 2).collect()] == [(1, 3, ["b", "a"]), (1, 2, None)]
    assert [r.similarity for r in views.affinity_table(pairs).collect()] == [80.0, 10.0, 0.0] and views.close_pairs(pairs).count() == 1
    loads = rows(spark, [(a, 40.5 - a, f"f{r}", 0.1, r) for a in range(4) for r in range(1, 11)], "axis int, variance double, feature string, loading double, rank int")
    assert views.plane_variance(loads).first().variance == 80.0 and views.top_loadings(loads).count() == 24
    assert views.top_profiles(rows(spark, [(1, r) for r in range(1, 11)], "id long, rank int")).count() == 8
    points = rows(spark, [(1, 0, -1.0), (2, 0, 3.0), (1, 1, 0.0), (2, 1, 0.0)], "id long, axis int, coordinate double")
    assert {r.axis: (round(r.low, 6), round(r.high, 6)) for r in views.bounds(points).collect()} == {0: (-1.48, 3.48), 1: (-1.0, 1.0)}
    assert {(r.id, r.axis): round(r.place, 6) for r in views.scaled(points, 0.0, 100.0).collect()}[2, 1] == 50.0
    total = rows(spark, [("a", 0), ("b", 0)], "family string, total long")
    assert [r.family for r in terms.shown_families(total, ["b", "a"], 1).collect()] == ["b"] and terms.top_total(total).first().total == 0
    counted = rows(spark, [("a", 1, 2), ("a", 2, 0), ("a", 3, 5), ("b", 1, 9)], "family string, id long, cnt long")
    assert [r.id for r in terms.documents_with_hits(counted, "a").collect()] == [3, 1]
    assert features.pca_feature_count("function", None, 77) == 120 and features.pca_feature_count("lexical", None, 77) == 77 and features.pca_feature_count("function", 30, 77) == 30
    with pytest.raises(ValueError):
        features.preset_table(documents(spark, ["a"]), "other")


def test_names_of_files_never_collide(spark):
    titles = {0: "a", 1: "a_2", 2: "a", 3: "a", 4: "È!", 5: "b_3", 6: "a_2"}
    docs = documents(spark, ["t"] * 7, title=titles)
    assert {r.id: r.file_name for r in exports.text_files(docs).collect()} == {0: "a.txt", 1: "a_2.txt", 2: "a_3.txt", 3: "a_4.txt", 4: "document_4.txt", 5: "b_3.txt", 6: "a_2_2.txt"}
    with zipfile.ZipFile(io.BytesIO(exports.zip_archive(docs))) as z:
        assert len(z.namelist()) == 7 and z.read("a.txt").decode() == "Title: a\nAuthor: attribuzione non indicata\nDate: non indicata\nGenre: non indicato\n\nt"


def test_reports_hold_what_was_run(spark):
    docs = documents(spark, ["Terra <et> fundus. " * 8, "terra nova (et) vetus. " * 8])
    results = pipeline.run_modules(["summary", "frequency", "stylometry", "affinity", "odd"], pipeline.Context(docs))
    assert {k: v["status"] for k, v in results.items()} == {"summary": "ok", "frequency": "ok", "stylometry": "ok", "affinity": "skipped", "odd": "unknown"}
    summary = views.summarise(results)
    listed = [{"title": "A & B", "author": "x"}]
    page = exports.html_report("Report <1>", listed, summary, {"summary": "Summary"})
    assert "Report &lt;1&gt;" in page and "<h2>Summary</h2>" in page and "A &amp; B" in page and "needs 3 documents" in page
    assert "needs 3 documents" not in exports.html_report("r", listed, summary, style="brief")
    with pytest.raises(ValueError):
        exports.html_report("r", [], {}, style="odd")
    pdf = exports.pdf_report("Rapport (è) 日", listed * 200, summary)
    assert pdf.startswith(b"%PDF-1.4") and rb"Rapport \(" + "è".encode("cp1252") + rb"\) ?" in pdf
    start = int(pdf.rsplit(b"startxref\n", 1)[1].split()[0])
    assert pdf[start : start + 4] == b"xref"
    for i, line in enumerate(pdf[start:].split(b"\n")[3:5], 1):
        assert pdf[int(line[:10]) :].startswith(b"%d 0 obj" % i)


def word_file(body, notes=None):
    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"{head}<w:body>{body}</w:body></w:document>")
        if notes:
            z.writestr("word/footnotes.xml", f"{head.replace('document', 'footnotes', 1)}{notes}</w:footnotes>")
    return buffer.getvalue()


def test_files_become_documents(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>A</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>d</w:t></w:r></w:p>'
    notes = '<w:footnote w:id="-1"><w:p><w:r><w:t>sep</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>x</w:t></w:r><w:r><w:t>y</w:t></w:r></w:p></w:footnote>'
    (tmp_path / "a.docx").write_bytes(word_file(body, notes))
    (tmp_path / "b.txt").write_bytes("﻿é  z\r\n\r\n\r\nq".encode())
    (tmp_path / "c.rtf").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b" ")
    files = importers.read_files(spark, str(tmp_path))
    found = {r.source_name: r for r in files.collect()}
    assert found["a.docx"].text == "A\tb\nc\n\nd" and found["a.docx"].notes == "Nota 2: x y"
    assert json.loads(found["a.docx"].structure_json)[0] == {"type": "paragraph", "style": "Title", "text": "A\tb\nc"}
    assert found["b.txt"].normalized_text == "é z\n\nq" and found["b.txt"].stored_as == found["b.txt"].source_hash + ".txt"
    assert "not supported" in found["c.rtf"].error and "no readable text" in found["d.txt"].error and found["c.rtf"].stored_as.endswith(".bin")
    forms = rows(spark, [(" T ", "a.docx", "own", None), ("", "b.txt", None, None), ("X", "", None, " pasted "), ("Y", None, None, " "), ("Z", "c.rtf", None, "t")], "title string, source_name string, notes string, text string")
    made = {r.title: r for r in importers.created(forms, files).collect()}
    assert made["T"].notes == "own\n\nNota 2: x y" and made["T"].source_type == "docx" and made["T"].error == ""
    assert made[""].error == "a title is needed" and made["X"].text == "pasted" and made["Y"].error == "a text or a file is needed" and "not supported" in made["Z"].error
    assert importers.pasted(spark, "t", "x  y").first().normalized_text == "x y"
    with pytest.raises(ValueError):
        importers.pasted(spark, "t", " ")


def test_pdf_readers_are_tried_in_turn():
    def broken(content):
        raise OSError("broken")

    assert importers.pdf_text(b"", {"a": broken, "b": lambda c: ["", ""], "c": lambda c: ["one \n", "", "two\x00\n\n\n\nx"]}) == "[pagina 1]\none\n\n[pagina 3]\ntwo\n\nx"
    with pytest.raises(ValueError, match="a: OSError: broken; b: no text"):
        importers.pdf_text(b"", {"a": broken, "b": lambda c: []})
    assert set(importers.pdf_status()) == set(importers.PDF_READERS)


def test_manifests_make_a_catalog_and_modules(spark, tmp_path):
    one = {"id": "note", "label": "Note", "category": "analysis", "order": 2, "runtime": {"kind": "static", "message": "hello"}}
    web = {"id": "web", "label": "Web", "category": "integration", "runtime": {"kind": "http_json", "url": "http://localhost:1/x", "include_text": True}}
    far = web | {"id": "far", "runtime": {"kind": "http_json", "url": "http://example.org/x"}}
    odd = one | {"id": "odd", "order": 1, "runtime": {"kind": "magic"}}
    own = one | {"id": "summary", "label": "Mine"}
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps([web, far, one, "text"]))
    (tmp_path / "c.json").write_text(json.dumps({"modules": [odd, own, {"id": "t", "label": "Tool", "category": "tool", "section": "s"}, {"id": "bad"}]}))
    (tmp_path / "d.json").write_text("{")
    manifests, errors = registry.load_manifests([tmp_path, tmp_path, tmp_path / "none"])
    assert [m.id for m in manifests] == ["odd", "summary", "note", "web", "far", "t"]
    assert len(errors) == 4 and any("taken" in e for e in errors)
    shown = registry.catalog(manifests, errors)
    assert [m["id"] for m in shown["analyses"]][0] == "odd" and registry.by_section(manifests) == {"s": ["Tool"]} and registry.label_of(manifests, "web") == "Web" and registry.label_of(manifests, "q") == "q"
    modules = registry.runnable(manifests)
    assert modules["summary"] is pipeline.BUILTIN["summary"]
    found = pipeline.run_modules(["note", "web", "odd"], pipeline.Context(documents(spark, ["una terra", "altera"])), modules)
    assert {k: v["status"] for k, v in found.items()} == {"note": "ok", "web": "error", "odd": "error"}
    assert {p["id"]: p["runnable"] for p in registry.parser_statuses()} == {"forms": True, "rules": True, "model": False}
