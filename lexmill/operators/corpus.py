"""Documents, annotations and runs: scans, lookups, filters and changes as DataFrame to DataFrame functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace, tokenize

RUN_SCHEMA = "id long, kind string, document_ids string, parameters string, created_at string"


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` under the engine's names: id, title, author, genre, period, text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc "), F.col("doc_id")).alias("title"),
        F.col("source").alias("author"),
        F.col("lang").alias("genre"),
        *[F.lit("").alias(c) for c in ("period", "place", "witness", "date_label")],
        F.coalesce("text", F.lit("")).alias("text"),
    )


def newest_first(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.desc("created_at"), F.desc("id"))


def by_ids(docs: DataFrame, ids: list[int] | None) -> DataFrame:
    """Documents with these ids by id; None or an empty list means all of them."""
    return (docs.where(F.col("id").isin(ids)) if ids else docs).orderBy("id")


def by_id(docs: DataFrame, document_id: int) -> DataFrame:
    """One document; no row if there is none of that id."""
    return docs.where(F.col("id") == document_id).limit(1)


def in_request_order(docs: DataFrame, ids: list[int], strict: bool = False, distinct: bool = False) -> DataFrame:
    """Documents with ``pos``, in the order of ``ids``.

    ``strict`` raises if an id is missing, ``distinct`` if one is repeated.
    """
    if distinct and len(set(ids)) != len(ids):
        raise ValueError("an id is repeated")
    wanted = docs.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id long")
    if strict and docs.join(F.broadcast(wanted.select("id").distinct()), "id").select("id").distinct().count() != len(set(ids)):
        raise ValueError("an id is missing")
    return docs.join(F.broadcast(wanted), "id").orderBy("pos")


def parse_ids(query: str) -> list[int]:
    return [int(x) for x in query.split(",") if x.strip().isdigit()]


def search(docs: DataFrame, query: str, columns: tuple[str, ...] = ("title", "author", "genre", "period", "place", "witness")) -> DataFrame:
    """Case-insensitive substring search over some columns."""
    return docs.where(F.lower(F.concat_ws(" ", *columns)).contains(query.lower()))


def decoded_runs(runs: DataFrame) -> DataFrame:
    """Runs with ids as an array; broken JSON gives an empty one."""
    ids = F.coalesce(F.from_json("document_ids", "array<bigint>", {"mode": "PERMISSIVE"}), F.array().cast("array<bigint>"))
    return runs.withColumn("document_ids", ids)


def run_history(runs: DataFrame, docs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs (1 to 200) with the titles of their documents in the order of their ids; missing ids are left out."""
    top = decoded_runs(runs).orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(200, limit)))
    each = top.select(F.col("id").alias("run_id"), "kind", "created_at", F.posexplode_outer("document_ids").alias("pos", "id"))
    each = each.join(docs.select("id", "title"), "id", "left")
    titles = F.sort_array(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("pos", "title"))))
    return each.groupBy("run_id", "kind", "created_at").agg(titles["title"].alias("titles")).orderBy(F.desc("created_at"), F.desc("run_id"))


def annotations_of(annotations: DataFrame, document_id: int) -> DataFrame:
    return annotations.where(F.col("document_id") == document_id).orderBy("start_offset", "id")


#: What an annotation has where nothing is given.
ANNOTATION_DEFAULTS = {"start_offset": 0, "end_offset": 0, "quote": "", "label": "nota", "body": "", "certainty": "possibile", "source": ""}


def add_annotation(annotations: DataFrame, docs: DataFrame, new: DataFrame) -> DataFrame:
    """Appends the annotations whose document exists.

    Missing or null values get their defaults; offsets are cast to whole
    numbers, which fails for other text; ids count on from the largest.
    """
    for name, value in ANNOTATION_DEFAULTS.items():
        given = F.col(name).cast("int" if isinstance(value, int) else "string") if name in new.columns else F.lit(None)
        new = new.withColumn(name, F.coalesce(given, F.lit(value)))
    new = new.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    if "id" not in new.columns:
        last = annotations.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        # A few rows from the caller, not a corpus.
        new = new.withColumn("id", F.lit(last) + F.row_number().over(Window.orderBy("document_id", "start_offset", "end_offset")))
    return annotations.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in annotations.columns]))


def captured(text: str, selected: str, before: str) -> dict:
    """A selection as an annotation's place: it begins where the text before it ends."""
    if text[len(before) : len(before) + len(selected)] != selected:
        raise ValueError("the selection doesn't follow the text before it")
    return {"start_offset": len(before), "end_offset": len(before) + len(selected), "quote": selected}


def delete_annotation(annotations: DataFrame, annotation_id: int) -> DataFrame:
    """Raises ValueError if there is no such annotation."""
    if annotations.where(F.col("id") == annotation_id).isEmpty():
        raise ValueError(f"no annotation {annotation_id}")
    return annotations.where(F.col("id") != annotation_id)


def update_document(docs: DataFrame, document_id: int, log: str | None = None, **values: str) -> DataFrame:
    """New metadata or text for one document; raises ValueError without such a document, or for an empty title or text.

    New text is normalised again, and the parse is dropped only if it differs.
    With ``log``, the path of a log of runs, the change is appended to it.
    """
    own = F.col("id") == document_id
    if docs.where(own).isEmpty():
        raise ValueError(f"no document {document_id}")
    empty = [k for k in ("title", "text") if k in values and not values[k].strip()]
    if empty:
        raise ValueError(f"{empty[0]} is empty")
    out = {k: F.when(own, F.lit(v.strip())).otherwise(F.col(k)) for k, v in values.items()}
    if "text" in values:
        differs = own & (F.col("text") != F.lit(values["text"].strip()))
        out |= {c: F.when(differs, "").otherwise(F.col(c)) for c in ("conllu", "conllu_source") if c in docs.columns}
        if "normalized_text" in docs.columns:
            out["normalized_text"] = F.when(own, normalize_whitespace(F.lit(values["text"].strip()))).otherwise(F.col("normalized_text"))
    if log:
        changed = "text" in values and not docs.where(own & ~F.col("text").eqNullSafe(F.lit(values["text"].strip()))).isEmpty()
        log_run(docs.sparkSession, log, "document_edit", [document_id], {"text_changed": changed})
    return docs.withColumns(out)


def delete_document(docs: DataFrame, annotations: DataFrame, runs: DataFrame, document_id: int) -> tuple[DataFrame, DataFrame, DataFrame, int, list[str]]:
    """The three tables without the document, its annotations and every run over it; how many runs went, and hashes of uploads that no document has any longer."""
    ids = F.coalesce(F.from_json("document_ids", "array<bigint>"), F.array().cast("array<bigint>"))
    over, own = F.array_contains(ids, document_id), F.col("id") == document_id
    left, unused = docs.where(~own), []
    if "source_hash" in docs.columns:
        gone = docs.where(own & (F.col("source_hash") != "")).select("source_hash").distinct()
        unused = [r.source_hash for r in gone.join(left.select("source_hash"), "source_hash", "left_anti").collect()]
    return left, annotations.where(F.col("document_id") != document_id), runs.where(~over), runs.where(over).count(), unused


def append_run(runs: DataFrame, kind: str, ids: list[int], parameters: dict) -> DataFrame:
    """The log of runs with one more, its id after the largest; ids and parameters are JSON."""
    spark = runs.sparkSession
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    row = spark.createDataFrame([(last + 1, kind, json.dumps(ids), json.dumps(parameters, ensure_ascii=False, sort_keys=True))], "id long, kind string, document_ids string, parameters string")
    return runs.unionByName(row.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")))


def report_runs(runs: DataFrame) -> DataFrame:
    """Runs of the pipeline that have a report."""
    url = F.get_json_object("parameters", "$.report_url")
    return runs.where((F.col("kind") == "pipeline") & (F.coalesce(url, F.lit("")) != ""))


def log_run(spark: SparkSession, path: str, kind: str, ids: list[int], parameters: dict) -> int:
    """Appends a run to the log, a Parquet table at ``path`` that need not exist yet; its id is one more than the largest.

    The log has one writer, as two at once would take the same id.
    """
    try:
        runs = spark.read.schema(RUN_SCHEMA).parquet(path)
    except AnalysisException:
        runs = spark.createDataFrame([], RUN_SCHEMA)
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    append_run(runs, kind, ids, parameters).where(F.col("id") > last).select(*runs.columns).coalesce(1).write.mode("append").parquet(path)
    return last + 1


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a log that ``log_run`` wrote."""
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def run_by_id(runs: DataFrame, run_id: int) -> DataFrame:
    """One run with its ids as an array and its parameters as a variant, nested values and lists as they are; broken JSON gives an empty array or object."""
    parameters = F.coalesce(F.try_parse_json("parameters"), F.parse_json(F.lit("{}")))
    return decoded_runs(runs.where(F.col("id") == run_id)).withColumn("parameters", parameters)


def with_status(modules: DataFrame, statuses: DataFrame) -> DataFrame:
    """A catalog's rows (id, label, ...) with the status of each; unknown ones are missing."""
    return modules.join(statuses.select("id", F.col("status").alias("run_status")), "id", "left").withColumn("run_status", F.coalesce("run_status", F.lit("missing")))


def warnings(docs: DataFrame, short: int = 1000) -> DataFrame:
    """(warning, detail): short documents by title, several periods, several genres, fewer than three documents."""
    docs = docs.select("period", "genre", F.size(tokenize(F.col("text"))).alias("tokens"))
    known = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    figures = docs.agg(F.count("*").alias("n"), known("period").alias("periods"), known("genre").alias("genres"), F.count_if(F.col("tokens") < short).alias("short"))
    cases = [("short", F.col("short") > 0, "short"), ("periods", F.col("periods") > 1, "periods"), ("genres", F.col("genres") > 1, "genres"), ("few", F.col("n") < 3, "n")]
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("warning"), F.when(c, F.col(d)).cast("long").alias("detail")) for k, c, d in cases]), lambda x: x["detail"].isNotNull())
    return figures.select(F.explode(rows).alias("w")).select("w.*")


#: What a listing shows of a document's own columns; absent or null ones are empty.
LISTED = ("title", "author", "date_label", "period", "place", "genre", "witness", "source_name", "source_hash", "source_type", "notes", "created_at", "conllu_source")


def serialized(docs: DataFrame, include_text: bool = False) -> DataFrame:
    """Listing rows: id, all metadata, is_demo, token_count, has_syntax and the hash of the normalised text.

    On request the text, as given and normalised, and the structure of
    ``structure_json`` as a variant; broken or absent JSON is an empty list.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    demo = F.coalesce(F.col("is_demo").cast("boolean"), F.lit(False)) if "is_demo" in docs.columns else F.lit(False)
    own = [
        "id", *[given(c).alias(c) for c in LISTED], demo.alias("is_demo"), F.size(tokenize(given("text"))).cast("long").alias("token_count"),
        given("conllu").rlike(r"(?U)\S").alias("has_syntax"), F.md5(normalize_whitespace(given("text"))).alias("text_md5"),
    ]
    structure = F.coalesce(F.try_parse_json(given("structure_json")), F.parse_json(F.lit("[]"))).alias("structure")
    return docs.select(*own, *([given("text").alias("text"), normalize_whitespace(given("text")).alias("normalized_text"), structure] if include_text else []))


def merged_spans(annotations: DataFrame) -> DataFrame:
    """Spans to render: valid ones, by start, each beginning at or after the end of the one before; rest dropped.

    Whether a span stays depends on all before it in its document, so a
    document's spans are read in order, once.
    """
    schema = "document_id long, start_offset int, end_offset int, id long"
    spans = annotations.where("start_offset >= 0 and end_offset > start_offset").select("document_id", "start_offset", "end_offset", "id")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, end, keep = pdf.sort_values(["start_offset", "end_offset", "id"]), 0, []
        for a, b in zip(pdf.start_offset, pdf.end_offset, strict=True):
            keep.append(a >= end)
            end = b if keep[-1] else end
        return pdf[keep]

    return spans.groupBy("document_id").applyInPandas(walk, schema)


def audit(docs: DataFrame, name: str = "src1") -> DataFrame:
    """Counts by genre: documents, authors, short documents and whether a title or author has a name in it, in any case."""
    docs = docs.select("genre", "title", "author", F.size(tokenize(F.col("text"))).alias("tokens"))
    return docs.groupBy("genre").agg(
        F.count("*").alias("documents"),
        F.count_distinct("author").alias("authors"),
        F.sum((F.col("tokens") < 1000).cast("long")).alias("short_documents"),
        F.max(F.lower(F.concat_ws(" ", "title", "author")).contains(name.lower())).alias("has_name"),
    )


def project_audit(docs: DataFrame, name: str = "frontin", modules: int = 0, runnable: int = 0, errors: tuple[str, ...] = ()) -> DataFrame:
    """One row on the whole project: documents, modules, runtime_modules, catalog_errors, and whether a title or the name of a source matches ``name``, in any case.

    The counts of modules and the errors are the catalog's.
    """
    columns = [c for c in ("title", "source_name") if c in docs.columns]
    has = F.exists(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns]), lambda x: x.rlike(f"(?i){name}"))
    listed = F.array(*[F.lit(e) for e in errors]).cast("array<string>")
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.bool_or(has), F.lit(False)).alias("name_in_documents")).select(
        "documents", F.lit(modules).cast("long").alias("modules"), F.lit(runnable).cast("long").alias("runtime_modules"), listed.alias("catalog_errors"), "name_in_documents"
    )
