"""Documents from files and from forms: plain text, XML and CoNLL-U as text, Word files, PDF where a reader is installed."""

from __future__ import annotations

import io
import json
import re
import shutil
import subprocess
import zipfile
from collections.abc import Callable
from importlib.util import find_spec
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import normalize_whitespace

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Metadata of a document that a form can give.
METADATA = ("author", "date_label", "period", "place", "genre", "witness")


def docx_parts(content: bytes) -> tuple[list[dict[str, str]], str]:
    """Paragraphs of a Word file's body, each with its style, and its numbered notes; separators' notes are left out."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        notes = ElementTree.fromstring(z.read("word/footnotes.xml")) if "word/footnotes.xml" in z.namelist() else None
    out = []
    for p in body if body is not None else ():
        if p.tag != f"{_W}p":
            continue
        text = "".join(e.text or "" if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter()).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if text:
            out.append({"type": "paragraph", "style": "" if style is None else style.get(f"{_W}val", ""), "text": text})
    numbered = []
    for note in notes.iter(f"{_W}footnote") if notes is not None else ():
        number = note.get(f"{_W}id", "")
        text = " ".join(t.text for t in note.iter(f"{_W}t") if t.text).strip()
        if text and not number.startswith("-"):
            numbered.append(f"Nota {number}: {text}")
    return out, "\n".join(numbered)


def _pypdf(content: bytes) -> list[str]:
    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def _pdfplumber(content: bytes) -> list[str]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [p.extract_text() or "" for p in pdf.pages]


def _pdfminer(content: bytes) -> list[str]:
    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(content)).split("\f")


def _pdftotext(content: bytes) -> list[str]:
    done = subprocess.run(["pdftotext", "-layout", "-", "-"], input=content, capture_output=True, timeout=30, check=True)
    return done.stdout.decode("utf-8", "replace").split("\f")


#: Readers of PDF pages, in the order in which they are tried.
PDF_READERS: dict[str, Callable[[bytes], list[str]]] = {"pypdf": _pypdf, "pdfplumber": _pdfplumber, "pdfminer": _pdfminer, "pdftotext": _pdftotext}


def pdf_status() -> dict[str, bool]:
    """Which PDF readers this machine has."""
    return {name: shutil.which(name) is not None if name == "pdftotext" else find_spec(name) is not None for name in PDF_READERS}


def clean_pdf(text: str) -> str:
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\x00", ""))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def pdf_text(content: bytes, readers: dict[str, Callable[[bytes], list[str]]] | None = None) -> str:
    """Pages with markers, by the first reader that finds text; raises ValueError with what each of them said."""
    errors = []
    for name, read in (readers or PDF_READERS).items():
        try:
            pages = [clean_pdf(p) for p in read(content)]
        except Exception as e:  # the next reader may do better
            errors.append(f"{name}: {type(e).__name__}: {e}")
            continue
        if any(pages):
            return "\n\n".join(f"[pagina {i}]\n{t}" for i, t in enumerate(pages, 1) if t)
        errors.append(f"{name}: no text")
    raise ValueError("no PDF reader found text: " + "; ".join(errors))


def read_content(kind: str, content: bytes) -> tuple[str, str, str]:
    """(text, structure as JSON, notes) of a file of this kind; raises ValueError if it has no readable text."""
    structure: list[dict[str, str]] = []
    notes = ""
    if kind == "docx":
        structure, notes = docx_parts(content)
        text = "\n\n".join(p["text"] for p in structure)
    elif kind == "pdf":
        text = pdf_text(content)
    elif kind in ("txt", "xml", "conllu"):
        text = content.decode("utf-8-sig", "replace")
    else:
        raise ValueError(f"files of the kind {kind or 'without suffix'} are not supported")
    if not text.strip():
        raise ValueError("the file has no readable text")
    return text, json.dumps(structure, ensure_ascii=False), notes


_READ = StructType([StructField(c, StringType()) for c in ("text", "structure_json", "notes", "error")])


@F.pandas_udf(_READ)  # an object, as a string needs a session when this is imported
def _extract(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = []
    for k, c in zip(kind, content, strict=True):
        try:
            rows.append((*read_content(k, c), ""))
        except Exception as e:  # a broken file is reported in its row
            rows.append(("", "[]", "", f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["text", "structure_json", "notes", "error"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: source_name, source_hash, source_type, stored_as, text, normalized_text, structure_json, notes, error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(suffix.isin("docx", "pdf", "xml", "conllu", "txt"), F.concat(F.lit("."), suffix)).otherwise(".bin")
    rows = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_name"), F.sha2("content", 256).alias("source_hash"), suffix.alias("source_type"), known.alias("suffix"), _extract(suffix, F.col("content")).alias("x"))
    return rows.select("source_name", "source_hash", "source_type", F.concat("source_hash", "suffix").alias("stored_as"), "x.text", normalize_whitespace(F.col("x.text")).alias("normalized_text"), "x.structure_json", "x.notes", "x.error")


def created(forms: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Documents from forms (title, text, source_name, notes and METADATA, any of them missing) and, by source_name, from files read before.

    A file's text replaces the form's; its notes follow the form's after a blank
    line.  ``error`` says what hinders a row: no title, no text or its file.
    """
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in forms.columns else F.lit("")
    rows = forms.select(*[given(c).alias(c) for c in ("title", "source_name", "notes", *METADATA)], given("text").alias("own_text"))
    if files is None:
        none = F.lit(None).cast("string")
        rows = rows.select("*", *[none.alias(c) for c in ("source_hash", "source_type", "text", "structure_json", "file_notes", "file_error")])
    else:
        read = files.select("source_name", "source_hash", "source_type", "text", "structure_json", F.col("notes").alias("file_notes"), F.col("error").alias("file_error"))
        rows = rows.join(read, "source_name", "left")
    text = F.coalesce("text", "own_text")
    notes = F.trim(F.array_join(F.filter(F.array("notes", F.coalesce("file_notes", F.lit(""))), lambda x: x != ""), "\n\n"))
    error = F.when(F.col("title") == "", "a title is needed").when(F.coalesce("file_error", F.lit("")) != "", F.col("file_error")).when(F.trim(text) == "", "a text or a file is needed").otherwise("")
    return rows.select(
        "title", *METADATA, "source_name", F.coalesce("source_hash", F.lit("")).alias("source_hash"), F.coalesce("source_type", F.lit("text")).alias("source_type"),
        text.alias("text"), normalize_whitespace(text).alias("normalized_text"), notes.alias("notes"), F.coalesce("structure_json", F.lit("[]")).alias("structure_json"),
        F.lit("").alias("conllu"), F.lit("").alias("conllu_source"), error.alias("error"),
    )


def pasted(spark: SparkSession, title: str, text: str, **metadata: str) -> DataFrame:
    if not title.strip() or not text.strip():
        raise ValueError("a title and a text are needed")
    return created(spark.createDataFrame([{"title": title, "text": text} | metadata])).withColumn("source_type", F.lit("manuale"))
