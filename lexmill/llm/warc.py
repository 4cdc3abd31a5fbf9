"""WARC archives compressed with Zstandard: writing, and reading them back.

An archive begins with a skippable frame that holds the dictionary; then comes
a frame for each record.  Archives are written by Spark's text sink, so they
can be in any store and a lost executor's files are written again.  That sink
puts a separator after every row; here it is an empty skippable frame, which
decoders pass over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import counted_join, materialise, shared_folder

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame: magic 0x184D2A50, size 0.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("latin-1")
DICTIONARY_BYTES = 32 << 10
#: The bound of the sample that the dictionary is trained on: pages, and bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES = 400, 1 << 18
_RECORD_URN = "urn:lexmill:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from some different pages, least hash first; plain content where there are too few to train on.

    Only hashes are ranked; then at most SAMPLE_PAGES pages go to the driver,
    however many rows repeat them.  Null and empty pages take no part; an empty
    table gives a dictionary of a few bytes.
    """
    html = F.col("html").cast("string")
    small = pages.select(html.alias("html"), F.xxhash64(html).alias("h")).where((F.octet_length("html") > 0) & (F.octet_length("html") <= SAMPLE_BYTES))
    last = small.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    chosen = small.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).collect() if last is not None else []
    samples = [r.html.encode() for r in sorted(chosen, key=lambda r: r.h)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"WARC/1.1\r\n" + b"".join(samples))[:DICTIONARY_BYTES]


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit has no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_RECORD_URN}{'' if page_id is None else page_id}>"), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_RECORD_URN}{refers_to}>")]
    else:
        block += payload or b""
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) under ``path``, an archive for each partition.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with
    the least page_id is the response and others revisit it.  Rows that repeat
    that page_id are responses too; a null page_id comes after all others.  A
    null html is empty; a null url has no header.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = materialise(groups.where("n > 1"), "payloads")
    rows = counted_join(rows, groups, ["sha1"], "n", ["page_id"])
    rows = rows.withColumn("refers_to", F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = dictionary.value
        codec = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
        for batch in batches:
            out, size = [], 0
            for page_id, url, text, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                payload = text.as_py().encode()
                bare = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                made = record(page_id.as_py(), url.as_py(), bare, len(payload), payload, refers_to.as_py())
                out.append(lead + codec.compress(made))
                lead, size = b"", size + len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    frames = rows.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frames(data: memoryview, where: str) -> Iterator[tuple[int, bytes]]:
    """(offset, record) for each frame of an archive; its dictionary must lead."""

    def fail(at: int, what: str):
        raise WarcError(f"{where}, byte {at}: {what}")

    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        fail(0, "no dictionary frame leads")
    size = struct.unpack_from("<I", data, 4)[0]
    raw, at = bytes(data[8 : 8 + size]), 8 + size
    if len(raw) != size:
        fail(0, "the dictionary is cut off")
    try:
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    except zstandard.ZstdError as e:
        fail(0, f"the dictionary can't be read: {e}")
    while at < len(data):
        if at + 8 > len(data):
            fail(at, "a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            fail(at, "no frame begins here")
        end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
        last = False
        while not last:
            if end + 3 > len(data):
                fail(at, "a frame is cut off")
            head = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (data[at + 4] >> 2 & 1)
        if end > len(data):
            fail(at, "a frame is cut off")
        try:
            yield at, codec.decompress(bytes(data[at:end]))
        except zstandard.ZstdError as e:
            fail(at, str(e))
        at = end
    if at != len(data):
        fail(at, "a frame is cut off")


def parse(data: bytes, where: str) -> dict:
    """A record's headers, payload and lengths, all checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise WarcError(f"{where}: no record header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"{where}: {line[:80]!r} is no header field")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{where}: no {name}")
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{where}: the block is not of {size[:20]} bytes")
    block = rest[:-4]
    fields["payload"], fields["payload_bytes"] = block, len(block)
    fields["digest"] = fields.get("warc-payload-digest", fields.get("warc-block-digest", "")).removeprefix("sha1:")
    if fields["warc-type"] not in ("response", "revisit"):
        return fields
    http, found, payload = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "").startswith("application/http"):
        payload = block
    else:
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not found or len(sizes) > 1 or not all(x.isdigit() for x in sizes):
            raise WarcError(f"{where}: no HTTP header with one length at most")
        fields["payload_bytes"] = int(sizes[0]) if sizes else len(payload)
    if fields["warc-type"] == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != fields["payload_bytes"] or ("warc-payload-digest" in fields and own != fields["digest"]):
            raise WarcError(f"{where}: the payload has not the length or digest that it is said to have")
        fields["digest"] = own
    elif "warc-refers-to" not in fields or payload:
        raise WarcError(f"{where}: a revisit with a payload, or of nothing")
    fields["payload"] = payload
    return fields


def read_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, record_id.

    All files under ``path`` whose names match ``glob`` are archives; empty
    files have no records.  Records of other types pass with their whole block
    as payload.  page_id and refers_to are null where an id isn't one of this
    module's; record_id has any id as it stands.  Any breach of the format
    raises WarcError with archive and place.
    """

    def page(urn: str | None) -> int | None:
        bare = (urn or "").strip("<>")
        found = bare.removeprefix(_RECORD_URN) if bare.startswith(_RECORD_URN) else ""
        return int(found) if found.removeprefix("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "record_id"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for at, data in frames(memoryview(content.as_buffer()), name.as_py()):
                    f = parse(data, f"{name.as_py()}, byte {at}")
                    rows.append((page(f["warc-record-id"]), f.get("warc-target-uri"), f["payload_bytes"], f["digest"], f["warc-type"], page(f.get("warc-refers-to")), f["payload"], f["warc-record-id"].strip("<>")))
                    size += len(data)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of ``pages`` to the shared folder and returns what reading them gives, without payloads."""
    path = f"{shared_folder(pages.sparkSession)}/warc"
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
