"""Language identification by a convolutional network over bytes, in numpy.

Text is cut into windows of WINDOW bytes.  Bytes are embedded; filters of
several widths run over them; each filter's maximum over the window goes
through one dense layer and softmax.  A text's prediction is the mean
probability over its windows, all of them.

For prediction, embedding and filters collapse into tables: a filter of width
w is a sum of w table rows, and two neighbouring bytes are looked up at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise
from .textscan import pieces, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: The bound of the labelled sample: texts of each language, and of all; every language keeps one text at least.
TEXTS_PER_LANGUAGE, TEXTS, WINDOWS_PER_TEXT = 400, 25_600, 6
#: Languages that STEPS steps are meant for; more take more steps.
LANGUAGES_PER_RUN = 64
STEPS, BATCH, RATE = 600, 128, 0.01
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256, EMBEDDING
    filters: list[np.ndarray]  # width, EMBEDDING, FILTERS for each width
    biases: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.dense, self.dense_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, tables of 65,536 rows for each two bytes and of 256 rows for a last odd one."""
        out = []
        for f in self.filters:
            single = [np.asarray(self.embedding @ part, np.float32) for part in f]
            pairs = [(single[i + 1][:, None, :] + single[i][None, :, :]).reshape(65536, -1) for i in range(0, len(f) - 1, 2)]
            out.append(pairs + ([single[-1]] if len(f) % 2 else []))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 1) -> Network:
    """Fits a network to windows (n, WINDOW) of bytes by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, n: (rng.standard_normal(shape) / np.sqrt(n)).astype(np.float32)
    k = len(languages)
    net = Network(
        languages,
        draw(256, EMBEDDING, n=4),
        [draw(w, EMBEDDING, FILTERS, n=w * EMBEDDING) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        draw(FILTERS * len(WIDTHS), k, n=FILTERS * len(WIDTHS)),
        np.zeros(k, np.float32),
    )
    if k < 2 or not len(windows):
        return net
    parameters = net.parameters()
    means, squares = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    by_label = [np.flatnonzero(labels == i) for i in range(k)]
    steps = STEPS * -(-k // LANGUAGES_PER_RUN)
    for step in range(1, steps + 1):
        label = rng.integers(0, k, BATCH)
        pick = np.array([by_label[i][rng.integers(len(by_label[i]))] for i in label])
        x = windows[pick]
        embedded = net.embedding[x]
        pooled, at = [], []
        for f, b in zip(net.filters, net.biases, strict=True):
            n = WINDOW - len(f) + 1
            y = sum(embedded[:, i : i + n] @ f[i] for i in range(len(f))) + b
            best = y.argmax(axis=1)
            pooled.append(np.take_along_axis(y, best[:, None, :], 1)[:, 0])
            at.append(best)
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        wrong = _softmax(hidden @ net.dense + net.dense_bias)
        wrong[np.arange(BATCH), label] -= 1
        wrong /= BATCH
        back = (wrong @ net.dense.T) * (raw > 0)
        g_embedding, g_filters, g_biases = np.zeros_like(net.embedding), [], []
        rows = np.arange(BATCH)[:, None]
        for i, (f, best) in enumerate(zip(net.filters, at, strict=True)):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            g = np.zeros_like(f)
            for j in range(len(f)):
                e = embedded[rows, best + j]  # batch, filter, embedding
                g[j] = np.einsum("bf,bfe->ef", own, e)
                np.add.at(g_embedding, x[rows, best + j], own[:, :, None] * f[j].T[None])
            g_filters.append(g)
            g_biases.append(own.sum(axis=0))
        gradients = [g_embedding, *g_filters, *g_biases, hidden.T @ wrong, wrong.sum(axis=0)]
        for p, g, m, s in zip(parameters, gradients, means, squares, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def cut(size: int) -> np.ndarray:
    """Where the windows of a text of ``size`` bytes begin: side by side, the last one ending with the text."""
    if size <= WINDOW:
        return np.zeros(1, np.int64)
    return np.minimum(np.arange(-(-size // WINDOW)) * WINDOW, size - WINDOW)


def predict(net: Network, tables: list, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, its mean probability) for each text; texts shorter than a window are padded with zero bytes."""
    data, offsets = utf8(texts)
    sizes = np.diff(offsets)
    per = np.maximum(1, -(-sizes // WINDOW))
    owner = np.repeat(np.arange(len(sizes)), per)
    local = np.arange(len(owner)) - (np.cumsum(per) - per)[owner]
    start = np.maximum(np.minimum(local * WINDOW, sizes[owner] - WINDOW), 0)
    total = np.zeros((len(sizes), len(net.languages)), np.float64)
    padded = np.concatenate((data, np.zeros(WINDOW, np.uint8)))
    for low in range(0, len(owner), 1024):
        own = owner[low : low + 1024]
        x = padded[(offsets[own] + start[low : low + 1024])[:, None] + np.arange(WINDOW)[None, :]]
        x[np.arange(WINDOW)[None, :] >= sizes[own][:, None]] = 0
        pairs = x[:, :-1].astype(np.int32) | x[:, 1:].astype(np.int32) << 8
        pooled = []
        for w, own_tables, bias in zip(WIDTHS, tables, net.biases, strict=True):
            n = WINDOW - w + 1
            y = None
            for i, t in enumerate(own_tables):
                at = pairs[:, 2 * i : 2 * i + n] if len(t) > 256 else x[:, 2 * i : 2 * i + n]
                part = np.take(t, at, axis=0)
                y = part if y is None else np.add(y, part, out=y)
            pooled.append(y.max(axis=1) + bias)
        p = _softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.dense_bias)
        np.add.at(total, own, p)
    best = total.argmax(axis=1)
    return best, np.clip(total[np.arange(len(best)), best] / per, 0, 1)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """(lang, h, windows): for each language some different rows, least hash first, and WINDOWS_PER_TEXT hashed windows of each.

    Never more than TEXTS rows, or one for each language, however often rows repeat.
    """
    labelled = docs.where(~held_out()).where("lang is not null and text is not null and length(text) > 0")
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    keys = materialise(labelled.select("lang", "h").distinct(), "labelled")
    sizes = materialise(keys.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    number = sizes.count()
    most = min(TEXTS_PER_LANGUAGE, max(1, TEXTS // max(1, number)))
    # Hashes are even: the ``most`` least ones of n lie below this share of their range, but for a chance below 1e-8, and then fewer are taken.
    share = F.lit(most + 6 * most**0.5 + 6) / F.col("n")
    low = keys.join(sizes, "lang").where(F.col("h").cast("double") <= (share - 0.5) * 2.0**64).select("lang", "h")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = materialise(low.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank"), "chosen")
    # At most TEXTS rows, or one for each language.
    chosen = labelled.join(F.broadcast(chosen) if number <= TEXTS else chosen, ["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            blobs = []
            for h, a, b in zip(batch.column(1).to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
                own = np.random.default_rng(h & 0x7FFFFFFF).integers(0, max(1, b - a - WINDOW + 1), WINDOWS_PER_TEXT)
                x = np.zeros((WINDOWS_PER_TEXT, WINDOW), np.uint8)
                for i, s in enumerate(own.tolist()):
                    part = data[a + s : min(b, a + s + WINDOW)]
                    x[i, : len(part)] = part
                blobs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["lang", "h", "windows"])

    cut = chosen.select("lang", "h", "text").mapInArrow(run, "lang string, h long, windows binary")
    # Repeated rows have one hash and count once.
    return cut.dropDuplicates(["lang", "h"])


def fit(docs: DataFrame) -> Network:
    """A network fitted to a bounded sample of the labelled rows that aren't held out."""
    rows = sample(docs).orderBy("lang", "h").toArrow()
    langs = rows.column("lang").to_pylist()
    languages = sorted(set(langs)) or [UNKNOWN]
    windows = np.frombuffer(b"".join(rows.column("windows").to_pylist()), np.uint8).reshape(-1, WINDOW)
    place = {x: i for i, x in enumerate(languages)}
    labels = np.repeat(np.array([place[x] for x in langs], np.int64), WINDOWS_PER_TEXT)
    return train(windows, labels, languages)


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Needs doc_id and text, and lang for learning alone.  A text that is null or
    has no letter is ``und``, with score 0.  Without labelled rows all are
    ``und``; with one language all others are that.  Repeated rows repeat.
    """
    net = net or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables, names = own.tables(), np.array(own.languages, object)
        for batch in batches:
            best, score = [], []
            for low, high in pieces(batch.column(2)):
                b, s = predict(own, tables, batch.column(2).slice(low, high - low))
                best.append(b)
                score.append(s)
            found = names[np.concatenate(best)] if best else np.zeros(0, object)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())],
                ["doc_id", "held_out", "letters", "lang_pred", "score"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text.alias("text"), text.rlike("\\p{L}").alias("letters"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, letters boolean, lang_pred string, score double")
    known = F.col("letters") & (F.col("lang_pred") != UNKNOWN)
    return out.select("doc_id", "held_out", F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"))
