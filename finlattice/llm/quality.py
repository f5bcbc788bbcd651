"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a vector of two halves over the whole text: wording, hashed counts of its lower-cased
words and pairs of words, and form, hashed counts of its byte 1-, 2- and 3-grams where letters keep
only their kind (lower, upper or non-ASCII).  Counts are damped by a square root and weighted by
inverse document frequency, each half is scaled to its share of the length, and the whole is
projected on the leading singular vectors of the labelled sample (latent semantic analysis).  The
labelled vectors are broadcast; each block of documents is multiplied with all of them, exactly, and
the labels of the `neighbours` nearest vote with a power of their cosines as weights.

The labelled sample is the only bounded part: at most `per_class` rows of each label (those with
the smallest hashes of the id), so what is collected and broadcast is at most 2 * per_class rows.
The vote of a class is divided by its sampling rate, so scores follow the labels' own shares.

Defined results: null and empty texts are the zero vector, and score the labels' mean, as do texts
that share nothing with any labelled one, and every text if there is no label; rows with equal texts score alike; labels with null ids or null
quality are ignored, of repeated labels of an id the larger counts; other columns are ignored by fit() and kept by
score(), whose output replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import few_rows, gram_counts, remainder, sample_per_class
from .shared import ASCII_LOWER, U64, plain, shingles, text_bytes, word_hashes, word_spans

PER_CLASS = 1500
BINS = 2048
WORD_BINS = 2048
#: The share of wording in the squared length of a vector.
WORDING = 0.1
SIZES = (1, 2, 3)
DIMENSIONS = 64
NEIGHBOURS = 15
POWER = 8

#: Letters by kind; digits as one; other bytes as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x61:0x7B] = ord("a")
SHAPE[0x41:0x5B] = ord("A")
SHAPE[0x30:0x3A] = ord("0")
SHAPE[0x80:] = ord("a")


def word_counts(column: pa.Array, bins: int = WORD_BINS) -> np.ndarray:
    """rows x bins counts of the words and pairs of words."""
    data, offsets = text_bytes(column)
    data, rows = ASCII_LOWER[data], len(column)
    starts, ends, firsts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    out = np.zeros(rows * bins, np.float32)
    for grams, before in ((words, firsts), shingles(words, firsts, 2)):
        row = np.repeat(np.arange(rows), np.diff(before))
        out += np.bincount(row * bins + (grams % U64(bins)).astype(np.int64), minlength=rows * bins).astype(np.float32)
    return out.reshape(rows, bins)


def _features(column: pa.Array) -> np.ndarray:
    return np.sqrt(np.hstack([word_counts(column), gram_counts(column, SIZES, BINS, SHAPE)]))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Projection, labelled vectors, labels and vote weights."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, totals: dict[int, int]):
        """features are overwritten; totals: labelled rows of each class before sampling."""
        self.prior = totals.get(1, 0) / max(sum(totals.values()), 1) if totals else 0.5
        self.labels = labels.astype(np.float32)
        rate = {c: max((labels == c).sum(), 1) / max(totals.get(c, 1), 1) for c in (0, 1)}
        self.weight = np.where(labels == 1, 1 / rate[1], 1 / rate[0]).astype(np.float32)
        self.weight /= self.weight.max(initial=1e-9)
        width = WORD_BINS + BINS
        frequency = (features > 0).mean(axis=0) if len(features) else np.zeros(width)
        self.idf = (np.log(1 / np.maximum(frequency, 1e-3)) + 1).astype(np.float32)
        x = self.weigh(features)  # in place: the sample is held once
        k = min(DIMENSIONS, *x.shape)
        random = np.random.default_rng(7)
        q = x.T @ random.standard_normal((len(x), min(k + 16, len(x)))).astype(np.float32) if len(x) else np.zeros((width, 1), np.float32)
        for _ in range(4):  # subspace iterations of a randomised decomposition
            q, _ = np.linalg.qr(x.T @ (x @ q) if len(x) else q)
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.axes = (q @ v[:k].T).astype(np.float32) if len(x) else np.zeros((width, 1), np.float32)
        self.points = _unit(x @ self.axes)

    def weigh(self, raw: np.ndarray) -> np.ndarray:
        """Both halves weighted and scaled to their shares, in place."""
        raw *= self.idf
        for half, share in ((raw[:, :WORD_BINS], WORDING), (raw[:, WORD_BINS:], 1 - WORDING)):
            length = np.sqrt(np.einsum("ij,ij->i", half, half))
            half *= (share**0.5 / np.maximum(length, 1e-12))[:, None].astype(np.float32)
        return raw

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a, b in few_rows(column):
            raw = _features(column[a:b])
            some = raw.any(axis=1)  # before raw is weighed in place
            cosines = _unit(self.weigh(raw) @ self.axes) @ self.points.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-6) ** POWER * self.weight[near]
            cast = votes.sum(axis=1, dtype=float)
            cast[~some] = 0
            heard = cast > 0  # a text at right angles to every label scores as an empty one
            out[a:b][heard] = (votes * self.labels[near]).sum(axis=1, dtype=float)[heard] / cast[heard]
        return np.clip(out, 0, 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features that aren't 0, their places first: 2 + 4 bytes each."""
    for batch in batches:
        column, rows = plain(batch.column(1)), []
        for a, b in few_rows(column):
            for x in _features(column[a:b]):
                at = np.flatnonzero(x)
                rows.append(at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["label", "features"])


def _dense(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), WORD_BINS + BINS), np.float32)
    for i, r in enumerate(rows):
        n = len(r.features) // 6
        out[i, np.frombuffer(r.features, "<u2", n)] = np.frombuffer(r.features, "<f4", n, 2 * n)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learns from at most per_class labelled rows of each class; give it no rows that are held out."""
    known = labels.where(F.col(id_).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_).alias("_id")).agg(F.max(label).alias("_label"))
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = F.broadcast(sample_per_class(known, "_id", "_label", per_class))  # at most 2 * per_class ids
    texts = docs.select(F.col(id_).alias("_id"), F.col(text).alias("text")).join(chosen, "_id").groupBy("_id", "_label").agg(F.min("text").alias("text")).select(F.col("_label").cast("int").alias("label"), "text")
    rows = sorted(texts.mapInArrow(_extract, "label int, features binary").collect(), key=lambda r: (r.features, r.label))  # at most WORD_BINS + BINS features a row
    return Model(_dense(rows), np.array([r.label for r in rows], np.int32), totals)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each row's text: 0 to 1, higher where label 1 is likelier."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(plain(texts)), pa.float64())

    return docs.withColumn(into, judge(F.col(text)))


def held_out(id_: str = "doc_id"):
    return remainder(F.col(id_), 4) == 2
