"""Language identification: string-kernel ridge regression on Nystrom landmarks.

The kernel is the blended spectrum kernel on presence: the number of byte n-grams (1 to 4, hashed)
that two lower-cased texts share, normalised to 1 for equal texts.  `landmarks` texts of the
labelled sample span its Nystrom approximation; a ridge regression is fitted for each language
against the rest.  As the kernel is an inner product of presence vectors, the landmarks' weights
fold into one weight per n-gram and language, and a batch of texts is scored with that matrix: the
same numbers, without comparing with each landmark.

The labelled sample is the only bounded part: at most `per_class` rows of each language and MOST_ROWS
in all, but one of each language however many there are, so that every language can be predicted.
Landmarks are LANDMARKS rows of it, or one a language where there are more languages, up to
MOST_LANDMARKS; the ridge is solved in that space for all languages at once, from sums over blocks of
rows.  A batch is scored by gathering and adding the weights of the n-grams that occur (the product
with a sparse presence matrix); with more languages than landmarks these are the landmarks' own
columns, and a second product turns them into scores.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text if
nothing can be learned; rows with equal texts get equal answers; other columns are ignored by fit() and
kept by identify(), whose two outputs replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import few_rows, gram_ids, overlapping, remainder, sample_per_class
from .shared import ASCII_LOWER, lowered, plain, text_bytes, unused

PER_CLASS = 400
LANDMARKS = 512
BINS = 1 << 15
SIZES = (1, 2, 3, 4)
RIDGE = 1e-3
#: Rows of the sample that are compared with the landmarks at a time.
BLOCK = 256
MOST_ROWS = 2000
MOST_LANDMARKS = 2048

#: Letters and non-ASCII bytes as they are, lower-cased; the rest is one separator.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = ASCII_LOWER[0x41:0x5B]
FOLD[0x80:] = np.arange(0x80, 0x100)


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (row, n-gram) pairs that occur, as one sorted array each."""
    data, offsets = text_bytes(column)
    seen = np.zeros(len(column) * BINS, bool)
    for n in SIZES:
        for piece, ends in overlapping(data, offsets, n):
            ids, row = gram_ids(FOLD[piece], ends, n, BINS)
            seen[row * BINS + ids] = True
    at = np.flatnonzero(seen)
    return at // BINS, at % BINS


def _dense(sets: list[np.ndarray]) -> np.ndarray:
    """Presence vectors of length 1."""
    out = np.zeros((len(sets), BINS), np.float32)
    for i, s in enumerate(sets):
        out[i, s] = 1 / np.sqrt(max(len(s), 1))
    return out


class Model:
    def __init__(self, languages: list[str], sets: list[np.ndarray], labels: np.ndarray):
        self.languages = languages
        n, many = len(sets), len(languages)
        k = min(max(LANDMARKS, min(many, MOST_LANDMARKS)), n)
        chosen = np.linspace(0, n - 1, k).astype(int) if n else np.zeros(0, int)  # rows come sorted by language, so all have their share
        marks = _dense([sets[i] for i in chosen])
        share = np.bincount(labels, minlength=many) / max(n, 1)
        weight = 1 / (many * np.maximum(share[labels], 1e-9)) if n else np.zeros(0)
        system, right = RIDGE * n * (marks @ marks.T).astype(float) + 1e-8 * n * np.eye(k), np.zeros((k, many))
        for a in range(0, n, BLOCK):
            near = (_dense(sets[a : a + BLOCK]) @ marks.T).astype(float)
            left = near.T * weight[a : a + BLOCK]
            system += left @ near
            right -= left.sum(axis=1, keepdims=True)  # the target is -1, but 1 in the row's own language
            np.add.at(right.T, labels[a : a + BLOCK], 2 * left.T)
        folded = np.linalg.solve(system, right) if n else right
        self.last = folded.astype(np.float32) if many > k else None
        self.weights = marks.T.copy() if many > k else (marks.T @ folded).astype(np.float32)

    def answer(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = np.full(len(column), "und", object), np.zeros(len(column))
        if not self.languages:
            return names.tolist(), scores
        letter = np.asarray(pc.match_substring_regex(column, r"\p{L}"))
        for a, b in few_rows(column, most_rows=256):
            row, gram = presence(lowered(column[a:b]))
            sizes = np.bincount(row, minlength=b - a)
            raw = np.zeros((b - a, self.weights.shape[1]))
            some = np.flatnonzero(sizes)
            if some.size:
                begin = np.concatenate([[0], np.cumsum(sizes)])[some]
                raw[some] = np.add.reduceat(self.weights[gram], begin, axis=0) / np.sqrt(sizes[some])[:, None]
            raw = raw if self.last is None else raw @ self.last
            best = raw.argmax(axis=1)
            likely = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
            names[a:b] = np.array(self.languages, object)[best]
            scores[a:b] = (likely / likely.sum(axis=1, keepdims=True)).max(axis=1)
        names[~letter], scores[~letter] = "und", 0.0
        return names.tolist(), scores


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, rows = plain(batch.column(1)), []
        for a, b in few_rows(column, most_rows=256):
            row, gram = presence(lowered(column[a:b]))
            edges = np.searchsorted(row, np.arange(b - a + 1))
            rows += [gram[x:y].astype("<u2").tobytes() for x, y in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["label", "grams"])


def fit(docs: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = PER_CLASS) -> Model:
    """Learns from at most per_class rows of each language; give it no rows that are held out."""
    named = docs.select(F.col(id_).alias("_id"), F.col(lang).alias("_label"), F.col(text).alias("text"))
    known = named.where("_label IS NOT NULL AND text IS NOT NULL AND _id IS NOT NULL").select("_id", "_label")
    many = known.select("_label").distinct().count()
    per_class = max(1, min(per_class, MOST_ROWS // max(many, 1)))
    chosen = sample_per_class(known, "_id", "_label", per_class)  # at most MOST_ROWS ids, or one a language
    texts = named.join(F.broadcast(chosen) if many <= MOST_ROWS else chosen, ["_id", "_label"]).groupBy("_id", F.col("_label").alias("label")).agg(F.min("text").alias("text")).select("label", "text")
    rows = sorted(texts.mapInArrow(_extract, "label string, grams binary").collect())  # 2 * BINS bytes a row at most
    languages = sorted({r.label for r in rows})
    place = {name: i for i, name in enumerate(languages)}
    return Model(languages, [np.frombuffer(r.grams, "<u2") for r in rows], np.array([place[r.label] for r in rows], int))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        names, scores = sent.value.answer(plain(texts))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    own = unused(docs, "_answer")
    return docs.withColumn(own, judge(F.col(text))).withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "score": F.col(f"{own}.score")}).drop(own)


def held_out(id_: str = "doc_id"):
    return remainder(F.col(id_), 3) == 1
