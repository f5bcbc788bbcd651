"""Hashed byte n-gram features of whole texts, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import PIECE, text_bytes


def gram_ids(data: np.ndarray, offsets: np.ndarray, n: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-gram that begins at each byte and its row; n-grams across rows are left out."""
    if data.size < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = data.size - n + 1
    h = np.full(count, n, np.uint32)
    for i in range(n):
        h = (h ^ data[i : i + count]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:count] == row[n - 1 :]
    return (h[inside] % np.uint32(bins)).astype(np.int64), row[:count][inside]


def overlapping(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows as they are, or one long row in pieces that share n - 1 bytes, so that each n-gram is in one piece."""
    if len(offsets) != 2 or data.size <= 2 * PIECE:
        yield data, offsets
        return
    for a in range(0, data.size - n + 1, PIECE):
        piece = data[a : a + PIECE + n - 1]
        yield piece, np.array([0, piece.size])


def gram_counts(column: pa.Array, sizes: tuple[int, ...], bins: int, table: np.ndarray) -> np.ndarray:
    """rows x bins counts of the n-grams of all sizes, after bytes are mapped by table."""
    data, offsets = text_bytes(column)
    rows = len(column)
    out = np.zeros(rows * bins, np.float32)
    for n in sizes:
        for piece, ends in overlapping(data, offsets, n):
            ids, row = gram_ids(table[piece], ends, n, bins)
            out += np.bincount(row * bins + ids, minlength=rows * bins).astype(np.float32)
    return out.reshape(rows, bins)


def few_rows(column: pa.Array, most_bytes: int = 2 << 20, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """Row ranges bounded in bytes and in rows; a longer text stands alone."""
    _, offsets = text_bytes(column)
    start, rows = 0, len(column)
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), start + most_rows, rows)
        yield start, end
        start = end


def remainder(id_: Column, of: int) -> Column:
    """crc32 of the id's text modulo `of`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(of))


def sample_per_class(labels: DataFrame, id_: str, label: str, most: int) -> DataFrame:
    """At most `most` rows of each class, those with the smallest hashes of the id.

    First a hash threshold leaves about twice as many of each class, so only a bounded number of
    rows is ranked.
    """
    h = F.xxhash64(F.col(id_), F.lit("sample"))
    counts = labels.groupBy(label).agg(F.count("*").alias("_n"))
    rows = labels.join(F.broadcast(counts), label)  # as many rows as classes
    rows = rows.where(F.pmod(h, F.lit(1 << 40)) <= F.ceil(F.lit(float(1 << 40)) * (2.0 * most + 50) / F.col("_n")))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(h, id_))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_n", "_rank")
