"""Helpers that several operators use: the shared folder and vectorised word splitting."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U64(0xD6E8FEB86659FD93)
#: Bytes, or words, that are worked on at a time.
PIECE = 1 << 20

#: Bytes of a word: digits, a-z after lower-casing, and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


_scopes: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Folders that are named inside lie in one of their own, which is removed at the end.

    What is needed later must be written outside before: DataFrames made inside can't be read then.
    """
    _scopes.append(shared_folder(spark, name))
    try:
        yield
    finally:
        discard(spark, _scopes.pop())


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of any store that Spark reaches, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent in local mode (tests) a temporary folder is set as the checkpoint
    folder of the session; on a cluster that is an error.
    """
    base = _scopes[-1] if _scopes else spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="finlattice-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets of its rows in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, most_bytes: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about most_bytes of text; a longer text stands alone."""
    _, offsets = text_bytes(column)
    start, rows = 0, len(column)
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and the number of words before each row (and in all).

    Works through PIECE bytes at a time, so what it needs beside its result doesn't grow with a text.
    """
    edges = offsets[1:-1]
    starts, ends = [], []
    for a in range(0, data.size, PIECE):
        b = min(a + PIECE, data.size)
        inside = table[data[max(a - 1, 0) : b + 1]]  # with a byte on either side
        if not a:
            inside = np.concatenate([[False], inside])
        if b == data.size:
            inside = np.concatenate([inside, [False]])
        here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
        own = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b, "right")] - a
        before[own[own < b - a]] = False
        after[own[own > 0] - 1] = False
        starts.append(np.flatnonzero(here & ~before) + a)
        ends.append(np.flatnonzero(here & ~after) + a + 1)
    first = np.concatenate([np.zeros(0, np.int64), *starts])
    return first, np.concatenate([np.zeros(0, np.int64), *ends]), np.searchsorted(first, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(PIECE, base, U64)]), dtype=U64) for base in (_BASE, _BASE_INVERSE)]
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: differences of one running polynomial sum for each PIECE bytes, then mixed.

    A span longer than PIECE is hashed by itself.
    """
    up, down = _power_tables()
    out, i = np.empty(starts.size, U64), 0
    while i < starts.size:
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        b = int(ends[j - 1])
        if b - a > PIECE:
            out[i] = int.from_bytes(hashlib.blake2b(np.ascontiguousarray(data[a:b]), digest_size=8).digest(), "little")
        else:
            total = np.zeros(b - a + 1, U64)
            np.cumsum((data[a:b].astype(U64) + U64(1)) * up[: b - a], out=total[1:])
            x, y = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix((total[y] - total[x]) * down[x] + (y - x).astype(U64))
        i = j
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; the last n - 1 places have none."""
    count = max(words.size - n + 1, 0)
    out = np.empty(count, U64)
    for a in range(0, count, PIECE):
        b = min(a + PIECE, count)
        part = np.full(b - a, U64(n), U64)
        for i in range(n):
            part *= _STEP
            part += words[a + i : b + i]
        out[a:b] = mix(part)
    return out


def shingles(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, in row order, and the number before each row.

    A row of fewer than n words, but not none, has one shingle of all its words.
    """
    counts = np.diff(firsts)
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(before[-1], U64)
    if words.size >= n:
        good = np.zeros(words.size + 1, np.int64)  # +1 where a row's shingles begin, -1 after their end
        long = counts >= n
        np.add.at(good, firsts[:-1][long], 1)
        np.add.at(good, firsts[1:][long] - n + 1, -1)
        take = np.cumsum(good[:-1])[: words.size - n + 1] > 0
        place = np.ones(len(out), bool)
        place[before[:-1][(counts > 0) & (counts < n)]] = False
        out[place] = window_hashes(words, n)[take]
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        out[before[row]] = window_hashes(words[firsts[row] : firsts[row + 1]], int(counts[row]))[0]
    return out, before


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)
