"""Bloom filters of 64-bit hashes, built by Spark and small enough to broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, mix

PROBES = 5
BITS_A_KEY = 16
LEAST_BITS = 1 << 12


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places of each hash."""
    h = mix(hashes.astype(np.int64).view(U64))
    step = mix(h ^ U64(0x9E3779B97F4A7C15)) | U64(1)
    return np.stack([(h + U64(i) * step) & U64(bits - 1) for i in range(PROBES)])


class Bloom:
    """Never denies what it was built from; its words take bits / 8 bytes."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, hashes: DataFrame, most_bits: int) -> Bloom:
        """From the column h of hashes; 16 bits a row, but most_bits (a power of two) at most."""
        bits = LEAST_BITS
        rows = hashes.count()
        while bits < min(most_bits, BITS_A_KEY * rows):
            bits *= 2

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = np.unique(_places(batch.column(0).to_numpy(), bits))
                word, first = np.unique(places >> U64(6), return_index=True)
                value = np.bitwise_or.reduceat(U64(1) << (places & U64(63)), first) if first.size else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

        table = hashes.select("h").mapInArrow(set_bits, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()  # at most bits / 64 rows
        words = np.zeros(bits // 64, U64)
        words[table.column("word").to_numpy()] = table.column("value").to_numpy().view(U64)
        return cls(words)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in _places(np.asarray(hashes), self.words.size * 64):
            out &= (self.words[place >> U64(6)] >> (place & U64(63)) & U64(1)).astype(bool)
        return out
