"""A static range asymmetric numeral system over interleaved lanes, in numpy.

Symbol i of a block belongs to lane i mod LANES; all lanes step together, so one step codes LANES
symbols by vector operations.  States are 63-bit, renormalised by 32-bit words; frequencies are
scaled to 2 ** SCALE_BITS, at least 1 for every symbol that occurs.
"""

from __future__ import annotations

import numpy as np

LANES = 1024
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
_U = np.uint64


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE_BITS; the rounding error goes to the most frequent symbols."""
    total, size = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > size // 2:
        raise ValueError("too many symbols for the scale")
    f = np.where(counts > 0, np.maximum(1, np.floor(counts.astype(float) * size / total)), 0).astype(np.int64)
    order, off = np.argsort(-f, kind="stable"), size - int(f.sum())
    for i in order:
        if off == 0:
            break
        change = off if off > 0 else max(off, 1 - int(f[i]) if f[i] else 0)
        f[i] += change
        off -= change
    return f.astype(np.uint32)


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(_U)
        self.c = np.concatenate([[0], np.cumsum(frequencies.astype(np.int64))])[:-1].astype(_U)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies.astype(np.int64))

    def encode(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lanes' final states and the words, in the order that decode() reads them."""
        x, parts = np.full(LANES, LOW, _U), []
        for at in range((len(symbols) - 1) // LANES * LANES, -1, -LANES) if len(symbols) else ():
            s = symbols[at : at + LANES]
            f, lane = self.f[s], x[: len(s)]
            full = lane >= f << _U(63 - SCALE_BITS)
            parts.append(lane[full].astype(np.uint32))
            lane[full] >>= _U(32)
            high = lane // f
            lane[:] = (high << _U(SCALE_BITS)) + (lane - high * f) + self.c[s]
        return x, np.concatenate(parts[::-1]) if parts else np.zeros(0, np.uint32)

    def decode(self, states: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        x, out, read, mask = states.astype(_U).copy(), np.empty(n, np.uint32), 0, _U((1 << SCALE_BITS) - 1)
        for at in range(0, n, LANES):
            lane = x[: min(LANES, n - at)]
            slot = lane & mask
            s = self.symbol[slot.astype(np.int64)]
            out[at : at + LANES] = s
            lane[:] = self.f[s] * (lane >> _U(SCALE_BITS)) + slot - self.c[s]
            low = lane < LOW
            count = int(np.count_nonzero(low))
            if count:
                lane[low] = (lane[low] << _U(32)) | words[read : read + count]
                read += count
        if read != len(words) or not (x == LOW).all():
            raise ValueError("damaged block")
        return out
