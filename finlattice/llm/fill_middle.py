"""Fill-in-middle transformation of whole batches of texts.

A text is cut at two places into prefix, middle and suffix, which are put together anew so that a
model learns to write the middle from both sides.  Places are counted in units: code points, words
(runs of word characters, runs of white space, other characters one by one) or lines.

A batch is worked on as the bytes of its UTF-8 buffer: a table gives each byte's class, a second
table tells from a byte's class and that of the byte before whether a unit begins there, the
cumulative sum of that mask less its value at the row's first byte numbers the units of each
row, and one binary search in the sums finds the cuts of all rows.  The cuts are offsets into the
same buffer, so the parts are taken and joined without a Python string.

Where a text is cut follows from four numbers drawn from SHA-256 of `<seed>:<id>`: reruns agree, and
no row depends on another.  `restore` rebuilds the text from the output and its form alone.

Defined results: a null text is an empty one, and an empty text is left plain, as is one that holds
a marker; a null id draws as an empty text does; rows with equal ids are cut at the same draws;
an empty table gives an empty one.  The output is one struct column, `into`, which replaces a column
of that name; all others stay.  A text of any length is numbered PIECE bytes at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import PIECE, plain, slices, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, and of these that begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
KIND = "struct<n:long,form:string,prefix_units:long,middle_units:long,output:string>"

# Classes of bytes: 0 inside a character, 1 first of a non-ASCII one, 2 word, 3 line end, 4 other white space, 5 other.
CLASS = np.full(256, 5, np.uint8)
CLASS[0x80:0xC0], CLASS[0xC0:] = 0, 1
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x5F, 0x60), (0x61, 0x7B)):
    CLASS[_a:_b] = 2
CLASS[[0x09, 0x0B, 0x0C, 0x0D, 0x20]], CLASS[0x0A] = 4, 3


def _begins(unit: str) -> np.ndarray:
    """[class before, class]: whether a unit begins between."""
    before, now = np.indices((6, 6))
    if unit == "code_point":
        return now != 0
    if unit == "line":
        return before == 3
    if unit == "word":
        return (now != 0) & ~((before <= 2) & (now <= 2)) & ~(np.isin(before, (3, 4)) & np.isin(now, (3, 4)))
    raise ValueError(f"no unit {unit!r}")


BEGINS = {unit: _begins(unit) for unit in ("code_point", "word", "line")}


class Units:
    """The numbered units of all rows of a buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        self.size, table = data.size, BEGINS[unit]
        self.mask = np.empty(data.size, bool)
        for a in range(0, data.size, PIECE):
            kinds = CLASS[data[max(a - 1, 0) : a + PIECE]]
            kinds = kinds if a else np.concatenate([kinds[:1], kinds])
            self.mask[a : a + PIECE] = table[kinds[:-1], kinds[1:]]
        self.mask[offsets[:-1][np.diff(offsets) > 0]] = True  # each row starts anew
        self.sums = np.cumsum([0, *[np.count_nonzero(self.mask[a : a + PIECE]) for a in range(0, data.size, PIECE)]])
        self.before = np.array([0, self.sums[-1]]) if len(offsets) == 2 else np.concatenate([[0], np.cumsum(self.mask)])[offsets]  # a long row stands alone
        self.counts = np.diff(self.before)

    def places(self, rows_unit: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The byte where unit rows_unit[r] of row r begins, or the row's end past its last."""
        wanted, out = self.before[:-1] + rows_unit, ends.copy()
        inside = rows_unit < self.counts
        for i, a in enumerate(range(0, self.size, PIECE)):
            own = np.flatnonzero(inside & (wanted >= self.sums[i]) & (wanted < self.sums[i + 1]))
            if own.size:
                out[own] = a + np.searchsorted(np.cumsum(self.mask[a : a + PIECE]), wanted[own] - self.sums[i] + 1)
        return out


def transform(column: pa.Array, draws: np.ndarray, unit: str, rate: int, suffix_first: int) -> pa.StructArray:
    """KIND for each text of a string array without nulls; draws: rows x 4 numbers."""
    data, offsets = text_bytes(column)
    units = Units(data, offsets, unit)
    n = units.counts
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    plain_form = (n == 0) | (draws[:, 2] % 100 >= rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain_form |= np.asarray(pc.match_substring(column, marker))
    spm = draws[:, 3] % 100 < suffix_first
    edges = np.column_stack([offsets[:-1], *[units.places(cuts[:, i], offsets[1:]) for i in (0, 1)]]).ravel()
    kind, wide = (pa.LargeStringArray, np.int64) if data.size > 1 << 31 else (pa.StringArray, np.int32)
    parts = kind.from_buffers(3 * len(column), pa.py_buffer(np.append(edges, data.size).astype(wide)), pa.py_buffer(np.ascontiguousarray(data)))
    each = np.arange(len(column)) * 3
    prefix, middle, suffix = (parts.take(pa.array(each + i)) for i in range(3))
    output = pc.if_else(
        pa.array(plain_form),
        column,
        pc.if_else(
            pa.array(spm),
            pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, ""),
            pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, ""),
        ),
    )
    form = pc.if_else(pa.array(plain_form), "plain", pc.if_else(pa.array(spm), "spm", "psm"))
    sizes = [pa.array(x, pa.int64(), mask=plain_form) for x in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), form.cast(pa.string()), *sizes, output.cast(pa.string())], ["n", "form", "prefix_units", "middle_units", "output"])


def draw(id_: str, seed: int, which: int) -> Column:
    """The which-th group of eight hexadecimal digits of SHA-256 of `<seed>:<id>`, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_: str = "doc_id", text: str = "text", into: str = "fim", unit: str = "code_point", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with `into`: units of the text, form (plain, psm or spm), units of prefix and middle (null if plain), output."""
    if unit not in BEGINS:
        raise ValueError(f"no unit {unit!r}")

    @F.arrow_udf(KIND)
    def run(texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        column, draws = plain(texts), np.column_stack([x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)])
        made = [transform(column[x:y], draws[x:y], unit, rate, suffix_first) for x, y in slices(column)]
        return pa.concat_arrays(made) if made else transform(column, draws, unit, rate, suffix_first)

    return docs.withColumn(into, run(F.col(text), *[draw(id_, seed, i) for i in range(4)]))


def restore(form: Column, output: Column) -> Column:
    """The text that an output of fill_in_middle was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")  # no text that was cut holds a marker
    part = lambda i: F.get(parts, F.lit(i))
    rebuilt = F.when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.concat(part(1), part(3), part(2)))
    return F.when(form == "plain", output).otherwise(rebuilt)
