"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  Every
window of `n` consecutive words of a test item goes into the set; an item of fewer words, but not
none, is one window.  Each batch of training text is scanned by vector operations: words are
hashed, windows are hashed from them, and a sorted search in the set finds hits, each of which is
verified word by word against the item's text.  Document words inside any hit window are hit.

The set is broadcast in parts of about PART_WINDOWS windows (a longer item is a part of its own); the
test table is streamed to the driver and split by item into as many parts as it needs.  One part
is scanned in the documents' own pass.  With more the documents are written once, with a number each;
each part then costs a pass over number and text that writes the rows with hits only, before the next
part is sent and the last one destroyed, and at the end the hits are united by number and
joined: a worker holds one part at a time, whatever the benchmark's size.

Defined results: null or wordless texts have no words and no hits; null texts and items without
words have no windows; rows of the benchmark with equal ids are one item, and those with a null id
are one item without a name: it hits and stands last in `items`, as null; repeated documents count
each; empty tables are fine on either side.  find_overlap() replaces a column that has the name of its
output; drop_documents() and cut_spans() keep all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, U64, materialise, plain, slices, text_bytes, unused, window_hashes, word_hashes, word_spans

N = 10
PART_WINDOWS = 2_000_000

NAMES = ("n_words", "starts", "ends", "from_byte", "to_byte", "items")
KIND = "struct<n_words:long,starts:array<int>,ends:array<int>,from_byte:array<int>,to_byte:array<int>,items:array<string>>"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = ASCII_LOWER[data]
    return data, *word_spans(data, offsets)


def in_order(names) -> list:
    """Distinct item names, sorted as strings, null last."""
    return sorted(set(names), key=lambda x: (x is None, x))


class TestWindows:
    """The windows of some items: their texts once, and for each window length sorted hashes with places in the texts."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.names = [name for name, _ in items]
        self.data, self.starts, self.ends, firsts = _words(pa.array([t or "" for _, t in items], pa.string()))
        hashes, counts = word_hashes(self.data, self.starts, self.ends), np.diff(firsts)
        self.by_size = {}
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            windows, item = window_hashes(hashes, size), np.searchsorted(firsts, np.arange(max(hashes.size - size + 1, 0)), "right") - 1
            own = np.flatnonzero((np.minimum(counts[item], n) == size) & (np.arange(len(item)) + size <= firsts[item + 1]))
            order = own[np.argsort(windows[own], kind="stable")]
            self.by_size[size] = windows[order], order, item[order].astype(np.int32)

    def words(self, first: int, size: int) -> bytes:
        return _text(self.data, self.starts, self.ends, first, size)

    def scan(self, column: pa.Array) -> Iterator[tuple]:
        """For each text: words, then hit windows' first and past-last word, their bytes, and item names."""
        data, starts, ends, firsts = _words(column)
        _, offsets = text_bytes(column)
        hashes = word_hashes(data, starts, ends)
        rows: list[dict] = [{} for _ in range(len(column))]
        known: dict[tuple[int, bytes], tuple[int, ...]] = {}  # a batch repeats few windows often
        for size, (keys, places, item) in self.by_size.items():
            windows = window_hashes(hashes, size)
            at = np.searchsorted(keys, windows)
            at[at == keys.size] = 0
            for w in np.flatnonzero(keys[at] == windows):
                row = int(np.searchsorted(firsts, w, "right")) - 1
                if w + size > firsts[row + 1]:
                    continue
                words = _text(data, starts, ends, w, size)
                own = known.get((size, words))
                if own is None:
                    equal = range(at[w], int(np.searchsorted(keys, windows[w], "right")))
                    own = known[size, words] = tuple({int(item[i]) for i in equal if self.words(int(places[i]), size) == words})
                if own:
                    rows[row][int(w), size] = own
        for row, hits in enumerate(rows):
            first, base = int(firsts[row]), int(offsets[row])
            spans = merged([(w, w + size) for w, size in hits])
            yield (
                int(firsts[row + 1]) - first,
                [a - first for a, _ in spans],
                [b - first for _, b in spans],
                [int(starts[a]) - base for a, _ in spans],
                [int(ends[b - 1]) - base for _, b in spans],
                in_order(self.names[i] for own in set(hits.values()) for i in own),
            )


def _text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, size: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[first : first + size], ends[first : first + size], strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame, item_id: str, text: str, n: int, most: int) -> Iterator[list]:
    """The items, streamed to the driver partition by partition, in lists of at most `most` windows or one item."""
    part, held = [], 0
    for name, words in benchmark.select(F.col(item_id).cast("string"), text).toLocalIterator():
        size = len(words or "") // 2 + 1  # no text has more words
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append((name, words))
        held += size
    yield part


def find_overlap(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, part_windows: int = PART_WINDOWS, into: str = "overlap") -> DataFrame:
    """docs with a column `into`: the hit spans (words and bytes of the text) and items of each row."""
    context = docs.sparkSession.sparkContext
    parts = _parts(benchmark, item_id, item_text, n, part_windows)
    part, more = next(parts), next(parts, None)
    if more is None:
        return docs.withColumn(into, scanner(context.broadcast(TestWindows(part, n)))(F.col(text)))
    number, found = unused(docs, "_row"), unused(docs, "_overlap")
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "overlap-documents")
    hits = None
    while part is not None:
        sent = context.broadcast(TestWindows(part, n))
        own = numbered.select(F.col(number).alias("row"), scanner(sent)(F.col(text)).alias("o"))
        own = materialise(own if hits is None else own.where(F.size("o.starts") > 0), "overlap")  # the first also counts the words
        sent.unpersist()
        hits, part, more = own if hits is None else hits.unionByName(own), more, next(parts, None)
    spans = hits.groupBy("row").agg(F.collect_list("o").alias("all")).select(F.col("row").alias(number), F.arrow_udf(unite, KIND)("all").alias(found))  # at most one a part
    joined = numbered.join(spans, number)
    return joined.select(*[c for c in docs.columns if c.lower() != into.lower()], F.col(found).alias(into))


def scanner(windows):
    @F.arrow_udf(KIND)
    def scan(texts: pa.Array) -> pa.Array:
        column, rows = plain(texts), []
        for a, b in slices(column):
            rows.extend(windows.value.scan(column[a:b]))
        return _structs(rows)

    return scan


def _structs(rows: list[tuple]) -> pa.Array:
    spans = pa.list_(pa.int32())
    kinds = (pa.int64(), spans, spans, spans, spans, pa.list_(pa.string()))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)


def unite(found: pa.Array) -> pa.Array:
    """Joins the overlaps that the parts of the benchmark have found in each text."""
    rows = []
    for every in found.to_pylist():
        spans = [merged([s for p in every for s in zip(p[a], p[b], strict=True)]) for a, b in (NAMES[1:3], NAMES[3:5])]
        rows.append((every[0]["n_words"], *[[s[i] for s in own] for own in spans for i in (0, 1)], in_order(x for p in every for x in p["items"])))
    return _structs(rows)


def hit_words(overlap: str = "overlap"):
    return F.aggregate(F.zip_with(f"{overlap}.starts", f"{overlap}.ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def drop_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs without any hit."""
    into = unused(docs, "_overlap")
    return find_overlap(docs, benchmark, into=into, **how).where(F.size(f"{into}.starts") == 0).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with hit spans cut out of the text, from the first byte of their first word to the last of their last."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, froms: pa.Array, tos: pa.Array) -> pa.Array:
        out = []
        for t, begins, ends in zip(texts.to_pylist(), froms.to_pylist(), tos.to_pylist(), strict=True):
            if t is not None and begins:
                raw = t.encode()
                t = b"".join(raw[x:y] for x, y in zip([0, *ends], [*begins, len(raw)], strict=True)).decode()
            out.append(t)
        return pa.array(out, pa.string())

    into = unused(docs, "_overlap")
    found = find_overlap(docs, benchmark, text=text, into=into, **how)
    return found.withColumn(text, cut(text, f"{into}.from_byte", f"{into}.to_byte")).select(*docs.columns)
