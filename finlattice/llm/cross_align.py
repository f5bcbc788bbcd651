"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Every text, with a space before it, is encoded by a byte-level BPE (A) and by a sentencepiece model
(B, which adds that space itself).  The tokens' byte ranges of B, in order, are a static interval
index: for the range of an A token, one bisection in the ends and one in the starts of B give the
first and the last B token that it overlaps.  An A token spans the gaps between the B tokens of its
list; where no A token spans a gap, both tokenizers end a token, and the gap closes a group: the
smallest runs of A and B tokens of equal bytes.  An A and a B token whose ranges end together are
linked; links are counted by pair of ids over the whole corpus, and each document reports how many
of its links are the most frequent one of their B id, and the sum of its links' counts.

Texts are tokenised once, in the tasks that read them, into a table in the shared folder, which also
holds the pair counts of each task; these are summed by pair.  The sums of up to `most_pairs` pairs
are broadcast for the second pass; beyond, documents meet them by a join on pair and a salt, over
pairs already counted within each document.  A long text is worked on in sections of about PIECE
bytes, cut where both tokenizers surely begin a token (a space after an ASCII letter).

Defined results: texts that are null or empty, or that either tokenizer does not spell out byte for
byte (a text with U+2581 in it, say), have no tokens: counts of 0, an empty text of groups and an
empty digest.  Rows with equal or null ids are reported each; an empty table gives an empty one.
The result is a table of its own, so the input's other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import PIECE, materialise, plain, slices, text_bytes
from .token_files import _LETTER, Tokens

#: Pairs of ids that are broadcast at most (13 bytes each), and that a task holds before it writes its counts.
MOST_PAIRS = 2_000_000
HELD_PAIRS = 1 << 20
SALTS = 16
SPACE = "▁"
#: What follows a token's id in the text of groups: another of its side, the other side, the next group, nothing.
AFTER = (",", "|", ";", "")


class Pieces(Tokens):
    """A sentencepiece model with a bounded cache of the ids of words.

    Where no piece holds a space after another character, merges never cross the boundary before a
    space that follows another character, so the text may be cut there and its parts encoded alone.
    Texts come with the space that the model would add, which is taken off again.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        probe = "".join(pieces[i] for i in self.model.encode(" a  b "))
        self.parts = probe == " a  b ".replace(" ", SPACE).join([SPACE, ""]) and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.spelling = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def begins(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(data.size + 1, bool)
        if self.parts:
            out[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        alone = [self.model.piece_to_id(SPACE)]
        return [np.array(ids if len(t) > 1 else alone, np.uint32).tobytes() for t, ids in zip(texts, found, strict=True)]


class Spelling:
    """The bytes of each token id."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.first, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(tokens), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.first[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if ends.size else 0)]


class Found(NamedTuple):
    """What a batch of texts gave: by row whether it is spelled out, and counts of A tokens, B tokens, groups and links; the groups' text and the links of all rows, with the rows' edges in both."""

    good: np.ndarray
    counts: np.ndarray
    text: np.ndarray
    text_edges: np.ndarray
    links: np.ndarray
    link_edges: np.ndarray


class Aligner:
    """Both tokenizers of a worker process."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Tokens(a_path, special=False), Pieces(b_path)
        byte = {c: b for b, c in self.a.letters.items()} | {chr(b): b for b in range(256) if b not in self.a.letters}
        vocabulary = sorted((i, t) for t, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items())
        spelled = [b""] * (vocabulary[-1][0] + 1)
        for i, t in vocabulary:
            spelled[i] = bytes(byte[c] for c in t)
        self.spell = Spelling(spelled), Spelling(self.b.spelling)
        self.shown = pa.array([f"{i}{s}" for i in range(max(len(spelled), self.b.size)) for s in AFTER])
        self.shift = np.uint64(max(self.b.size - 1, 1).bit_length())
        self.key = np.uint32 if len(spelled) << int(self.shift) <= 1 << 32 else np.uint64

    def align(self, spaced: pa.Array) -> Found:
        """spaced: texts that begin with a space."""
        data, offsets = text_bytes(spaced)
        rows, good = len(spaced), np.ones(len(spaced), bool)
        sides = []
        for tokens, spell in zip((self.a, self.b), self.spell, strict=True):
            ids, many = tokens.encode(spaced)
            spelled = spell.bytes(ids)
            edges = np.concatenate([[0], np.cumsum(spell.sizes[ids])])[np.concatenate([[0], np.cumsum(many)])]
            if not (np.array_equal(edges, offsets) and np.array_equal(spelled, data)):
                for r in range(rows):
                    good[r] &= np.array_equal(spelled[edges[r] : edges[r + 1]], data[offsets[r] : offsets[r + 1]])
            sides.append((ids.astype(np.int64), many))
        (a, n_a), (b, n_b) = ((ids[np.repeat(good, many)], np.where(good, many, 0)) for ids, many in sides)
        row_a, row_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        ends_a, ends_b = (np.cumsum(spell.sizes[ids]) for ids, spell in zip((a, b), self.spell, strict=True))
        starts_a, starts_b = ends_a - self.spell[0].sizes[a], ends_b - self.spell[1].sizes[b]

        first = np.searchsorted(ends_b, starts_a, "right")  # the B tokens that each A token overlaps, first to last
        last = np.searchsorted(starts_b, ends_a, "left") - 1
        spanned = np.cumsum(np.bincount(first, minlength=b.size + 1) - np.bincount(last, minlength=b.size + 1))[: b.size]
        closes = spanned == 0
        group_b = np.cumsum(closes) - closes
        group_a = group_b[first] if a.size else first
        linked = np.flatnonzero(ends_a == ends_b[last]) if a.size else first
        links = (a[linked].astype(np.uint64) << self.shift | b[last[linked]].astype(np.uint64)).astype(self.key)

        many_a, many_b = (np.cumsum(np.bincount(g, minlength=1)) for g in (group_a, group_b))
        codes = np.empty(a.size + b.size, np.int64)
        before_b = np.concatenate([[0], many_b])
        codes[np.arange(a.size) + before_b[group_a]] = a * len(AFTER) + np.append(group_a[1:] != group_a[:-1], True)[: a.size]
        after_b = np.where(closes, 2, 0)
        after_b[row_b[1:][n_b > 0] - 1] = 3
        codes[np.arange(b.size) + many_a[group_b]] = b * len(AFTER) + after_b
        text, edges = text_bytes(self.shown.take(pa.array(codes)))
        closed = np.concatenate([[0], np.cumsum(closes)])
        link_edges = np.searchsorted(linked, row_a)
        counts = np.column_stack([n_a, n_b, np.diff(closed[row_b]), np.diff(link_edges)])
        return Found(good, counts, text, edges[row_a + row_b], links, link_edges)

    def sections(self, spaced: pa.Array) -> Iterator[pa.Array]:
        """One long text in parts that begin with a space."""
        data, _ = text_bytes(spaced)
        at = 0
        while at < data.size:
            end = data.size
            if self.a.byte_level and self.b.parts:
                for look in range(at, data.size - PIECE, PIECE // 2):
                    own = data[look + PIECE // 2 : look + PIECE + 1]
                    cut = np.flatnonzero((own[1:] == 0x20) & _LETTER[own[:-1]])
                    if cut.size:
                        end = look + PIECE // 2 + 1 + int(cut[-1])
                        break
            yield pa.array([data[at:end].tobytes()], pa.binary()).cast(pa.string())
            at = end

    def rows(self, column: pa.Array, with_groups: bool) -> tuple[np.ndarray, list, list, list]:
        """Counts, digests, groups and links of each text of a string array without nulls, as slices() gives it."""
        some = np.flatnonzero(np.asarray(pc.binary_length(column)))
        counts, digests, groups, links = np.zeros((len(column), 4), np.int64), [""] * len(column), [""] * len(column), [b""] * len(column)
        spaced = pc.binary_join_element_wise(" ", column.take(pa.array(some)), "") if some.size else column[:0]
        if len(spaced) == 1:
            digest, texts, own = hashlib.sha256(), [], []
            for i, part in enumerate(self.sections(spaced)):
                found = self.align(part)
                if not found.good[0]:
                    return np.zeros_like(counts), [""] * len(column), [""] * len(column), [b""] * len(column)
                made = (b";" if i else b"") + found.text.tobytes()
                digest.update(made)
                texts.append(made if with_groups else b"")
                own.append(found.links.tobytes())
                counts[some[0]] += found.counts[0]
            digests[some[0]], groups[some[0]], links[some[0]] = digest.hexdigest(), b"".join(texts).decode(), b"".join(own)
        elif len(spaced):
            found = self.align(spaced)
            counts[some] = found.counts
            for i, r in enumerate(some.tolist()):
                if found.good[i]:
                    made = found.text[found.text_edges[i] : found.text_edges[i + 1]]
                    digests[r] = hashlib.sha256(made).hexdigest()
                    groups[r] = made.tobytes().decode() if with_groups else ""
                    links[r] = found.links[found.link_edges[i] : found.link_edges[i + 1]].tobytes()
        return counts, digests, groups, links


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process and pair of files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(keys.size, np.int64)
    np.add.at(sums, where, np.concatenate([n for _, n in parts]))
    return keys, sums


FIELDS = "place long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, pairs binary, counts binary"


def alignments(docs: DataFrame, a_path: str, b_path: str, id_: str, text: str, with_groups: bool) -> DataFrame:
    """(id, FIELDS): a row for each document, and rows of pair counts of each task."""
    source = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL(FIELDS).fields])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a reused worker may still hold what earlier stages read
        both, place, held, size = aligner(a_path, b_path), TaskContext.get().partitionId() << 40, [], 0
        id_kind = pa.null()

        def rows(ids: pa.Array, *columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

        def sums() -> pa.RecordBatch:
            keys, n = summed(held)
            return rows(pa.nulls(1, id_kind), [None], *[[None]] * 7, [keys.astype("<i8").tobytes()], [n.astype("<i8").tobytes()])

        for batch in batches:
            column, id_kind = plain(batch.column(1)), batch.schema.field(0).type
            for x, y in slices(column):
                counts, digests, groups, links = both.rows(column[x:y], with_groups)
                yield rows(batch.column(0)[x:y], range(place, place + y - x), *counts.T, digests, groups, links, [None] * (y - x), [None] * (y - x))
                place += y - x
                held.append(np.unique(np.frombuffer(b"".join(links), both.key), return_counts=True))
                size += held[-1][0].size
                if size > HELD_PAIRS:
                    held = [summed(held)]
                    size = held[0][0].size
                    if size > HELD_PAIRS // 2:
                        yield sums()
                        held, size = [], 0
        if size:
            yield sums()

    return source.mapInArrow(run, schema)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pairs, counts in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), "<i8")) for x in (pairs, counts)], ["pair", "n"])


def pair_table(rows: DataFrame, shift: int) -> DataFrame:
    """(pair, n, best): links of each pair of ids over the corpus, and whether no other pair of its B id has more."""
    sums = rows.where("pairs IS NOT NULL").select("pairs", "counts").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "pairs").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << shift) - 1)))
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    return sums.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))  # a row an id of B


def align(docs: DataFrame, a_path: str, b_path: str, id_: str = "doc_id", text: str = "text", with_groups: bool = False, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(id_, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with with_groups the groups) of each document."""
    both = aligner(a_path, b_path)
    rows = materialise(alignments(docs, a_path, b_path, id_, text, with_groups), "alignments")
    pairs = materialise(pair_table(rows, int(both.shift)), "pair-counts")
    rows = rows.where("place IS NOT NULL")
    if pairs.count() <= most_pairs:
        table = pairs.toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(_sorted(*[table.column(i).to_numpy() for i in range(3)], both.key))

        @F.arrow_udf("struct<n_best:long,count_sum:long>")
        def look_up(links: pa.Array) -> pa.Array:
            keys, n, best = sent.value
            out = np.zeros((2, len(links)), np.int64)
            for i, own in enumerate(links):
                own = np.frombuffer(own.as_buffer() or b"", keys.dtype)
                if own.size:
                    at = np.searchsorted(keys, own)
                    out[:, i] = np.count_nonzero(best[at]), n[at].sum()
            return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n_best", "count_sum"])

        rows = rows.withColumn("sums", look_up("links"))
    else:
        rows = rows.join(_joined(rows, pairs, both.key), "place", "left")
    sums = [F.coalesce(F.col(f"sums.{c}"), F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.select(F.col("id").alias(id_), "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256", *(["groups"] * with_groups))


def _sorted(pairs: np.ndarray, n: np.ndarray, best: np.ndarray, key: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(pairs)
    return pairs[order].astype(key), n[order], best[order]


def _joined(rows: DataFrame, pairs: DataFrame, key: type) -> DataFrame:
    """(place, sums) of documents with links, by a join on pair and salt."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, links in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own, many = np.unique(np.frombuffer(links.as_buffer() or b"", key), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.size, place)), pa.array(own.astype(np.int64)), pa.array(many)], ["place", "pair", "m"])

    used = rows.select("place", "links").mapInArrow(within, "place long, pair long, m long").withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)))
    salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = used.join(salted, ["pair", "salt"]).groupBy("place").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    return met.select("place", F.struct("n_best", "count_sum").alias("sums"))
