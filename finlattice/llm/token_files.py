"""Token-ID files: documents as token ids, entropy-coded for parallel decoding.

Texts are tokenised once, in the tasks that read them, into a table in the shared folder; the same
tasks leave their symbol counts, whose sum over all documents gives one shared frequency table.
The token table is then range-partitioned by id, and by the row's place in the table so that an id
which many rows share fills many files, and sorted; each partition becomes one file of blocks.  A block codes BLOCK_TOKENS ids with a static range asymmetric numeral system on
interleaved lanes and stands alone: it starts from its own states (a checkpoint), holds its place
in the file, the documents or parts of documents in it, and a CRC-32 of all that.  Files are
written by Spark's writer as raw bytes, so any store that Spark reaches will do, and a lost
executor costs its tasks only.

File: blocks one after another.  Block, little-endian: magic, CRC-32 of the rest and of the
frequency table, body length, file number, first id's place in the file, counts of ids, documents
and words; documents (id, ids in this block, flags); lane states; words; a line end.
The frequency table is a file of its own, in the same folder.

Defined results: a null text is an empty one; a null id sorts first and stays null; rows with equal
ids stand together, in the order they were read; an empty table gives no blocks.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rans import LANES, Coder, scaled
from .shared import materialise, plain, shared_folder, slices, text_bytes

BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 8 << 20
MAGIC = b"RANSBLK1"
HEAD = struct.Struct("<8sIIIIQIII")
DOCUMENT = np.dtype([("id", "<i8"), ("n", "<u4"), ("flags", "u1")])
FIRST, LAST, NO_ID = 1, 2, 4
CACHE = 250_000
#: Bytes of text that are tokenised at a time: the more, the fewer words are looked up again.
SLICE = 2 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


class Tokens:
    """A byte-level BPE tokenizer with a bounded cache of the ids of words.

    Such a tokenizer splits a text into words and punctuation before it merges, and never merges
    across: so a text may be cut where such a piece surely begins (a space after a character that
    is none; a character that is no letter after a letter) and its parts encoded alone.  Texts that
    hold one of the tokenizer's special strings are encoded whole (without `special` such strings
    are ordinary text), as is every text by a tokenizer of another kind.  A part of letters alone is one piece, so it goes straight to the tokenizer's
    model, in the letters that stand for its bytes.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.byte_level = made["normalizer"] is None and made["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        # the letter that stands for a byte: itself if it can be printed, else the next free one from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each at least one id."""
        model, out, rest = self.tokenizer.model, [b""] * len(texts), []
        for i, t in enumerate(texts):
            word = t[1:] if t[0] == " " else t
            if self.byte_level and word.isalpha():
                piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                out[i] = array("I", [x.id for x in model.tokenize(piece if word is t else self.letters[0x20] + piece)]).tobytes()
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        return out

    def _lookup(self, texts: list[str]) -> list[bytes]:
        """Ids of distinct texts, from the cache where it has them; what hasn't been met for long drops out."""
        if len(self.recent) > CACHE:
            self.older, self.recent = self.recent, {}
        recent, older, new = self.recent, self.older, []
        out = list(map(recent.get, texts))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = older.get(texts[i])
            if ids is None:
                new.append(i)
            else:
                out[i] = recent[texts[i]] = ids
        for i, ids in zip(new, self._encode([texts[i] for i in new]), strict=True):
            out[i] = ids
            if len(texts[i]) < 64:
                recent[texts[i]] = ids
        return out

    def begins(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where parts that can be encoded alone begin, beside the beginnings of texts: a mask of the bytes, and one more."""
        rows = len(column)
        whole = np.full(rows, not self.byte_level)
        for s in self.special:
            whole |= np.asarray(pc.match_substring(column, s))
        begins = np.zeros(data.size + 1, bool)
        if data.size > 1:
            now, last = data[1:], data[:-1]
            before_last = np.concatenate([np.zeros(1, np.uint8), data[:-2]])
            latin = (before_last == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)  # the letters of two bytes with lead C3
            letter = _LETTER[last] | latin
            begins[1:-1] = (now == 0x20) & (letter | ((last < 0x80) & ~_SPACE[last] & (last >= 0x20))) | letter & (now < 0x80) & ~_LETTER[now]
            for r in np.flatnonzero(whole):
                begins[offsets[r] : offsets[r + 1]] = False
        return begins

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and their number in each."""
        data, offsets = text_bytes(column)
        rows, begins = len(column), self.begins(column, data, offsets)
        filled = np.flatnonzero(np.diff(offsets))
        begins[offsets[:-1][filled]] = True
        starts = np.flatnonzero(begins[:-1])
        if not starts.size:
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        where = np.concatenate([starts, [data.size]]).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        each = self._lookup(parts.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(each), np.uint32)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        index = parts.indices.to_numpy()
        many = sizes[index]
        ends = np.cumsum(many)
        place = np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - many), many) + np.arange(ends[-1])
        before = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return flat[place], np.diff(before)


_tokens: dict[str, Tokens] = {}


def tokenizer(path: str) -> Tokens:
    """One for each worker process and file."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def tokenise(docs: DataFrame, path: str, end: int | None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, place, n_tokens, ids, counts): a row of ids for each document, and of symbol counts for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a reused worker may still hold what earlier stages read
        t = tokenizer(path)
        kind = np.uint16 if t.size <= 1 << 16 else np.uint32
        counts = np.zeros(t.size, np.int64)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = plain(batch.column(1))
            for a, b in slices(column, SLICE):
                ids, many = t.encode(column[a:b])
                if end is not None:
                    ids = np.insert(ids, np.cumsum(many), end)
                    many = many + 1
                counts += np.bincount(ids, minlength=t.size)
                raw, edges = ids.astype(kind), np.concatenate([[0], np.cumsum(many)])
                yield _token_rows(batch.column(0)[a:b], place, many, [raw[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)], None)
                place += b - a
        yield _token_rows(pa.nulls(1, pa.int64()), place, [0], [None], [counts.astype("<i8").tobytes()])

    return docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, place long, n_tokens long, ids binary, counts binary")


def _token_rows(ids: pa.Array, place: int, many, tokens: list, counts: list | None) -> pa.RecordBatch:
    counts = pa.array(counts, pa.binary()) if counts else pa.nulls(len(tokens), pa.binary())
    return pa.RecordBatch.from_arrays([ids, pa.array(np.arange(place, place + len(tokens))), pa.array(many, pa.int64()), pa.array(tokens, pa.binary()), counts], ["id", "place", "n_tokens", "ids", "counts"])


def _symbol_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column(0):
            counts = np.frombuffer(value.as_buffer(), "<i8")
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["symbol", "n"])


def block(coder: Coder, table_crc: int, part: int, first: int, documents: list[tuple], symbols: np.ndarray) -> bytes:
    states, words = coder.encode(symbols)
    body = np.array(documents, DOCUMENT).tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    rest = HEAD.pack(MAGIC, 0, table_crc, len(body), part, first, len(symbols), len(documents), len(words))[12:] + body
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def write_blocks(coder: Coder, table_crc: int, wide: bool):
    """Sorted token rows of a partition to its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        documents: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            made = block(coder, table_crc, part, first, documents, np.concatenate(held) if held else np.zeros(0, np.uint16))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["block"])

        for batch in batches:
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, flags = np.frombuffer(value.as_buffer() or b"", np.uint32 if wide else np.uint16), FIRST | (NO_ID if id_ is None else 0)
                while True:
                    piece = ids[: BLOCK_TOKENS - size]
                    ids = ids[len(piece) :]
                    documents.append((id_ or 0, len(piece), flags | (0 if len(ids) else LAST)))
                    held.append(piece)
                    size += len(piece)
                    flags &= ~FIRST
                    if size == BLOCK_TOKENS:
                        yield close()
                        first += size
                        held, documents, size = [], [], 0
                    if not len(ids):
                        break
        if documents:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end: int | None = 0, id_: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> None:
    """Writes the files of blocks to path/blocks and the frequency table to path/table."""
    spark = docs.sparkSession
    tokens = materialise(tokenise(docs, tokenizer_file, end, id_, text), "tokens")
    size = tokenizer(tokenizer_file).size
    sums = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(_symbol_counts, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()  # one row a symbol
    counts = np.zeros(size, np.int64)
    for symbol, n in sums:
        counts[symbol] = n
    table = scaled(counts)
    raw = table.astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(raw),)], "value binary").coalesce(1).select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/table")
    files = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // file_tokens))
    rows = tokens.where("ids IS NOT NULL").select("id", "ids", "place").repartitionByRange(files, "id", "place").sortWithinPartitions("id", "place")
    made = rows.mapInArrow(write_blocks(Coder(table), zlib.crc32(raw), size > 1 << 16), "block binary")
    made.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/blocks")


def blocks_of(data: memoryview) -> Iterator[tuple]:
    """(header fields, documents, states, words) of each block of a file; damage is an error."""
    at = 0
    while at < len(data):
        magic, crc, table_crc, length, part, first, n, documents, words = HEAD.unpack_from(data, at)
        end = at + HEAD.size + length
        if magic != MAGIC or end > len(data) or zlib.crc32(data[at + 12 : end]) != crc:
            raise ValueError("damaged block")
        body = data[at + HEAD.size : end]
        a, b = documents * DOCUMENT.itemsize, documents * DOCUMENT.itemsize + 8 * LANES
        yield (part, first, n, table_crc), np.frombuffer(body[:a], DOCUMENT), np.frombuffer(body[a:b], "<u8"), np.frombuffer(body[b : b + 4 * words], "<u4")
        at = end + 1


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and with with_ids the ids) of each document, decoded from the files."""
    raw = spark.read.format("binaryFile").load(f"{path}/table").where("length > 0").select("content").first()[0]
    raw = bytes(raw)[:-1]
    table_crc, coder = zlib.crc32(raw), Coder(np.frombuffer(raw, "<u4"))
    fields = "part int, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                out: list[tuple] = []
                count = crc = 0
                kept: list[np.ndarray] = []
                for (part, first, n, own), documents, states, words in blocks_of(memoryview(value.as_buffer() or b"")):
                    if own != table_crc:
                        raise ValueError("a block of another frequency table")
                    ids = coder.decode(states, words, n).astype("<u4")
                    at = 0
                    for id_, many, flags in documents.tolist():
                        if flags & FIRST:
                            count, crc, place, kept = 0, 0, first + at, []
                        piece = ids[at : at + many]
                        crc, count, at = zlib.crc32(piece, crc), count + many, at + many
                        if with_ids:
                            kept.append(piece)
                        if flags & LAST:
                            out.append((part, place, None if flags & NO_ID else id_, count, crc, *([np.concatenate(kept).astype(np.int32)] if with_ids else [])))
                    if len(out) >= 5000 or with_ids:
                        yield _document_rows(out, with_ids)
                        out = []
                yield _document_rows(out, with_ids)

    rows = materialise(spark.read.format("binaryFile").load(f"{path}/blocks").where("length > 0").select("content").mapInArrow(run, fields), "token-documents")
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def _document_rows(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["part", "place", "doc_id", "n_tokens", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names[: len(kinds)])


def scratch(spark: SparkSession) -> str:
    return shared_folder(spark, "token-files")
