"""WARC archives through a chunked record table.

A payload is never handled as one value beyond the cell that the source holds it in: it is cut
into rows (record id, chunk number, data) of at most CHUNK bytes, and digests are carried from
chunk to chunk.  In the archive each chunk is a WARC 1.1 record of its own: a payload of one chunk
is an ordinary response, a longer one is segmented as the standard has it (WARC-Segment-Number,
continuation records with WARC-Segment-Origin-ID, WARC-Segment-Total-Length on the last).

Archives are written by Spark's own writer with the record's end as line separator, gzipped, so
they land in any store that Spark reaches, are committed with the job and survive lost executors.
Chunks are cut so that no block holds the text that a reader splits at (the end of a record with
the version line after it), so splitting there is exact for any payload bytes.

Equal payloads (SHA-1 and length) of at least `smallest` bytes are stored once, by the row with
the largest id; the others are revisit records that refer to it.

Payloads are not shuffled but for a few.  A Bloom filter of the digests that several rows share is
broadcast (at most BLOOM_BITS bits); a row whose digest it denies is written by the task that reads it.
The others meet their response by digest, without payloads; a second filter holds the ids of those
that turn out to be responses, and only what it lets through carries a payload to the join by id.

Rows are told apart by id; where ids repeat or are null, those rows are written to the shared folder
first, with a number each that goes into the record's name.

Defined results: a null payload is an empty one; each row makes one record, also where ids repeat or
are null (null is the least id, and refers_to shows the id of the response, so null where that has
none); of rows with equal ids and payloads one is the response; an empty table gives an archive
without records; other columns are ignored, except url, which may be null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom
from .shared import materialise

CHUNK = 1 << 20
VERSION = b"WARC/1.1\r\n"
#: Between two records: the two line ends that close one, and the version line of the next.
SEPARATOR = b"\r\n\r\n" + VERSION
DATE = "2024-01-01T00:00:00Z"
#: Parts that the rows of one payload are dealt over where they meet its response.
SALTS = 16
BLOOM_BITS = 1 << 26


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cut(data: bytes | memoryview, size: int) -> Iterator[memoryview]:
    """Pieces of at most size bytes, none of which holds SEPARATOR.  One empty piece for no data."""
    view, start = memoryview(data), 0
    while True:
        end = min(start + size, len(view))
        # with the line ends that stand before and after a block
        found = (b"\r\n\r\n" + bytes(view[start:end]) + b"\r\n\r\n").find(SEPARATOR)
        if found >= 0:
            end = start + found + 2
        yield view[start:end]
        start = end
        if start >= len(view):
            return


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, payload) to (id, n, bytes, digest, its first 8 bytes)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *_digested(batch.column(2))], ["id", "n", "payload_bytes", "payload_digest", "h"])


def _digested(payload: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Bytes, digest and its first 8 bytes of each payload, chunk by chunk."""
    sizes, found = [], []
    for value in payload:
        data = memoryview(value.as_buffer() or b"")
        sha = hashlib.sha1()
        for start in range(0, len(data), CHUNK):
            sha.update(data[start : start + CHUNK])
        sizes.append(len(data))
        found.append(sha.digest())
    first = np.frombuffer(b"".join(d[:8] for d in found), ">i8").astype(np.int64)
    return pa.array(sizes, pa.int64()), pa.array(map(b32, found), pa.string()), pa.array(first)


def name_of(id_: int | None, n: int) -> str:
    """The record's name: its id, and the number of its row if the id alone doesn't tell it."""
    return ("none" if id_ is None else str(id_)) + (f"+{n}" if n else "")


def id_of(name: str) -> int | None:
    first = name.split("+")[0]
    return None if first == "none" else int(first)


def urn(name: str, chunk: int = 1) -> str:
    return f"<urn:record:{name}>" if chunk == 1 else f"<urn:record:{name}:{chunk}>"


def record(kind: str, name: str, url: str | None, block: bytes, chunk: int = 1, last: bool = True, total: int = 0, digest: str = "", refers_to: str | None = None) -> bytes:
    """A record without the version line and the closing line ends, which the separator holds."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(name, chunk)}", f"WARC-Date: {DATE}", f"Content-Length: {len(block)}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}"]
    if url is not None and chunk == 1:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if chunk == 1:
        lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if chunk > 1 or not last:
        lines.append(f"WARC-Segment-Number: {chunk}")
    if chunk > 1:
        lines.append(f"WARC-Segment-Origin-ID: {urn(name)}")
        if last:
            lines.append(f"WARC-Segment-Total-Length: {total}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


ROW = "id long, n long, url string, payload binary"


def holds(filter_):
    @F.arrow_udf("boolean")
    def known(h: pa.Array) -> pa.Array:
        return pa.array(filter_.value.holds(h.to_numpy()), pa.bool_())

    return known


def told_apart(shared, whole):
    """(ROW, hash of id and n) to (ROW, digest, alone): rows that are surely a payload's only one, and the others without their payloads unless `whole` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = batch.column(3)
            _, digest, first = _digested(payload)
            alone = ~shared.value.holds(first.to_numpy())
            kept = pc.if_else(pa.array(alone | whole.value.holds(batch.column(4).to_numpy())), payload, pa.scalar(None, payload.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], kept, digest, pa.array(alone)], ["id", "n", "url", "payload", "digest", "alone"])

    return run


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, url, payload, digest, response: id and n or null) to chunk rows (id, chunk, record), a few MB a batch."""
    out, held = ([], [], []), 0
    for batch in batches:
        ids, ns, urls, _, digest, refers = (c.to_pylist() if i != 3 else None for i, c in enumerate(batch.columns))
        for i, value in enumerate(batch.column(3)):
            data = memoryview(value.as_buffer() or b"")
            name = name_of(ids[i], ns[i])
            if refers[i] is not None:
                pieces = [(1, record("revisit", name, urls[i], b"", digest=digest[i], refers_to=name_of(refers[i]["id"], refers[i]["n"])))]
            else:
                pieces = _pieces(name, urls[i], data, digest[i])
            for chunk, made in pieces:
                for column, x in zip(out, (ids[i], chunk, made), strict=True):
                    column.append(x)
                held += len(made)
                if held > 8 * CHUNK:
                    yield _rows(out)
                    out, held = ([], [], []), 0
    yield _rows(out)


def _pieces(name: str, url: str | None, data: memoryview, digest: str) -> Iterator[tuple[int, bytes]]:
    done = 0
    for chunk, piece in enumerate(cut(data, CHUNK), 1):
        done += len(piece)
        yield chunk, record("response" if chunk == 1 else "continuation", name, url, bytes(piece), chunk, done == len(data), len(data), digest)


def _rows(out: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["id", "chunk", "record"])


def write_warc(pages: DataFrame, path: str, id_: str = "page_id", payload: str = "html", url: str = "url", smallest: int = 0) -> None:
    """Writes gzipped WARC files below path, one per task."""
    rows = pages.select(F.col(id_).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), F.col(url).alias("url"), F.col(payload).cast("binary").alias("payload"))
    schema = "id long, n long, payload_bytes long, payload_digest string, h long"
    digest = materialise(rows.select("id", "n", "payload").mapInArrow(digests, schema), "warc-digests")  # the only pass that hashes payloads whole
    again = digest.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1 OR id IS NULL").select(F.col("id").alias("_again"))
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("_again"))
        numbered = materialise(rows.join(again, same, "left_semi").withColumn("n", F.monotonically_increasing_id() + 1), "warc-repeated")
        rows = rows.join(again, same, "left_anti").unionByName(numbered)
        digest = digest.join(again, same, "left_anti").unionByName(numbered.select("id", "n", "payload").mapInArrow(digests, schema))
    key = ["payload_digest", "payload_bytes"]
    stored = digest.where(F.col("payload_bytes") >= smallest).groupBy(key).agg(F.max(F.struct("id", "n")).alias("response"), F.first("h").alias("h"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    stored = materialise(stored, "warc-stored")
    send = rows.sparkSession.sparkContext.broadcast
    shared = send(Bloom.of(stored.select("h"), BLOOM_BITS))
    salted = stored.drop("h").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = digest.where(holds(shared)("h")).withColumn("salt", F.pmod(F.xxhash64("id", "n"), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"], "left")
    own = (F.col("response.id").eqNullSafe(F.col("id"))) & (F.col("response.n") == F.col("n"))
    known = materialise(met.select("id", "n", "payload_digest", F.when(~own, F.col("response")).alias("refers_to")), "warc-shared")
    whole = send(Bloom.of(known.where("refers_to IS NULL").select(F.xxhash64("id", "n").alias("h")), BLOOM_BITS))

    told = rows.withColumn("name", F.xxhash64("id", "n")).mapInArrow(told_apart(shared, whole), f"{ROW}, digest string, alone boolean")
    there = [F.coalesce("id", F.lit(0).cast("long")).alias("_id"), F.col("id").isNull().alias("_none"), F.col("n").alias("_n")]
    known = known.select(*there, F.col("payload_digest").alias("digest"), "refers_to")
    several = told.where("NOT alone").select("id", "n", "url", "payload", *there).join(known, ["_id", "_none", "_n"]).select("id", "n", "url", "payload", "digest", "refers_to")
    alone = told.where("alone").select("id", "n", "url", "payload", "digest", F.lit(None).cast("struct<id:long,n:long>").alias("refers_to"))
    made = alone.unionByName(several).mapInArrow(records, "id long, chunk int, record binary")
    # The separator ends with the next record's version line, so each row closes one record and opens the next;
    # the version line of a file's first record is the head of its first row.
    body = F.concat(F.lit(VERSION), F.col("record")).cast("string")
    made.select(body.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


NAMES = ("id", "record", "chunk", "type", "url", "refers_to", "payload_digest", "total", "bytes", "data")
CHUNKS = "id long, record string, chunk int, type string, url string, refers_to string, payload_digest string, total long, bytes long, data binary"


def parse(batches: Iterator[pa.RecordBatch], all_data: bool = True) -> Iterator[pa.RecordBatch]:
    """Raw records to chunk rows; a block that doesn't fit its length and digest is an error.

    Without all_data, the payload of an unsegmented record is checked against its digest here and
    left out of its row.
    """
    names = NAMES
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for value in batch.column(0):
            raw = memoryview(value.as_buffer() or b"")
            if not len(raw):
                continue
            head, found = bytes(raw[:4096]), 0
            found = head.find(b"\r\n\r\n")
            while found < 0 and len(head) < len(raw):
                head = bytes(raw[: 4 * len(head)])
                found = head.find(b"\r\n\r\n")
            lines = head[:found].removeprefix(VERSION).decode().split("\r\n")
            field = dict(x.split(": ", 1) for x in lines)
            length = int(field["Content-Length"])
            block = raw[found + 4 : found + 4 + length]
            rest = bytes(raw[found + 4 + length :])
            if len(block) != length or rest not in (b"", b"\r\n\r\n") or "sha1:" + b32(hashlib.sha1(block).digest()) != field["WARC-Block-Digest"]:
                raise ValueError(f"damaged record {field['WARC-Record-ID']}")
            of = field.get("WARC-Segment-Origin-ID", field["WARC-Record-ID"])
            refers = field.get("WARC-Refers-To")
            stated = field.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
            whole = "WARC-Segment-Number" not in field
            if whole and field["WARC-Type"] == "response" and field["WARC-Block-Digest"] != f"sha1:{stated}":
                raise ValueError(f"damaged payload {field['WARC-Record-ID']}")
            data = bytes(block) if all_data or not whole else None
            name = of[12:-1]
            row = (id_of(name), name, int(field.get("WARC-Segment-Number", 1)), field["WARC-Type"], field.get("WARC-Target-URI"), refers[12:-1] if refers else None, stated, int(field.get("WARC-Segment-Total-Length", -1)), length, data)
            for column, x in zip(out, row, strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], list(names))


def read_chunks(spark: SparkSession, path: str, all_data: bool = True) -> DataFrame:
    """The chunked record table of the archives below path."""
    raw = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("value").cast("binary"))
    return raw.mapInArrow(lambda batches: parse(batches, all_data), CHUNKS)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows in order of (record, chunk) to one row a record, with length and digest of the whole payload."""
    state: dict = {}
    for batch in batches:
        out: list[tuple] = []
        fields = [batch.column(n).to_pylist() for n in ("record", "chunk", "type", "refers_to", "payload_digest", "total", "bytes")]
        for i, (name, chunk, kind, refers_to, stated, total, size) in enumerate(zip(*fields, strict=True)):
            data = batch.column("data")[i]
            if chunk == 1:
                if state:
                    out.append(_finish(state))
                    state = {}
                if not data.is_valid:
                    out.append((name, kind, refers_to, size, stated))
                    continue
                state = {"name": name, "stated": stated, "total": -1, "next": 1, "bytes": 0, "sha": hashlib.sha1()}
            if not state or state["name"] != name or state["next"] != chunk:
                raise ValueError(f"chunk {chunk} of record {name} has no predecessor")
            state["sha"].update(memoryview(data.as_buffer() or b""))
            state["bytes"] += size
            state["next"] += 1
            state["total"] = max(state["total"], total)
        yield _folded(out)
    yield _folded([_finish(state)] if state else [])


def _finish(s: dict) -> tuple:
    if b32(s["sha"].digest()) != s["stated"] or s["bytes"] != s["total"]:
        raise ValueError(f"record {s['name']} is not whole")
    return s["name"], "response", None, s["bytes"], s["stated"]


RECORDS = "id long, record string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def _folded(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
    columns = [[id_of(row[0]) for row in out], *([row[i] for row in out] for i in range(5))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RECORDS.split(", ")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, record_type, refers_to, payload_bytes, payload_digest) of each record, checked as a whole.

    Payloads of one chunk are settled where they are read; only chunks of longer ones are brought
    together, by record.  A revisit has the length of the response that it refers to.
    """
    chunks = read_chunks(spark, path, all_data=False).drop("url")
    rows = materialise(chunks.repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(fold, RECORDS), "warc-records")
    revisits = rows.where("refers_to IS NOT NULL")
    responses = rows.where("record_type = 'response'").select(F.col("record").alias("refers_to"), F.col("id").alias("response"), F.col("payload_bytes").alias("stored"), F.col("payload_digest").alias("found"))
    asked = revisits.groupBy("refers_to").count().select("refers_to").join(responses, "refers_to")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = revisits.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int")).join(asked, ["refers_to", "salt"], "left")
    same = F.coalesce(F.col("found") == F.col("payload_digest"), F.lit(False))
    checked = F.when(same, F.col("stored")).otherwise(F.raise_error(F.lit("a revisit has no response")))
    revisits = joined.select("id", "record_type", F.col("response").alias("refers_to"), checked.cast("long").alias("payload_bytes"), "payload_digest")
    whole = rows.where("refers_to IS NULL").select("id", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest")
    return whole.unionByName(revisits)
