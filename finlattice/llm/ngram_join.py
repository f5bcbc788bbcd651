"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text.  A document is
the set of its five-word shingles (one shingle of all words if there are fewer).  Documents of
equal word sequences are one class from the start, known by a number of its own; one row with the
smallest id stands for all.

Each of TREES trees is a sorted prefix trie of signatures of DEEPEST values, kept as two numbers:
the first LEAST values and the rest.  A class alone in its node of depth LEAST meets nobody in that
tree; the others carry the sizes of their nodes at each depth from LEAST to DEEPEST.  Each class
starts from its deepest nodes and shortens the matched prefixes, a level at a time in all trees,
until a partner at the threshold would have been met with the target recall: a node that holds no
more members than a shallower one counts as that shallower one, so classes with few relatives stop
early and only crowded ones go down to FLOOR, where the target holds whatever the trie looks like.
Where two classes are in a node that either of them uses they are candidates; of nested nodes the
shallowest in use counts.

Groups with the same members count once.  Every pair of a group is then verified exactly on whole
texts: groups are cut into blocks, bounded in members and in bytes, and each pair of blocks is one
cell of work, a product of shingle incidence matrices, whatever the group's size.  A pair counts
in the first tree where it meets, so links are counted once.  A cell returns a row for each linked
class (its links there and its smallest linked relative), never the pairs.

Defined results: null or wordless texts have no shingles, no links and a class of their own; rows
with a null id take no part; rows with equal ids are told apart by their texts, and those with
equal texts are copies of each other; an empty table gives an empty result; other columns,
whatever their names, are ignored by the join and kept by one_of_each().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import SALTS, components
from .shared import U64, lowered, materialise, mix, plain, shingles, slices, text_bytes, unused, word_hashes, word_spans

WORDS = 5
THRESHOLD = 0.8
TREES = 20
#: A signature has DEEPEST values of 16 bits, the first LEAST of them in one number and the others in another.
DEEPEST, LEAST = 8, 4
RECALL = 0.999
GROUP_BLOCK = 256
BLOCK_BYTES = 8 << 20
COLUMNS = 1 << 14
#: Marks the rows of a cell that compares a block with itself; else 0 and 1 are its two blocks.
SAME = 2


def missed(depths: list[int], threshold: float = THRESHOLD) -> float:
    """The chance that a pair at the threshold shares no prefix of these lengths, one a tree."""
    return math.prod(1 - threshold**d for d in depths)


def floor_depth(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix that reaches the recall in all trees without regard to the data."""
    for depth in range(DEEPEST, LEAST - 1, -1):
        if missed([depth] * trees, threshold) <= 1 - recall:
            return depth
    raise ValueError(f"{trees} trees cannot reach a recall of {recall} at {threshold}: add trees")


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    return random.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 1 << 32, n, dtype=np.uint32)


def text_shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and words before each row, shingle hashes and shingles before each row."""
    data, offsets = text_bytes(lowered(column))
    starts, ends, firsts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    return words, firsts, *shingles(words, firsts, n)


def tree_keys(grams: np.ndarray, before: np.ndarray, trees: int) -> np.ndarray:
    """rows x trees x 2: the first and the last four values of each signature; rows without shingles get 0."""
    some = np.flatnonzero(np.diff(before))
    keys = np.zeros((len(before) - 1, trees, 2), np.int64)
    if some.size:
        x, at = (grams >> U64(32)).astype(np.uint32), before[:-1][some]
        times, plus = _multipliers(trees * DEEPEST)
        buffer = np.empty_like(x)
        for t in range(trees):
            for half, (first, end) in enumerate(((0, LEAST), (LEAST, DEEPEST))):
                key = np.zeros(some.size, U64)
                for d in range(t * DEEPEST + first, t * DEEPEST + end):
                    np.multiply(x, times[d], out=buffer)
                    np.add(buffer, plus[d], out=buffer)
                    key = (key << U64(16)) | (mix(np.minimum.reduceat(buffer, at).astype(U64) + U64(d)) >> U64(48))
                keys[some, t, half] = key.view(np.int64)
    return keys


SIGNED = "id long, fp long, bytes long, content binary, keys array<struct<hi:long,lo:long>>"


def sign(trees: int, n: int):
    """(id, fp, text) to SIGNED: content identifies the word sequence, null if there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = plain(batch.column(2))
            for a, b in slices(column):
                words, firsts, grams, before = text_shingles(column[a:b], n)
                counts = np.diff(firsts)
                some = np.flatnonzero(counts)
                place = (np.arange(words.size) - np.repeat(firsts[:-1], counts)).astype(U64)
                content = np.zeros((b - a, 2), U64)
                for i, salt in enumerate((0x1234567, 0x7654321)):
                    if some.size:
                        content[some, i] = np.add.reduceat(mix(words + mix(place + U64(salt))), firsts[:-1][some])
                content = [x.tobytes() if c else None for x, c in zip(content, counts, strict=True)]
                keys = tree_keys(grams, before, trees)
                pairs = pa.StructArray.from_arrays([pa.array(keys[:, :, i].ravel()) for i in (0, 1)], ["hi", "lo"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * trees, pa.int32()), pairs)
                size = pa.array(np.diff(text_bytes(column[a:b])[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], size, pa.array(content, pa.binary()), lists], ["id", "fp", "bytes", "content", "keys"])

    return run


def _verify(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, marks: np.ndarray, tree: int, texts: pa.Array, n: int, threshold: float) -> list[tuple]:
    """Links among one cell's documents: (id, smallest relative, links)."""
    sets = []
    for a, b in slices(texts):
        _, _, grams, before = text_shingles(texts[a:b], n)
        sets += [np.unique(grams[x:y]) for x, y in zip(before, before[1:], strict=False)]
    size = np.array([len(s) for s in sets])
    m = len(sets)
    value, gram, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    shared = often[gram] > 1  # what one document holds alone meets nothing
    number = np.cumsum(often > 1) - 1
    gram, owner = number[gram[shared]], owner[shared]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    common = np.zeros((m, m), np.float32)
    for first in range(0, int(gram[-1]) + 1 if gram.size else 0, COLUMNS):
        x, y = np.searchsorted(gram, [first, first + COLUMNS])
        held = np.zeros((m, min(COLUMNS, int(gram[-1]) + 1 - first)), np.float32)
        held[owner[x:y], gram[x:y] - first] = 1
        common += held @ held.T
    near = common >= threshold * (size[:, None] + size[None] - common) - 1e-4
    near &= common > 0
    np.fill_diagonal(near, False)
    if side[0] != SAME:
        near &= side[:, None] != side[None]
    root = np.arange(m)
    ids_of = ids.copy()
    while True:  # the smallest id spreads along links
        new = np.where(near, ids_of[None], ids_of[:, None]).min(axis=1)
        new = np.minimum(new, ids_of)
        if (new == ids_of).all():
            break
        ids_of = new
    counted = near.copy()
    for t in range(tree):
        counted &= ~((marks[:, t][:, None] == marks[:, t][None]) & (marks[:, t] != 0)[:, None])
    links = counted @ copies
    return [(int(ids[i]), int(ids_of[i]), int(links[i])) for i in root if near[i].any()]


def verify(trees: int, n: int, threshold: float):
    """Rows sorted by cell to links; a cell is at most two blocks of documents."""
    names = ("cell", "id", "copies", "second", "tree", "marks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != cells[a]:
                    out += finish(held)
                    held = []
                held.append(batch.slice(a, b - a))
            yield rows(out)
        yield rows(finish(held) if held else [])

    def finish(held: list[pa.RecordBatch]) -> list[tuple]:
        t = pa.Table.from_batches(held)
        if t.num_rows < 2:
            return []
        id_, copies, second, tree = (t.column(c).to_numpy() for c in names[1:5])
        marks = t.column("marks").combine_chunks().flatten().to_numpy().reshape(-1, trees)
        return _verify(id_, copies, second, marks, int(tree[0]), plain(t.column("text")), n, threshold)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["id", "root", "links"])

    return run


def forest(classes: DataFrame, trees: int, threshold: float, recall: float) -> DataFrame:
    """(cls, tree, bucket, bytes): the trie nodes in which classes (cls, bytes, keys) meet, nodes of one member left out."""
    nodes = classes.select("cls", "bytes", F.posexplode("keys").alias("tree", "key")).select("cls", "bytes", "tree", "key.hi", "key.lo")
    crowded = nodes.groupBy("tree", "hi").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(nodes.join(crowded, ["tree", "hi"]), "forest-nodes")

    depths = range(LEAST + 1, DEEPEST + 1)
    node = ["tree", "hi", "depth", "prefix"]
    spread = met.select("cls", "tree", "hi", "n", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("lo", 16 * (DEEPEST - d)).alias("prefix")) for d in depths])).alias("at")).select("cls", "tree", "hi", "n", "at.*")
    held = spread.groupBy(node).agg(F.count("*").alias("members"))
    sizes = spread.join(held, node).groupBy("cls", "tree").agg(F.first("n").alias(f"n{LEAST}"), *[F.max(F.when(F.col("depth") == d, F.col("members"))).alias(f"n{d}") for d in depths])

    def miss(level: int) -> Column:
        """Log of the chance to miss a partner in this tree with the node of this level, in excess of the node of LEAST."""
        log = {d: math.log(missed([d], threshold)) - math.log(missed([LEAST], threshold)) for d in range(LEAST, level + 1)}
        same = F.lit(log[level])
        for d in range(level - 1, LEAST - 1, -1):  # the shallowest node with as many members
            same = F.when(F.col(f"n{d}") == F.col(f"n{level}"), log[d]).otherwise(same)
        return F.sum(same)

    floor = floor_depth(threshold, trees, recall)
    room = math.log(1 - recall) - trees * math.log(missed([LEAST], threshold)) + 1e-9
    level = F.lit(floor)
    for d in range(floor + 1, DEEPEST + 1):  # the deepest level that reaches the target
        level = F.when(F.col(f"miss{d}") <= room, d).otherwise(level)
    levels = sizes.groupBy("cls").agg(*[miss(d).alias(f"miss{d}") for d in range(max(floor, LEAST + 1), DEEPEST + 1)]).select("cls", level.alias("level"))
    leveled = materialise(met.join(levels, "cls"), "forest-levels")

    spread = leveled.select("cls", "bytes", "tree", "hi", "level", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("lo", 16 * (DEEPEST - d)).alias("prefix")) for d in depths])).alias("at")).select("cls", "bytes", "tree", "hi", "level", "at.*")
    if floor == LEAST:
        least = leveled.select("cls", "bytes", "tree", "hi", "level", F.lit(LEAST).alias("depth"), F.lit(0).cast("long").alias("prefix"))
        spread = spread.unionByName(least)
    used = spread.groupBy(node).agg(F.max((F.col("level") == F.col("depth")).cast("int")).alias("used"), F.count("*").alias("members")).where("used = 1 AND members > 1").select(node)
    return spread.join(used, node).groupBy("cls", "tree").agg(F.min(F.struct("depth", F.xxhash64(*node).alias("bucket"))).alias("s"), F.first("bytes").alias("bytes")).select("cls", "tree", "s.bucket", "bytes")


def _rows(docs: DataFrame, id_: str, text: str) -> DataFrame:
    return docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.xxhash64(text).alias("fp"), F.col(text).alias("text"))


def cells_of(texts: DataFrame, wanted: DataFrame, trees: int, group_block: int, block_bytes: int) -> DataFrame:
    """(cell, id, copies, second, tree, marks, text): a row for each class, tree and cell it is compared in.

    wanted: (cls, id, fp, copies, marks, sizes): its group in each tree, and the groups' members and bytes.
    """
    # of repeated rows one is kept before anything is moved
    placed = texts.groupBy("id", "fp").agg(F.first("text").alias("text")).join(wanted, ["id", "fp"])
    placed = placed.select(F.col("cls").alias("id"), "copies", "marks", "text", F.explode("sizes").alias("tree", "size"))
    placed = placed.withColumn("blocks", F.greatest(F.ceil(F.col("size.members") / group_block), F.ceil(F.col("size.bytes") / block_bytes)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("tree", F.element_at("marks", F.col("tree") + 1), F.least("block", "other"), F.greatest("block", "other"))
    second = F.when(F.col("block") == F.col("other"), SAME).otherwise((F.col("block") > F.col("other")).cast("int"))
    return placed.select(cell.alias("cell"), "id", "copies", second.alias("second"), "tree", "marks", "text")


def classified(docs: DataFrame, id_: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL, group_block: int = GROUP_BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, fp, copy_of, first_id, first_fp, n_links) for each row of docs with an id.

    fp: a fingerprint of the text; first_*: the row that stands for all that are connected with this one.
    """
    texts = _rows(docs, id_, text)
    signed = materialise(texts.mapInArrow(sign(trees, words), SIGNED), "signatures")
    some, none = signed.where("content IS NOT NULL"), signed.where("content IS NULL")
    classes = some.groupBy("content").agg(F.min(F.struct("id", "fp")).alias("rep"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"), F.first("keys").alias("keys"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "copy-classes")

    nodes = materialise(forest(classes.select("cls", "bytes", "keys"), trees, threshold, recall), "forest")
    groups = nodes.groupBy("tree", "bucket").agg(F.count("*").alias("members"), F.sum("bytes").alias("all_bytes"), F.bit_xor(F.xxhash64("cls")).alias("f"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("g"))
    groups = groups.groupBy("members", "all_bytes", "f", "g").agg(F.min(F.struct("tree", "bucket")).alias("node")).select("node.tree", "node.bucket", F.struct("members", F.col("all_bytes").alias("bytes")).alias("size"))
    met = nodes.select("cls", "tree", "bucket").join(groups, ["tree", "bucket"])
    marks = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("by_tree", t), F.lit(0).cast("long")))
    of = met.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("tree", "bucket"))).alias("by_tree"), F.map_from_entries(F.collect_list(F.struct("tree", "size"))).alias("sizes"))  # a tree at most once
    wanted = of.select("cls", "sizes", marks.alias("marks")).join(classes.select("cls", "rep.id", "rep.fp", "copies"), "cls")
    cells = cells_of(texts, wanted, trees, group_block, block_bytes)
    linked = materialise(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify(trees, words, threshold), "id long, root long, links long"), "links")

    roots = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cls"), "root")
    links = linked.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "cls")
    small = classes.select("cls", "content", "rep", "copies")
    firsts = roots.join(small.select("cls", "rep"), "cls").groupBy("root").agg(F.min("rep").alias("first"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a group may hold a third of all
    related = roots.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(firsts, ["root", "salt"]).join(links, "cls").select("cls", "first", "links")
    known = small.join(related, "cls", "left").select("content", F.col("rep.id").alias("copy_of"), F.coalesce("first", "rep").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = some.select("id", "fp", "content").join(known, "content").select("id", "fp", "copy_of", F.col("first.id").alias("first_id"), F.col("first.fp").alias("first_fp"), F.col("n_links").cast("long").alias("n_links"))
    return out.unionByName(none.select("id", "fp", F.col("id").alias("copy_of"), F.col("id").alias("first_id"), F.col("fp").alias("first_fp"), F.lit(0).cast("long").alias("n_links")))


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, copy_of, class_id, n_links) for each row of docs with an id.

    copy_of: the smallest id with the same words; class_id: the smallest id connected by links;
    n_links: the number of other rows with a similarity of at least the threshold.
    """
    return classified(docs, id_, text, **how).select("id", "copy_of", F.col("first_id").alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, id_: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows that are connected with a row before them, by id and then by text; of equal rows one stays.

    Rows with a null id, and rows without words that are not repeated, stay as they are.
    """
    found = materialise(classified(docs, id_, text, **how), "near-duplicates")
    stays = (F.col("id") == F.col("first_id")) & (F.col("fp") == F.col("first_fp"))
    own_id, own_fp = (unused(docs, name) for name in ("_same_id", "_same_fp"))
    same = (F.col(id_) == F.col(own_id)) & (F.xxhash64(text) == F.col(own_fp))
    gone = found.where(~stays).select(F.col("id").alias(own_id), F.col("fp").alias(own_fp)).distinct()
    kept = docs.join(gone, same, "left_anti")
    repeated = found.where(stays).groupBy("id", "fp").count().where("count > 1").select(F.col("id").alias(own_id), F.col("fp").alias(own_fp))
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([id_, text]))
