"""The pipeline's stages by brute force on a small table, and the queries' SQL."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from finlattice.llm import mixing, quality, queries, shared
from finlattice.llm.url_filter import LOWER, UPPER

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def words_of(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def test_stages(spark):
    """Each stage against brute force on what the stage before it left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF).cache()
        seen.append(out)
    assert all(d.columns == docs.columns for d in seen[1:-1])
    first, scored, single, clean, mixed = ({r.doc_id: r for r in d.collect()} for d in seen[:-1])

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(i, q) for i, q in labels.items() if i is not None and q in (0, 1) and i in first and zlib.crc32(str(i).encode()) % 4 != 2]
    rows = sorted((quality._features(pa.array([first[i].text or ""]))[0].tobytes(), q) for i, q in known)  # fewer than per_class: all are the sample
    model = quality.Model(np.array([np.frombuffer(f, np.float32) for f, _ in rows]), np.array([q for _, q in rows]), Counter(q for _, q in known))
    want = {i: model.score(pa.array([r.text or ""]))[0] for i, r in first.items()}
    assert all((i in scored) == (s >= queries.QUALITY_FROM) for i, s in want.items() if abs(s - queries.QUALITY_FROM) > 1e-3)
    good = [i for i in first if labels.get(i) == 1]
    assert sum(i in scored for i in good) >= 0.97 * len(good)

    sets = {}
    for i, r in scored.items():
        w = re.findall("[0-9a-z\u0080-\U0010ffff]+", (r.text or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert set(single) == set(root.values())

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r.text)
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(len(w) - 9, 1))} if w else set()
    lengths = {len(x) for x in windows}
    hit = {i for i, r in single.items() if any(tuple(words_of(r.text)[k : k + n]) in windows for n in lengths for k in range(len(words_of(r.text))))}
    assert set(clean) == set(single) - hit

    size = {i: len(re.findall(mixing.WORD, r.text or "")) for i, r in clean.items()}
    sums, taken = Counter(), Counter()
    for i, r in clean.items():
        sums[r.source] += size[i]
    copies = Counter(r.doc_id for r in seen[4].collect())
    for i, n in copies.items():
        assert n <= 3
        taken[clean[i].source] += n * size[i]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.capped_targets([sums[s] for s in order], [[1, 2, 3][k % 3] for k in range(len(order))], 3)):
        assert abs(taken[s] - t) <= max(0.05 * t, max(size.values()))

    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    start, got = 0, sorted(seen[5].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(copies.elements())
    for r in got:
        ids = library.encode(mixed[r.doc_id].text or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_registered():
    names = registry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(queries.QUERIES) < set(names) and "pipeline" in names


def test_scratch_goes_with_its_stage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_scopes", [str(tmp_path)])
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if not p.name.startswith("."))
    assert left == ["pipeline-mixing-sources-to-target-weights", "token-documents", "token-files", "tokens"]
