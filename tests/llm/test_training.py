"""Each training-data operator against brute force and on odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finlattice.llm import bloom, decontam, language_id, mixing, ngram_join, quality, queries, rans, token_counts, token_files, topk, url_filter, warc
from finlattice.llm.components import components
from finlattice.llm.shared import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, id long"  # size and id clash with names inside
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(100)) for i in r.integers(0, len(WORDS), n))


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", 0, 7, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# 1


def judge(host, path, rules):
    best = None
    for text, verdict in rules:
        h, _, rest = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = text, verdict
    return best


@pytest.mark.parametrize("inline", [500, 0])
def test_url_filter(spark, inline):
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "https://WWW.Example.com/en/x?y#z", "http://example.com/en", "http://xexample.com/en/", "ftp://m.net/es/1", "http://net/fr/#a://b", "http://é.com/ü", "http://spam.org/x", "http://ads-track.org", "http://x.org/spam", "x://com:80/a", "http://www.example.com.org/en/", "http://a.org/b.ZIP?x", "http://a.org/cart/checkout", "http://a.org/?q=1&sort=a&x=1&order=b", "http://a.org/wp-login.php.bak", "http://a.org?PHPSESSID=3#x", "http://cheap-pills.pharmacy.org/cgi-bin/x.exe"] * 2
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [url_filter.host_rule(*r) for r in queries.URL_RULES]
    got = {r.page_id: r for r in url_filter.filter_urls(df, rules, inline_rules=inline).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), m[2]) if m else ("", "")
        best = judge(host, path, queries.URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0])
        assert got[i].verdict == (best[1] if best else "block" if got[i].pattern else "allow")
        query = re.match(r"(?s).*?://[^?#]*(\?[^#]*)?", u or "")
        full = (host + path + (query[1] or "" if query else "")).translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        every = [p for p in url_filter.DEFAULT_PATTERNS if re.search(p.regex, full)]  # without the index
        assert got[i].pattern == (min(every, key=lambda p: (-p.size, p.name)).name if every else None)
    assert got[12].verdict == got[13].verdict == "block" and got[14].verdict == "allow"
    assert url_filter.filter_urls(df.limit(0), rules, inline_rules=inline).count() == 0
    with pytest.raises(ValueError):
        url_filter.index_rules([url_filter.Rule("x", "block", ".*", (), 1, "rule")])


# 2


def test_targets():
    assert mixing.capped_targets([100, 100, 100], [1, 2, 3], 3) == pytest.approx([50, 100, 150])
    assert mixing.capped_targets([10, 1000], [3, 1], 3) == pytest.approx([30, 980])
    assert mixing.capped_targets([], [], 3) == [] and mixing.capped_targets([0, 5], [1, 2], 3) == [0.0, 5.0]


def test_dual_with_overlapping_constraints(spark):
    cells = spark.createDataFrame([(60.0, [0, 2]), (40.0, [0, 3]), (30.0, [1, 2]), (70.0, [1, 3])], "mass double, members array<int>")
    lam = mixing.solve_dual(cells, [120.0, 80.0, 90.0, 110.0])
    mass = {(0, 2): 60, (0, 3): 40, (1, 2): 30, (1, 3): 70}
    tilted = {k: m * np.exp(lam[list(k)].sum()) for k, m in mass.items()}
    for j, t in enumerate([120, 80, 90, 110]):
        assert sum(v for k, v in tilted.items() if j in k) == pytest.approx(t, rel=1e-6)


def test_mixing(spark):
    texts = [prose(10 + i % 50, i) for i in range(300)] + [None, "", "\u00a0 x\ty"] + ["same words here"] * 900
    sources = [["a", "b", None][i % 3] for i in range(303)] + ["hot"] * 900
    docs = documents(spark, texts, sources)
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) and all(0 <= r.copies <= 3 for r in got)
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(re.findall(mixing.WORD, t or ""))
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        assert r.source_size == sizes[r.source]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.capped_targets([sizes[s] for s in order], [[1, 2, 3][i % 3] for i in range(4)], 3)
    for s, t in zip(order, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= max(0.02 * t, 10)
    again = {r.id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.id: r.copies for r in got}
    # conditions of the minimum: rates are exp(lambda of the source + beta of the band) below the cap, and the bands' misses are slack * beta
    rate, mass = {}, Counter()
    for r in got:
        if r["size"]:
            band = int(np.log2(r["size"]))
            rate[r.source, band] = r.rate
            mass[r.source, band] += r["size"]
    bands = sorted({b for _, b in rate})
    free = {k: v for k, v in rate.items() if 0 < v < 3 - 1e-9}
    base = {s: np.log(free[s, bands[-1]]) for s in sizes if (s, bands[-1]) in free}
    beta = {b: np.mean([np.log(free[s, b]) - base[s] for s in base if (s, b) in free]) for b in bands if any((s, b) in free for s in base)}
    assert all(np.log(v) == pytest.approx(base[s] + beta[b], abs=1e-6) for (s, b), v in free.items() if s in base and b in beta)
    for s in base:
        assert sum(v * mass[k] for k, v in rate.items() if k[0] == s) == pytest.approx(target[s], rel=1e-6)
    total, all_ = sum(mass.values()), sum(target.values())
    miss = {b: (sum(v * mass[k] for k, v in rate.items() if k[1] == b) / all_ - sum(m for k, m in mass.items() if k[1] == b) / total) / (sum(m for k, m in mass.items() if k[1] == b) / total) for b in beta}
    shift = {b: -miss[b] / mixing.SLACK - beta[b] for b in beta}
    assert max(shift.values()) - min(shift.values()) < 1e-3 * max(1, max(map(abs, shift.values())))
    repeated = mixing.resample(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_takes_any_number_of_sources(spark):
    n = mixing.MOST_CONSTRAINTS + 500
    sources = [f"host{i:05d}.example" for i in range(n)] + [None, "\uffee", "\U0001f600"]
    words = [1 + 40 * (i % 7 == 0) + i % 5 for i in range(len(sources))]
    docs = spark.createDataFrame([(i, "w " * k, s) for i, (s, k) in enumerate(zip(sources, words))] + [(-1, "", "empty")], "doc_id long, text string, source string")
    got = {r.source: r for r in mixing.mix(docs).collect()}
    size = dict(zip(sources, words)) | {"empty": 0}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.capped_targets([size[s] for s in order], [[1, 2, 3][i % 3] for i in range(len(order))], 3)
    assert len(got) == len(order) and {size[s] * 3 == t for s, t in zip(order, want)} == {True, False}
    for s, t in zip(order, want):
        rate = t / size[s] if t else 0  # a source of one document has the one rate that meets its target
        assert got[s].source_size == size[s] and got[s].target == pytest.approx(t) and got[s].rate == pytest.approx(rate)
        assert int(rate + 1e-9) <= got[s].copies <= int(np.ceil(rate - 1e-9))


def test_repeated_rows_get_their_own_copies(spark):
    texts = ["one two three"] * 7 + ["four five six seven"] * 5
    rows = [(1, t, s) for t, s in zip(texts, ["a"] * 7 + ["b"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.copies
    assert Counter(r.source for r in mixing.resample(docs).collect()) == +taken


# 3


def test_token_counts(spark):
    store = shared_folder(spark, "counts")
    token_counts.create(spark, store)
    schema = "op string, seq int, doc_id long, tokenizer string, source string, lang string, n_tokens long"
    first = spark.createDataFrame([("insert", 0, i, "t", "s" if i % 2 else None, "en", 10 + i) for i in range(6)] + [("insert", 0, None, "t", "s", "en", 5), ("insert", 1, 0, "t", None, "en", 99)], schema)
    assert token_counts.commit(spark, store, "one", first) and not token_counts.commit(spark, store, "one", first)
    second = spark.createDataFrame([("revise", 0, 1, "t", "s", "de", 1), ("delete", 0, 2, "t", None, None, None), ("delete", 0, 77, "t", None, None, None)], schema)
    assert token_counts.commit(spark, store, "two", second)
    assert token_counts.commit(spark, store, "three", second.limit(0))
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in token_counts.totals(spark, store).collect()}
    assert got == {(None, "en"): (2, 99 + 14), ("s", "en"): (2, 13 + 15), ("s", "de"): (1, 1)}
    assert token_counts.live(spark, store).count() == 5


def test_compacting_keeps_state_and_names(spark):
    store, new = shared_folder(spark, "counts"), shared_folder(spark, "counts")
    token_counts.create(spark, store)
    schema = "op string, seq int, doc_id long, tokenizer string, source string, lang string, n_tokens long"
    for name, rows in (("one", [("insert", 0, 1, "t", "s", "en", 5), ("insert", 0, 2, "t", "s", None, 7)]), ("two", [("delete", 0, 2, "t", None, None, None), ("revise", 0, 1, "t", "s", "en", 6)])):
        token_counts.commit(spark, store, name, spark.createDataFrame(rows, schema))
    token_counts.compact(spark, store, new)
    again = spark.createDataFrame([("insert", 0, 9, "t", "s", "en", 100)], schema)
    assert not token_counts.commit(spark, new, "two", again) and token_counts.commit(spark, new, "three", again)
    assert [tuple(r) for r in token_counts.totals(spark, new).collect()] == [("s", "en", "t", 2, 106)]
    assert sorted(r.doc_id for r in token_counts.live(spark, new).collect()) == [1, 9]


@pytest.mark.parametrize("name", ["2024/01/01", "a/b*{c}[d]%41", "../up", "", "from=x", "é ü"])
def test_any_batch_name(spark, name):
    store = shared_folder(spark, "counts")
    token_counts.create(spark, store, buckets=4)
    schema = "op string, seq int, doc_id long, tokenizer string, source string, lang string, n_tokens long"
    rows = spark.createDataFrame([("insert", 0, i, "t", "s", "en", 5) for i in range(20)], schema)
    assert token_counts.commit(spark, store, name, rows) and not token_counts.commit(spark, store, name, rows)
    assert token_counts.commit(spark, store, f"{name}2", rows.where("doc_id < 2").withColumn("n_tokens", F.lit(7).cast("long")))
    assert [tuple(r) for r in token_counts.totals(spark, store).collect()] == [("s", "en", "t", 20, 104)]
    plan = token_counts.live(spark, store, rows.where("doc_id = 3").withColumn("bucket", token_counts._bucket("doc_id", 4)))._jdf.queryExecution().toString()
    assert "PartitionFilters: [(bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan  # other parts aren't read


def test_token_count_query_by_brute_force(spark):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    sf, want = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        docs, tokens = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = docs + 1, tokens + len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in queries.op3_token_counts(spark, sf).collect()} == want


def test_token_counts_are_the_tokenizers(spark):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    texts = [prose(30, i) for i in range(20)] + [None, ""]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, texts), queries.tokenizer_path()).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


# 4


def brute(texts, threshold=0.8):
    pattern = re.compile("[0-9a-z\u0080-\U0010ffff]+")
    sets = []
    for t in texts:
        w = pattern.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root, links = list(range(len(texts))), Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root, links


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, block):
    texts = [prose(60, i) for i in range(30)]
    base = prose(120, 99).split()
    for i in range(40):  # a chain of near copies
        copy = list(base)
        for j in range(i % 7):
            copy[(i * 13 + j * 17) % 120] = f"new{i}x{j}"
        texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + [texts[1].upper() + "!"] + ["one two", "One, two", "", None, None, prose(5000, 5)]
    root, links = brute(texts)
    got = {r.id: r for r in ngram_join.near_duplicates(documents(spark, texts), group_block=block).collect()}
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(root))
    assert {i: r.n_links for i, r in got.items()} == {i: links[i] for i in range(len(texts))}
    kept = ngram_join.one_of_each(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_near_duplicates_odd_tables(spark):
    docs = documents(spark, [prose(20, 1)] * 2)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 0").union(docs.where("doc_id = 0"))
    assert [r.n_links for r in ngram_join.near_duplicates(twice).collect()] == [1, 1]
    assert ngram_join.one_of_each(twice).count() == 1
    lost = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert ngram_join.near_duplicates(lost).count() == 0 and ngram_join.one_of_each(lost).count() == 2


def test_prefixes_are_shortened_to_the_target_only():
    d = ngram_join.floor_depth(0.8, ngram_join.TREES, ngram_join.RECALL)
    assert 1 - ngram_join.missed([d] * ngram_join.TREES) >= ngram_join.RECALL > 1 - ngram_join.missed([d + 1] * ngram_join.TREES)
    with pytest.raises(ValueError):
        ngram_join.floor_depth(0.3, 3, 0.999)


def test_forest_takes_the_deepest_nodes_that_reach_the_target(spark):
    """Two classes alone together in each tree need no short prefix; a crowd that shares 5 values in each tree needs depth 5."""
    trees = 20
    hi, lo = 7 << 40, 0x0001_0002_0003_0004
    pair = [(i, 10, [(hi + t, lo) for t in range(trees)]) for i in (1, 2)]
    crowd = [(10 + i, 10, [(99 + t, (5 << 48) + (i << 32) + (i << 16) + i) for t in range(trees)]) for i in range(1, 30)]
    alone = [(100, 10, [(10**6 + t, 1) for t in range(trees)])]
    classes = spark.createDataFrame(pair + crowd + alone, "cls long, bytes long, keys array<struct<hi:long,lo:long>>")
    met = ngram_join.forest(classes, trees, 0.8, 0.999).groupBy("tree", "bucket").agg(F.sort_array(F.collect_list("cls")).alias("who")).collect()
    assert {tuple(r.who) for r in met} == {(1, 2), tuple(range(11, 40))} and len(met) == 2 * trees


def test_rows_with_equal_ids_are_told_apart_by_text(spark):
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    near = lambda t: t + " tail"
    rows = [(1, a), (1, b), (1, b), (2, near(a)), (3, near(b)), (4, c), (0, near(c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 1, 2), (2, 2, 1, 1), (3, 3, 1, 2), (4, 4, 0, 1), (0, 0, 0, 1)])
    assert sorted(tuple(r) for r in ngram_join.one_of_each(docs).collect()) == sorted([(1, a), (1, b), (0, near(c))])


def test_recall_on_the_documents(spark):
    """Links of whole documents against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect()))
    owners, sets = {}, {}
    for i, t in texts.items():
        w = re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for g in sets[i]:
            owners.setdefault(g, []).append(i)
    common = Counter((x, y) for own in owners.values() for k, x in enumerate(own) for y in own[k + 1 :])
    links = Counter()
    for (x, y), n in common.items():
        if 5 * n >= 4 * (len(sets[x]) + len(sets[y]) - n):
            links.update((x, y))
    got = {r.id: r.n_links for r in ngram_join.near_duplicates(docs).collect()}
    assert sum(links.values()) >= 200 and sum(min(got[i], n) for i, n in links.items()) >= 0.95 * sum(links.values())
    assert all(got[i] <= links[i] for i in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((90, 95, 100), 90)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    sep = warc.SEPARATOR.decode()
    pages = ["short", None, "", "é" * 3000, "WARC/1.1\r\nx", "a\r\n\r\nWARC/1.1", sep * 200, "x" * 999 + sep, "short", "\r\n" * 1500, "é" * 3000, "WARC/1.1\r\n" * 300 + "\r\n\r\n"]
    df = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i} a", h, "t") for i, h in enumerate(pages)], "page_id long, url string, html string, type string")
    path = shared_folder(spark, "warc")
    warc.write_warc(df, path)
    got = {r.id: r for r in warc.read_records(spark, path).collect()}
    raw = [(h or "").encode() for h in pages]
    last = {b: i for i, b in enumerate(raw)}
    for i, b in enumerate(raw):
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[b] == i else ("revisit", last[b]))
    whole = {}
    for r in sorted(warc.read_chunks(spark, path).collect(), key=lambda r: (r.id, r.chunk)):
        whole[r.id] = whole.get(r.id, b"") + bytes(r.data)
    assert all(whole[i] == b for i, b in enumerate(raw) if last[b] == i)
    warc.write_warc(df.limit(0), path + "-none")
    assert warc.read_records(spark, path + "-none").count() == 0
    warc.write_warc(df, path + "-large", smallest=100)
    assert {r.id for r in warc.read_records(spark, path + "-large").where("record_type = 'revisit'").collect()} == {3}


def test_warc_of_repeated_and_null_ids(spark):
    rows = [(1, "x"), (1, "y"), (1, "y"), (2, "x"), (None, "z"), (None, "z"), (None, None), (3, "")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    path = shared_folder(spark, "warc")
    warc.write_warc(df, path)
    got = warc.read_records(spark, path).collect()
    digest = {h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in "xyz"} | {"": base64.b32encode(hashlib.sha1(b"").digest()).decode()}
    assert Counter((r.id, r.payload_digest) for r in got) == Counter((i, digest[h or ""]) for i, h in rows)
    assert Counter((r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter([(digest["x"], "response", None), (digest["x"], "revisit", 2), (digest["y"], "response", None), (digest["y"], "revisit", 1), (digest["z"], "response", None), (digest["z"], "revisit", None), (digest[""], "response", None), (digest[""], "revisit", 3)])


def test_bloom_filters(spark):
    r = np.random.default_rng(5)
    keys = r.integers(-(1 << 62), 1 << 62, 3000)
    for most in (1 << 20, 1 << 12):
        made = bloom.Bloom.of(spark.createDataFrame([(int(k),) for k in keys], "h long"), most)
        assert made.holds(keys).all() and made.words.size * 64 <= max(most, bloom.LEAST_BITS)
    other = r.integers(-(1 << 62), 1 << 62, 20000)
    assert bloom.Bloom.of(spark.createDataFrame([(int(k),) for k in keys], "h long"), 1 << 20).holds(other).mean() < 0.01
    assert not bloom.Bloom.of(spark.createDataFrame([], "h long"), 1 << 20).holds(other).any()


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_warc_whatever_the_filters_let_through(spark, monkeypatch, bits):
    monkeypatch.setattr(bloom, "LEAST_BITS", 64)
    monkeypatch.setattr(warc, "BLOOM_BITS", bits)  # 64 bits: everything seems shared
    rows = [(i, f"u{i}", f"page {i % 40 if i % 3 else i}") for i in range(300)] + [(1000 + i, None, "hot") for i in range(200)]
    path = shared_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    best = {}
    for i, _, h in rows:
        best[h] = max(best.get(h, 0), i)
    got = {r.id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(spark, path).collect()}
    assert got == {i: ("response", None, len(h)) if best[h] == i else ("revisit", best[h], len(h)) for i, _, h in rows}


def test_cut_never_leaves_a_separator():
    r = np.random.default_rng(3)
    parts = [b"\r\n", b"WARC/1.1", b"\r\n\r\n", b"x", b"WARC/1.1\r\n"]
    for _ in range(200):
        data = b"".join(parts[i] for i in r.integers(0, 5, 30))
        pieces = [bytes(p) for p in warc.cut(data, 20)]
        assert b"".join(pieces) == data and all(warc.SEPARATOR not in b"\r\n\r\n" + p + b"\r\n\r\n" for p in pieces)


# 6


def test_decontamination(spark):
    item, short = prose(25, 1), "Tiny Item"
    texts = [prose(30, 2), "x " + item.upper().replace(" ", ", ") + " y", item + " " + item, " ".join(item.split()[:9]), "a tiny,item b", "tiny items", None, "", "z" * 10 + " " + " ".join(item.split()[3:13])]
    bench = spark.createDataFrame([("b10", item), ("b9", short), ("n", None), ("e", "..."), ("b10x", item)], "item_id string, text string")
    docs = documents(spark, texts)
    for most in (2_000_000, 1):
        got = {r.doc_id: r for r in decontam.find_overlap(docs, bench, part_windows=most).select("doc_id", "overlap.*", decontam.hit_words().alias("n_hit")).collect()}
        assert [got[i].n_hit for i in range(9)] == [0, 25, 50, 0, 2, 0, 0, 0, 10]
        assert [got[i]["items"] for i in (1, 4, 8)] == [["b10", "b10x"], ["b9"], ["b10", "b10x"]]
        assert got[6].n_words == 0 and got[1].n_words == 27
    nameless = bench.union(spark.createDataFrame([(None, item), (None, short)], "item_id string, text string"))
    for most in (2_000_000, 1):
        got = {r.doc_id: r["items"] for r in decontam.find_overlap(docs, nameless, part_windows=most).select("doc_id", "overlap.items").collect()}
        assert got[1] == ["b10", "b10x", None] and got[4] == ["b9", None] and got[0] == []
    assert sorted(r.doc_id for r in decontam.drop_documents(docs, bench).collect()) == [0, 3, 5, 6, 7]
    cut = {r.doc_id: r.text for r in decontam.cut_spans(docs, bench).collect()}
    assert cut[1] == "x  y" and cut[0] == texts[0] and cut[2].strip() == "" and cut[6] is None
    assert decontam.drop_documents(docs, bench.limit(0)).count() == 9 and decontam.find_overlap(docs.limit(0), bench).count() == 0


# 7 and 9


def test_quality(spark):
    good, bad = [prose(40, i) for i in range(60)], [prose(40, i).upper().replace(" ", "!! ") for i in range(60)]
    docs = documents(spark, good + bad + [None, "", "x" * 200_000])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (4, None, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert all(got[i] > 0.7 for i in range(60)) and all(got[i] < 0.3 for i in range(60, 120))
    assert got[120] == got[121] == pytest.approx(model.prior) and 0 <= got[122] <= 1
    assert scored.columns == [*docs.columns, "score"]
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {none.prior}
    assert quality.score(docs.limit(0), model).count() == 0


def test_language(spark):
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmnü"}
    r = np.random.default_rng(1)
    rows = [(i, " ".join("".join(r.choice(list(letters[c]), 6)) for _ in range(12)), c, "s", 0, 1, 1) for i, c in enumerate(["aa", "bb", "cc"] * 40)]
    odd = [(200, None, "aa", None, 0, 1, 1), (201, "123 !?", "aa", None, 0, 1, 1), (202, "", None, None, 0, 1, 1), (None, "abc", None, None, 0, 1, 1)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    out = language_id.identify(docs, model)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert all(got[i][0] == c for i, _, c, *_ in rows) and got[200] == got[201] == got[202] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_quality_by_naive_votes():
    """Scores against the definition, text by text, with the model's projection."""
    texts = [prose(30 + i, i) if i % 3 else prose(30, i).upper() + "!!" for i in range(90)]
    labels = np.array([int(i % 3 > 0) for i in range(60)])
    model = quality.Model(quality._features(pa.array(texts[:60])), labels, {0: 200, 1: 80})
    got = model.score(pa.array(texts[60:] + [""]))
    known = [model.weigh(quality._features(pa.array([t])))[0] @ model.axes for t in texts[:60]]
    for t, score in zip(texts[60:], got):
        v = model.weigh(quality._features(pa.array([t])))[0] @ model.axes
        cosines = np.array([v @ k / np.linalg.norm(v) / np.linalg.norm(k) for k in known])
        near = np.argsort(-cosines, kind="stable")[: quality.NEIGHBOURS]
        rate = np.where(labels[near] == 1, 40 / 80, 20 / 200)  # the share of each class that was sampled
        votes = np.maximum(cosines[near], 1e-6) ** quality.POWER / rate
        assert score == pytest.approx((votes * labels[near]).sum() / votes.sum(), abs=1e-3)
    assert got[-1] == model.prior


def test_quality_learns_wording():
    """Texts of the same form, told apart by their words alone."""
    r = np.random.default_rng(4)
    pools = [[f"{a}{b}" for a in "bcdfg" for b in ("ar", "ol", "un")], [f"{a}{b}" for a in "klmnp" for b in ("ar", "ol", "un")]]
    texts, labels = [], []
    for i in range(120):
        texts.append(" ".join(r.choice(pools[i % 2], 40)))
        labels.append(i % 2)
    model = quality.Model(quality._features(pa.array(texts[:80])), np.array(labels[:80]), {0: 40, 1: 40})
    assert ((model.score(pa.array(texts[80:])) >= 0.5) == np.array(labels[80:])).all()


def test_folded_weights_are_the_kernels():
    """Answers by folded weights against an explicit kernel matrix with every landmark."""
    r = np.random.default_rng(1)
    letters = ["abcde", "efghi", "ijklm"]
    texts = [" ".join("".join(r.choice(list(letters[i % 3]), 5)) for _ in range(8 + i % 5)) for i in range(60)]
    labels = np.array([i % 3 for i in range(60)])
    order = np.argsort(labels, kind="stable")
    texts, labels = [texts[i] for i in order], labels[order]
    row, gram = language_id.presence(pa.array(texts))
    sets = [gram[row == i] for i in range(60)]
    model = language_id.Model(["a", "b", "c"], sets, labels)

    def kernel(x, y):
        return len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y))

    between = np.array([[kernel(x, y) for y in sets] for x in sets])  # fewer texts than landmarks: each is one
    system = between @ between / 3 / (1 / 3) + language_id.RIDGE * 60 * between + 1e-8 * 60 * np.eye(60)
    alpha = np.linalg.solve(system, between @ np.where(labels[:, None] == np.arange(3)[None], 1.0, -1.0))
    new = ["abcd eabc bbba", "fghi ihgf eehh", "klmj jklm iikl", "abc klm"]
    row, gram = language_id.presence(pa.array(new))
    raw = np.array([[kernel(gram[row == i], s) for s in sets] for i in range(len(new))]) @ alpha
    names, scores = model.answer(pa.array(new))
    assert names == [model.languages[i] for i in raw.argmax(axis=1)]
    likely = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
    assert scores == pytest.approx(1 / likely.sum(axis=1), abs=1e-3)


def test_every_language_is_learned(spark):
    """2,001 languages of a row each, and two frequent ones: more than the sample's bound."""
    def text(i):
        r = np.random.default_rng(i)
        return " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(6))

    rows = [(i, text(i), f"l{i}", "s", 0, 1, 1) for i in range(2001)] + [(9000 + i, "common words of one", "most", "s", 0, 1, 1) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs)
    assert len(model.languages) == 2002
    own = list(range(0, 2001, 40))
    names, _ = model.answer(pa.array([text(i) for i in own] + ["common words of one"]))
    assert np.mean([n == f"l{i}" for i, n in zip(own, names, strict=False)]) > 0.95 and names[-1] == "most"


@pytest.mark.parametrize("landmarks", [512, 20])
def test_more_languages_than_landmarks(monkeypatch, landmarks):
    """Scores by landmarks' columns and a second product are those of one matrix."""
    monkeypatch.setattr(language_id, "LANDMARKS", landmarks)
    monkeypatch.setattr(language_id, "MOST_LANDMARKS", landmarks)
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, language_id.BINS, 30)) for _ in range(90)]
    labels = np.repeat(np.arange(30), 3)
    model = language_id.Model([f"l{i:02}" for i in range(30)], sets, labels)
    assert (model.last is None) == (landmarks > 30)
    dense = language_id._dense(sets)
    marks = dense[np.linspace(0, 89, min(landmarks, 90)).astype(int)]
    near, targets = (dense @ marks.T).astype(float), np.where(labels[:, None] == np.arange(30)[None], 1.0, -1.0)
    system = near.T @ near + language_id.RIDGE * 90 * (marks @ marks.T).astype(float) + 1e-8 * 90 * np.eye(len(marks))
    want = marks.T @ np.linalg.solve(system, near.T @ targets)
    got = model.weights if model.last is None else model.weights @ model.last
    assert np.abs(dense @ got - dense @ want).max() < 1e-3


def test_long_texts_are_worked_on_in_pieces(monkeypatch):
    """Results don't depend on the size of pieces, nor need a text fit one."""
    from finlattice.llm import features, shared

    texts = pa.array(["", prose(400, 1), "é" * 900 + " x", prose(3, 2)])
    long = pa.array([prose(900, 3) + "y" * 300])

    def all_of():
        data, offsets = shared.text_bytes(texts)
        words = shared.word_spans(data, offsets)
        held = language_id.presence(long)
        return [*words, ngram_join.text_shingles(long, 5)[1], features.gram_counts(long, (1, 3), 512, quality.SHAPE), *held, quality.word_counts(texts).sum(axis=1)]

    want = all_of()
    for module in (shared, features):
        monkeypatch.setattr(module, "PIECE", 128)
    shared._powers[:] = []
    got = all_of()
    shared._powers[:] = []
    assert all((x == y).all() for x, y in zip(got, want, strict=True))


# 8


def test_rans_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 5000):
        s = np.minimum(r.zipf(1.3, n), 49_999).astype(np.uint16)
        coder = rans.Coder(rans.scaled(np.bincount(s, minlength=50_000) + (0 if n else 1)))
        states, words = coder.encode(s)
        assert (coder.decode(states, words, n) == s).all()
    f = rans.scaled(np.array([10**12, 1, 0, 5]))
    assert f.sum() == 1 << rans.SCALE_BITS and f[1] >= 1 and f[2] == 0
    with pytest.raises(ValueError):
        coder.decode(states, words[:-1] if len(words) else words, 4999)


def test_words_encode_as_whole_texts():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    t = token_files.Tokens(queries.tokenizer_path())
    texts = ["Don't  stop\n\n now,é à×, \u00a0 x \u2003 y", "a<|endoftext|> b", "  lead", "x1y2 'll we'll", "日本 語", "e\u0301 é", "\t\r\n", "", "ab\x00 c", "%%% *** a!!! b"] * 2
    r = np.random.default_rng(5)
    pool = list(" \n\t'ab1.é×÷ \u00a0日\u0301<|>")
    texts += ["".join(r.choice(pool, 40)) for _ in range(300)]
    ids, many = t.encode(pa.array(texts))
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert many.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files(spark, monkeypatch):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    texts = [prose(20, i) for i in range(40)] + [None, "", prose(3000, 1)]
    docs = documents(spark, texts).repartition(5)
    path = shared_folder(spark, "tokens")
    token_files.write_tokens(docs, path, queries.tokenizer_path(), file_tokens=4000)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, path, with_ids=True).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i].ids == ids and (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_files.write_tokens(docs.limit(0), path + "-none", queries.tokenizer_path())
    assert token_files.read_tokens(spark, path + "-none").count() == 0
    odd = docs.limit(3).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).union(docs.limit(1))
    token_files.write_tokens(odd, path + "-odd", queries.tokenizer_path())
    assert token_files.read_tokens(spark, path + "-odd").count() == 4
    hot = documents(spark, [prose(30, i) for i in range(200)]).withColumn("doc_id", F.lit(5).cast("long"))
    token_files.write_tokens(hot, path + "-hot", queries.tokenizer_path(), file_tokens=4000)
    files = spark.read.format("binaryFile").load(f"{path}-hot/blocks").where("length > 0")
    assert token_files.read_tokens(spark, path + "-hot").count() == 200 and files.count() >= 3
    raw = bytearray(spark.read.format("binaryFile").load(f"{path}/blocks").where("length > 0").first().content)
    raw[100] ^= 1
    with pytest.raises(ValueError):
        list(token_files.blocks_of(memoryview(bytes(raw))))


# 10


def test_topk(spark):
    r = np.random.default_rng(2)
    vectors = [list(map(float, v)) for v in r.standard_normal((400, 8))] + [[1.0] * 8] * 300
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1050, [1.0, float("nan")]), (1100, [None, 1.0]), (1150, [2.0, float("inf")]), (1200, [3.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    whole = {i: np.floor(256 * np.array(v + [0.0] * (8 - len(v)))).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = {}
    for x in topk.top_k(df, F.col("vec_id") % 50 == 0, pivots=9, block=64).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.score, x.id)
    asked = [i for i in whole if i % 50 == 0]
    assert sorted(got) == asked
    for q in asked:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(-s, i) for s, i in best]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    one = df.where("vec_id IN (50, 51, 52)")
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).count() == 2


def test_large_scores_are_exact():
    x = np.array([[2.0**40, 1.0], [3.0, 2.0**30]])
    y = np.array([[2.0**15, 3.0], [5.0, 7.0]])
    assert topk.products(x, y).tolist() == [[2**55 + 3, 5 * 2**40 + 7], [3 * 2**15 + 3 * 2**30, 15 + 7 * 2**30]]
    with pytest.raises(ValueError):
        topk.products(x * 2**20, y)


# all


def test_columns_with_names_used_inside(spark):
    """Input columns of any name come out as they went in, and none stops an operator."""
    names = ["overlap", "_overlap", "_row", "_id", "_label", "_of", "_gone", "_again", "_same_id", "_mix", "_mix_id", "_quality", "_answer", "_scan", "fp", "rows", "copies", "label", "found", "cls", "content"]
    texts = [prose(40, i % 7) for i in range(14)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 2}", *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(1, " ".join(texts[0].split()[:12])), (2, " ".join(texts[1].split()[5:30]))], "item_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), *names)
    known = {r.doc_id: r for r in docs.collect()}

    def same(df, but=()):
        assert [c for c in df.columns if c in docs.columns] == docs.columns
        out = df.collect()
        for r in out:
            assert all(r[c] == known[r.doc_id][c] for c in docs.columns if c not in but)
        return [r.doc_id for r in out]

    for most in (2_000_000, 1):
        assert sorted(same(decontam.drop_documents(docs, bench, part_windows=most))) == [i for i in range(14) if i % 7 > 1]
        assert len(same(decontam.cut_spans(docs, bench, part_windows=most), but=["text"])) == 14
        assert decontam.find_overlap(docs, bench, part_windows=most, into="found").where("found.n_words > 0").count() == 14
    assert len(same(quality.score(docs, quality.fit(docs, labels)))) == 14
    assert len(same(language_id.identify(docs, language_id.fit(docs)))) == 14
    assert sorted(same(ngram_join.one_of_each(docs))) == list(range(7))
    assert set(same(mixing.resample(docs))) <= set(known)
    assert mixing.mix(docs).count() == ngram_join.near_duplicates(docs).count() == 14
