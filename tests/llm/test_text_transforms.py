"""Cross-tokenizer alignment, fill-in-middle and secret scans against brute force and on odd rows."""

import hashlib
import random
import re
import string
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from finlattice.llm import cross_align, fill_middle, queries, secret_scan

ODD = [None, "", "a", " ", "  a  b ", "a ", "\n\n a\tb\r\n", "<|endoftext|> x <s>", "a▁b", "日本語 text ü", "ﬁ①　a\xa0b", "don't  stop's", "x" * 300, "\x00a", " ▁", "é" * 30 + " z", "🙂🙃 <P>", "b<S>", "ends <", "áb"]


def mixed(n, seed, alphabet=("a", "b", " ", "  ", "\n", "é", "日", "'s", "<", "1", "🙂", ".", "the ", "token")):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(n)]


def table(spark, texts):
    """Repeated and null ids, and columns that clash with the operators' own names."""
    rows = [(None if i % 11 == 3 else i // 2, t, "mine", "mine", 7, "mine", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, _scan string, place int, sums string, row int")


# 11


@pytest.fixture(scope="module")
def brute():
    a_path, b_path = queries.tokenizer_path(), queries.tokenizer_path(queries.PIECES)
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        """(ids of A, ids of B) of each group, found by walking both lists byte by byte."""
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [bytes(byte[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            return []
        ends = [{sum(map(len, s[: k + 1])): k for k in range(len(s))} for s in spelled]
        out, i, j = [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            out.append((x[i : ends[0][e] + 1], y[j : ends[1][e] + 1]))
            i, j = ends[0][e] + 1, ends[1][e] + 1
        return out

    return groups


@pytest.mark.parametrize("most_pairs,piece", [(cross_align.MOST_PAIRS, 1 << 20), (0, 1 << 20), (cross_align.MOST_PAIRS, 64)])
def test_cross_align(spark, brute, monkeypatch, most_pairs, piece):
    texts = ODD + mixed(60, 5) + ["same text here"] * 9
    want = [brute(t) for t in texts]
    links = Counter((a[-1], b[-1]) for g in want for a, b in g)
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for i, g in enumerate(want):
        own = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((None if i % 11 == 3 else i // 2, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if g else "", text))
    if piece < 1 << 20:  # sections of a long text, as a worker cuts them
        monkeypatch.setattr(cross_align, "PIECE", piece)
        import pyarrow as pa

        made = cross_align.aligner(queries.tokenizer_path(), queries.tokenizer_path(queries.PIECES))
        long = "word and some more, then  spaces\n " * 40
        assert len(list(made.sections(pa.array([" " + long])))) > 10
        counts, _, groups, _ = made.rows(pa.array([long]), True)
        assert (counts[0, 2], groups[0]) == (len(brute(long)), ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute(long)))
        return
    got = cross_align.align(table(spark, texts), queries.tokenizer_path(), queries.tokenizer_path(queries.PIECES), with_groups=True, most_pairs=most_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(rows, key=key)


def test_cross_align_empty(spark):
    empty = table(spark, ["x"]).limit(0)
    assert cross_align.align(empty, queries.tokenizer_path(), queries.tokenizer_path(queries.PIECES)).count() == 0


# 12


def naive_fim(text, id_):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    texts = ODD + mixed(300, 9) + ["long ü " * 3000]
    df = table(spark, texts)
    made = fill_middle.fill_in_middle(df)
    got = made.withColumn("back", fill_middle.restore(F.col("fim.form"), F.col("fim.output"))).orderBy("row").collect()
    assert made.columns == [*df.columns, "fim"] and [r.form for r in got] == ["mine"] * len(texts)
    for r, t in zip(got, texts, strict=True):
        assert tuple(r.fim) == naive_fim(t, r.doc_id)
        assert r.back == (t or "")
    assert {r.fim.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_units_and_long_rows(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from finlattice.llm.shared import text_bytes

    cut = {"code_point": lambda t: list(t), "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t), "word": lambda t: re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+|[ \t\v\f\r\n]+|.", t, re.S)}
    texts = [t for t in ODD if t] + mixed(50, 2) + ["", "", "a_b-c\n\nd"]
    for unit, split in cut.items():
        for piece in (1 << 20, 7):
            monkeypatch.setattr(fill_middle, "PIECE", piece)
            for batch in [texts] if piece > 7 else [[t] for t in texts]:
                data, offsets = text_bytes(pa.array(batch))
                units = fill_middle.Units(data, offsets, unit)
                parts = [split(t) for t in batch]
                assert units.counts.tolist() == [len(p) for p in parts]
                for k in (0, 1, 3):
                    wanted = np.array([min(k, len(p)) for p in parts])
                    sizes = [len("".join(p[:w]).encode()) for p, w in zip(parts, wanted, strict=True)]
                    assert (units.places(wanted, offsets[1:]) - offsets[:-1]).tolist() == sizes
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(None, unit="page")


# 13


def naive_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def keys(n, seed):
    r = random.Random(seed)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.hexdigits[:16].upper())
    return ["".join(r.choices(alphabets[i % 4], k=r.randint(24, 60))) for i in range(n)]


ENGLISH = "the quick brown fox jumps over lazy dog while every developer writes readable function names for parsing request response headers values configuration manager service account user session table column index builder factory number context handler message queue worker result status update delete insert".split()


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choices(ENGLISH, k=200))) for i in range(80)], "doc_id long, text string")
    sample = secret_scan.labelled(docs)
    assert {r.label for r in sample.collect()} == {0, 1} and sample.where("token IS NULL").count() == 0
    return secret_scan.train(sample)


def test_known_forms(spark, model):
    r = random.Random(4)
    parts = ["token", "SECRET", "api_key", "ApiKey", "ſecret", "password", ":", "=", " = ", '"', "'", "é🙂", "abcdef", "abc", "AKIA", "AKIA" + "Z9" * 8, "AKIA" + "Z" * 15, "a" * 24, "0f" * 11, "0f" * 40, " ", "\n", ".", "x-y/z+", "secret=token:abcdef ", "passwd='hunter2'"]
    texts = ODD + ["".join(r.choices(parts, k=r.randint(1, 40))) for _ in range(400)] + [" ".join([f"token=abcdef{i} ü" for i in range(700)])]
    df = table(spark, texts)
    got = secret_scan.scan(df, model)
    assert got.columns == [*df.columns, "secrets"]
    for row, t in zip(got.orderBy("row").collect(), texts, strict=True):
        assert [tuple(s)[:4] for s in row.secrets if s.kind != "random"] == naive_base(t)
        assert [(s.start, s.place) for s in row.secrets] == sorted((s.start, s.place) for s in row.secrets)
        assert (row.place, row.form) == (7, "mine")
        for s in row.secrets:
            assert (s.score is None) == (s.kind != "random")
    assert secret_scan.scan(df.limit(0), model).count() == 0


def test_random_strings_and_identifiers(spark, model):
    r = random.Random(8)
    secret = keys(200, 3)
    ordinary = [s.join(r.choices(ENGLISH, k=r.randint(4, 7))) for s in ("_", "-", "/", "") for _ in range(50)] + ["".join(w.title() for w in r.choices(ENGLISH, k=5)) for _ in range(50)] + ["=" * 60, "-" * 80, "_" * 30, "/" * 25, "z" * 40]
    texts = [f"some words ü {x} and more" for x in secret + ordinary]
    rows = secret_scan.scan(table(spark, texts), model).orderBy("row").collect()
    found = [[(s.start, s.end) for s in row.secrets if s.kind != "assign"] for row in rows]
    exact = [(13, 13 + len(x)) in f for x, f in zip(secret + ordinary, found, strict=True)]
    assert sum(exact[: len(secret)]) >= 0.98 * len(secret)
    assert [x for x, f in zip(ordinary, found[len(secret) :], strict=True) if f] == []


def test_places_of_runs_after_assignments(spark, model):
    key = keys(1, 5)[0]
    text = f"é token=abc password: hunter22 🙂 {key} secret='{key}' {'0a' * 20} {key}"
    (row,) = secret_scan.scan(spark.createDataFrame([(text,)], "text string"), model).collect()
    assert [(s.kind, text[s.start : s.end]) for s in row.secrets] == [("assign", "password: hunter22"), ("random", key), ("assign", f"secret='{key}"), ("hex", "0a" * 20), ("random", key)]


def test_model(spark, model):
    empty = spark.createDataFrame([], "token string, label int")
    assert secret_scan.train(empty) == [0.0] * secret_scan.SYMBOLS**2
    few = spark.createDataFrame([("ab", 1), ("ab", 1), ("cd", 0), (None, 1), ("zz", 5)], "token string, label int")
    k, at = secret_scan.SYMBOLS, lambda a, b: (secret_scan.ALPHABET.find(a) + 1 if a else 0) * secret_scan.SYMBOLS + secret_scan.ALPHABET.find(b) + 1
    made = secret_scan.train(few)
    assert made[at("", "a")] == pytest.approx(__import__("math").log((2.5 / (2 + k / 2)) / (0.5 / (1 + k / 2))))
    assert made[at("c", "d")] == pytest.approx(__import__("math").log((0.5 / (k / 2)) / (1.5 / (1 + k / 2))))
    tokens = spark.createDataFrame([("ab",), ("éa",), ("",), (None,)], "token string")
    got = [r.score for r in secret_scan.score(tokens, made).collect()]
    assert got[0] == pytest.approx(made[at("", "a")] + made[at("a", "b")], rel=1e-4) and got[2] == 0 and got[3] is None
    none = secret_scan.scan(spark.createDataFrame([(keys(1, 1)[0],)], "text string"), [0.0] * k**2).collect()[0]
    assert none.secrets == []


def test_query(spark, tmp_path):
    docs = [(1, "x token = 'abcdef0'"), (2, None), (3, "AKIA" + "A1" * 10 + " " + "9f" * 20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op13_secret_scan(spark, str(tmp_path)).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex, got[1].spans) == (1, 0, 0, "assign:2:18")
    assert (got[2].spans, got[2].base_sha256) == ("", hashlib.sha256(b"").hexdigest())
    assert got[3].spans == "access:0:24,hex:25:65" and got[3].base_sha256 == hashlib.sha256(got[3].spans.encode()).hexdigest()
