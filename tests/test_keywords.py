"""The automaton and the rules against one search a word."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finlattice.operators import keywords, text

ALPHABET = ["a", "b", "ab", "c", "é", "É", "芯片", "芯", "A", "B", " ", "\n", "x"]


def some(r, most):
    return "".join(r.choices(ALPHABET, k=r.randint(0, most)))


def times(t, w):
    return sum(t.startswith(w, i) for i in range(len(t)))


def naive(t, rules):
    """Hits by rule, with one search for every listed word."""
    found = {}
    for rule, priority, place, word, any_case in sorted(rules, key=lambda r: (r[2], r[3])):
        n = times((t or "").lower(), word.lower()) if any_case else times(t or "", word)
        if n:
            hit = found.setdefault((priority, rule), [0, {}, word])
            hit[0] += 1
            hit[1][word.lower() if any_case else word, any_case] = n
    return [(p, rule, w, sum(n.values()), first) for (p, rule), (w, n, first) in sorted(found.items())]


def rows_of(hits):
    return [tuple(h) for h in hits]


@pytest.mark.parametrize("stretch", [1, 5, 512])
def test_automaton(monkeypatch, stretch):
    monkeypatch.setattr(keywords, "STRETCH", stretch)
    r = random.Random(stretch)
    for _ in range(30):
        words = sorted({some(r, 4).encode() for _ in range(r.randint(1, 25))} - {b""}) or [b"a"]
        data = some(r, 60).encode()
        place, word = keywords.Automaton(words).walk(np.frombuffer(data, np.uint8))
        want = sorted((i + len(w) - 1, k) for k, w in enumerate(words) for i in range(len(data)) if data.startswith(w, i))
        assert sorted(zip(place.tolist(), word.tolist(), strict=True)) == want


@pytest.mark.parametrize("most", [keywords.MOST_STATES, 40])
def test_rules_against_one_search_a_word(spark, monkeypatch, tmp_path, most):
    r = random.Random(2)
    listed = [(f"rule {i % 7}", i % 7 // 2, i, some(r, 3), i % 3 > 0) for i in range(40)]
    listed = [x for x in listed if x[3]] + [("rule 0", 0, 90, "芯片", True), ("rule 0", 0, 91, "芯片", True), ("Z", 0, 0, "b", False)]
    texts = [None, "", "É", "ab" * 2000] + [some(r, 80) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "mine", "mine") for i, t in enumerate(texts)], "id int, t string, _text string, _part0 string")
    table = spark.createDataFrame([*listed, ("", 0, 0, "", True), ("null", 0, 0, None, True), (None, 0, 0, "a", True)], keywords.RULES)
    got = keywords.find_rules(df, F.col("t"), table, most_states=most)
    assert got.columns == [*df.columns, "hits"]
    for row in got.orderBy("id").collect():
        assert rows_of(row.hits) == naive(texts[row.id], listed) and (row._text, row._part0) == ("mine", "mine")
    assert keywords.find_rules(df.limit(0), F.col("t"), table).count() == 0
    assert {tuple(x.hits) for x in keywords.find_rules(df, F.col("t"), table.limit(0)).collect()} == {()}


def test_thousands_of_words(spark):
    r = random.Random(9)
    words = sorted({"".join(r.choices("abcdefgh", k=r.randint(3, 9))) for _ in range(6000)})
    texts = ["".join(r.choices("abcdefgh ", k=400)) for _ in range(60)]
    table = spark.createDataFrame([(f"r{i % 500:03}", i % 500, i, w, False) for i, w in enumerate(words)], keywords.RULES)
    got = keywords.find_rules(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string"), F.col("t"), table)
    rules = {}
    for i, w in enumerate(words):
        rules.setdefault(i % 500, []).append(w)
    for row in got.collect():
        want = [(p, f"r{p:03}", len(held), sum(times(texts[row.id], w) for w in held), held[0]) for p, own in sorted(rules.items()) if (held := [w for w in own if w in texts[row.id]])]
        assert rows_of(row.hits) == want


def test_categories_by_table_are_those_of_the_expressions(spark):
    r = random.Random(1)
    every = [w for _, words in text.FUND_INDUSTRIES for w in words] + ["nothing", "ai", "gpu"]
    df = spark.createDataFrame([(i, " ".join(r.choices(every, k=r.randint(0, 4)))) for i in range(200)], "fund_code int, t string")
    low = keywords.find_rules(df, F.col("t"), keywords.rules_of(spark, text.FUND_INDUSTRIES))
    both = low.select(keywords.classified(F.col("hits")).alias("a"), text.classify(F.col("t"), F.lit(""), text.FUND_INDUSTRIES).alias("b")).collect()
    assert all((x.a.industry, x.a.confidence) == (x.b.industry, x.b.confidence) for x in both)
    exact = keywords.find_rules(df, F.col("t"), keywords.rules_of(spark, text.FUND_INDUSTRIES, any_case=False))
    best = exact.select("fund_code", F.inline(keywords.best_rules(F.col("hits"))))
    want = text.top_industries(df, F.col("t"))
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.collect()))


def test_tags_of_holdings(spark):
    df = spark.createDataFrame([(["招商银行", "美团"],), (["万科"],), ([],), (["中国平安", "腾讯控股", "芯片基金", "五粮液"],)], "held array<string>")
    found = keywords.find_rules(df, F.array_join("held", "\n"), keywords.rules_of(spark, text.HOLDING_TAGS, any_case=False))
    assert [r.t for r in found.select(keywords.tags(F.col("hits")).alias("t")).collect()] == [["金融", "互联网", "港股"], ["混合配置"], ["混合配置"], ["半导体", "消费", "金融"]]
