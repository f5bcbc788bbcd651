"""Keyword joins: which rules of a table have words in a text, found by one walk over its bytes.

The words of a rule table (rule, priority, place, word, any_case) become an Aho-Corasick automaton: a table
from state and byte to state, in which the longest beginning of a word that the last bytes spell is
always known, so no byte is looked at twice, however many words there are.  Texts are laid end to end, a byte
between them that no text holds, and cut into stretches that share the length of the longest
word; all stretches of a batch are walked side by side, a byte of each at a time.

Words of any case are looked for in the lower-cased text, others in the text as it is.  Rules are collected,
and broadcast in parts of at most `most_states` bytes of words, each a pass of its own.

Defined results: null texts hold nothing; empty and null words and rules with a null name are left out; a word
listed twice in a rule counts twice; occurrences of a word may overlap; without rules every text holds none.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import unused, written

RULES = "rule string, priority int, place int, word string, any_case boolean"
#: Of a text's rules: by priority, then by name; words: how many of the listed ones it holds; first: that with the least place.
HITS = "array<struct<priority:int,rule:string,words:int,occurrences:long,first:string>>"
ARROW_HITS = pa.list_(pa.struct([("priority", pa.int32()), ("rule", pa.string()), ("words", pa.int32()), ("occurrences", pa.int64()), ("first", pa.string())]))
MOST_STATES = 100_000
STRETCH = 512
#: Bytes of text that are walked at a time; a longer text is cut at stretches like any other.
BATCH_BYTES = 4 << 20
BETWEEN = 0xFF


class Automaton:
    """Of distinct words as bytes; walk() tells where they end."""

    def __init__(self, words: list[bytes]):
        self.longest = max(map(len, words), default=1)
        self.classes = np.zeros(256, np.uint8)
        letters = sorted({b for w in words for b in w})
        self.classes[letters] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, w in enumerate(words):
            s = 0
            for b in w:
                c = int(self.classes[b])
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    ends.append([])
                s = children[s][c]
            ends[s].append(i)
        self.next = np.zeros((len(children), len(letters) + 1), np.int32)
        back, queue = [0] * len(children), deque([0])
        while queue:
            s = queue.popleft()
            if s:
                self.next[s] = self.next[back[s]]  # as if only the longest shorter beginning had been read
                ends[s] += ends[back[s]]
            for c, t in children[s].items():
                back[t] = int(self.next[s, c])
                self.next[s, c] = t
                queue.append(t)
        self.width = self.next.shape[1]
        self.flat = self.next.ravel() * self.width  # states as places of their rows
        self.many = np.array([len(e) for e in ends])
        self.first = np.cumsum(self.many) - self.many
        self.words = np.array([i for e in ends for i in e], np.int64)

    def walk(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last byte, word) of each occurrence, in no order."""
        lead, n = self.longest - 1, data.size
        rows = -(-n // STRETCH)
        padded = np.concatenate([np.full(lead, BETWEEN, np.uint8), data, np.full(rows * STRETCH - n, BETWEEN, np.uint8)])
        steps = np.lib.stride_tricks.sliding_window_view(self.classes[padded], STRETCH + lead)[::STRETCH].T if n else np.zeros((0, 0), np.uint8)
        state, places, states = np.zeros(rows, np.int64), [], []
        ending = self.many > 0
        begins = np.arange(rows) * STRETCH - lead
        for i, step in enumerate(np.ascontiguousarray(steps)):
            state = self.flat[state + step]
            if i >= lead:
                hit = np.flatnonzero(ending[state // self.width])
                if hit.size:
                    places.append(begins[hit] + i)
                    states.append(state[hit] // self.width)
        place, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, states))
        many = self.many[at]
        which = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(place, many), self.words[which]


class Rules:
    """Some rows of a rule table, and what texts hold of them."""

    def __init__(self, rows: list[tuple[str, int, int, str, bool]]):
        rows = sorted(rows, key=lambda r: (r[1], r[0], r[2], r[3]))
        names = sorted({(r[1], r[0]) for r in rows})
        self.names, place = names, {n: i for i, n in enumerate(names)}
        self.sides = []
        for folded in (True, False):
            own = [(place[r[1], r[0]], pc.utf8_lower(pa.scalar(r[3])).as_py() if folded else r[3], r[3]) for r in rows if bool(r[4]) == folded]
            if own:
                words = sorted({w for _, w, _ in own})
                number = {w: i for i, w in enumerate(words)}
                # listings of a word: a word of two rules, or twice in one, has several; they are in order of rule and place
                listed = np.array([(number[w], rule) for rule, w, _ in own])
                order = np.argsort(listed[:, 0], kind="stable")
                many = np.bincount(listed[:, 0], minlength=len(words))
                self.sides.append((folded, words, Automaton([w.encode() for w in words]), order, many, listed[:, 1], [(r[2], shown) for r, (_, _, shown) in zip((r for r in rows if bool(r[4]) == folded), own, strict=True)]))

    def held(self, column: pa.Array) -> Iterator[list[dict]]:
        """HITS of each text of a string array without nulls."""
        found: list[dict[int, list]] = [{} for _ in range(len(column))]
        for folded, words, automaton, order, many, rule_of, shown in self.sides:
            texts = pc.utf8_lower(column) if folded else column
            first = np.cumsum(many) - many
            data, ends = _joined(texts)
            place, word = automaton.walk(data)
            row = np.searchsorted(ends, place, "right")
            pairs, counts = np.unique(row * len(words) + word, return_counts=True)
            for r, w, n in zip((pairs // len(words)).tolist(), (pairs % len(words)).tolist(), counts.tolist(), strict=True):
                seen = set()
                for listing in order[first[w] : first[w] + many[w]].tolist():
                    rule = int(rule_of[listing])
                    hit = found[r].setdefault(rule, [0, 0, None])
                    hit[0] += 1
                    hit[1] += n if rule not in seen else 0
                    hit[2] = min(hit[2] or shown[listing], shown[listing])
                    seen.add(rule)
        for hits in found:
            yield [{"priority": self.names[i][0], "rule": self.names[i][1], "words": h[0], "occurrences": h[1], "first": h[2][1]} for i, h in sorted(hits.items())]


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, each with BETWEEN after it, and where each ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return np.insert(raw, offsets[1:], BETWEEN), offsets[1:] + np.arange(1, len(texts) + 1)


def _parts(rows: list[tuple], most: int) -> Iterator[list[tuple]]:
    """The rows, by rule and place, in lists of at most `most` bytes of words."""
    part, size = [], 0
    for row in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        n = len(row[3].encode())
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(row)
        size += n
    if part:
        yield part


def _united(hits: Column) -> Column:
    """Hits of several parts as one array; those of a rule that two parts share are added up."""

    def merged(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = F.struct(last["priority"].alias("priority"), last["rule"].alias("rule"), (last["words"] + x["words"]).alias("words"), (last["occurrences"] + x["occurrences"]).alias("occurrences"), last["first"].alias("first"))
        same = (F.size(done) > 0) & (last["rule"] == x["rule"]) & (last["priority"] == x["priority"])
        return F.when(same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(hits, F.array().cast(HITS), merged)


def _scanner(sent):
    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        column, rows, start = texts.fill_null(""), [], 0
        sizes = np.cumsum(np.asarray(pc.binary_length(column), np.int64))
        while start < len(column):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, "right")))
            rows.extend(sent.value.held(column[start:end]))
            start = end
        return pa.array(rows, ARROW_HITS)

    return scan


def find_rules(df: DataFrame, text: Column, rules: DataFrame, into: str = "hits", most_states: int = MOST_STATES) -> DataFrame:
    """df with `into` (HITS): the rules that have words in the text; a column of that name is replaced."""
    listed = rules.where("rule IS NOT NULL AND word <> ''").select("rule", F.coalesce("priority", F.lit(0)), F.coalesce("place", F.lit(0)), "word", F.coalesce("any_case", F.lit(True)))
    parts = list(_parts([tuple(r) for r in listed.collect()], most_states))  # a few thousand words; parts are broadcast one by one
    if not parts:
        return df.withColumn(into, F.array().cast(HITS))
    body, part_ = unused(df, "_text"), unused(df, "_part")
    out = df.withColumn(body, text)
    for i, part in enumerate(parts):
        sent = df.sparkSession.sparkContext.broadcast(Rules(part))
        out = out.withColumn(f"{part_}{i}", _scanner(sent)(F.col(body)))
        if len(parts) > 1:
            out = written(out, "keyword-part")
            sent.unpersist()
    own = [f"{part_}{i}" for i in range(len(parts))]
    return out.withColumn(into, F.col(own[0]) if len(own) == 1 else _united(F.concat(*own))).drop(body, *own)


def rules_of(spark: SparkSession, categories, any_case: bool = True) -> DataFrame:
    """A rule table of (name, words) in order of priority."""
    return spark.createDataFrame([(name, i, j, w, any_case) for i, (name, words) in enumerate(categories) for j, w in enumerate(words)], RULES)


def classified(hits: Column, hit: float = 0.7, miss: float = 0.3, other: str = "其他") -> Column:
    """(industry, confidence, reasoning): the first rule by priority."""
    first = F.get(hits, F.lit(0))
    found = first.isNotNull()
    return F.struct(F.coalesce(first["rule"], F.lit(other)).alias("industry"), F.when(found, hit).otherwise(miss).alias("confidence"), F.when(found, F.concat(F.lit("关键词匹配: "), first["first"])).otherwise("无匹配关键词").alias("reasoning"))


def best_rules(hits: Column, n: int = 3) -> Column:
    """The n rules with the most words, ties by priority: (rule, score, confidence min(95, score / best * 50 + 50))."""
    order = F.array_sort(F.transform(hits, lambda h: F.struct((-h["words"]).alias("minus"), h["priority"].alias("priority"), h["rule"].alias("rule"))))
    most = F.get(order, F.lit(0))["minus"]
    return F.transform(F.slice(order, 1, n), lambda h: F.struct(h["rule"].alias("rule"), (-h["minus"]).alias("score"), F.least(F.lit(95.0), h["minus"] / most * 50 + 50).alias("confidence")))


def tags(hits: Column, n: int = 3, default: str = "混合配置") -> Column:
    """The first n rules that the text holds a word of, by priority."""
    names = F.transform(F.slice(hits, 1, n), lambda h: h["rule"])
    return F.when(F.size(hits) > 0, names).otherwise(F.array(F.lit(default)))
