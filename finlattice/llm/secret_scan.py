"""Secret scans: patterns of known forms, and character Markov models for the rest.

Known forms (assignments to names such as `password`, access keys, long hexadecimal runs) are found
by regular expressions.  Beside them every long run of the characters that keys are written in is
scored by two first-order Markov models of its characters, one of random strings and one of ordinary
identifiers: the sum over its characters of log P(character | the one before; random) less the same
under the other model.  A run whose log-likelihood ratio reaches LIMIT is a span of kind `random`.
Both models are counted from labelled samples (`train`); `labelled` makes such a sample from
documents: words joined as identifiers are (snake, kebab and camel case, paths, numbers), and
lines of one character, are ordinary; digests of the same words, written in the usual alphabets, are random.

All of it is column expressions: the texts are never shuffled and no Python runs.  A pattern's
matches and the pieces between them give the matches' places as running sums of lengths, in blocks of
the square root of their number, so that a text with n matches costs n * sqrt(n) steps.

The labelled sample is the only bounded part: the distinct ids of `most_docs` documents, those with
the smallest hashes of the id, and of rows with equal ids the smallest text.  The counts collected
are at most two for each pair of the 68 symbols.

Defined results: null and empty texts have no spans; rows with equal ids or texts are scanned each;
an empty sample gives a model that adds no span; an empty table gives an empty one.  A run that holds
a hexadecimal or access span, or lies in an assignment, is not scored, as it is reported already.
The output is one column, `into`, which replaces a column of that name; all others stay.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused


class Form(NamedTuple):
    """A known form: matches of pattern whose group `group` has `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


HEX, ACCESS = "[0-9a-f]{24,}", "AKIA[A-Z0-9]{16,}"  # the same runs as those of [0-9a-f]+ and AKIA[A-Z0-9]+ with that many characters
FORMS = (
    Form("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Form("access", ACCESS, 0, 20),
    Form("hex", HEX, 0, 24),
)
RANDOM = "random"
RUN = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Natural logarithm of the odds that a run must reach.
LIMIT = 12.0
MOST_DOCS = 2000

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SYMBOLS = len(ALPHABET) + 1  # 0: the beginning, or any other character
SPAN = "array<struct<start:int,place:int,end:int,kind:string,score:double>>"


def _codes(token: Column) -> Column:
    """For each character the code of the symbol before it and its own."""
    own = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.filter(F.zip_with(F.concat(F.array(F.lit(0)), own), own, lambda p, c: p * SYMBOLS + c), lambda x: x.isNotNull())


def train(samples: DataFrame, token: str = "token", label: str = "label") -> list[float]:
    """Log-likelihood ratios by code, from tokens labelled 1 (random) or 0 (ordinary); other rows are ignored."""
    known = samples.where(F.col(label).isin(0, 1) & F.col(token).isNotNull())
    rows = known.select(F.col(label).cast("int").alias("label"), F.explode(_codes(F.col(token))).alias("code")).groupBy("label", "code").count().collect()
    counts = [[0.0] * SYMBOLS**2 for _ in range(2)]
    for y, code, n in rows:
        counts[y][code] = float(n)
    if not all(map(any, counts)):
        return [0.0] * SYMBOLS**2
    sums = [[sum(c[p * SYMBOLS : (p + 1) * SYMBOLS]) for p in range(SYMBOLS)] for c in counts]
    chance = lambda y, code: (counts[y][code] + 0.5) / (sums[y][code // SYMBOLS] + 0.5 * SYMBOLS)
    return [log(chance(1, code) / chance(0, code)) for code in range(SYMBOLS**2)]


def labelled(docs: DataFrame, id_: str = "doc_id", text: str = "text", most_docs: int = MOST_DOCS) -> DataFrame:
    """(token, label): identifiers made of the words of some documents, and digests of them."""
    ids = docs.select(F.col(id_).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(most_docs)
    texts = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))
    words = texts.select(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), lambda w: F.length(w).between(2, 16)).alias("words"))
    triples = words.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("words") / 3).cast("int") - 1, F.lit(0))), lambda i: F.slice("words", i * 3 + 1, F.lit(3)))).alias("i", "w")).where(F.size("w") == 3)
    w = [F.get("w", F.lit(i)) for i in range(3)]
    camel = F.concat(F.lower(w[0]), F.initcap(w[1]), F.initcap(w[2]))
    rule = F.repeat(F.substring(F.lit(ALPHABET), F.pmod(F.xxhash64("w"), F.lit(SYMBOLS - 1)).cast("int") + 1, F.lit(1)), F.lit(30))  # a line of one character
    ordinary = _pick("i", [F.concat_ws("_", "w"), F.concat_ws("-", "w"), camel, F.concat_ws("/", "w"), F.concat(*w), F.concat(F.concat_ws("_", "w"), F.col("i").cast("string")), F.upper(F.concat_ws("_", "w")), rule])
    digest = F.sha2(F.concat_ws(":", "w", "i"), 256)
    coded = F.base64(F.unhex(digest))
    random = _pick("i", [coded, F.regexp_replace(F.translate(coded, "+/", "-_"), "=", ""), digest, F.upper(digest), F.regexp_replace(coded, "[+/=]", ""), F.regexp_replace(F.upper(coded), "[+/=]", "")])
    return triples.select(F.explode(F.array(F.struct(ordinary.alias("token"), F.lit(0).alias("label")), F.struct(random.alias("token"), F.lit(1).alias("label")))).alias("s")).select("s.*")


def _pick(by: str, choices: list[Column]) -> Column:
    return F.get(F.array(*choices), F.pmod(F.col(by), F.lit(len(choices))))


def _score(token: Column, model: list[float]) -> Column:
    table = F.split(F.lit(" ".join(f"{x:.6g}" for x in model)), " ").cast("array<double>")  # folded to a constant
    return F.aggregate(F.transform(_codes(token), lambda c: F.get(table, c)), F.lit(0.0), lambda s, x: s + x)


def score(tokens: DataFrame, model: list[float], token: str = "token", into: str = "score") -> DataFrame:
    """tokens with their log-likelihood ratio; null where the token is."""
    return tokens.withColumn(into, _score(F.col(token), model))


def _places(df: DataFrame, text: str, forms: list[tuple[str, str]], own: str) -> DataFrame:
    """Adds for each (name, pattern) the columns name (matches) and name_at (their first characters), both empty without a match."""
    found = lambda name: F.col(f"{own}{name}")
    df = df.withColumns({f"{own}{name}": F.regexp_extract_all(text, F.lit(pattern), 0) for name, pattern in forms})

    def steps(name: str, pattern: str) -> Column:
        """From the end of the text before the last match, or the text's beginning, to each match."""
        m, n = found(name), F.size(found(name))
        return F.when(n > 0, F.zip_with(F.slice(F.split(text, pattern), F.lit(1), n), F.concat(F.array(F.lit("")), F.slice(m, F.lit(1), n - 1)), lambda p, last: F.length(p) + F.length(last)))

    def before(sums: Column) -> Column:
        return F.transform(sums, lambda _, k: _sum(F.slice(sums, F.lit(1), k)))

    df = df.withColumns({f"{own}{name}_step": steps(name, pattern) for name, pattern in forms})

    def blocks(step: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(step))).cast("int")
        return F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.slice(step, k * width + 1, width))

    df = df.withColumns({f"{own}{name}_block": F.when(F.size(found(name)) > 0, blocks(found(f"{name}_step"))) for name, _ in forms})
    df = df.withColumns({f"{own}{name}_sum": F.transform(found(f"{name}_block"), _sum) for name, _ in forms})
    df = df.withColumns({f"{own}{name}_sum": before(found(f"{name}_sum")) for name, _ in forms})

    def starts(block: Column, sums: Column) -> Column:
        return F.flatten(F.zip_with(block, sums, lambda b, s: F.transform(b, lambda _, i: s + _sum(F.slice(b, F.lit(1), i + 1)))))

    df = df.withColumns({f"{own}{name}_at": F.coalesce(starts(found(f"{name}_block"), found(f"{name}_sum")), F.array().cast("array<int>")) for name, _ in forms})
    return df.drop(*[f"{own}{name}_{part}" for name, _ in forms for part in ("step", "block", "sum")])


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda s, y: s + y)


def _spans(own: str, name: str, place: int, keep, scored) -> Column:
    """The matches that `keep` lets through, as spans; `scored` gives a match its score."""
    spans = F.zip_with(f"{own}{name}_at", f"{own}{name}", lambda a, m: F.struct(a.alias("start"), F.lit(place).alias("place"), (a + F.length(m)).alias("end"), F.lit(name).alias("kind"), scored(m).alias("score"), m.alias("match")))
    return F.transform(F.filter(spans, keep), lambda s: s.dropFields("match"))


def _long(form: Form):
    return lambda s: F.length(F.regexp_extract(s["match"], form.pattern, form.group)) >= form.least


def scan(docs: DataFrame, model: list[float], text: str = "text", into: str = "secrets", limit: float = LIMIT) -> DataFrame:
    """docs with `into`: the spans (SPAN) of each text in code points, by start and then by kind as listed; score is null for known forms."""
    own = unused(docs, "_scan")
    body = f"{own}body"
    df = _places(docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))), body, [(f.kind, f.pattern) for f in FORMS], own)
    # runs are looked for where no assignment is, found or failed: blanks of the same length stand for those
    assign = FORMS[0]
    blanked = F.zip_with(F.split(body, assign.pattern), f"{own}{assign.kind}", lambda p, m: F.concat(p, F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit(""))))
    df = df.withColumn(f"{own}blanked", F.when(F.size(f"{own}{assign.kind}") > 0, F.array_join(blanked, "")).otherwise(F.col(body)))
    df = _places(df, f"{own}blanked", [(RANDOM, RUN)], own)
    none = lambda m: F.lit(None).cast("double")
    parts = {f"{own}{f.kind}_spans": _spans(own, f.kind, i, _long(f), none) for i, f in enumerate(FORMS)}
    unknown = lambda m: F.when(~F.regexp_like(m, F.lit(f"{HEX}|{ACCESS}")), _score(m, model))
    parts[f"{own}{RANDOM}_spans"] = _spans(own, RANDOM, len(FORMS), lambda s: s["score"] >= limit, unknown)
    df = df.withColumns(parts)
    df = df.withColumn(into, F.array_sort(F.concat(*parts)).cast(SPAN))
    return df.drop(*[c for c in df.columns if c.startswith(own) and c != into])


def shown(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
