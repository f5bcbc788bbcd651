"""URL filters: pattern rules found by their rarest literal token.

Every rule is a regular expression with literal tokens that any matching URL must hold as
whole tokens (runs of ASCII letters and digits, A-Z lower-cased).  A rule is filed under the one of
its tokens that the fewest rules hold.  The distinct tokens of a URL fetch candidate rules from that
index, and only the candidates' regular expressions run.  Host-and-path rules (`example.com/en/`:
the host and all its subdomains, paths that start with the path) are such rules; of those that fit,
the longest decides.  Where none fits, the patterns decide: parts of host names, path segments, file
kinds and query parameters, matched against lower-cased host, path and query: block if one fits,
else allow.

Up to INLINE_RULES rules the index is a constant in the plan, and the filter is one projection
without a shuffle.  Beyond, the index is a table: each distinct (host, path) is judged once by an
equi-join on tokens and joined back.  The rules are a list in the driver; the URLs need fit nowhere.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no rule.
Repeated rows stay, each judged alike; an empty table gives an empty one.  Columns of the input
stay as they are; one that clashes with an output name is replaced by the output.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """name: as reported; regex: over host and path (rule) or lower-cased host, path and query (pattern); size: the larger wins."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    size: int
    kind: str


def host_rule(text: str, verdict: str) -> Rule:
    """`example.com/en/`: that host and its subdomains, where the path starts with `/en/`."""
    host, slash, rest = text.partition("/")
    host = host.lower()
    path = slash + rest
    literal = re.split(r"[^A-Za-z0-9]+", host) + re.split(r"[^A-Za-z0-9]+", path)[: None if re.search(r"[^A-Za-z0-9]$", path) else -1]
    quoted = "".join(c if c.isalnum() else "\\" + c for c in host), "".join(c if c.isalnum() else "\\" + c for c in path)
    return Rule(text, verdict, f"^(?:[^/]*\\.)?{quoted[0]}" + (quoted[1] or "(?:/|$)"), tuple(t.lower() for t in literal if t), len(text), "rule")


def _pattern(name: str, literal: str, regex: str, verdict: str) -> Rule:
    return Rule(name, verdict, regex, tuple(t for t in re.split("[^a-z0-9]+", literal) if t), len(name), "pattern")


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in literal)


def word_pattern(words: str, verdict: str = "block") -> Rule:
    """Hosts that hold the words, joined by hyphens, as whole parts of a label."""
    return _pattern(words, words, f"^(?:[^/?]*[.\\-])?{_quoted(words)}(?:[.\\-:/?]|$)", verdict)


def segment_pattern(segments: str, verdict: str = "block") -> Rule:
    """Paths with these whole segments in a row: `cgi-bin`, `user/login`."""
    return _pattern(f"/{segments}", segments, f"^[^/?]*(?:/[^?]*)?/{_quoted(segments)}(?:[/?]|$)", verdict)


def file_pattern(kind: str, verdict: str = "block") -> Rule:
    """Paths that end with this file kind."""
    return _pattern(f".{kind}", kind, f"^[^/?]*/[^?]*\\.{_quoted(kind)}(?:\\?|$)", verdict)


def query_pattern(parameters: str, verdict: str = "block") -> Rule:
    """Queries with these parameters, joined by `&`, in this order, others between them or not."""
    between = "=[^&]*&(?:.*&)?"
    return _pattern(f"?{parameters}", parameters, r"^[^?]*\?(?:.*&)?" + between.join(map(_quoted, parameters.split("&"))) + "=", verdict)


#: What a crawl for text has no use for: advertising, adult, gambling, pharmacy and link-spam hosts; logins, carts, searches, archives; programs and media; pages of a session or of a sort order.
DEFAULT_PATTERNS = (
    *map(word_pattern, "ads adserver adult affiliate banner betting bingo casino cheap-pills counterfeit-watches doubleclick escort essay-writing free-bets free-ringtones link-farm payday-loans pharmacy pixel poker popunder porn replica slots spam torrent tracker viagra warez xxx".split()),
    *map(segment_pattern, "account/register admin basket cart/checkout cgi-bin feed/rss forgot-password phpmyadmin search/results signin user/login wp-admin wp-content/uploads wp-login.php xmlrpc.php".split()),
    *map(file_pattern, "apk avi bin bmp css dmg exe gif gz ico iso jpeg jpg js mov mp3 mp4 msi png rar svg swf tar.gz tiff torrent ttf wav webp woff zip".split()),
    *map(query_pattern, "action&token add-to-cart jsessionid phpsessid print replytocom sessionid share sort&order".split()),
)


def index_rules(rules: list[Rule]) -> dict[str, list[Rule]]:
    """The rules by their rarest token; ties go to the longer token, then to the smaller."""
    held = Counter(t for r in rules for t in set(r.tokens))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name!r} has no literal token")
        index.setdefault(min(r.tokens, key=lambda t: (held[t], -len(t), t)), []).append(r)
    return index


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """The query with its question mark, or an empty text."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)


def _fields(r: Rule) -> tuple:
    return r.kind, -r.size, r.name, r.verdict, r.regex


FIELDS = "kind string, minus int, name string, verdict string, regex string"


def _literal(r: Rule) -> Column:
    return F.struct(*[F.lit(v).alias(f.split()[0]) for v, f in zip(_fields(r), FIELDS.split(", "), strict=True)])


def _rank(c: Column) -> Column:
    """Orders candidates: the largest size first, then the smallest name."""
    return F.struct(c["minus"].alias("minus"), c["name"].alias("name"), c["verdict"].alias("verdict"))


def _is(kind: str):
    return lambda c: c["kind"] == kind


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", patterns: tuple[Rule, ...] = DEFAULT_PATTERNS, default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Adds host, path, rule, pattern and verdict to each row of pages; see the module for the results of odd rows."""
    host, path = host_and_path(F.col(url))
    split = pages.withColumns({"host": host, "path": path, "_full": F.concat(host, F.translate(F.concat(path, query_of(F.col(url))), UPPER, LOWER))})
    tokens = F.array_distinct(F.split("_full", "[^a-z0-9]+"))
    whole = F.concat("host", "path")
    index = index_rules([*rules, *patterns])
    if 0 < len(rules) + len(patterns) <= inline_rules:
        filed = F.create_map(*[x for t, own in index.items() for x in (F.lit(t), F.array(*map(_literal, own)))])
        known = F.array_intersect(tokens, F.array(*map(F.lit, index)))
        fits = F.filter(F.flatten(F.transform(known, lambda t: filed[t])), lambda c: F.regexp_like(F.when(c["kind"] == "rule", whole).otherwise(F.col("_full")), c["regex"]))
        split = split.withColumn("_fits", fits)
        judged = split.withColumns({f"_{k}": F.array_min(F.transform(F.filter("_fits", _is(k)), _rank)) for k in ("rule", "pattern")}).drop("_fits")
    else:
        table = pages.sparkSession.createDataFrame([(t, *_fields(r)) for t, own in index.items() for r in own], f"token string, {FIELDS}")
        own = ["host", "path", "_full"]
        candidates = split.select(*own).distinct().withColumn("token", F.explode(tokens)).join(table, "token").where(F.regexp_like(F.when(F.col("kind") == "rule", whole).otherwise(F.col("_full")), F.col("regex")))
        row = F.struct("minus", "name", "verdict")
        best = candidates.groupBy(*own).agg(*[F.min(F.when(F.col("kind") == k, row)).alias(f"_{k}") for k in ("rule", "pattern")])
        judged = split.join(best, own, "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.col("_pattern.verdict"), F.lit(default))
    return judged.withColumns({"rule": F.col("_rule.name"), "pattern": F.col("_pattern.name"), "verdict": verdict}).drop("_rule", "_pattern", "_full")
