"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_align, decontam, fill_middle, language_id, mixing, ngram_join, quality, secret_scan, token_counts, token_files, topk, url_filter, warc
from .shared import materialise, shared_folder

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
QUALITY_FROM = 0.7


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = [url_filter.host_rule(text, verdict) for text, verdict in URL_RULES]
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of all documents, after every kind of change.

    All documents are inserted with an estimate of a token for four bytes and revised to what the
    tokenizer counts, which is committed twice as after a lost answer; those that repeat the text of
    a document with a smaller id are deleted and inserted again.
    """
    store, version = shared_folder(spark, "token-counts"), TOKENIZER.removesuffix(".json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = token_counts.count_tokens(docs, tokenizer_path()).select("doc_id", "source", "lang", F.xxhash64("text").alias("fp"), F.coalesce(F.ceil(F.octet_length("text") / 4), F.lit(0)).alias("estimate"), "n_tokens")
    counted = materialise(counted, "counted")
    firsts = counted.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))  # one text may be a third of all rows
    met = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(salted, ["fp", "salt"])
    copies = materialise(met.where("doc_id > first").select("doc_id", "source", "lang", "n_tokens"), "copies")
    token_counts.create(spark, store)
    token_counts.commit(spark, store, "estimated", token_counts.changes(counted, "insert", version, "estimate"))
    for _ in range(2):
        token_counts.commit(spark, store, "counted", token_counts.changes(counted, "revise", version))
    token_counts.commit(spark, store, "withdrawn", token_counts.changes(copies, "delete", version))
    token_counts.commit(spark, store, "restored", token_counts.changes(copies, "insert", version))
    return token_counts.totals(spark, store)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_overlap(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")).select("doc_id", "overlap")
    items = F.col("overlap.items")
    n_hit = decontam.hit_words()
    return found.select("doc_id", F.col("overlap.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    scored = quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_FROM).cast("int"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_tokens(spark, path)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op11_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return cross_align.align(docs, tokenizer_path(), tokenizer_path(PIECES))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    form, output = F.col("fim.form"), F.col("fim.output")
    digests = F.sha2(output, 256).alias("output_sha256"), F.sha2(fill_middle.restore(form, output), 256).alias("restored_sha256")
    return made.select("doc_id", F.col("fim.n").alias("n"), form.alias("form"), F.col("fim.prefix_units").alias("prefix_chars"), F.col("fim.middle_units").alias("middle_chars"), *digests)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.labelled(docs)))
    spans, kinds = F.col("secrets"), [f.kind for f in secret_scan.FORMS]
    counts = [F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in kinds]  # noqa: B023
    base = F.sha2(secret_scan.shown(F.filter(spans, lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secret_scan.shown(spans).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_token_counts, op4_ngram_join, op5_warc, op6_decontamination, op7_quality, op8_token_files, op9_language_id, op10_topk, op11_cross_align, op12_fill_middle, op13_secret_scan)}

# The method's patterns once more, as their meaning is stated, not as the module writes them.
_PATTERNS = r"""
  SELECT w AS name, '(^|[.-])' || w || '($|[.:-])' AS host_has, NULL AS path_has, NULL AS ends, NULL AS query_has FROM (SELECT unnest(string_split('ads adserver adult affiliate banner betting bingo casino cheap-pills counterfeit-watches doubleclick escort essay-writing free-bets free-ringtones link-farm payday-loans pharmacy pixel poker popunder porn replica slots spam torrent tracker viagra warez xxx', ' ')) AS w)
  UNION ALL SELECT '/' || w, NULL, '/' || w || '/', NULL, NULL FROM (SELECT unnest(string_split('account/register admin basket cart/checkout cgi-bin feed/rss forgot-password phpmyadmin search/results signin user/login wp-admin wp-content/uploads wp-login.php xmlrpc.php', ' ')) AS w)
  UNION ALL SELECT '.' || w, NULL, NULL, '.' || w, NULL FROM (SELECT unnest(string_split('apk avi bin bmp css dmg exe gif gz ico iso jpeg jpg js mov mp3 mp4 msi png rar svg swf tar.gz tiff torrent ttf wav webp woff zip', ' ')) AS w)
  UNION ALL SELECT '?' || w, NULL, NULL, NULL, w FROM (SELECT unnest(string_split('action&token add-to-cart jsessionid phpsessid print replytocom sessionid share sort&order', ' ')) AS w)"""

ORACLE_SQL = {
    "op1_url_filter": f"""
WITH split AS (
  SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, lower(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1)) AS query FROM split
), pattern AS ({_PATTERNS}
), hit AS (
  SELECT r, arg_min(name, (-length(name), name)) AS pattern FROM parts JOIN pattern ON
    regexp_matches(host, host_has) OR contains(lower(path) || '/', path_has) OR contains(path, '/') AND ends_with(lower(path), ends)
    OR len(list_filter(string_split(query, '&'), lambda x: starts_with(x, string_split(query_has, '&')[1] || '='))) > 0 AND (query_has NOT LIKE '%&%' OR
      regexp_matches('&' || query, '&' || string_split(query_has, '&')[1] || '=.*&' || string_split(query_has, '&')[2] || '=')) GROUP BY r
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule, pattern FROM parts LEFT JOIN hit USING (r)
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM judged""",
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL
), c AS (
  SELECT w, min(doc_id) AS id, count(*) AS n, row_number() OVER (ORDER BY min(doc_id)) AS k FROM w WHERE len(w) > 0 GROUP BY w
), s AS (
  SELECT DISTINCT k, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM c)
), z AS (
  SELECT k, count(*) AS z FROM s GROUP BY k
), common AS (
  SELECT a.k AS a, b.k AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.k < b.k GROUP BY a.k, b.k
), pair AS (
  SELECT a, b FROM common JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE 5 * n >= 4 * (x.z + y.z - n)
), link AS (
  SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (
  SELECT a AS k, a AS r FROM link UNION SELECT reach.k, link.b FROM reach JOIN link ON link.a = reach.r
), class AS (
  SELECT reach.k, min(c.id) AS class_id FROM reach JOIN c ON c.k = reach.r GROUP BY reach.k
), links AS (
  SELECT link.a AS k, sum(c.n) AS n FROM link JOIN c ON c.k = link.b GROUP BY link.a
)
SELECT doc_id, coalesce(id, doc_id) AS copy_of, coalesce(class_id, id, doc_id) AS class_id, CAST(coalesce(links.n, 0) + coalesce(c.n, 1) - 1 AS BIGINT) AS n_links
FROM w LEFT JOIN c ON c.w = w.w LEFT JOIN class USING (k) LEFT JOIN links USING (k)""",
    "op6_decontamination": r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), spot AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
  SELECT r, i, spot.n, item FROM spot JOIN win ON spot.n = win.n AND array_to_string(w[i : i + spot.n - 1], ' ') = s
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5""",
    "op12_fill_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS r FROM d
), c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b, CASE
    WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), o AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o""",
    "op5_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS r FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> r THEN r END AS refers_to
FROM g""",
}
