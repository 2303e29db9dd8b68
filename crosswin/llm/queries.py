"""The operators of this package as queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from crosswin.llm import digest_filter, feistel_pii, feistel_shards, jaccard_join, license_scan, line_dedup, piece_codec, pu_toxicity, source_divergence, spelling_variants, template_leaks, trusted_rules, warc_derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql_unescaped(text: str) -> str:
    for entity, char in warc_derive.ENTITIES.items():
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    return text


def sql_uuid(digest: str) -> str:
    return f"'<urn:uuid:' || {digest}[1:8] || '-' || {digest}[9:12] || '-' || {digest}[13:16] || '-' || {digest}[17:20] || '-' || {digest}[21:32] || '>'"


CRC_TABLE = """(SELECT list(c ORDER BY i) AS t FROM (SELECT i,
    list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"""


def sql_crc32(text: str) -> str:
    """CRC-32 of a text in UTF-8, given the column t of CRC_TABLE."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295)"


def sql_feistel(source: str, place: str) -> str:
    """(row, place) of ``source`` permuted once; it has row, place, n, a and b. Every step is a select of its own."""
    steps, prime = f"SELECT row, n, a, b, {place} // b AS l, {place} % b AS r FROM {source}", feistel_shards.PRIME
    for i, (k, m) in enumerate(feistel_shards.round_keys(1)):
        half, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        steps = f"SELECT *, ({other} + {k}) % {prime} AS x FROM ({steps})"
        steps = f"SELECT * EXCLUDE (x), (x * x + {m}) % {prime} AS y FROM ({steps})"
        steps = f"SELECT row, n, a, b, {other}, ({half} + y * y % {prime} % {size}) % {size} AS {half} FROM ({steps})"
    return f"SELECT row, l * b + r AS place FROM ({steps})"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


RULES = [  # fixed values
    digest_filter.Rule(True, "org", "/"), digest_filter.Rule(False, "example.org", "/es/"), digest_filter.Rule(False, "example.org", "/en/1"),
    digest_filter.Rule(True, "com", "/fr/"), digest_filter.Rule(False, "com", "/de/"),
]
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op1_template_leaks")
def op1(spark, sf_dir):
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units."""
    return template_leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_ngram_jaccard_join")
def op2(spark, sf_dir):
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op3_warc_derive", rf"""
WITH s AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS html, chr(13) || chr(10) AS nl,
    sha256('page ' || coalesce(page_id::VARCHAR, '')) AS uid,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS warc_date FROM pages),
r AS (SELECT *, {sql_uuid('uid')} AS refers_to, 'sha256:' || sha256(html) AS source_payload_digest,
    nullif({sql_unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}, '') AS title,
    regexp_extract_all(html, '(?i)<a[^a-z>][^>]*?href="([^"]*)"', 1) AS links,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{warc_derive.HIDDEN[0]}', '', 'g'), '{warc_derive.HIDDEN[1]}', '', 'g'), '{warc_derive.HIDDEN[2]}', '', 'g'), '{warc_derive.HIDDEN[3]}', '', 'g') AS seen FROM s),
t AS (SELECT *, {sql_unescaped(f"regexp_replace(regexp_replace(seen, '(?i)</?(?:{warc_derive.LINE_TAGS})(?:[^a-z0-9>][^>]*)?>', chr(10), 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g')")} AS raw FROM r),
b AS (SELECT *, 'metadata' AS record_type, concat_ws(nl, 'http-status-line: HTTP/1.1 200 OK', 'title: ' || regexp_replace(title, '[\r\n]+', ' ', 'g'),
      'http-header: Content-Type: text/html; charset=utf-8', 'http-header: Content-Length: ' || strlen(html),
      nullif(array_to_string(list_transform(links, lambda x: 'outlink: ' || {sql_unescaped('x')}), chr(13) || chr(10)), '')) || nl AS block, 'application/warc-fields' AS content_type FROM t
  UNION ALL SELECT *, 'conversion', regexp_replace(regexp_replace(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g'), 'text/plain; charset=utf-8' FROM t),
c AS (SELECT *, sha256(refers_to || '|' || record_type) AS own, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length FROM b)
SELECT page_id, record_type, {sql_uuid('own')} AS record_id, refers_to, target_uri, warc_date, source_payload_digest, content_length, block_digest,
  sha256('WARC/1.1' || nl || concat_ws(nl, 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || {sql_uuid('own')}, 'WARC-Refers-To: ' || refers_to,
    'WARC-Target-URI: ' || target_uri, 'WARC-Date: ' || warc_date, 'WARC-Source-Payload-Digest: ' || source_payload_digest, 'WARC-Block-Digest: ' || block_digest,
    'Content-Type: ' || content_type, 'Content-Length: ' || content_length) || nl || nl || block || nl || nl) AS record_sha256
FROM c""")
def op3(spark, sf_dir):
    """Metadata and conversion records of all pages, with the digest of each whole WARC record."""
    records = warc_derive.derive(warc_derive.responses_of(table(spark, sf_dir, "pages")))
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "source_payload_digest", "content_length",
        "block_digest", F.sha2(warc_derive.record_text(), 256).alias("record_sha256"))


@query("op4_digest_filter", """
WITH a AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(allow, h, p) AS (VALUES (true, 'org', '/'), (false, 'example.org', '/es/'), (false, 'example.org', '/en/1'), (true, 'com', '/fr/'), (false, 'com', '/de/')),
u AS (SELECT DISTINCT host, path FROM a),
best AS (SELECT host, path, arg_max(h || p, length(h) * 1000 + length(p) * 1001) AS rule, arg_max(allow, length(h) * 1000 + length(p) * 1001) AS allow
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
listed AS (SELECT DISTINCT host || path AS key FROM a WHERE page_id % 50 = 0 AND host || path <> '')
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN allow THEN 'allow' ELSE 'block' END
  WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM a LEFT JOIN best USING (host, path) LEFT JOIN listed ON listed.key = a.host || a.path""")
def op4(spark, sf_dir):
    """Rules first; else the addresses of every 50th page are the block list, probed by all pages."""
    pages = table(spark, sf_dir, "pages")
    listed = digest_filter.addresses(pages.where("page_id % 50 = 0")).select(F.concat("host", "path").alias("key"))
    return digest_filter.filter_pages(pages, listed, RULES)


@query("op5_license_scan")
def op5(spark, sf_dir):
    """Licences of all documents as files in folders by source, language and number."""
    docs = table(spark, sf_dir, "documents")
    at = F.pmod(F.col("doc_id"), F.lit(100))
    leaf = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.pmod(F.col("doc_id"), F.lit(8))))
    place = F.when(at == 0, F.coalesce("source", F.lit(""))).when(at == 25, F.concat_ws("/", "source", "lang")).otherwise(leaf)
    name = F.when(at % 25 == 0, F.concat(F.lit("LICENSE."), "doc_id")).otherwise(F.concat(F.lit("file"), F.col("doc_id"), F.lit(".txt")))
    out = license_scan.scan_licenses(docs.select(F.concat_ws("/", place, name).alias("path"), "text"))
    doc_id = F.regexp_extract("path", r"(?:file|LICENSE\.)(-?[0-9]+)(?:\.txt)?$", 1).try_cast("bigint").alias("doc_id")
    return out.select(doc_id, "path", "own_license", F.round("cosine", 6).alias("cosine"), "license", "license_dir")


@query("op6_line_dedup", """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad USING (key) GROUP BY doc_id""")
def op6(spark, sf_dir):
    """Lines found in ten documents or more leave every document."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_feistel_pii")
def op7(spark, sf_dir):
    """Everything private in all documents and what stands in its place."""
    return feistel_pii.findings(table(spark, sf_dir, "documents"), b"a key of the test tables")


@query("op8_pu_toxicity")
def op8(spark, sf_dir):
    """Toxicity of every document, learnt from confirmed toxic ones and unlabelled text."""
    return pu_toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_piece_round_trip")
def op9(spark, sf_dir):
    """Ids of every document and the text they decode to, as digests."""
    return piece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query("op10_trusted_rules")
def op10(spark, sf_dir):
    """Base rules, then the log ratio of the documents labelled good to the whole corpus."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    out = trusted_rules.judge_quality(table(spark, sf_dir, "documents"), trusted)
    return out.select("doc_id", *trusted_rules.FEATURES, "base_failed", "kept")


@query("op11_spelling_variants", f"""
WITH RECURSIVE tab AS {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, c, {sql_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, tab),
x AS (SELECT c, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h),
words AS (SELECT word, sum(c)::BIGINT AS n FROM x WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word),
best AS (SELECT near.word, other, w.n AS n, o.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
  FROM near JOIN words w ON near.word = w.word JOIN words o ON other = o.word),
forms AS (SELECT word, other AS form, form_n FROM best WHERE place = 1 AND form_n >= 5 * n),
way AS (SELECT word, form AS here, 1 AS step FROM forms UNION ALL SELECT way.word, forms.form, step + 1 FROM way JOIN forms ON way.here = forms.word),
ends AS (SELECT word, arg_max(here, step) AS root FROM way GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, words.n AS n, coalesce(n_near, 0) AS n_near, forms.form_n AS form_n
FROM words LEFT JOIN (SELECT word, n_near FROM best WHERE place = 1) USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)""")
def op11(spark, sf_dir):
    """Words of all documents, their near words, and the frequent form that each may be a slip of."""
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


@query("op12_feistel_shards", f"""
WITH RECURSIVE tab AS {CRC_TABLE},
d AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1)::BIGINT AS row FROM documents),
side AS (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM documents),
walk AS ({sql_feistel("d, side", "row")} UNION ALL {sql_feistel("walk, side WHERE place >= n", "place")}),
p AS (SELECT row, place FROM walk, side WHERE place < n)
SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, {sql_crc32("coalesce(text, '')")} AS text_crc32, 'rows' AS law,
  (place % 40)::INTEGER AS shard, place // 40 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN p USING (row), tab""")
def op12(spark, sf_dir):
    """All documents in 40 shards whose counts differ by one at most, by a shuffle of their row numbers."""
    placed = feistel_shards.assign(table(spark, sf_dir, "documents"), shards=40, seed=1)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op13_source_divergence", r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS run FROM d),
l AS (SELECT lang, source, id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS c FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(c) AS total FROM l GROUP BY lang, term HAVING count(*) >= 3),
f AS (SELECT lang, source, term, sum(c) AS c FROM l GROUP BY ALL),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(f.c, 0)::HUGEINT AS c, total::HUGEINT AS total
  FROM g JOIN kept USING (lang) LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.term = kept.term),
ng AS (SELECT lang, source, sum(c) AS n FROM dense GROUP BY ALL),
nl AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
p AS (SELECT lang, source, term, c, 1 + 1000000000 * (c + 1) // (ng.n + v) AS p, 1 + 1000000000 * (total + 1) // (nl.n + v) AS q
  FROM dense JOIN ng USING (lang, source) JOIN nl USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart ON apart.lang = x.lang AND apart.source = x.source AND apart.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200""")
def op13(spark, sf_dir):
    """Distances between the sources of a language, and the terms that set a source apart."""
    return source_divergence.audit_sources(table(spark, sf_dir, "documents"), min_docs=3, top=200)
