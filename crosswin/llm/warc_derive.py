"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both records name the response in WARC-Refers-To and keep its target, date and payload digest; the
metadata record also keeps every HTTP header of the response, its title and its outlinks. All of it
is a projection over the responses, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CRLF = "\r\n"
# fixed values: tags that end a line of text, and character entities
LINE_TAGS = "p|div|br|h[1-6]|li|ul|ol|nav|footer|article|section|header|table|tr|td|th|blockquote|pre|main|aside|hr|dl|dt|dd|form|figure|figcaption"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&amp;": "&"}
HIDDEN = ["(?is)<!--.*?-->", "(?is)<script[^>]*>.*?</script[^>]*>", "(?is)<style[^>]*>.*?</style[^>]*>", "(?is)<head[^a-z].*?</head[^>]*>"]
SPACES = r"[\x20\x09\x0B-\x0D]"


def unescaped(text: Column) -> Column:
    """Entities as characters, each once: what follows an & is looked up as far as the next semicolon."""
    names = F.create_map(*[F.lit(x) for entity, char in ENTITIES.items() for x in (entity[1:-1], char)])
    after = F.split(text, "&")

    def piece(p: Column) -> Column:
        name = F.substring_index(p, ";", 1)
        char = F.when(F.contains(p, F.lit(";")), F.try_element_at(names, name))
        return F.coalesce(F.concat(char, p.substr(F.length(name) + 2, F.length(p))), F.concat(F.lit("&"), p))

    rest = F.transform(F.slice(after, F.lit(2), F.size(after)), piece)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(after, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


def with_plain_text(rows: DataFrame, html: str, out: str) -> DataFrame:
    """Visible text: hidden parts and tags go, block tags end lines, entities become characters."""
    text = F.when(F.contains(html, F.lit("<!--")), F.regexp_replace(html, HIDDEN[0], "")).otherwise(F.col(html))
    for pattern in HIDDEN[1:]:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, f"(?i)</?(?:{LINE_TAGS})(?:[^a-z0-9>][^>]*)?>", "\n")
    rows = rows.withColumn(out, F.regexp_replace(text, "<[a-zA-Z/!?][^>]*>", "")).withColumn(out, unescaped(F.col(out)))
    # a single space stays as it is
    text = F.regexp_replace(out, rf"[\x09\x0B-\x0D]{SPACES}*|\x20{SPACES}+", " ")
    return rows.withColumn(out, F.btrim(F.regexp_replace(text, " ?\n[ \n]*", "\n"), F.lit(" \n")))


def sha(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def record_id(digest: str) -> Column:
    """A name-based identifier from a hexadecimal digest column."""
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def header_lines(*pairs: tuple[str, Column]) -> Column:
    """'name: value' lines of the fields that are not null."""
    return F.concat_ws(CRLF, *[F.concat(F.lit(f"{name}: "), value) for name, value in pairs])


def derive(responses: DataFrame) -> DataFrame:
    """Two records per response: record_type, record_id, refers_to, target_uri, warc_date,
    source_payload_digest, content_type, content_length, block_digest, headers, block.

    ``responses`` has record_id, target_uri, warc_date and block: an HTTP message, whose headers
    end at the first empty line (a block without one is a payload without headers). Missing
    targets and dates leave out their fields, a null block is an empty one. Repeated responses
    give repeated records, an empty table none. Other columns come along unless an output
    column, or one the operator works with (their names begin with _), has their name.
    """
    outputs = {"record_type", "record_id", "refers_to", "target_uri", "warc_date", "source_payload_digest", "content_type", "content_length", "block_digest", "headers", "block"}
    extra = [c for c in responses.columns if c not in outputs and c not in ("_block", "_http", "_payload", "_title", "_fields", "_text", "_metadata", "_conversion")]
    rows = responses.select(
        *extra, F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.coalesce("block", F.lit("")).alias("_block"))
    cut = F.instr("_block", CRLF * 2)
    rows = rows.select(
        *extra, "refers_to", "target_uri", "warc_date",
        F.when(cut > 0, F.expr("substring(_block, 1, instr(_block, '\\r\\n\\r\\n') - 1)")).otherwise("").alias("_http"),
        F.when(cut > 0, F.expr("substring(_block, instr(_block, '\\r\\n\\r\\n') + 4)")).otherwise(F.col("_block")).alias("_payload"))
    lines = F.split("_http", CRLF)
    kept = F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x != ""), lambda x: F.concat(F.lit("http-header: "), x))
    links = F.regexp_extract_all("_payload", F.lit('(?i)<a[^a-z>][^>]*?href="([^"]*)"'), 1)
    outlinks = F.transform(links, lambda x: F.concat(F.lit("outlink: "), unescaped(x)))
    status = F.when(F.get(lines, F.lit(0)).startswith("HTTP/"), F.get(lines, F.lit(0)))
    # columns of their own, so that none is computed twice: the same response always gets the same derivatives
    own = {f"_{kind}": F.sha2(F.concat("refers_to", F.lit(f"|{kind}")), 256) for kind in ("metadata", "conversion")}
    rows = rows.withColumn("_title", F.regexp_extract("_payload", "(?is)<title[^>]*>(.*?)</title", 1)).withColumn("_title", unescaped(F.col("_title")))
    title = F.when(F.col("_title") != "", F.concat(F.lit("title: "), F.regexp_replace("_title", "[\r\n]+", " ")))
    fields = F.concat_ws(CRLF, F.concat(F.lit("http-status-line: "), status), title, kept, outlinks)
    rows = with_plain_text(rows.withColumns({"_fields": fields, **own}), "_payload", "_text")
    fields = F.when(F.col("_fields") != "", F.concat("_fields", F.lit(CRLF))).otherwise("")
    both = rows.select(
        *extra, "refers_to", "target_uri", "warc_date", sha(F.col("_payload")).alias("source_payload_digest"),
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("record_type"), record_id("_metadata").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
            F.struct(F.lit("conversion").alias("record_type"), record_id("_conversion").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block")),
        )).alias("r"))
    both = both.select(*extra, "refers_to", "target_uri", "warc_date", "source_payload_digest", "r.*")
    both = both.withColumn("content_length", F.octet_length("block").cast("bigint")).withColumn("block_digest", sha(F.col("block")))
    head = header_lines(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("warc_date")), ("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")))
    return both.withColumn("headers", F.concat(F.lit("WARC/1.1" + CRLF), head))


def record_text() -> Column:
    """A derived record as it stands in a WARC file."""
    return F.concat("headers", F.lit(CRLF * 2), "block", F.lit(CRLF * 2))


def write_warc(records: DataFrame, path: str) -> None:
    """gzip-compressed WARC text, a part file per task, through Spark's own writer."""
    without_end = F.concat("headers", F.lit(CRLF * 2), "block", F.lit(CRLF + "\r")).alias("value")  # the writer ends it
    records.select(without_end).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records of fetched pages: an identifier by page, one second of fetch time each."""
    uid = F.sha2(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 256)
    html = F.coalesce("html", F.lit(""))
    http = F.concat_ws(CRLF, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length(html)), F.lit(""), html)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("target_uri"), uid.alias("_uid"), http.alias("block"))
    return rows.select(
        "page_id", record_id("_uid").alias("record_id"), "target_uri",
        F.expr("concat(replace(cast(timestampadd(SECOND, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS string), ' ', 'T'), 'Z')").alias("warc_date"),
        "block")
