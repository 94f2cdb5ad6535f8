"""Operator 1: WARC derivatives of responses, as linked metadata and conversion records.

Each response gives a ``metadata`` record (application/warc-fields: title, language, charset,
links) and a ``conversion`` record (text/plain of its HTML). Both refer to the response by id,
URI and date, carry its payload digest and its own headers, and have ids and block digests of
their own. All is a projection: no shuffle, only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Patterns that are the same to Java and RE2, and what replaces what they match, in this order.
HTML_STEPS = (
    (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)[^>]*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|article|section|nav|header|footer|main|aside|pre|blockquote|title|head|body|html)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)
#: Entities, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
SPACE_STEPS = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+", ""), (r"[ \n]+$", ""))
CAPTURE_DATE = "2024-01-01T00:00:00Z"


def plain_text(html: Column) -> Column:
    """Text of HTML: without scripts, styles, comments and tags; a line for each block; null: empty."""
    out = F.coalesce(html, F.lit(""))
    for pattern, by in HTML_STEPS:
        out = F.regexp_replace(out, pattern, by)
    for entity, by in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(by))
    for pattern, by in SPACE_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def record_id(*parts: Column) -> Column:
    """A urn:uuid that depends on nothing but the parts (null: empty)."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, *, date: str = CAPTURE_DATE) -> DataFrame:
    """pages (page_id, url, html) as response records: record_id, target_uri, date, http_headers, payload, payload_digest."""
    html = F.coalesce(pages["html"], F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"))
    return pages.select(record_id(pages["page_id"], pages["url"]).alias("record_id"), pages["url"].alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), html.alias("payload"), _digest(html).alias("payload_digest"))


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response: record_id, warc_type, refers_to, target_uri, date, content_type, content, content_length, block_digest, payload_digest (of the response), source_headers, header (the WARC header block).

    Missing payloads are empty ones: their conversion is empty. A missing URI leaves its
    headers out. Repeated responses give repeated records. Other columns are left out.
    """
    r = records.select("record_id", "target_uri", "date", "http_headers", F.coalesce("payload", F.lit("")).alias("payload"), "payload_digest")
    title = F.regexp_replace(plain_text(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\n", " ")
    language = F.lower(F.regexp_extract("payload", r"(?i)<html[^>]*\blang=\"?([A-Za-z-]+)", 1))
    charset = F.lower(F.regexp_extract("payload", r"(?i)<meta[^>]*\bcharset=\"?([A-Za-z0-9_-]+)", 1))
    links = F.regexp_count("payload", F.lit(r"(?i)<a\s[^>]*href=")).cast("string")
    fields = F.concat(F.lit("title: "), title, F.lit("\r\nlanguage: "), language, F.lit("\r\ncharset: "), charset, F.lit("\r\noutlinks: "), links, F.lit("\r\n"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("content")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("content")),
    )
    out = r.select(F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.col("http_headers").alias("source_headers"), F.inline(kinds))
    out = out.withColumns({"record_id": record_id(F.col("warc_type"), F.col("refers_to")), "content_length": F.octet_length("content").cast("long"), "block_digest": _digest(F.col("content"))})
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        *[line(n, F.col(c)) for n, c in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))],
    )
    return out.select("record_id", "warc_type", "refers_to", "target_uri", "date", "content_type", "content", "content_length", "block_digest", "payload_digest", "source_headers", header.alias("header"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def _sql_text(x: str) -> str:
    for pattern, by in HTML_STEPS:
        x = f"regexp_replace({x}, {_sql(pattern)}, {_sql(by)}, 'g')"
    for entity, by in ENTITIES:
        x = f"replace({x}, {_sql(entity)}, {_sql(by)})"
    for pattern, by in SPACE_STEPS:
        x = f"regexp_replace({x}, {_sql(pattern)}, {_sql(by)}, 'g')"
    return x


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_UUID = "'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"
OP1_SQL = f"""
WITH r AS (SELECT {_UUID.format(h="sha256(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, ''))")} AS refers_to, url AS target_uri, coalesce(html, '') AS payload FROM pages),
kinds AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || replace({_sql_text("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title>', 1)")}, chr(10), ' ')
    || chr(13) || chr(10) || 'language: ' || lower(regexp_extract(payload, '(?i)<html[^>]*\\blang="?([A-Za-z-]+)', 1))
    || chr(13) || chr(10) || 'charset: ' || lower(regexp_extract(payload, '(?i)<meta[^>]*\\bcharset="?([A-Za-z0-9_-]+)', 1))
    || chr(13) || chr(10) || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\\s[^>]*href=')) || chr(13) || chr(10) AS content FROM r
  UNION ALL
  SELECT *, 'conversion', 'text/plain', {_sql_text("payload")} FROM r),
d AS (SELECT {_UUID.format(h="sha256(warc_type || '|' || refers_to)")} AS record_id, warc_type, refers_to, target_uri, '{CAPTURE_DATE}' AS date, content_type, content,
  CAST(strlen(content) AS BIGINT) AS content_length, 'sha256:' || sha256(content) AS block_digest, 'sha256:' || sha256(payload) AS payload_digest,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) AS source_headers FROM kinds),
n AS (SELECT *, chr(13) || chr(10) AS e FROM d)
SELECT record_id, warc_type, refers_to, target_uri, date, content_type, content, content_length, block_digest, payload_digest, source_headers,
  'WARC/1.1' || e || 'WARC-Type: ' || warc_type || e || 'WARC-Record-ID: ' || record_id || e || 'WARC-Refers-To: ' || refers_to || e
  || coalesce('WARC-Refers-To-Target-URI: ' || target_uri || e, '') || 'WARC-Refers-To-Date: ' || date || e || coalesce('WARC-Target-URI: ' || target_uri || e, '')
  || 'WARC-Date: ' || date || e || 'WARC-Payload-Digest: ' || payload_digest || e || 'WARC-Block-Digest: ' || block_digest || e
  || 'Content-Type: ' || content_type || e || 'Content-Length: ' || content_length || e AS header
FROM n
"""
