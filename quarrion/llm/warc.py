"""WARC derivatives: metadata and plain-text conversion records from responses.

Every response gives two records that refer to it: a ``metadata`` record (warc-fields: source
headers, digests, title and outlink count) and a ``conversion`` record with the text. Identifiers are
UUIDs made from the source's identifier, so a second run writes the same records. Digests are
SHA-256 in hex. Nothing is shuffled, and all but rare character references is DataFrame expressions.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Software field of the metadata records.
SOFTWARE = "quarrion warc derivatives"

#: Elements whose content is no text of the page.
UNREAD = ("script", "style", "title", "noscript", "noframes", "noembed", "iframe", "template", "textarea")
#: Regular expressions (Java and RE2 alike) and replacements that turn HTML into text lines: markup, then character references, then blanks, in this order.
MARKUP = (
    (r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{name}\b[^>]*>.*?(?:</{name}\s*>|\z)" for name in UNREAD) + ")", ""),
    (r"[\s]{2,}|[\t\n\r\f]", " "),
    (r"(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|td|th|br|hr|article|section|main|nav|header|footer|aside|blockquote|pre|form|dl|dt|dd|body|html|head)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)
#: The usual references; a text with any other one has all of its references decoded together.
REFERENCES = ((r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"&copy;", "©"), (r"&middot;", "·"), (r"&amp;", "&"))
BLANKS = ((r"\n[ \n]*", "\n"), (r"  +", " "))
#: At last no line ends with a blank, and the text begins and ends with neither a blank nor a line end.
LINE_END, ENDS = (" \n", "\n"), (r"^[ \n]+|[ \n]+$", "")
TEXT_STEPS = (*MARKUP, *REFERENCES, *BLANKS, LINE_END, ENDS)


OTHER_REFERENCES = "&(?!(?:" + "|".join(name[1:-1] for name, _ in REFERENCES) + ");)[#A-Za-z]"


def _decoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All named and numeric references as characters, no-break blanks as blanks; null stays null."""
    for s in texts:
        yield s.map(lambda t: html.unescape(t).replace("\xa0", " "), na_action="ignore")


def plain_text(page):
    """Text lines of an HTML column, all character references decoded; a null column gives the empty text.

    Comments and the elements of UNREAD give no text; one without an end goes on to the end of the page.
    """
    text = F.coalesce(page, F.lit(""))
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    rare = F.pandas_udf(_decoded, "string")(F.when(text.rlike(OTHER_REFERENCES), text))
    for name, by in REFERENCES:  # plain strings, so no regular expression is run
        text = F.replace(text, F.lit(name), F.lit(by))
    text = F.coalesce(rare, text)
    for pattern, by in BLANKS:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(F.replace(text, *map(F.lit, LINE_END)), F.lit(" \n"))


def sha256_label(text):
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def uuid_of(text):
    """A URN whose UUID is made of the first 32 hex digits of the text's SHA-256."""
    h = F.sha2(text, 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records (record_id, target_uri, warc_date, http_headers, payload) of rows (page_id, url, html).

    The pages carry no capture time or headers: the date is a fixed day, the headers state type and length. Identifiers
    are made of page_id, url and the payload's digest, so other contents under one page and url are other records.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload))
    key = F.concat(F.lit("response|"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("url", F.lit("")), F.lit("|"), F.sha2(payload, 256))
    return pages.select(uuid_of(key).alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), headers.alias("http_headers"), payload.alias("payload"))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records (metadata, conversion) for every response, each with its header fields and block.

    Columns: record_id, warc_type, refers_to, target_uri, warc_date, content_type, content_length,
    block_digest, source_digest, source_headers, block. A null payload is an empty one, a null
    target or date stays null, null headers are empty; repeated responses give repeated records.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    headers = F.coalesce(F.col("http_headers"), F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_extract(payload, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))
    links = F.regexp_count(payload, F.lit(r"(?i)<a\b[^>]*\bhref="))
    source = responses.select("record_id", "target_uri", "warc_date", headers.alias("source_headers"), sha256_label(payload).alias("source_digest"), plain_text(payload).alias("text"), title.alias("title"), links.alias("links"))
    fields = F.concat(
        F.lit("software: "), F.lit(SOFTWARE), F.lit(f"{CRLF}source-digest: "), F.col("source_digest"), F.lit(f"{CRLF}text-digest: "), sha256_label(F.col("text")),
        F.lit(f"{CRLF}title: "), F.col("title"), F.lit(f"{CRLF}outlinks: "), F.col("links").cast("string"), F.lit(f"{CRLF}source-headers: "), F.regexp_replace("source_headers", r"\r\n", f"{CRLF} "), F.lit(CRLF),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("text").alias("block")),
    )
    both = source.select("record_id", "target_uri", "warc_date", "source_headers", "source_digest", F.explode(kinds).alias("x"))
    return both.select(
        uuid_of(F.concat(F.col("x.kind"), F.lit("|"), F.coalesce("record_id", F.lit("")))).alias("record_id"),
        F.col("x.kind").alias("warc_type"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("x.type").alias("content_type"),
        F.octet_length("x.block").cast("long").alias("content_length"), sha256_label(F.col("x.block")).alias("block_digest"), "source_digest", "source_headers", F.col("x.block").alias("block"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """(record): WARC/1.1 records as text, header and block, without the two line ends that follow a record."""
    names = (
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Refers-To-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    lines = [F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in names]  # null columns give no line
    return records.select(F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF + CRLF), F.coalesce("block", F.lit(""))).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, one a task."""
    serialised(records).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
