"""Readers: tables by JDBC or Parquet, dissector output, packet lines, source trees, binaries, dimensions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions.text import blank_to_null
from quarrion.operators.extract import Fingerprint, worth_reading

#: Columns of the tab-separated dissector output, in order (fixed values).
PACKET_FIELDS = (
    "frame.number", "frame.time_epoch", "ip.src", "ipv6.src", "ip.dst", "ipv6.dst", "tcp.srcport", "udp.srcport", "tcp.dstport", "udp.dstport",
    "frame.protocols", "http.host", "tls.handshake.extensions_server_name", "dns.a", "dns.aaaa",
)


def table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; columns and filters are pushed into the scan."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def jdbc(spark: SparkSession, url: str, name: str, *, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database, read in parallel ranges of a numeric key if one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of a dissector: tab-separated, one column a field, several values of a field joined by commas."""
    schema = ", ".join(f"`{f}` string" for f in PACKET_FIELDS)
    return spark.read.option("sep", "\t").option("quote", "").schema(schema).csv(path)


def normal_packets(raw: DataFrame) -> DataFrame:
    """One row a packet with addresses: first values of fields, TCP ports before UDP, Host before server name before DNS."""
    first = lambda f: blank_to_null(F.substring_index(F.col(f"`{f}`"), ",", 1))
    any_of = lambda *fs: F.coalesce(*(first(f) for f in fs))
    rows = raw.select(
        first("frame.number").try_cast("long").alias("frame"), first("frame.time_epoch").try_cast("double").alias("epoch"),
        any_of("ip.src", "ipv6.src").alias("src_ip"), any_of("ip.dst", "ipv6.dst").alias("dst_ip"),
        any_of("tcp.srcport", "udp.srcport").try_cast("int").alias("src_port"), any_of("tcp.dstport", "udp.dstport").try_cast("int").alias("dst_port"),
        F.upper(F.element_at(F.split(F.col("`frame.protocols`"), ":"), -1)).alias("protocol"),
        any_of("http.host", "tls.handshake.extensions_server_name").alias("domain"), any_of("dns.a", "dns.aaaa").alias("resolved_ip"),
    )
    return rows.where("src_ip is not null and dst_ip is not null")


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Newline-delimited JSON; lines that cannot be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file that is one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of the files below a path; media and oversized files are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.where(worth_reading("path", "length")).select("path", "length", "content")


def sources(spark: SparkSession, path: str, pattern: str = "*.java", most: int = 1 << 20) -> DataFrame:
    """(path, text) of source files below a path, decoded as UTF-8, of at most so many bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.where(F.col("length") <= most).select("path", F.decode("content", "UTF-8").alias("text"))


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(value) of gzipped or plain files with one token a line."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("value"))


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain) of a CSV file with a header line, lowered and distinct."""
    return spark.read.option("header", True).csv(path).toDF("domain").select(F.lower(F.trim("domain")).alias("domain")).where("domain <> ''").distinct()


def tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.option("sep", "\t").schema(", ".join(f"{c} string" for c in columns)).csv(path)


def fingerprints(spark: SparkSession, path: str) -> list[Fingerprint]:
    """The product fingerprints of a YAML or JSON file, a list of objects (product, prefixes, recognised_by, credentials).

    YAML is told by the ending and needs its parser.

    A file that breaks a rule is an error that names the entry: products are given once, in small letters, digits,
    ``_``, ``.`` or ``-``; an entry has prefixes or a pattern; patterns can be compiled, those of credentials have named groups.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # a dimension of some kilobytes
    if re.search(r"\.ya?ml$", path):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("no parser for YAML is installed; give the list as JSON") from missing
        entries = yaml.safe_load(text)
    else:
        entries = json.loads(text)
    if not isinstance(entries, list) or not entries:
        raise ValueError("a list of fingerprints is wanted")
    out: dict[str, Fingerprint] = {}
    for number, entry in enumerate(entries, start=1):
        fail = lambda why: ValueError(f"fingerprint {number}: {why}")  # noqa: B023, E731
        product = entry.get("product") if isinstance(entry, dict) else None
        if not isinstance(product, str) or not re.fullmatch(r"[a-z0-9][a-z0-9_.-]*", product):
            raise fail("no valid product")
        if product in out:
            raise fail(f"{product} is given twice")
        found = Fingerprint(product, tuple(entry.get("prefixes") or ()), entry.get("recognised_by"), tuple(entry.get("credentials") or ()))
        if not found.prefixes and not found.recognised_by:
            raise fail("neither prefixes nor a pattern")
        try:
            for pattern in (found.recognised_by or "", *found.credentials):
                re.compile(pattern)
            found.groups()
        except (re.error, ValueError) as why:
            raise fail(str(why)) from why
        out[product] = found
    return list(out.values())
