"""Expressions on URLs, hosts and addresses."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions.text import col, is_blank

#: IPv4 networks that are no public ones (fixed values).
LOCAL_NETWORKS = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def ipv4_number(c: Column | str) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(col(c), r"\.")
    total = sum((F.get(parts, i).try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0))
    return F.when(col(c).rlike(IPV4), total)


def is_local_ipv4(c: Column | str) -> Column:
    n = ipv4_number(c)
    hit = F.lit(False)
    for block in map(ipaddress.ip_network, LOCAL_NETWORKS):
        hit = hit | n.between(int(block.network_address), int(block.broadcast_address))
    return F.coalesce(hit, F.lit(False))


def _local_ipv6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def local(text: str | None) -> bool:
        try:
            a = ipaddress.IPv6Address(text)
        except ValueError:
            return False
        return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified

    for s in batches:
        code, seen = pd.factorize(s, use_na_sentinel=False)  # each address is parsed once a batch
        yield pd.Series(np.array([local(x) for x in seen], dtype=bool)[code], index=s.index)


def is_local(c: Column | str, ipv6: bool = False) -> Column:
    """True for addresses inside a private network; ``ipv6`` also looks at IPv6 ones (in Arrow batches)."""
    own = is_local_ipv4(c)
    if not ipv6:
        return own
    check = F.pandas_udf(_local_ipv6, T.BooleanType())
    return own | (F.coalesce(F.contains(col(c), F.lit(":")), F.lit(False)) & check(col(c)))


def is_uplink(flag: Column | str, src: Column | str, dst: Column | str) -> Column:
    """The stored direction, or else: both ends known and the source local."""
    return F.coalesce(col(flag), ~is_blank(src) & ~is_blank(dst) & is_local(src))


def remote_peer(src: Column | str, dst: Column | str) -> Column:
    """The end that is not local, the destination first; null if both are local or blank."""
    return F.when(~is_blank(dst) & ~is_local(dst), col(dst)).when(~is_blank(src) & ~is_local(src), col(src))


def url_part(c: Column | str, part: str) -> Column:
    return F.try_parse_url(col(c), F.lit(part))


def host(c: Column | str) -> Column:
    """The lower-case host without user and port; null if there is none."""
    x = F.lower(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(x, "^.*@", ""), ":[0-9]*$", ""), F.lit(""))


def port(c: Column | str) -> Column:
    """The port of a URL, or the usual one of http and https."""
    given = F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1).try_cast("int")
    return F.coalesce(given, F.when(F.lower(col(c)).like("https://%"), 443).when(F.lower(col(c)).like("http://%"), 80))


def is_https(url: Column | str, protocol: Column | str) -> Column:
    """A URL must be https with a host; without a URL the protocol decides."""
    return F.when(is_blank(url), F.upper(F.trim(col(protocol))) == "HTTPS").otherwise(F.lower(F.trim(col(url))).like("https://%") & host(F.trim(col(url))).isNotNull())


def https_target(url: Column | str) -> Column:
    """The host of a URL; an address comes with its port, an IPv6 one in brackets."""
    h = host(url)
    return F.when(h.rlike(IPV4), F.concat(h, F.lit(":"), port(url).cast("string"))).when(F.startswith(h, F.lit("[")), F.concat(h, F.lit(":"), port(url).cast("string"))).otherwise(h)


def built_url(scheme: Column | str, domain: Column | str, path: Column | str) -> Column:
    """scheme://domain/path; null without a domain."""
    p = F.coalesce(col(path), F.lit(""))
    return F.when(~is_blank(domain), F.concat(col(scheme), F.lit("://"), col(domain), F.when((p == "") | F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))))


def path_and_query(c: Column | str) -> Column:
    rest = F.regexp_replace(F.regexp_replace(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def parent_domains(h: Column | str, with_last: bool = False) -> Column:
    """A host and its parents, the longest first; ``with_last`` includes the bare last label."""
    labels = F.split(col(h), r"\.")
    n = F.size(labels) if with_last else F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_static_response(content_type: Column | str, url: Column | str) -> Column:
    """Images, fonts, styles and scripts by content type, or by the ending of the URL where the type says nothing."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(col(content_type), F.lit("")), ";", 1)))
    ending = F.regexp_extract(F.lower(F.regexp_replace(col(url), "[?#].*$", "")), r"\.([a-z0-9]+)$", 1)
    by_type = F.startswith(kind, F.lit("image/")) | F.startswith(kind, F.lit("font/")) | F.startswith(kind, F.lit("audio/")) | F.startswith(kind, F.lit("video/")) | kind.isin("text/css", "text/javascript", "application/javascript", "application/font-woff")
    by_name = ending.isin("png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "css", "js", "woff", "woff2", "ttf", "mp4", "mp3")
    return F.when(kind.isin("", "application/octet-stream"), F.coalesce(by_name, F.lit(False))).otherwise(by_type)


def header_map(c: Column | str) -> Column:
    """Header lines as a map: names in lower case, values of a repeated name joined by a comma and a blank; other lines give nothing."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    split = lambda x: F.struct(F.lower(bare(F.substring_index(x, ":", 1))).alias("n"), bare(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v"))
    lines = F.filter(F.split(col(c), r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.filter(F.transform(lines, split), lambda p: p["n"] != "")
    names = F.array_distinct(F.transform(pairs, lambda p: p["n"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["n"] == n), lambda p: p["v"]), ", ")))


def header_number(headers: Column, name: str) -> Column:
    """A header as a whole number, the first of a repeated one; null for anything else."""
    return F.trim(F.substring_index(F.try_element_at(headers, F.lit(name)), ",", 1)).try_cast("long")


def in_ranges(rows: DataFrame, number: str, ranges: DataFrame, cell_bits: int = 16) -> DataFrame:
    """rows with the columns of the range (low, high, ...) that holds their number, nulls where there is none.

    Ranges do not overlap. Each is listed under all cells of 2**cell_bits numbers that it touches, so the two tables
    meet in an equi-join on the cell; the whole of IPv4 has 65536 cells.
    """
    cell = lambda c: F.shiftright(F.col(c).cast("long"), cell_bits)
    listed = ranges.select("*", F.explode(F.sequence(cell("low"), cell("high"))).alias("_cell"))
    keyed = rows.withColumn("_at", cell(number))
    on = (keyed["_at"] == listed["_cell"]) & (keyed[number] >= listed["low"]) & (keyed[number] <= listed["high"])
    return keyed.join(listed, on, "left").drop("_at", "_cell")
