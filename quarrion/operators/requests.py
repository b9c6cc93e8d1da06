"""Service addresses and API routes in scripts, by what stands around each mention.

A mention is an address, a quoted path or a quoted string, with its place; the 180 characters before it and the 80 after
it are its window, and windows of neighbours may overlap. An address is a service if a word of a request stands in its
window, or if its path is an API route; a route is told by its first segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a window before and after a mention.
BEFORE, AFTER = 180, 80
# Forms of addresses, quoted paths and quoted strings.
_ADDRESS = re.compile(r"(?i)\b(?:https?|wss?)://[^\s\"'<>\\`]+")
_PATH = re.compile(r"([\"'`])(/[A-Za-z0-9_./${}?=&:%-]{2,260})\1")
_STRING = re.compile(r"([\"'`])([^\"'`\\]{1,300})\1")
# Words of a request.
CONTEXT = (
    r"(?i)(?:uni\.request|request\s*\(|axios|fetch\s*\(|ajax\s*\(|uploadFile|downloadFile|baseURL|baseUrl|base_url|apiUrl|api_url|apiBase|host|domain|networkList|domainList|apiList|srcarr|srcArr|urlList"
    r"|nodeList|lineList|webviewUrl|webUrl|app_url|loadURL|plus\.webview\.create|createWebview|location\.href|location\.replace)"
)
# Hosts that say nothing, whole and by their end.
NOISE = (
    "api.map.baidu.com", "api.next.bspapp.com", "api.bspapp.com", "apis.map.qq.com", "at.alicdn.com", "cdn.jsdelivr.net", "developer.mozilla.org", "developers.weixin.qq.com", "ext.dcloud.net.cn",
    "github.com", "jquery.com", "map.qq.com", "maps.googleapis.com", "mui.ucmed.cn", "service.dcloud.net.cn", "stackoverflow.com", "unpkg.com", "vuejs.org", "webapi.amap.com", "www.google.com",
    "www.googleapis.com", "www.w3.org",
)
NOISE_ENDS = (".vuejs.org", ".w3.org")
# First segments of API routes; beginnings and endings of paths that are none, and paths that are none whole.
SEGMENTS = (
    "api", "apis", "ajax", "app", "auth", "bank", "card", "common", "config", "customer", "file", "finance", "group", "home", "image", "index", "login", "market", "message", "my", "news", "notice",
    "order", "pay", "product", "public", "publics", "qrLogin", "recharge", "register", "stock", "stock-record", "stock-sales", "team", "trade", "upload", "user", "users", "video", "wallet", "withdraw",
    "withdrawal",
)
SKIPPED_STARTS = ("/assets/", "/css/", "/fonts/", "/hybrid/", "/img/", "/images/", "/js/", "/pages/", "/static/", "/uni_modules/", "/wxcomponents/")
SKIPPED_ENDS = (
    ".apk", ".css", ".gif", ".htm", ".html", ".ico", ".jpeg", ".jpg", ".js", ".json", ".map", ".mp3", ".mp4", ".png", ".svg", ".ttf", ".txt", ".wasm", ".webp", ".woff", ".woff2",
)
SKIPPED = ("/api/js", "/image/gif", "/image/jpeg", "/image/jpg", "/image/png", "/image/svg+xml", "/image/webp")

ADDRESS, PATH, STRING = "address", "path", "string"
_MENTION = pa.struct([("kind", pa.string()), ("value", pa.string()), ("at", pa.int32()), ("before", pa.string()), ("after", pa.string())])


def read_mentions(text: str) -> list[dict]:
    """All mentions of a text: addresses, then quoted paths, then quoted strings, each in order."""
    out = []
    for kind, form, group in ((ADDRESS, _ADDRESS, 0), (PATH, _PATH, 2), (STRING, _STRING, 2)):
        for m in form.finditer(text):
            out.append({"kind": kind, "value": m[group], "at": m.start(), "before": text[max(0, m.start() - BEFORE) : m.start()], "after": text[m.end() : m.end() + AFTER]})
    return out


def mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value, at, before, after): a row a mention, windows apart. A null text has none. No shuffle."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_mentions(t or "") for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            rows = pa.array([m for f in found for m in f], _MENTION)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *rows.flatten()], names=[key, *(f.name for f in _MENTION)])

    return texts.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, kind string, value string, at int, before string, after string")


def api_route(c: Column | str, segments: Sequence[str] = SEGMENTS) -> Column:
    """A path as an API route, without query, fragment and doubled slashes; null for other paths."""
    x = F.replace(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("\\/"), F.lit("/"))
    x = F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(F.lit("/"), x))
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?s)[?#].*$", ""), r"[.,);\]}]+$", ""), "/+", "/")
    first = F.regexp_extract(x, "^/([^/]*)", 1)
    plain = F.lower(F.substring_index(x, "${", 1))
    skipped = x.isin(*SKIPPED) | F.lower(x).rlike("^(?:" + "|".join(map(re.escape, SKIPPED_STARTS)) + ")") | plain.rlike("(?:" + "|".join(map(re.escape, SKIPPED_ENDS)) + ")$")
    return F.when((F.length(x) >= 3) & ~skipped & (first.isin(*segments) | F.startswith(F.lower(first), F.lit("api"))), x)


def _clean(c: Column) -> Column:
    """An address without escapes and without the punctuation that ends the text around it."""
    return F.replace(F.regexp_replace(F.replace(c, F.lit("\\/"), F.lit("/")), r"[.,);\]}>'\"]+$", ""), F.lit("&amp;"), F.lit("&"))


def mined(found: DataFrame, key: str, segments: Sequence[str] = SEGMENTS, always: bool = False) -> DataFrame:
    """Mentions with in_context, route, service and domain.

    ``route`` is the API route of a mention or of its address's path; ``service`` the address that is kept, with its path
    where that is a route (or ``always``, which takes every address for a service), and ``domain`` its host with port.
    Noise hosts, hosts without a dot and those with other characters are no services.
    """
    v = F.trim("value")
    is_url = (F.col("kind") == ADDRESS) | ((F.col("kind") == STRING) & v.rlike("^(?:https?|wss?)://"))
    url = _clean(v)
    bare = F.regexp_replace(url, r"(?s)[?#].*$", "")
    scheme, net, path = (F.regexp_extract(bare, r"(?i)^((?:https?|wss?))://([^/]*)(.*)$", i) for i in (1, 2, 3))
    of_path = api_route(path, segments)
    url_route = F.when(path != "", of_path)
    relative = (F.col("kind") == PATH) | F.startswith(v, F.lit("/")) | v.rlike(r"^[A-Za-z0-9_-]+/[A-Za-z0-9_./${}?=&:-]+$")
    route = F.when(is_url, url_route).when(relative, api_route(v, segments))
    context = F.col("before").rlike(CONTEXT) | F.col("after").rlike(CONTEXT)
    low = F.lower(net)
    name = F.regexp_replace(low, ":[0-9]*$", "")
    noise = name.isin(*NOISE) | low.isin(*NOISE)
    for end in NOISE_ENDS:
        noise = noise | F.endswith(name, F.lit(end))
    good = is_url & (net != "") & ~low.rlike(r"[${},\\@]") & name.rlike("^[a-z0-9.-]+$") & (F.contains(name, F.lit(".")) | (name == "localhost")) & ~noise
    kept = good & (context | url_route.isNotNull() | F.lit(always))
    with_path = (url_route.isNotNull() | F.lit(always)) & (path != "") & (path != "/")
    service = F.when(kept, F.concat(F.lower(scheme), F.lit("://"), net, F.when(with_path, path).otherwise("")))
    return found.withColumns({"in_context": context, "route": route, "service": service, "domain": F.when(kept, low)})


def services(texts: DataFrame, key: str, text: str, segments: Sequence[str] = SEGMENTS, always: bool = False) -> DataFrame:
    """(key, urls, domains, routes) of texts that have any, each sorted and distinct."""
    rows = mined(mentions(texts, key, text), key, segments, always)
    sets = rows.groupBy(key).agg(*(F.array_sort(F.collect_set(c)).alias(n) for c, n in (("service", "urls"), ("domain", "domains"), ("route", "routes"))))
    return sets.where(F.size("urls") + F.size("domains") + F.size("routes") > 0)
