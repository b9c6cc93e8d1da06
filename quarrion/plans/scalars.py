"""Scalar functions, addresses and URLs on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions import net as N
from quarrion.functions import text as X
from quarrion.operators.extract import without_allowed
from quarrion.operators.families import is_code_component
from quarrion.plans.registry import Tables, query

_SRC = "(10 + event_id % 3 * 90) || '.' || (event_id % 256) || '.0.' || (user_id % 250)"
_DST = "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN '192.168.1.' || (event_id % 200) ELSE '8.8.' || (event_id % 256) || '.4' END"


def _packets(t: Tables) -> DataFrame:
    """Events as packets with addresses made from their numbers."""
    e = F.col("event_id")
    src = F.concat_ws(".", (10 + e % 3 * 90).cast("string"), (e % 256).cast("string"), F.lit("0"), (F.col("user_id") % 250).cast("string"))
    dst = F.when(e % 7 == 0, "").when(e % 5 == 0, F.concat(F.lit("192.168.1."), (e % 200).cast("string"))).otherwise(F.concat(F.lit("8.8."), (e % 256).cast("string"), F.lit(".4")))
    return t.events.select("event_id", "event_type", src.alias("src"), dst.alias("dst"), F.when(F.col("event_type") == "view", True).alias("flag"))


_LOCAL = "(regexp_matches({0}, '^10\\.') OR regexp_matches({0}, '^192\\.168\\.'))"


@query(f"SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN true END, trim({_DST}) <> '' AND {_LOCAL.format('(' + _SRC + ')')}) AS uplink FROM events")
def p10_uplink(t: Tables) -> DataFrame:
    return _packets(t).select("event_id", N.is_uplink("flag", "src", "dst").alias("uplink"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN page_id % 8 = 0 ELSE url LIKE 'https://%' END AS https FROM pages")
def p11_https(t: Tables) -> DataFrame:
    url = F.when(F.col("page_id") % 4 != 0, F.col("url"))
    return t.pages.select("page_id", N.is_https(url, F.when(F.col("page_id") % 8 == 0, "https").otherwise("http")).alias("https"))


@query(f"WITH p AS (SELECT event_id, {_SRC} AS src, {_DST} AS dst FROM events) SELECT event_id, CASE WHEN dst <> '' AND NOT {_LOCAL.format('dst')} THEN dst WHEN NOT {_LOCAL.format('src')} THEN src END AS peer FROM p")
def p12_remote_peer(t: Tables) -> DataFrame:
    return _packets(t).select("event_id", N.remote_peer("src", "dst").alias("peer"))


@query(f"WITH p AS (SELECT {_DST} AS dst FROM events) SELECT {_LOCAL.format('dst')} AS local, count(*) AS n FROM p GROUP BY 1")
def p13_local_address(t: Tables) -> DataFrame:
    return _packets(t).groupBy(N.is_local("dst").alias("local")).agg(F.count("*").alias("n"))


@query("SELECT page_id, page_id % 3 = 0 OR (page_id % 3 = 1 AND regexp_matches(regexp_replace(url, '[?#].*$', ''), '\\.(css|js|png)$')) AS static FROM pages")
def p15_static_response(t: Tables) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "image/PNG; q=1").when(F.col("page_id") % 3 == 1, "application/octet-stream").otherwise("text/html")
    return t.pages.select("page_id", N.is_static_response(kind, "url").alias("static"))


@query(f"WITH r AS (SELECT * FROM (VALUES (0, 134744063, 'AA'), (134744064, 134760447, 'BB'), (134760448, 4294967295, 'CC')) v(lo, hi, country)), p AS (SELECT event_id, {_DST} AS dst FROM events) SELECT event_id, country FROM p LEFT JOIN r ON regexp_matches(dst, '^[0-9.]+$') AND TRY_CAST(split_part(dst, '.', 1) AS BIGINT) * 16777216 + TRY_CAST(split_part(dst, '.', 2) AS BIGINT) * 65536 + TRY_CAST(split_part(dst, '.', 3) AS BIGINT) * 256 + TRY_CAST(split_part(dst, '.', 4) AS BIGINT) BETWEEN lo AND hi")
def j09_address_country(t: Tables) -> DataFrame:
    ranges = t.spark.createDataFrame([(0, 134744063, "AA"), (134744064, 134760447, "BB"), (134760448, 4294967295, "CC")], "low long, high long, country string")
    numbered = _packets(t).select("event_id", N.ipv4_number("dst").alias("number"))
    return N.in_ranges(numbered, "number", ranges).select("event_id", "country")


@query("WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) SELECT page_id, host FROM h WHERE NOT (host = 'example.org' OR host LIKE '%.example.org' OR host LIKE 'm.%' AND host LIKE '%.ththth.example.net')")
def j10_allowed_parents(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("Example.org",), ("m.ththth.example.net",)], "domain string")
    return without_allowed(t.pages.select("page_id", N.host("url").alias("host")), "host", allowed)


@query("SELECT doc_id, lower(trim('  ' || upper(md5(text)) || ' ')) AS md5 FROM documents")
def f01_normal_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normal_md5(F.concat(F.lit("  "), F.upper(F.md5("text")), F.lit(" "))).alias("md5"))


@query("SELECT s_suppkey, nullif(nullif(regexp_replace(s_name, '[^A-Za-z]+$', ''), 'x'), '') AS stem FROM supplier")
def f02_stem(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", X.stem("s_name", ("x",)).alias("stem"))


_RANDOM = "regexp_matches(w, '^[0-9a-z]{6,}$') AND (regexp_matches(w, '[0-9]') OR (length(regexp_replace(w, '[^a-z]', '', 'g')) > 0 AND length(regexp_replace(w, '[^aeiou]', '', 'g')) < 0.28 * length(regexp_replace(w, '[^a-z]', '', 'g'))) OR regexp_matches(w, '[bcdfghjklmnpqrstvwxyz]{5}'))"


@query(f"SELECT doc_id, count(w) AS n, count(*) FILTER ({_RANDOM}) AS random FROM (SELECT doc_id, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\n]+') AS x FROM documents)) GROUP BY 1")
def f03_random_name(t: Tables) -> DataFrame:
    """How many words of a whole text look as if a generator had made them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \n]+"), F.lit(0))
    return t.documents.select("doc_id", F.size(words).cast("long").alias("n"), F.size(F.filter(words, lambda w: X.looks_random(w))).cast("long").alias("random"))


_DOTS = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"WITH h AS (SELECT page_id, {_DOTS} AS n FROM pages), r AS (SELECT page_id, list_transform(list_slice(string_split(n, '.'), 1, CASE WHEN len(string_split(n, '.')) <= 3 THEN greatest(len(string_split(n, '.')) - 1, 0) ELSE 3 END), lambda s: CASE WHEN regexp_matches(s, '^[0-9a-z]{{6,}}$') AND (regexp_matches(s, '[0-9]') OR (length(regexp_replace(s, '[^aeiou]', '', 'g')) < 0.28 * length(s)) OR regexp_matches(s, '[bcdfghjklmnpqrstvwxyz]{{5}}')) THEN '*' ELSE s END) AS parts FROM h) SELECT page_id, array_to_string(parts, '.') AS root FROM r")
def f04_package_root(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.package_root(N.host("url")).alias("root"))


@query(f"WITH h AS (SELECT page_id, {_DOTS} AS n FROM pages) SELECT page_id, array_to_string(list_slice(string_split(n, '.'), -2, -1), '.') AS skeleton FROM h")
def f05_suffix_skeleton(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.suffix_skeleton(F.concat(N.host("url"), F.lit("$Inner.x"))).alias("skeleton"))


@query("SELECT page_id, name, contains(name, '.') AND NOT contains(lower(name), '.permission.') AND regexp_matches(name, '(?:^|\\.)\\p{Lu}[^.]*$') AS code_like FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'org.Permission.' WHEN page_id % 5 = 1 THEN '' ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '.' END || unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS name FROM pages)")
def f06_component_test(t: Tables) -> DataFrame:
    """The links of every page's menu, below its host, tested as components."""
    before = F.when(F.col("page_id") % 5 == 0, "org.Permission.").when(F.col("page_id") % 5 == 1, "").otherwise(F.concat(N.host("url"), F.lit(".")))
    names = t.pages.select("page_id", before.alias("b"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("leaf")).select("page_id", F.concat("b", "leaf").alias("name"))
    return names.select("page_id", "name", is_code_component(F.col("name")).alias("code_like"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '.Main' ELSE 'Main' END AS component FROM documents")
def f07_relative_component(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.full_component("source", F.when(F.col("doc_id") % 2 == 0, ".Main").otherwise("Main")).alias("component"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'lib' || source || '.so' END AS lib FROM documents")
def f08_native_library(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 3
    path = F.when(m == 0, F.concat(F.lit("lib/arm64/lib"), F.col("source"), F.lit(".so"))).when(m == 1, "lib/x86/libflutter.so").otherwise("lib/x86/libdeadbeef01.so")
    return t.documents.select("doc_id", X.native_library(path, ("libflutter.so",)).alias("lib"))


@query("SELECT page_id, nullif(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '') AS route FROM pages")
def f09_route(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit(" '"), F.replace(F.regexp_replace("url", "^[a-z]+://[^/]*", "/"), F.lit("/"), F.lit("\\/")), F.lit("' "))
    return t.pages.select("page_id", X.route(quoted).alias("route"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['a', event_type] ELSE [event_type, 'b', 'c'] END AS items FROM events")
def f10_list_decode(t: Tables) -> DataFrame:
    json = F.concat(F.lit('["a", " '), F.col("event_type"), F.lit('", ""]'))
    text = F.concat(F.col("event_type"), F.lit(" ;b,\n c;"))
    return t.events.select("event_id", X.decoded_list(F.when(F.col("event_id") % 2 == 0, json).otherwise(text)).alias("items"))


@query("SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM documents")
def f11_comma_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.pieces("text").alias("items"))


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(text, '[,\\s]+'), lambda x: x <> ''))) AS n FROM documents")
def f12_similarity_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.array_distinct(X.pieces("text", "rule"))).cast("long").alias("n"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s,;]+'), lambda x: x <> '')) AS n FROM documents")
def f13_cluster_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.pieces("text", "cluster")).cast("long").alias("n"))


@query("SELECT event_id, 'a,' || event_type AS joined FROM events")
def f14_join_without_blanks(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.joined(F.array(F.lit(" a"), F.lit(" "), F.col("event_type"), F.lit(""))).alias("joined"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port, regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages")
def f17_url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", N.host("url").alias("host"), N.port("url").alias("port"), N.url_part("url", "PROTOCOL").alias("scheme"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '8.8.8.8:443' WHEN 1 THEN '[2001:db8::1]:8443' ELSE 'h' || user_id || '.example.org' END AS target FROM events")
def f18_https_target(t: Tables) -> DataFrame:
    m = F.col("event_id") % 3
    url = F.when(m == 0, "https://8.8.8.8/x").when(m == 1, "https://[2001:db8::1]:8443/").otherwise(F.concat(F.lit("https://H"), F.col("user_id").cast("string"), F.lit(".Example.org:9/p")))
    return t.events.select("event_id", N.https_target(url).alias("target"))


@query("SELECT page_id, 'https://' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '#.*$', '') AS url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '#.*$', '') AS target FROM pages")
def f19_build_and_split_url(t: Tables) -> DataFrame:
    target = N.path_and_query("url")
    return t.pages.select("page_id", N.built_url(F.lit("https"), N.host("url"), target).alias("url"), target.alias("target"))


@query("SELECT page_id, CASE WHEN url LIKE '%example.com%' THEN NULL ELSE regexp_replace(url, '[?#].*$', '') END AS service FROM pages")
def f20_service_url(t: Tables) -> DataFrame:
    kept = F.regexp_replace("url", "[?#].*$", "")
    return t.pages.select("page_id", F.when(~N.host("url").rlike(r"(^|\.)example\.com$"), kept).alias("service"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) IN ('en', 'de') AS allowed FROM pages")
def f21_route_allow_list(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.coalesce(F.get(F.split(X.route(N.path_and_query("url")), "/"), 1).isin("en", "de"), F.lit(False)).alias("allowed"))


@query("SELECT doc_id, 'store/' || source || '/a b' || doc_id AS name FROM documents")
def f22_object_name(t: Tables) -> DataFrame:
    name = F.concat(F.lit("store/"), F.col("source"), F.lit("/a b"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", F.url_decode(F.regexp_replace(F.concat(F.lit("http://s3/bucket/"), F.url_encode(name)), "^http://s3/bucket/", "")).alias("name"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def f23_any_time(t: Tables) -> DataFrame:
    m, s = F.col("event_id") % 4, F.unix_timestamp(F.col("ts").cast("timestamp"))
    raw = F.when(m == 0, s.cast("string")).when(m == 1, (s * 1000).cast("string")).when(m == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("never")
    return t.events.select("event_id", X.any_time(raw).alias("at"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 6 GROUP BY 1")
def f24_days_back(t: Tables) -> DataFrame:
    return t.events.where(F.to_date("ts") >= F.date_sub(F.lit("2024-01-30").cast("date"), 6)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.2f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.2f KB', n_chars / 1024.0) ELSE printf('%.2f MB', n_chars / 1048576.0) END AS label FROM documents")
def f25_size_label(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.size_label("n_chars").alias("label"))


@query("SELECT event_id, event_id % 4 < 2 AS yes FROM events")
def f26_truthy(t: Tables) -> DataFrame:
    m = F.col("event_id") % 4
    return t.events.select("event_id", X.truthy(F.when(m == 0, " Yes").when(m == 1, "是").when(m == 2, "no")).alias("yes"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents")
def f27_printable(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.printable(F.concat(F.lit("​\x01"), F.col("text"))).alias("clean"))


@query("SELECT doc_id, left(text, 100) AS clip FROM documents")
def f28_clip(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clipped("text", 100).alias("clip"))


@query("SELECT conv_id, sha256('roles' || chr(0) || string_agg(role, chr(0) ORDER BY role)) AS key, left(sha256(string_agg(role, ';' ORDER BY role)), 12) AS short FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY 1")
def f29_set_keys(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return g.select("conv_id", X.set_key(F.col("r"), F.lit("roles")).alias("key"), X.short_id(F.col("r")).alias("short"))


@query("SELECT conv_id, md5(string_agg(DISTINCT '.' || role, chr(10) ORDER BY '.' || role)) AS fingerprint FROM conversations GROUP BY 1")
def f30_component_fingerprint(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id").agg(F.collect_list(F.concat(F.lit("org.x."), F.col("role"))).alias("r"))
    return g.select("conv_id", X.component_fingerprint(F.lit("org.x"), "r").alias("fingerprint"))


@query("SELECT p_partkey, CASE WHEN p_type ILIKE '%steel%' THEN 'steel' WHEN p_type ILIKE '%brass%' THEN 'brass' ELSE 'other' END AS vendor FROM part")
def f35_first_pattern(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.first_pattern("p_type", [("steel", "(?i)steel"), ("brass", "(?i)brass")]).alias("vendor"))


@query("SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'packer' WHEN bool_or(role = 'assistant') THEN 'protector' ELSE 'none' END AS kind, string_agg(DISTINCT role, '、' ORDER BY role) AS summary FROM conversations GROUP BY 1")
def f36_tag_categories(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("r"))
    kind = F.when(F.arrays_overlap("r", F.array(F.lit("system"))), "packer").when(F.arrays_overlap("r", F.array(F.lit("assistant"))), "protector").otherwise("none")
    return g.select("conv_id", kind.alias("kind"), F.array_join("r", "、").alias("summary"))


@query("""WITH s AS (SELECT doc_id, [{'n': len(regexp_extract_all(text, ' the ')), 'f': 'english'}, {'n': len(regexp_extract_all(text, ' de ')), 'f': 'romance'}, {'n': len(regexp_extract_all(text, ' der ')), 'f': 'german'}] AS x FROM documents)
SELECT doc_id, CASE WHEN greatest(x[1].n, x[2].n, x[3].n) = 0 THEN NULL WHEN x[1].n >= greatest(x[2].n, x[3].n) THEN 'english' WHEN x[2].n >= x[3].n THEN 'romance' ELSE 'german' END AS framework, greatest(x[1].n, x[2].n, x[3].n) AS score FROM s""")
def f37_best_score(t: Tables) -> DataFrame:
    scores = [F.struct(F.regexp_count("text", F.lit(p)).cast("long").alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("framework")) for i, (n, p) in enumerate((("english", " the "), ("romance", " de "), ("german", " der ")))]
    best = F.array_max(F.array(*scores))
    return t.documents.select("doc_id", F.when(best["score"] > 0, best["framework"]).alias("framework"), best["score"].alias("score"))


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n]+')) AS w FROM documents) SELECT doc_id, CASE WHEN regexp_matches(w, '^https?://') THEN 'url' WHEN regexp_matches(w, '^/[a-z]') THEN 'route' WHEN regexp_matches(w, '^[a-z]+[A-Z]') THEN 'camel' ELSE 'other' END AS category, count(*) AS n FROM w GROUP BY ALL")
def f38_string_categories(t: Tables) -> DataFrame:
    """Words of whole texts by category."""
    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("w"))
    named = words.select("doc_id", X.first_pattern("w", [("url", "^https?://"), ("route", "^/[a-z]"), ("camel", "^[a-z]+[A-Z]")]).alias("category"))
    return named.groupBy("doc_id", "category").agg(F.count("*").alias("n"))


@query("SELECT event_id, 'ldr reg, [stack] ; add reg, reg, imm' AS code FROM events")
def f39_normal_instruction(t: Tables) -> DataFrame:
    code = F.concat(F.lit("  LDR x"), (F.col("event_id") % 30).cast("string"), F.lit(", [sp, #0x"), F.hex(F.col("event_id")), F.lit("] ; add w1, w2, #"), (F.col("user_id")).cast("string"))
    return t.events.select("event_id", X.normal_instruction(code).alias("code"))


@query("SELECT doc_id, position(chr(10) IN text) > 0 AS has, CASE WHEN regexp_matches(text, 'licensed|Licensed') THEN 1 + length(split_part(regexp_replace(text, 'licensed|Licensed', chr(1)), chr(1), 1)) - length(replace(split_part(regexp_replace(text, 'licensed|Licensed', chr(1)), chr(1), 1), chr(10), '')) END AS line FROM documents")
def f40_line_of_match(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.contains("text", F.lit("\n")).alias("has"), X.line_of("text", "licensed|Licensed").cast("long").alias("line"))


@query("SELECT event_id, event_type AS inner_name FROM events")
def f43_class_prefix(t: Tables) -> DataFrame:
    value = F.concat(F.lit("com.example.Type@1f: "), F.col("event_type"))
    return t.events.select("event_id", F.regexp_extract(value, r"^(?:[\w.$]+@[0-9a-f]+: )?(.*)$", 1).alias("inner_name"))


@query("SELECT event_id, length(event_type) <= 5 AND event_id % 2 = 0 AS valid FROM events")
def f45_metadata_checks(t: Tables) -> DataFrame:
    score = F.when(F.col("event_id") % 2 == 0, 0.5).otherwise(1.5)
    json = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("event_type").alias("name"), score.alias("confidence"))), F.lit("\n```"))
    m = F.from_json(F.regexp_replace(json, "^```json\\s*|\\s*```$", ""), "name string, confidence double")
    return t.events.select("event_id", (m.isNotNull() & (F.length(m["name"]) <= 5) & m["confidence"].between(0, 1)).alias("valid"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f46_json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT page_id, unnest(['host', 'x-part', 'content-length']) AS name, unnest([regexp_extract(url, '://([^/?#]*)', 1), '1, ' || (page_id % 7), CAST(strlen(html) AS VARCHAR)]) AS value, strlen(html) AS content_length FROM pages")
def f41_header_map(t: Tables) -> DataFrame:
    text = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("\r\nX-Part:1\r\n x-part :  "), (F.col("page_id") % 7).cast("string"), F.lit(" \r\n: none\nContent-Length: "), F.octet_length("html").cast("string"))
    found = t.pages.select("page_id", N.header_map(text).alias("h"))
    return found.select("page_id", F.explode("h").alias("name", "value"), N.header_number(F.col("h"), "content-length").alias("content_length"))


@query("SELECT s_suppkey, n_name AS name FROM supplier LEFT JOIN nation ON s_suppkey * 7919 % 40000 BETWEEN n_nationkey * 1500 + 200 AND n_nationkey * 1500 + 1200")
def s15_range_lookup(t: Tables) -> DataFrame:
    ranges = t.nation.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 1500 + 200).alias("low"), (F.col("n_nationkey") * 1500 + 1200).alias("high"))
    return N.in_ranges(t.supplier.select("s_suppkey", (F.col("s_suppkey") * 7919 % 40000).alias("number")), "number", ranges, 8).select("s_suppkey", "name")
