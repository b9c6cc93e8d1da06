"""Extraction of indicators, credentials and routes, and the rule language, on documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.functions import net as N
from quarrion.functions import text as X
from quarrion.operators import extract as E
from quarrion.operators import rules as L
from quarrion.plans.registry import Tables, query

_EMAILS = f"SELECT doc_id, source, unnest(regexp_extract_all(text, '{E.EMAIL}')) AS value FROM documents"


@query("SELECT page_id, unnest(regexp_extract_all('see ' || url || ' and http://10.0.0.' || (page_id % 9) || '/x.png', '" + E.URL.replace("'", "''") + "')) AS value FROM pages")
def e01_urls(t: Tables) -> DataFrame:
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" and http://10.0.0."), (F.col("page_id") % 9).cast("string"), F.lit("/x.png"))
    return E.found(t.pages.withColumn("t", text), ["page_id"], "t", E.URL)


@query()
def e02_bounded_emails(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(E.emails("text")).alias("value"))


@query(_EMAILS)
def e02_emails(t: Tables) -> DataFrame:
    return E.found(t.documents, ["doc_id", "source"], "text", E.EMAIL)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '138' || lpad(CAST(event_id AS VARCHAR), 8, '0') END AS value FROM events WHERE event_id % 2 = 0")
def e03_phones(t: Tables) -> DataFrame:
    digits = F.lpad(F.col("event_id").cast("string"), 8, "0")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("tel:138"), digits, F.lit("."))).otherwise(F.concat(F.lit("no 4138"), digits, F.lit(" 138"), digits, F.lit("7")))
    return E.found(t.events.select("event_id", text.alias("t")), ["event_id"], "t", E.PHONE)


@query("SELECT page_id, url FROM pages WHERE NOT contains(url, 'utm_source') AND NOT url LIKE '%example.com/%'")
def e04_noise_rules(t: Tables) -> DataFrame:
    return t.pages.where(~E.is_noise("url", noise_parts=("utm_source", "example.com/"))).select("page_id", "url")


@query(f"WITH m AS ({_EMAILS}) SELECT value, source FROM m WHERE value IN (SELECT value FROM m GROUP BY value HAVING NOT bool_and(regexp_matches(source, '[0-4]$')))")
def e05_only_dull_sources(t: Tables) -> DataFrame:
    m = E.found(t.documents, ["doc_id", "source"], "text", E.EMAIL)
    return E.not_only_from(m, ["value"], "source", ["[0-4]$"]).select("value", "source")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def e06_located_values(t: Tables) -> DataFrame:
    """Which documents hold a whole benchmark item."""
    return E.located(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query("WITH i AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(html, '<p>([^<]{3,40})', 1) WHEN 1 THEN regexp_extract(html, '<title>([^< ]+)', 1) ELSE regexp_extract(html, '([a-z]+ [a-z]+)', 1) END AS item FROM pages) SELECT d.doc_id, page_id FROM documents d JOIN i ON item <> '' AND contains(d.text, item)")
def e06_located_titles(t: Tables) -> DataFrame:
    """Which documents hold words and phrases of pages, most of fewer than five words."""
    m = F.col("page_id") % 3
    item = F.when(m == 0, F.regexp_extract("html", "<p>([^<]{3,40})", 1)).when(m == 1, F.regexp_extract("html", "<title>([^< ]+)", 1)).otherwise(F.regexp_extract("html", "([a-z]+ [a-z]+)", 1))
    return E.located(t.documents, "doc_id", "text", t.pages.select("page_id", item.alias("item")), "page_id", "item")


_KNOWN = (
    E.Fingerprint("apache", ("Apache License",), None, ()),
    E.Fingerprint("gnu", ("GNU General",), r"version [0-9]", ()),
    E.Fingerprint("tokens", (), r"token = \"[0-9a-f]{8}", (r"token = \"(?P<prefix>[0-9a-f]{4})(?P<rest>[0-9a-f]+)\"",)),
)
_PREFIX = "regexp_matches(text, '(?:{0})(?:[^A-Za-z0-9_]|$)')"


@query(f"SELECT doc_id, 'apache' AS product, 'prefix' AS \"by\" FROM documents WHERE {_PREFIX.format('Apache License')} UNION ALL SELECT doc_id, 'gnu', CASE WHEN {_PREFIX.format('GNU General')} THEN 'prefix' ELSE 'pattern' END FROM documents WHERE {_PREFIX.format('GNU General')} OR regexp_matches(text, 'version [0-9]') UNION ALL SELECT doc_id, 'tokens', 'pattern' FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]{{8}}')")
def e07_products(t: Tables) -> DataFrame:
    return E.products(t.documents, ["doc_id"], "text", _KNOWN)


@query(f"SELECT source, bool_or({_PREFIX.format('Apache License')}) AS named FROM documents GROUP BY 1")
def e08_recognition_gate(t: Tables) -> DataFrame:
    hit = E.products(t.documents, ["source"], "text", _KNOWN[:1]).distinct()
    return t.documents.select("source").distinct().join(hit, "source", "left").select("source", F.col("product").isNotNull().alias("named"))


@query("WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, 'token = \"([0-9a-f]{4})([0-9a-f]+)\"', 0)) AS m FROM documents) SELECT doc_id, 'tokens' AS product, 'prefix' AS name, substr(m, 10, 4) AS value FROM m UNION ALL SELECT doc_id, 'tokens', 'rest', substr(m, 14, length(m) - 14) FROM m")
def e09_named_credentials(t: Tables) -> DataFrame:
    return E.credentials(t.documents, ["doc_id"], "text", _KNOWN[2:])


@query("SELECT event_id, 0 AS call, event_type AS first, 2 AS n FROM events")
def e10_call_arguments(t: Tables) -> DataFrame:
    code = F.concat(F.lit("// init(1)\nSdk.init("), F.col("event_type"), F.lit(', "a,(b" /* x, y */);'))
    found = E.calls(t.events.select("event_id", code.alias("code")), ["event_id"], "code", "init")
    return found.select("event_id", "call", F.col("arguments")[0].alias("first"), F.size("arguments").alias("n"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), url) AS name, CASE WHEN regexp_extract(html, '<h1>([^<]*)', 1) <> '' THEN 'h1' WHEN regexp_extract(html, '<title>([^<]*)', 1) <> '' THEN 'title' ELSE 'url' END AS found_in FROM pages""")
def e11_staged_fallback(t: Tables) -> DataFrame:
    h1, title = (F.nullif(F.regexp_extract("html", f"<{tag}>([^<]*)", 1), F.lit("")) for tag in ("h1", "title"))
    return t.pages.select("page_id", F.coalesce(h1, title, "url").alias("name"), F.when(h1.isNotNull(), "h1").when(title.isNotNull(), "title").otherwise("url").alias("found_in"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS value FROM pages")
def e12_routes(t: Tables) -> DataFrame:
    return E.found(t.pages, ["page_id"], "html", 'href="(/[^"]*)"', 1)


@query("SELECT doc_id, CASE WHEN a AND b THEN 'high' WHEN a OR b THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT doc_id, regexp_matches(text, 'Licensed') AS a, regexp_matches(text, 'Version') AS b FROM documents)")
def e13_confidence_ladder(t: Tables) -> DataFrame:
    a, b = F.col("text").rlike("Licensed"), F.col("text").rlike("Version")
    return t.documents.select("doc_id", F.when(a & b, "high").when(a | b, "medium").otherwise("low").alias("confidence"))


@query("SELECT doc_id, CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, '%%%') OR contains(text, '###') THEN 'symbols' ELSE 'plain' END AS kind FROM documents")
def e17_kinds(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.first_pattern("text", [("table", r"\|"), ("symbols", "%%%|###")], "plain").alias("kind"))


@query(f"WITH m AS (SELECT DISTINCT value, source FROM ({_EMAILS})), r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY source) AS n FROM m) SELECT value, list(source ORDER BY source) AS source FROM r WHERE n <= 5 GROUP BY 1")
def e02_email_sources(t: Tables) -> DataFrame:
    return E.with_sources(E.found(t.documents, ["source"], "text", E.EMAIL), ["value"], "source")


@query(f"WITH m AS (SELECT DISTINCT 'email' AS kind, value, source FROM ({_EMAILS})), r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY CASE WHEN regexp_matches(source, '[02468]$') THEN 0 ELSE 1 END, source) AS n FROM m) SELECT kind, value, list(source ORDER BY n) AS sources FROM r WHERE n <= 5 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value) <= 200")
def u04_merged_sources(t: Tables) -> DataFrame:
    m = E.found(t.documents.withColumn("kind", F.lit("email")), ["kind", "source"], "text", E.EMAIL).distinct()
    half = lambda pattern: E.with_sources(m.where(F.col("source").rlike(pattern)), ["kind", "value"], "source", 50).withColumnRenamed("source", "sources")
    return E.merged_sources(half("[02468]$"), half("[13579]$"), ["kind", "value"])


_BEST = "SELECT p_partkey, p_name, p_brand, p_type, CASE {0} END AS rule_id FROM part"
_PART_RULES = [
    L.Rule("r1", "brass rings", "a", "p_name=~/ring$/ && p_type=='ECONOMY'"),
    L.Rule("r2", "odd", "a", "p_name=='x' && p_type=='y' || p_brand=='z'"),
    L.Rule("r3", "words", "b", "content_include(p_list,'red,%dget')"),
    L.Rule("r4", "twice", "b", "keywords_contains(p_name,'[aeiou]',4)"),
    L.Rule("r5", "alike", "c", "jaccard_sim(p_name,'hot gear') >= 0.3 || p_brand=='Brand#7'"),
    L.Rule("r6", "bad", "c", "keywords_contains(p_name,'[',1)"),
]
_CASES = """CASE WHEN regexp_matches(p_name, 'ring$') AND p_type = 'ECONOMY' THEN 'r1' WHEN list_contains(string_split(p_name, ' '), 'red') AND len(list_filter(string_split(p_name, ' '), lambda x: x LIKE '%dget')) > 0 THEN 'r3'
WHEN len(regexp_extract_all(p_name, '[aeiou]')) >= 4 THEN 'r4' WHEN len(list_intersect(string_split(p_name, ' '), ['hot', 'gear'])) / len(list_distinct(list_concat(string_split(p_name, ' '), ['hot', 'gear']))) >= 0.3 OR p_brand = 'Brand#7' THEN 'r5' END"""


def _parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", F.split("p_name", " ").alias("p_list"))


@query(f"SELECT p_partkey, {_CASES} AS rule_id FROM part")
def r07_first_match(t: Tables) -> DataFrame:
    return L.first_match(_parts(t), _PART_RULES).select("p_partkey", "rule_id")


@query(f"SELECT p_partkey, rule_id FROM (SELECT p_partkey, {_CASES} AS rule_id, CASE WHEN p_partkey % 2 = 0 THEN 'r4' END AS now FROM part) WHERE rule_id IS DISTINCT FROM now")
def r08_changed_matches(t: Tables) -> DataFrame:
    rows = _parts(t).withColumn("now", F.when(F.col("p_partkey") % 2 == 0, "r4"))
    return L.changed_matches(rows, _PART_RULES, "now").select("p_partkey", "rule_id")


def _atom(t: Tables, expression: str) -> DataFrame:
    rows = _parts(t)
    return rows.select("p_partkey", L.Compiler(rows.schema).rule(expression).alias("holds"))


@query("SELECT p_partkey, list_contains(string_split(p_name, ' '), 'small') AND len(list_filter(string_split(p_name, ' '), lambda x: x LIKE 'g%')) > 0 AS holds FROM part")
def r01_content_include(t: Tables) -> DataFrame:
    return _atom(t, "content_include(p_list,'small, g%')")


@query("SELECT p_partkey, len(regexp_extract_all(p_name, '[rg]')) >= 2 AS holds FROM part")
def r02_keywords_contains(t: Tables) -> DataFrame:
    return _atom(t, 'keywords_contains(p_name, "[rg]", 2)')


@query("SELECT p_partkey, regexp_matches(p_name, '^(red|hot) ') AS holds FROM part")
def r03_search(t: Tables) -> DataFrame:
    return _atom(t, "pName =~ /^(red|hot) /")


@query("SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'bolt'])) / len(list_distinct(list_concat(string_split(p_name, ' '), ['red', 'bolt']))) > 0.5 AS holds FROM part")
def r04_jaccard(t: Tables) -> DataFrame:
    return _atom(t, "jaccard_sim(p_name,'red bolt red') > 0.5")


@query("SELECT p_partkey, p_brand = 'Brand#3' AS holds FROM part")
def r05_equality(t: Tables) -> DataFrame:
    return _atom(t, "p_brand == 'Brand#3'")


@query("SELECT p_partkey, p_type IN ('SMALL', 'LARGE') AS holds FROM part")
def r06_disjunction(t: Tables) -> DataFrame:
    return _atom(t, "p_type=='SMALL' || p_type=='LARGE'")


@query("SELECT p_partkey, p_name LIKE '%ring%' AND p_name LIKE 'small%' AS holds FROM part")
def r09_generated_rule(t: Tables) -> DataFrame:
    whole = t.part.select("p_partkey", F.concat_ws(".", F.split("p_name", " ")).alias("parts"), F.array(F.concat_ws(".", F.split("p_name", " "))).alias("p_list"))
    return whole.select("p_partkey", L.Compiler(whole.schema).rule(L.rule_from_fingerprint("p_list", ["P:ring", "H:small"])).alias("holds"))


@query("SELECT p_type, bool_and(p_name LIKE '%r%') AS all_hold, count(*) FILTER (WHERE p_name LIKE '%r%') AS n FROM part GROUP BY 1")
def r10_rule_on_every_member(t: Tables) -> DataFrame:
    rows = _parts(t)
    holds = L.Compiler(rows.schema).rule("p_name=~/r/")
    return rows.groupBy("p_type").agg(F.bool_and(holds).alias("all_hold"), F.count_if(holds).alias("n"))


@query("SELECT p_partkey, p_partkey % 6 IN (0, 4) AS holds FROM part")
def f16_wildcards(t: Tables) -> DataFrame:
    """A wildcard stands for anything but a line feed; underscores and signs of patterns stand for themselves."""
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    v = F.when(k == 0, F.concat(F.lit("a_b "), n, F.lit("c.d"))).when(k == 1, F.concat(F.lit("axb"), n, F.lit("c.d"))).when(k == 2, F.concat(F.lit("a_b"), n, F.lit("cxd"))).when(k == 3, F.concat(F.lit("a_b\n"), n, F.lit("c.d"))).when(k == 4, F.concat(F.lit("a_b\r"), n, F.lit("c.d\n"))).otherwise(F.concat(F.lit("p a_b"), n, F.lit("c.d")))
    rows = t.part.select("p_partkey", F.array(F.lit("x"), v).alias("names"))
    return rows.select("p_partkey", L.Compiler(rows.schema).rule("content_include(names,'a_b%c.d')").alias("holds"))


@query("SELECT p_partkey, p_size = 7 AS by_camel, p_brand = 'Brand#3' AS by_digit, p_name = 'red bolt' AS by_itself, false AS unknown FROM part")
def f15_field_names(t: Tables) -> DataFrame:
    """Fields that rules name in camel case, with a number, or as they are."""
    rows = t.part.select("p_partkey", F.col("p_size").alias("part_size"), F.col("p_brand").alias("brand_4_grams"), F.col("p_name").alias("PartName"))
    c = L.Compiler(rows.schema)
    rules = {"by_camel": "partSize == '7'", "by_digit": "brand4Grams == 'Brand#3'", "by_itself": "PartName == 'red bolt'", "unknown": "noField == 'x'"}
    return rows.select("p_partkey", *(c.rule(r).alias(n) for n, r in rules.items()))


_ORDER_RULES = [
    L.Rule("urgent", "", "a", "oOrderpriority=~/^1/ && oOrderstatus=='O'"), L.Rule("none", "", "a", "oOrderstatus=='O' && o_orderpriority=='x' || oOrderstatus=='F'"),
    L.Rule("many", "", "a", 'keywords_contains(o_orderpriority, "[A-Z]", 6)'), L.Rule("open", "", "a", "oOrderstatus=='O' || oOrderstatus=='P'"), L.Rule("urgent again", "", "a", "oOrderpriority=~/^1/"),
]


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'O' THEN 'urgent' WHEN len(regexp_extract_all(o_orderpriority, '[A-Z]')) >= 6 THEN 'many' WHEN o_orderstatus IN ('O', 'P') THEN 'open' WHEN o_orderpriority LIKE '1%' THEN 'urgent again' END AS rule_id FROM orders")
def j16_ordered_rules(t: Tables) -> DataFrame:
    """The first of several rules, in their order, that holds for each order."""
    return L.first_match(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), _ORDER_RULES).select("o_orderkey", "rule_id")


@query("SELECT doc_id, k FROM (SELECT doc_id, md5(text) AS k, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END, doc_id) AS n FROM documents) WHERE n = 1")
def u05_preferred_findings(t: Tables) -> DataFrame:
    """Of findings with one key the structured source (even ids) displaces the other."""
    at = Window.partitionBy("k").orderBy(F.col("doc_id") % 2, "doc_id")
    return t.documents.select("doc_id", F.md5("text").alias("k")).withColumn("n", F.row_number().over(at)).where("n = 1").drop("n")


@query("SELECT page_id, length(html) <= 20000 AND url NOT LIKE '%.png' AS kept FROM pages")
def s10_read_policy(t: Tables) -> DataFrame:
    return t.pages.select("page_id", ((F.length("html") <= 20000) & ~F.endswith("url", F.lit(".png"))).alias("kept"))


@query("SELECT page_id, name, NOT regexp_matches(lower(name), '[.](?:png|jpe?g|gif|webp|bmp|ico|tiff?|hei[cf]|mp[34]|m4a|aac|wav|ogg|flac|avi|mov|mkv|webm|[to]tf|woff2?)$') AND size <= CASE WHEN regexp_matches(name, '[.](?:java|kt|xml|json|properties|txt|js|html|gradle|smali)$') THEN 1048576 ELSE 67108864 END AS wanted FROM (SELECT page_id, 'page' || page_id || '.' || unnest(['html', 'PNG', 'apk', 'svg', 'heif', 'txt', 'pdf', 'css']) AS name, strlen(html) * 100 AS size FROM pages)")
def s10_worth_reading(t: Tables) -> DataFrame:
    """Which of eight files a page, a hundred times as long as its html, are worth a scan."""
    endings = F.explode(F.array(*map(F.lit, ("html", "PNG", "apk", "svg", "heif", "txt", "pdf", "css"))))
    named = t.pages.select("page_id", endings.alias("e"), (F.octet_length("html") * 100).alias("size")).withColumn("name", F.concat(F.lit("page"), "page_id", F.lit("."), "e"))
    return named.select("page_id", "name", E.worth_reading("name", "size").alias("wanted"))


@query("SELECT page_id, md5(html) AS digest, strlen(html) AS length, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme FROM pages WHERE strlen(html) <= 524288000")
def s22_digest_and_cap(t: Tables) -> DataFrame:
    return t.pages.where(F.octet_length("html") <= 500 << 20).select("page_id", F.md5("html").alias("digest"), F.octet_length("html").cast("long").alias("length"), N.url_part("url", "PROTOCOL").alias("scheme"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'p/' || page_id END AS page, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'tab' END AS tab FROM pages")
def f44_script_configuration(t: Tables) -> DataFrame:
    """Pages named by a configuration that a script assigns; every third has none that can be read."""
    page = F.concat(F.lit("p/"), F.col("page_id").cast("string"))
    tab = F.when(F.col("page_id") % 3 == 1, ', "tabBar": {"list": [{"pagePath": "tab"}]}').otherwise("")
    text = F.when(F.col("page_id") % 3 == 0, "var __uniConfig = {broken").otherwise(F.concat(F.lit('x=1;var __uniConfig ={"pages": ["'), page, F.lit('"]'), tab, F.lit("};function f(){}")))
    found = F.from_json(E.script_value(text, "__uniConfig"), "pages array<string>, tabBar struct<list: array<struct<pagePath: string>>>")
    return t.pages.select("page_id", found.alias("c")).select("page_id", F.get("c.pages", F.lit(0)).alias("page"), F.get("c.tabBar.list.pagePath", F.lit(0)).alias("tab"))


@query()
def f31_gram_hashes(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.split("text", r"\s+").alias("w"))
    return words.select("doc_id", F.size(E.gram_hashes(F.col("w"))).alias("n"), F.array_min(E.gram_hashes(F.col("w"))).alias("least"))
