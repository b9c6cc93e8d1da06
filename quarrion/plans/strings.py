"""Vendors, strategies, kinds of strings, noise sources, products and web packages on rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.operators import recognition as R
from quarrion.operators.extract import Fingerprint
from quarrion.plans.registry import Tables, query


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _pick(words, at):
    return F.get(F.array(*map(F.lit, words)), F.pmod(at, F.lit(len(words))).cast("int"))


_PRODUCTS = (*(v[2] + " " + v[3].split(" ")[0] for v in R.VENDORS), "jiagu 360", "SecShell by proguard", "com/ali/security", "nothing known", "", "UPX!", "upxx", "Kiwi Enc")
_VENDOR_CASES = " ".join("WHEN regexp_matches(d, '(?i){}') THEN {}".format(p.replace("'", "''"), _listed([product])[1:-1]) for p, _, _, product, _ in R.VENDORS)


@query(f"SELECT p_partkey, CASE {_VENDOR_CASES} WHEN d = '' THEN 'Unknown' ELSE d END AS product, d AS description FROM (SELECT p_partkey, trim({_listed(_PRODUCTS)}[1 + p_partkey % {len(_PRODUCTS)}] || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name ELSE '' END) AS d FROM part)")
def f35_vendors(t: Tables) -> DataFrame:
    """The protection product that a description names, by the first of all patterns."""
    d = F.trim(F.concat(_pick(_PRODUCTS, F.col("p_partkey")), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name")).otherwise("")))
    return t.part.select("p_partkey", R.vendor(d)["product"].alias("product"), d.alias("description"))


_FRAMEWORKS = ("Flutter", "my FLUTTER 3", "uni-app/DCloud", "UniApp", "原生 (Native Android)", "React Native", "Unity", "", "Cordova/PhoneGap")


@query(f"SELECT strategy, count(*) AS n FROM (SELECT CASE WHEN contains(f, 'flutter') THEN 'flutter' WHEN contains(f, 'dcloud') OR contains(f, 'uni-app') OR contains(f, 'uniapp') THEN 'dcloud' WHEN contains(f, 'native') OR contains(f, '原生') THEN 'native' WHEN f <> '' THEN 'framework_component' END AS strategy FROM (SELECT lower({_listed(_FRAMEWORKS)}[1 + o_orderkey % {len(_FRAMEWORKS)}]) AS f FROM orders)) GROUP BY 1")
def g02_strategies(t: Tables) -> DataFrame:
    """How many orders, each with the name of a framework, go to which way of clustering."""
    return t.orders.groupBy(R.strategy(_pick(_FRAMEWORKS, F.col("o_orderkey"))).alias("strategy")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS key, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank FROM orders GROUP BY 1 HAVING count(*) >= 5")
def g20_ranked_candidates(t: Tables) -> DataFrame:
    """Customers with five orders or more, the largest first."""
    return R.candidates(t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("node")))


def page_strings(pages: DataFrame) -> DataFrame:
    """(page_id, value): the words of whole pages, and some of addresses, routes, names and Chinese."""
    k = F.col("page_id").cast("string")
    made = F.array(
        F.col("url"), F.concat(F.lit("see <a href=\""), "url", F.lit("\">, wss://s"), k, F.lit(".example.org:8443/x?y). http://flutter.dev/z http://noname/")), F.concat(F.lit("POST /api//v2/item"), k, F.lit("?a=b, /assets/user/x /v1/a.png /home/login a/login /pay/"), k, F.lit(".;")),
        F.concat(F.lit("package:shop/src/p"), k, F.lit(".dart) file:///tmp/x%20y package:flutter/x")), F.concat(F.lit("file:///a/login/"), k), F.concat(F.lit("orderCount.item"), k), F.concat(F.lit("order_item_"), k), F.concat(F.lit("漢 "), k, F.lit(" 字")), F.lit("setState"), F.lit("  \t "), F.lit("FontManifest.json orderCount"),
    )
    words = F.array_distinct(F.regexp_extract_all("html", F.lit(r"[^\s<>\"]+"), F.lit(0)))
    return pages.select("page_id", F.explode(F.concat(made, words)).alias("value"))


@query()
def f38_string_kinds(t: Tables) -> DataFrame:
    """Addresses, libraries, routes, Chinese texts and names among the strings of whole pages."""
    found = page_strings(t.pages).select("page_id", F.explode(R.string_kinds("value")).alias("k"))
    return found.select("page_id", "k.kind", "k.value").distinct()


_SOURCES = ("META-INF/CERT.rsa", "assets/LICENSE.txt", "classes.dex", "sources/androidx/a/B.java", "sources/com/shop/C.java", "x/sources/kotlin/K.java", "com/google/G.java", "META-INF/x.txt")


@query(f"WITH v AS (SELECT DISTINCT o_custkey AS value, {_listed(_SOURCES)}[1 + o_orderkey % 7 % (1 + o_custkey % 8)] AS source FROM orders), j AS (SELECT value, bool_or(NOT regexp_matches(source, '(?i)META-INF/.*\\.(?:RSA|DSA|EC|SF|MF)$|NOTICE|LICENSE')) FILTER (NOT ends_with(source, '.java')) AS other, bool_and(regexp_matches(source, 'androidx/|kotlin/|com/google/')) FILTER (ends_with(source, '.java')) AS framework FROM v GROUP BY 1) SELECT value, source FROM v JOIN j USING (value) WHERE coalesce(other, true) AND NOT coalesce(framework, false)")
def e05_noise_sources(t: Tables) -> DataFrame:
    """Values of which not all sources are licences, signatures or a framework's code."""
    at = F.col("o_orderkey") % 7 % (F.col("o_custkey") % 8 + 1)
    values = t.orders.select(F.col("o_custkey").alias("value"), _pick(_SOURCES, at).alias("source")).distinct()
    return R.worth_keeping(values, ["value"], "source")


_PRODUCTS_KNOWN = (Fingerprint("pay", ("com.shop.pay", "com.shop.old"), r"init\(\"[0-9a-f]{3,}\"\)$"), Fingerprint("map", ("org.map",)), Fingerprint("none", ("no.such",)), Fingerprint("licence", ("Apache",), r"^Licensed"))


@query("""WITH d AS (SELECT source || lang AS app, doc_id % 3 AS m, doc_id % 4 AS e, doc_id % 5 = 0 AS i, text FROM documents), p AS (
  SELECT app, 'pay' AS product, CASE WHEN e IN (0, 2) OR m = 0 THEN ['com.shop.pay'] ELSE [] END AS named, i AND m <> 0 AS seen FROM d
  UNION ALL SELECT app, 'map', CASE WHEN m = 1 THEN ['org.map'] ELSE [] END, true FROM d
  UNION ALL SELECT app, 'licence', CASE WHEN regexp_matches(text, 'Apache[./;$]') THEN ['Apache'] ELSE [] END, regexp_matches(text, '(?m)^Licensed') FROM d
) SELECT app, product, list_sort(list_distinct(flatten(list(named)))) AS prefixes FROM p GROUP BY 1, 2 HAVING len(flatten(list(named))) > 0 AND bool_or(seen)""")
def e08_products_in_use(t: Tables) -> DataFrame:
    """Products in the sources of each origin and language, by names and patterns outside their own code."""
    k = F.col("doc_id")
    text = F.concat("text", F.lit(" com/shop/pay"), _pick((";", "_", ".a", ","), k), F.lit("\n"), F.when(k % 5 == 0, 'init("beef")').otherwise('init("be")'), F.lit("\n"))
    path = F.when(k % 3 == 0, "src\\com\\shop\\pay\\A.java").when(k % 3 == 1, "lib/org/map/B.kt").otherwise("a/X.java")
    texts = t.documents.select(F.concat("source", "lang").alias("app"), path.alias("source"), text.alias("text"))
    return R.products_in_use(texts, _PRODUCTS_KNOWN)


_ENTRIES = ("assets/apps/__A/www/manifest.json", "assets/apps/__A/www/app-service.js", "assets/apps/__A/www/index.html", "assets/apps/__A/www/hybrid/html/x.js", "assets/apps/__A/www/app-confusion.js", "classes.dex", "assets/apps/__A/mani.json", "res/a.xml", "lib/app-view.js")
_CONFUSION = ('{"plus": {"confusion": {"a": 1}}, "confusion": ""}', '{"app-plus": {"confusion": "x"}, "confusion": []}', '{"confusion": {"b": [2]}, "plus": {"confusion": {}}}', '{broken confusion', '{"plus": 1}', "", "[]")


@query(f"""WITH e AS (SELECT o_custkey AS app, {_listed(_ENTRIES)}[1 + o_orderkey % 9 % (1 + o_custkey % 10)] AS name, o_orderkey % 7 AS c, o_orderkey % 4 AS s FROM orders),
j AS (SELECT *, ends_with(name, '/manifest.json') OR ends_with(name, '/mani.json') AS manifest, regexp_matches(name, '/(app-service|app-view)\\.js$|/index\\.html$') AS script FROM e)
SELECT app, CASE WHEN bool_or(ends_with(name, '/app-service.js') OR (script AND s = 1)) THEN CASE WHEN bool_or(contains(name, '/www/hybrid/html/') OR (script AND s = 2)) THEN '混合' ELSE 'uni-app' END WHEN bool_or(starts_with(name, 'assets/apps/')) THEN 'h5壳' ELSE 'unknown' END AS tech_type,
  list_sort(list_distinct(list_filter(list(CASE WHEN ends_with(name, '/app-confusion.js') THEN 'app-confusion.js' WHEN manifest THEN name || CASE c WHEN 0 THEN ':plus.confusion' WHEN 1 THEN ':app-plus.confusion' WHEN 2 THEN ':confusion' WHEN 3 THEN ':confusion_text' END END), lambda x: x IS NOT NULL))) AS details
FROM j GROUP BY 1""")
def e17_web_packages(t: Tables) -> DataFrame:
    """Kind and signs of obfuscation of every customer's package, whose entries are the orders."""
    k = F.col("o_orderkey")
    name = _pick(_ENTRIES, k % 9 % (F.col("o_custkey") % 10 + 1))
    script = _pick(("plain", "x=__uniConfig;", "plus.webview.create()", ""), k)
    text = F.when(name.rlike(r"\.json$"), _pick(_CONFUSION, k)).otherwise(script)
    found = R.web_packages(t.orders.select(F.col("o_custkey").alias("app"), name.alias("name"), text.alias("text")))
    return found.select("app", "tech_type", "details")


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/octet-stream' WHEN 4 THEN 'application/vnd.android.dex' END AS mime, page_id % 6 = 0 AND strlen(html) + 4 <= 524288000 AS accepted FROM pages")
def s22_mime_check(t: Tables) -> DataFrame:
    """The type of files made of whole pages behind the first bytes of a kind, and whether they may be taken for packages."""
    m, html = F.col("page_id") % 6, F.encode("html", "UTF-8")
    content = F.when(m == 5, None).otherwise(F.concat(F.unhex(_pick(("504B0304", "89504E470D0A1A0A", "", "00", "6465780A", ""), m)), html))
    mime = R.mime_type("content")
    return t.pages.select("page_id", content.alias("content")).select("page_id", mime.alias("mime"), F.coalesce((mime == "application/zip") & (F.octet_length("content") <= 500 << 20), F.lit(False)).alias("accepted"))
