"""Sources, listings, archives and messages: name resolution, signatures, blocks, entries and directories, on texts derived from the tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.operators import archives as A
from quarrion.operators import constants as C
from quarrion.operators import frameworks as W
from quarrion.operators import listings as B
from quarrion.operators import requests as R
from quarrion.operators import signatures as G
from quarrion.operators.extract import pieces_of
from quarrion.plans.registry import Tables, query


def _string(c: Column | str) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def java_sources(parts: DataFrame) -> DataFrame:
    """(app, path, text, k): a Java class for each part, in the package of its brand, whose PATH is its parent's and its own NAME.

    The parent of part k is k / 10, whose class is imported but for every 37th; the PATH of every 25th is that of part
    10 k, where there is one, which makes a circle.
    """
    brand = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    own = parts.select(F.col("p_partkey").alias("k"), brand("p_brand").alias("brand"), "p_name")
    up = own.select(F.col("k").alias("parent"), F.col("brand").alias("above"))
    down = own.select(F.col("k").alias("child"), F.col("brand").alias("below"))
    tree = own.withColumns({"parent": F.floor(F.col("k") / 10), "child": F.when(F.col("k") % 25 == 0, F.col("k") * 10)})
    linked = tree.join(up, "parent", "left").join(down, "child", "left")
    other = F.when(F.col("below").isNotNull(), F.col("child")).otherwise(F.when(F.col("k") >= 10, F.col("parent")))
    package = F.coalesce("below", "above")
    call = F.lit('  void run() { Sdk.init(/* first, */ PATH, "id," + NAME, f(1, 2)); }\n')
    fields = F.concat(F.lit('  public static final String NAME = "'), "p_name", F.lit('"; // shown\n  static final String\n    PATH = '), F.when(other.isNull(), "NAME").otherwise(F.concat(F.lit("(P"), _string(other), F.lit('.PATH + "/") /* up; */ + NAME'))), F.lit(";\n"))
    imported = F.when(other.isNotNull() & (F.col("k") % 37 != 0), F.concat(F.lit("import shop."), package, F.lit(".P"), _string(other), F.lit(";\n"))).otherwise("")
    text = F.concat(F.lit("package shop."), "brand", F.lit(";\n"), imported, F.lit("public class P"), _string("k"), F.lit(" {\n"), fields, call, F.lit("}\n"))
    path = F.concat(F.lit("shop/"), "brand", F.lit("/P"), _string("k"), F.lit(".java"))
    return linked.select(F.lit("shop").alias("app"), path.alias("path"), text.alias("text"), "k")


_J21 = """
WITH RECURSIVE own AS (SELECT p_partkey AS k, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand, p_name AS name FROM part),
tree AS (SELECT o.*, CASE WHEN d.k IS NOT NULL THEN d.k WHEN o.k >= 10 THEN o.k // 10 END AS other FROM own o LEFT JOIN own d ON o.k % 25 = 0 AND d.k = o.k * 10),
bound AS (SELECT t.* FROM tree t JOIN own u ON u.k = t.other WHERE t.k % 37 <> 0 OR u.brand = t.brand),
walk AS (
  SELECT k, name AS path, 2 AS n FROM tree WHERE other IS NULL
  UNION ALL SELECT b.k, walk.path || '/' || b.name, n + 2 FROM bound b JOIN walk ON b.other = walk.k
)
SELECT k, path AS value, n FROM own LEFT JOIN walk USING (k)
"""


@query(_J21)
def j21_resolved_constants(t: Tables) -> DataFrame:
    """The PATH of every part's class, resolved over imports and packages, however deep it nests and long it gets."""
    sources = java_sources(t.part)
    asked = sources.select("app", F.col("path").alias("unit"), F.col("k").alias("id"), F.lit("PATH").alias("expression"))
    out = C.resolved(C.units(sources), asked, depth=None, definitions="names")
    return out.select(F.col("id").alias("k"), "value", F.when(F.col("value").isNotNull(), F.size("definitions")).alias("n"))


@query(f"WITH v AS ({_J21.strip()}) SELECT k, place, CASE place WHEN 0 THEN v.value WHEN 1 THEN 'id,' || p_name END AS value, CASE WHEN place = 1 OR (place = 0 AND v.value IS NOT NULL) THEN 'resolved' WHEN place = 2 THEN 'missing' END AS status FROM v JOIN part ON p_partkey = k, unnest([0, 1, 2]) AS u(place)")
def e10_resolved_arguments(t: Tables) -> DataFrame:
    """The values of the arguments of every class's call, over constants of other files, however deep they nest and long they get."""
    out = C.resolved_arguments(java_sources(t.part), "init", depth=None, definitions="none")
    k = F.regexp_extract("unit", "P([0-9]+)", 1).cast("long")
    return out.select(k.alias("k"), F.col("at").alias("place"), "value", F.when((F.col("at") > 0) | F.col("value").isNotNull(), F.col("status")).alias("status"))


def messages(events: DataFrame) -> DataFrame:
    """(event_id, message): error messages made of a cause, a signature of any class and a detail, chosen by the event's numbers."""
    pick = lambda words, c: F.get(F.array(*map(F.lit, words)), F.pmod(c, F.lit(len(words))).cast("int"))
    causes = ("adb: ", "shell: ", "Phone Agent error: ", "Plan Model error: ", "MinIO error: ", "error: ", " \n", "host worker: ")
    details = (": closed", " (no status)", " after 30s", ", device '10.0.0.1:5555' not found", "", " ADB gone")
    signature = pick((*G.DEVICE, *G.PACKAGE, G.NO_WINDOW, "timeout", "closed"), F.col("event_id"))
    shouted = F.when(F.col("event_id") % 3 == 0, F.upper(signature)).otherwise(signature)
    return events.select("event_id", F.concat(pick(causes, F.col("user_id")), shouted, pick(details, F.floor(F.col("value"))), F.lit(" "), "event_type").alias("message"))


def _contains(words) -> str:
    quoted = (w.replace("'", "''") for w in words)
    return "(" + " OR ".join(f"contains(m, '{w}')" for w in quoted) + ")"


def _messages_sql() -> str:
    pick = lambda words, c: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][1 + ({c}) % {len(words)}]"
    causes = ("adb: ", "shell: ", "Phone Agent error: ", "Plan Model error: ", "MinIO error: ", "error: ", " \n", "host worker: ")
    details = (": closed", " (no status)", " after 30s", ", device '10.0.0.1:5555' not found", "", " ADB gone")
    signature = pick((*G.DEVICE, *G.PACKAGE, G.NO_WINDOW, "timeout", "closed"), "event_id")
    return f"SELECT event_id, lower(trim({pick(causes, 'user_id')} || {signature} || {pick(details, 'CAST(floor(value) AS BIGINT)')} || ' ' || event_type, ' ' || chr(10))) AS m FROM events"


_DEVICE_SQL = f"((contains(m, 'device ''') AND contains(m, ' not found')) OR {_contains(G.DEVICE)})"
_RUNTIME_SQL = f"""(NOT starts_with(m, '{G.PLAN_ERROR}') AND ({_contains(G.RUNTIME)} OR (contains(m, 'device ''') AND contains(m, ' not found')) OR (starts_with(m, '{G.AGENT_ERROR}') AND contains(m, '{G.NO_WINDOW}'))
  OR ({_contains((*G.BRIDGE, G.SHELL))} AND {_contains(G.RUNTIME_BESIDE)}) OR contains(m, '{G.SHELL_TIMEOUT}') OR (contains(m, 'closed') AND {_contains(G.BRIDGE)})))"""


@query(f"SELECT event_id, d AS device_error, p AS package_error, r AS runtime_error, CASE WHEN d THEN 'device' WHEN p THEN 'package' WHEN r THEN 'runtime' ELSE 'other' END AS kind FROM (SELECT event_id, {_DEVICE_SQL} AS d, {_contains(G.PACKAGE)} AS p, {_RUNTIME_SQL} AS r FROM ({_messages_sql()}))")
def p14_error_signatures(t: Tables) -> DataFrame:
    """Messages of every signature in every context, classified."""
    return G.classified(messages(t.events), "message").select("event_id", "device_error", "package_error", "runtime_error", "kind")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'he')) + len(regexp_extract_all(lower(text), 'licen')) AS n, nullif(strpos(lower(regexp_replace(text, '^\\s+', '')), 'licen') - 1, -1) AS first FROM documents")
def p14_document_hits(t: Tables) -> DataFrame:
    """All occurrences, overlapping ones included, of three signatures in whole documents."""
    hits = G.with_hits(t.documents.select("doc_id", "text"), "text", ("the", "he", "licen"))
    first = F.filter("hits", lambda h: h["signature"] == "licen")
    return hits.select("doc_id", F.size("hits").cast("long").alias("n"), F.get(first, F.lit(0))["at"].cast("long").alias("first"))


def scripts(pages: DataFrame) -> DataFrame:
    """(page_id, text): pages with a script that asks for an address, and names one more at a distance that grows with the page's number."""
    far = F.repeat(F.lit("/*-*/"), (F.col("page_id") % 60).cast("int"))
    route = F.concat(F.lit("/api/v"), (F.col("page_id") % 3).cast("string"), F.lit("//item?id="), F.col("page_id").cast("string"))
    script = F.concat(F.lit('<script>let u="'), "url", F.lit('";'), far, F.lit("\nuni.request({url:`"), route, F.lit("`});"), far, F.lit("x='wss://s"), _string("page_id"), F.lit(".example.org:8443/ws/on?k=1'</script>"))
    return pages.select("page_id", F.concat("html", script).alias("text"))


@query()
def e12_request_context(t: Tables) -> DataFrame:
    """Every mention of an address, path or string in whole pages, with what its window makes of it."""
    rows = R.mined(R.mentions(scripts(t.pages), "page_id", "text"), "page_id", (*R.SEGMENTS, "en", "fr", "de", "es"))
    return rows.select("page_id", "kind", "at", F.md5("value").alias("digest"), F.length("before").alias("n_before"), F.length("after").alias("n_after"), "in_context", "route", "service", "domain")


def listings(orders: DataFrame) -> DataFrame:
    """(app, path, text): the listing of a library for each order; a customer's orders are an app."""
    k, s = _string("o_orderkey"), F.col("o_orderstatus")
    line = lambda on, x: F.when(on, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x), F.lit("\n"))).otherwise("")
    m = F.col("o_orderkey") % 7
    uri = F.when(m == 0, F.concat(F.lit("package:shop"), _string(F.col("o_custkey") % 3), F.lit("/o"), k, F.lit(".dart"))).when(m == 1, F.concat(F.lit("file:///build/app"), _string("o_custkey"), F.lit("/lib/main.dart"))).when(m == 2, "dart:core").when(m == 3, "package:dio/dio.dart").when(m == 4, F.concat(F.lit("one"), k)).otherwise(F.concat(F.lit("package:own/o"), k, F.lit(".dart")))
    widget = F.concat(F.lit("Order"), k, F.when(F.col("o_orderkey") % 2 == 0, "App").otherwise("Page"), F.lit("<T, List<T>>"))
    made = F.concat(F.lit("Order"), k, F.when(F.col("o_orderkey") % 2 == 0, "App").otherwise("Page"))
    urgent = F.startswith("o_orderpriority", F.lit("1"))
    text = F.concat(
        line(F.lit(True), ("// lib: x, url: ", uri, " ")), line(F.lit(True), ("class ", widget, " extends StatelessWidget {")),
        line(F.col("o_custkey") % 4 < 2, ("  Widget build(BuildContext c) {\n    // 0x10: r0 = AllocateMaterialAppStub -> MaterialApp\n  }",)),
        line(s == "F", ("  static void main() {",)), line((s == "F") & urgent, ("    // 0x14: r1 = Allocate", made, "Stub")), line(s == "F", ("    // 0x18: \"https://api", _string(F.col("o_custkey") % 5), ".example.org:8443/x\"\n  }",)),
        line(s == "P", ("  static start() {\n    // 0x1c: r0 = runApp()\n    // \"cdn.example.com\" \"http://10.0.0.1/\"\n  }",)), line(urgent, ("  // r2 = runApp()",)), F.lit("}\n"),
    )
    return orders.select(_string("o_custkey").alias("app"), F.concat(F.lit("asm/"), k, F.when(F.col("o_orderkey") % 5 == 0, "/main.dart").otherwise("/lib.dart")).alias("path"), text.alias("text"))


@query()
def e13_entry_location(t: Tables) -> DataFrame:
    """Where each customer's app begins, with its libraries, classes and addresses."""
    return B.summary(B.libraries(listings(t.orders)))


def line_listings(lines: DataFrame) -> DataFrame:
    """(path, text): a listing for each order, a class with a function a line, of which every fifth nests and the last is not closed."""
    n, p = _string("l_linenumber"), _string("l_partkey")
    body = F.concat(
        F.lit("  void f"), n, F.lit("() async {\n    // 0x10: mov x1, x"), (F.col("l_linenumber") + 1).cast("string"), F.lit("\n"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit("    if (a) {\n      0xA4: ldr x3, [x27, #0x20] ; \"in\"\n    }\n")).otherwise(""),
        F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("    // 0x14: add w0, w1, #"), p, F.lit(" ; [pp+0x9] \"p"), p, F.lit("\" \"dart:core\"\n"))).otherwise(""), F.lit("    // Goto: B1\n  }\n"),
    )
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", body.alias("body"))))
    joined = F.array_join(F.transform(parts, lambda x: x["body"]), "")
    return lines.groupBy("l_orderkey").agg(joined.alias("b")).select(_string("l_orderkey").alias("path"), F.concat(F.lit("// lib\nabstract class O"), _string("l_orderkey"), F.lit(" extends Object {\n"), F.expr("substring(b, 1, length(b) - 4)")).alias("text"))


_E14 = """
WITH f AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS path, row_number() OVER w - 1 AS function_no, l_partkey % 5 = 0 AS nests, l_partkey % 3 > 0 AS adds, CAST(l_partkey AS VARCHAR) AS p, lead(l_linenumber) OVER w IS NOT NULL AS closed
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)
), g AS (
  SELECT *, list_sort(list_filter([CASE WHEN nests THEN 'in' END, CASE WHEN adds THEN 'p' || p END], lambda x: x IS NOT NULL)) AS strings, array_to_string(list_filter(['mov reg,reg', CASE WHEN nests THEN 'ldr reg,[pp,#imm]' END, CASE WHEN adds THEN 'add reg,reg,#imm' END], lambda x: x IS NOT NULL), chr(10)) AS code FROM f
)
SELECT path, 0 AS class_no, function_no, closed, strings, left(sha256(code), 16) AS fingerprint FROM g WHERE len(strings) > 0
"""


@query(_E14)
def e14_block_features(t: Tables) -> DataFrame:
    """The function blocks of every order's listing that have a telling string."""
    found = B.block_features(B.blocks(line_listings(t.lineitem)))
    return found.select("path", "class_no", F.col("function_no").cast("long"), "closed", "strings", "fingerprint")


def packed(documents: DataFrame) -> DataFrame:
    """(path, content): an archive for each document, behind as many foreign bytes as its id modulo 50: its text, an archive with its source, and a picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces_of(b)):
            for doc, text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inner, outer = io.BytesIO(), io.BytesIO(b"\x7f" * (doc % 50))
                outer.seek(0, io.SEEK_END)
                with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"in/{source}.txt", source)
                with zipfile.ZipFile(outer, "a", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{lang}/{doc}.txt", text)
                    z.writestr("inner.zip", inner.getvalue())
                    z.writestr("p.PNG", b"picture", zipfile.ZIP_STORED)
                yield pa.RecordBatch.from_arrays([pa.array([str(doc)]), pa.array([outer.getvalue()], pa.binary())], names=["path", "content"])

    return documents.select("doc_id", F.coalesce("text", F.lit("")), "lang", "source").mapInArrow(run, "path string, content binary")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, unnest([lang || '/' || doc_id || '.txt', 'inner.zip', 'p.PNG']) AS entry, unnest([strlen(text), NULL, 7]) AS length, unnest([8, 8, 0]) AS method, unnest([doc_id % 50, NULL, NULL]) AS at FROM documents")
def s09_archive_directories(t: Tables) -> DataFrame:
    """Entries of an archive a document, from its directory."""
    entry = A.listed(packed(t.documents))
    known = F.when(F.col("entry") != "inner.zip", F.col("length"))
    return entry.select("path", "entry", known.alias("length"), "method", F.when(F.endswith("entry", F.lit(".txt")), F.col("at")).alias("at"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, unnest([lang || '/' || doc_id || '.txt', 'inner.zip!in/' || source || '.txt']) AS entry, unnest([md5(text), md5(source)]) AS digest FROM documents WHERE strlen(text) <= 1048576 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'inner.zip!in/' || source || '.txt', md5(source) FROM documents WHERE strlen(text) > 1048576")
def s08_carved_entries(t: Tables) -> DataFrame:
    """What is carved out of an archive a document, behind foreign bytes and one archive deep."""
    return A.carved_entries(packed(t.documents)).select("path", "entry", F.md5("content").alias("digest"))


@query("WITH t AS (SELECT doc_id, translate(text, 'aeiou', '漢字文本語') AS x FROM documents), r AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(x, '[\t -~]+'), lambda s: trim(s, ' ' || chr(9))), lambda s: length(s) >= 3) AS one, regexp_extract_all(x, '[㐀-䶿一-鿿]{2,128}') AS two FROM t) SELECT doc_id, len(one) AS n_ascii, len(two) AS n_cjk, md5(array_to_string(list_concat(one, two), chr(1))) AS digest FROM r")
def f42_text_runs(t: Tables) -> DataFrame:
    """ASCII and Chinese runs in the bytes of whole documents, whose vowels are replaced by Chinese characters."""
    data = F.encode(F.translate("text", "aeiou", "漢字文本語"), "UTF-8")
    found = t.documents.select("doc_id", A.runs(data).alias("r"))
    wide = F.filter("r", lambda x: x.rlike("^[\u3400-\u9fff]"))
    return found.select("doc_id", (F.size("r") - F.size(wide)).cast("long").alias("n_ascii"), F.size(wide).cast("long").alias("n_cjk"), F.md5(F.array_join("r", "\x01")).alias("digest"))


_NAMES = (
    "lib/arm64-v8a/libapp.so", "lib/arm64-v8a/libflutter.so", "lib/x86/libflutter.so", "assets/index.android.bundle", "lib/x86/libhermes_executor.so", "lib/x86/libjsc.so",
    "assets/apps/__UNI__A/www/index.html", "assets/apps/__UNI__B/x.txt", "assets/apps/../www/index.html", "assets/data/dcloud_control.xml", "lib/x86/libweexcore.so", "lib/x86/libil2cpp.so",
    "assets/bin/Data/global-metadata.dat", "lib/x86/libUE4.so", "assemblies/a.dll", "lib/x86/libmonosgen-2.0.so", "assets/www/cordova.js", "res/xml/config.xml", "assets/public/index.html",
    "assets/capacitor.config.json", "assets/widget/config", "com/apicloud/a.class", "lib/x86/libcocos2djs.so", "assets/src/project.json", "classes.dex", "AndroidManifest.xml", "res/layout/a.xml",
)


def _f37() -> str:
    last, seen = "regexp_extract(name, '[^/]*$', 0)", lambda on, x: f"arg_min({x}, position) FILTER ({on})"
    columns, structs = [], []
    for i, (framework, signs) in enumerate(W.RULES):
        for j, (kind, sign) in enumerate(signs):
            columns.append(seen(f"ends_with(name, '.so') AND contains({last}, '{sign}')", f"'lib/*/' || {last}") + f" AS e{i}_{j}" if kind == "so" else seen(f"contains(name, '{sign}')", "name") + f" AS e{i}_{j}")
        score = " + ".join(f"(e{i}_{j} IS NOT NULL)::INT" for j in range(len(signs)))
        score = {W.FLUTTER: "CASE WHEN len(list_intersect(abis0, abis1)) > 0 THEN 2 ELSE 0 END", W.DCLOUD: "CASE WHEN direct THEN 3 WHEN weak AND launcher THEN 2 ELSE 0 END"}.get(framework, score)
        structs.append(f"{{'less': -({score}), 'ord': {i}, 'framework': '{framework}'}}")
    abis = [f"coalesce(list(DISTINCT regexp_extract(name, '^lib/([^/]+)/{lib}$', 1)) FILTER (regexp_matches(name, '^lib/[^/]+/{lib}$')), []) AS abis{i}" for i, lib in enumerate(W.PAIR)]
    direct = "bool_or(regexp_matches(name, '^assets/apps/[A-Za-z0-9_-][A-Za-z0-9_.-]*/www/(manifest.json|index.html|app-config-service.js)$')) AS direct"
    weak = "bool_or(ends_with(name, '/dcloud_control.xml') OR regexp_matches(name, '^assets/apps/[A-Za-z0-9_-][A-Za-z0-9_.-]*/') OR ends_with(name, '/libweexcore.so')) AS weak"
    listed = ", ".join(f"'{n}'" for n in _NAMES)
    return f"""WITH e AS (SELECT l_orderkey AS app, l_linenumber AS position, [{listed}][1 + l_partkey % {len(_NAMES)}] AS name FROM lineitem),
    g AS (SELECT app, {", ".join([*columns, *abis, direct, weak])} FROM e GROUP BY app),
    r AS (SELECT app, list_sort(list_filter([{", ".join(structs)}], lambda m: m.less < 0)) AS m FROM (SELECT g.*, o_custkey % 3 = 0 AS launcher FROM g JOIN orders ON o_orderkey = app))
    SELECT app, coalesce(m[1].framework, '{W.NATIVE}') AS framework, CASE WHEN len(m) = 0 THEN 'default' WHEN m[1].less <= -2 THEN 'high' ELSE 'low' END AS confidence, array_to_string(list_transform(m, lambda x: x.framework || -x.less), ',') AS scores FROM r"""


@query(_f37())
def f37_frameworks(t: Tables) -> DataFrame:
    """The framework of every order, its lines read as entries of a package."""
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("l_partkey") % len(_NAMES)).cast("int"))
    entries = t.lineitem.select(F.col("l_orderkey").alias("app"), F.col("l_linenumber").alias("position"), name.alias("name"))
    launchers = t.orders.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("app"), F.lit("io.dcloud.PandoraEntry").alias("launcher"))
    found = W.detected(entries, launchers)
    return found.select("app", "framework", "confidence", F.array_join(F.transform("matches", lambda m: F.concat(m["framework"], m["score"].cast("string"))), ",").alias("scores"))
