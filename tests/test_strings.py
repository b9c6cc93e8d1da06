"""Kinds of strings, vendors, products, sources, web packages, located items and one-scan collectors against plain versions."""

import json
import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from quarrion.operators import extract as E
from quarrion.operators import recognition as R
from quarrion.plans import strings
from quarrion.plans.registry import Tables
from quarrion.sources import readers, sinks


def plain_noise(v):
    low = v.strip().lower()
    return not low or low.startswith(R.NOISE_STARTS) or any(m in low for m in R.NOISE_PARTS)


def plain_kinds(raw):
    v = re.sub(r"\s+", " ", raw or "").strip()
    if plain_noise(v):
        return set()
    bare, out = lambda x: x.rstrip(".,;:)]}"), set()
    url = re.compile(r"(?:https?|wss?|ftp)://[^\s\"'<>]{4,2048}", re.I)
    for u in map(bare, url.findall(v)):
        host = (urlsplit(u).hostname or "").lower()
        labels = host.split(".")
        if len(labels) > 1 and all(labels) and re.fullmatch(r"[a-z]{2,63}|\d{1,3}", labels[-1]) and host not in R.FRAMEWORK_HOSTS and not host.endswith((".flutter.dev", ".dart.dev")):
            out.add(("url", u))
    for form in (r"package:[A-Za-z0-9_./@+\-]+", r"file:///[A-Za-z0-9_%./@+~:\-]+", r"org-dartlang-app:[A-Za-z0-9_%./@+~:\-]+"):
        out |= {("library_uri", u) for u in map(bare, re.findall(form, v)) if u and not plain_noise(u)}
    rest = url.sub(" ", v)
    if "file://" not in rest.lower() and "package:" not in rest.lower():
        for r in map(bare, re.findall(r"(?<![A-Za-z0-9])/(?:[A-Za-z0-9_.~:@+\-]+/?){1,12}(?:\?[A-Za-z0-9_%&=.+:@/\-]*)?", rest)):
            path = r.lower().split("?")[0]
            parts = [s for s in path.split("/") if s]
            if 4 <= len(r) <= 256 and not r.lower().startswith(R.NO_ROUTES) and not path.endswith(R.FILE_ENDS) and parts and (parts[0] == "api" or re.fullmatch(r"v\d+", parts[0]) or set(parts) & set(R.ROUTE_HINTS)):
                out.add(("api_route", r))
    if sum("㐀" <= c <= "鿿" for c in v) >= 2:
        out.add(("chinese_text", v))
    if 5 <= len(v) <= 120 and not re.search(r"[/\\ \t\n?&=#]", v) and v not in R.COMMON_NAMES:
        if re.fullmatch(r"[a-z][A-Za-z0-9]*(?:\.[a-z][A-Za-z0-9]*)*", v) and re.search("[a-z][A-Z]", v):
            out.add(("camel_case", v))
        if re.fullmatch(r"[a-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+", v):
            out.add(("structured_key", v))
    return out


def test_string_kinds_of_whole_pages(spark, sf_dir):
    rows = [r.value for r in strings.page_strings(Tables(spark, sf_dir).pages).select("value").distinct().collect()]
    rows += [None, "", "http://user:pw@Host.Example.com:80/a b http://1.2.3.4/x http://a..b/x https://x.dart.dev/y", "ab_1", "aB", "abcdE", "ABC_DEF", "a.bC.d", "漢", "x漢字y", "dart:core", "/api", "/v12/x?y=/z", "xx/api/y", "//api/z", "/a/b/token.json?x"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v string")
    got = {r.i: {tuple(k) for k in r.k} for r in df.select("i", R.string_kinds("v").alias("k")).collect()}
    for i, v in enumerate(rows):
        assert got[i] == plain_kinds(v), v
    assert {k for g in got.values() for k, _ in g} == set(R.KINDS)


def test_vendors_in_their_order(spark):
    rows = ["Bangcle SecNeo", "360 jiagu", "proguard with dexguard", "kiro", "akirob", "", None, "  some packer ", "UPX", "upxed"]
    got = {r.d: r.v for r in spark.createDataFrame([(d,) for d in rows], "d string").select("d", R.vendor("d").alias("v")).collect()}
    want = {d: next(((cn, en, p, free) for pattern, cn, en, p, free in R.VENDORS if re.search(pattern, (d or "").strip(), re.I)), ("其他", "Other", (d or "").strip() or "Unknown", False)) for d in rows}
    assert {d: tuple(v) for d, v in got.items()} == want and len(R.VENDORS) == 48
    names = ["Flutter", "UNI-APP", "原生 x", "Unity", "", None]
    assert [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(R.strategy("n").alias("s")).collect()] == ["flutter", "dcloud", "native", "framework_component", None, None]


def test_products_need_names_and_marks_outside_their_own_code(spark):
    known = [E.Fingerprint("pay", ("com.pay",), r"key=\d+"), E.Fingerprint("map", ("org.map", "org.maps"))]
    rows = [
        ("a", "x.java", "import com.pay.Api;"), ("a", "com/pay/Core.java", "key=12"), ("b", "x.java", "com/pay;"), ("b", "y.txt", "a\nkey=1"), ("c", "z.xml", "com.payments key=1"), ("c", "z.smali", "org/map$1"),
        ("d", "q/org/maps/X.kt", None), ("d", None, "org.map"), ("e", "lib\\org\\map\\X.kt", ""), ("f", "com/pay/Core.txt", "key=12 "), (None, "org/map/Y.java", "x"),
    ]
    got = {(r.app, r["product"]): r.prefixes for r in R.products_in_use(spark.createDataFrame(rows, "app string, source string, text string"), known).collect()}
    assert got == {("b", "pay"): ["com.pay"], ("c", "map"): ["org.map"], ("d", "map"): ["org.map", "org.maps"], ("e", "map"): ["org.map"], ("f", "pay"): ["com.pay"], (None, "map"): ["org.map"]}


def test_values_by_their_sources(spark):
    cases = {
        "signed": (["META-INF/A.RSA", "x/NOTICE"], False), "code": (["classes.dex", "META-INF/A.RSA"], True), "framework": (["classes.dex", "sources/androidx/A.java", "kotlin/B.java"], False),
        "mixed": (["classes.dex", "androidx/A.java", "sources/com/own/B.java"], True), "both": (["LICENSE", "sources/com/own/B.java"], False), "java": (["com/own/B.java"], True), "rsa": (["META-INF/x.RSA.txt"], True),
    }
    df = spark.createDataFrame([(v, s) for v, (sources, _) in cases.items() for s in sources], "v string, s string")
    assert {r.v for r in R.worth_keeping(df, ["v"], "s").collect()} == {v for v, (_, kept) in cases.items() if kept}


def test_kinds_of_web_packages(spark):
    rows = [
        ("uni", "assets/apps/X/www/app-service.js", "x"), ("mixed", "assets/apps/X/www/index.html", "__uniRoutes loadURL(1)"), ("shell", "assets/apps/X/www/a.js", "__uniConfig"), ("none", "classes.dex", None),
        ("set", "assets/apps/X/manifest.json", json.dumps({"app-plus": {"confusion": {"a": 1}}, "confusion": {}, "plus": {"confusion": None}})), ("broken", "assets/apps/X/mani.json", "{ confusion"), ("file", "www/app-confusion.js", ""),
    ]
    got = {r.app: (r.tech_type, r.confused, r.details) for r in R.web_packages(spark.createDataFrame(rows, "app string, name string, text string")).collect()}
    assert got == {
        "uni": (R.UNI, False, []), "mixed": (R.MIXED, False, []), "shell": (R.SHELL, False, []), "none": (R.UNKNOWN, False, []), "set": (R.SHELL, True, ["assets/apps/X/manifest.json:app-plus.confusion"]),
        "broken": (R.SHELL, True, ["assets/apps/X/mani.json:confusion_text"]), "file": (R.UNKNOWN, True, ["app-confusion.js"]),
    }


def test_types_of_files(spark):
    rows = [("zip", b"PK\3\4x"), ("gz", b"\x1f\x8b\0"), ("text", "é text".encode()), ("zero", b"a\0b"), ("shifted", b"\x10\x01"), ("empty", b""), ("null", None)]
    got = {r.n: r.m for r in spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in rows], "n string, c binary").select("n", R.mime_type("c").alias("m")).collect()}
    assert got == {"zip": "application/zip", "gz": "application/gzip", "text": "text/plain", "zero": "application/octet-stream", "shifted": "text/plain", "empty": "text/plain", "null": None}


def test_items_are_located_however_short_they_are(spark):
    texts = {1: "xalpha beta gammay", 2: "one two", 3: "a b c dd", 4: "p one\ntwo three four five  six", 5: None, 6: "the one two three four five sixty"}
    items = {"i": "alpha beta gamma", "j": "one two", "k": "a b c d", "l": "ne two three four five six", "m": "", "n": None, "o": "two three four five  six", "p": " "}
    df, known = spark.createDataFrame(list(texts.items()), "k int, t string"), spark.createDataFrame(list(items.items()), "i string, w string")
    got = {(r.k, r.i) for r in E.located(df, "k", "t", known, "i", "w").collect()}
    assert got == {(k, i) for k, t in texts.items() for i, w in items.items() if t and w and w in t}
    assert {(1, "i"), (2, "j"), (3, "k"), (6, "l"), (4, "o")} <= got


def test_equal_items_are_located_once_in_whatever_numbers(spark, monkeypatch):
    """More different items than are broadcast, equal items of many keys, keys of several items and texts."""
    texts = [(1, "one two three four five six"), (1, "seven one two"), (2, "x one two three four five y"), (3, "three four"), (None, "seven")]
    items = [(k, "one two") for k in "abc"] + [("d", "one two three four five"), ("e", "seven"), ("a", "seven"), ("a", "three four"), ("f", "two three four five six"), (None, "y"), ("g", "x one two three four")]
    df, known = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(items, "i string, w string")
    want = sorted({(k, i) for k, t in texts for i, w in items if w in t}, key=str)
    for few in (100, 1):
        monkeypatch.setattr(E, "FEW_ITEMS", few)
        monkeypatch.setattr(E, "FEW_KEYS", few)
        got = [(r.k, r.i) for r in E.located(df, "k", "t", known, "i", "w").collect()]
        assert sorted(got, key=str) == want


def test_one_scan_feeds_several_collectors(spark, tmp_path):
    rows = [(i, "mail a@b.cd and " * (i % 3) + f"call {i}") for i in range(50)] + [(99, None)]
    spark.createDataFrame(rows, "i int, t string").write.parquet(str(tmp_path / "in"))
    scan = spark.read.parquet(str(tmp_path / "in"))
    at = lambda values: F.transform(values, lambda v: F.struct("i", v.alias("value")))
    collectors = {"mails": at(F.regexp_extract_all("t", F.lit(r"\w@\w\.\w+"), F.lit(0))), "numbers": at(F.regexp_extract_all("t", F.lit(r"[0-9]+"), F.lit(0))), "nothing": at(F.regexp_extract_all("t", F.lit("zz"), F.lit(0)))}
    found = sinks.collected(scan, str(tmp_path / "out"), **collectors)
    assert {n: sorted((r.i, r.value) for r in d.collect()) for n, d in found.items()} == {
        "mails": sorted((i, m) for i, t in rows if t for m in re.findall(r"\w@\w\.\w+", t)), "numbers": sorted((i, m) for i, t in rows if t for m in re.findall(r"[0-9]+", t)), "nothing": [],
    }
    assert not list((tmp_path / "out").glob("**/collector=nothing"))
    plan = scan.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), c.alias("r")) for n, c in collectors.items()))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    with pytest.raises(Exception, match="already exists"):
        sinks.collected(scan, str(tmp_path / "out"), **collectors)


def test_tables_of_a_database_by_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(i, f"name {i}", None if i % 7 == 0 else i * 1.5) for i in range(100)]
    spark.createDataFrame(rows, "ID int, NAME string, VALUE double").write.jdbc(url, "THINGS", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    whole = readers.jdbc(spark, url, "THINGS", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    parts = readers.jdbc(spark, url, "THINGS", key="ID", low=0, high=100, parts=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in parts.collect()) == sorted(rows)
    few = parts.where("ID >= 90").select("NAME")
    assert few.count() == 10 and "PushedFilters: [*IsNotNull(ID), *GreaterThanOrEqual(ID,90)]" in few._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_of_a_yaml_file(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "known.yaml"
    path.write_text("- product: pay\n  prefixes: [com.pay]\n  recognised_by: 'key=\\d+'\n  credentials:\n    - 'key=(?P<key>\\d+)'\n- {product: map, prefixes: [org.map]}\n")
    found = readers.fingerprints(spark, str(path))
    assert [f.product for f in found] == ["pay", "map"] and found[0].groups() == [(r"key=(\d+)", "key", 1)]
    path.write_text("- product: pay\n- product: pay\n")
    with pytest.raises(ValueError, match="fingerprint 1"):
        readers.fingerprints(spark, str(path))


def test_words_that_no_kind_can_hold_are_passed_over():
    import re

    told = ["https://a.example/x", "package:a/b", "file:///a", "/api/v1", "漢字", "orderCount", "order_item"]
    assert all(re.search(R._TELLING, x) for x in told) and not any(re.search(R._TELLING, x) for x in ("word", "Word,", "12.5", "ABC", ""))
