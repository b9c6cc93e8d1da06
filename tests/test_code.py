"""Name resolution, signatures, listings, archives and entries against plain versions."""

import contextlib
import hashlib
import io
import random
import re
import struct
import zipfile
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from quarrion.operators import archives as A
from quarrion.operators import constants as C
from quarrion.operators import frameworks as W
from quarrion.operators import listings as B
from quarrion.operators import requests as R
from quarrion.operators import signatures as G
from quarrion.plans import code
from quarrion.plans.registry import Tables


def plain_value(files, app, unit, expression, depth=0, seen=()):
    """The value of an expression by recursion over parsed files {(app, path): unit}; None if there is none."""
    if depth > C.DEPTH:
        return None
    found = C.parts(expression)
    if found is None:
        return None
    out = []
    for p in found:
        at = depth + p["level"]
        if at > C.DEPTH:
            return None
        if p["name"] is None:
            out.append(p["literal"])
            continue
        u = files.get((app, unit), {"package": "", "class": "", "imports": {}, "static_imports": {}})
        own = f"{u['package']}.{u['class']}" if u["package"] else u["class"]
        name, (first, dot, tail) = p["name"], p["name"].partition(".")
        ways = [name if dot else None, u["static_imports"].get(name), None if dot else f"{own}.{name}", f"{u['imports'][first]}.{tail}" if dot and first in u["imports"] else None, f"{u['package']}.{name}" if u["package"] else name]
        symbols = {}
        for (a, path), v in sorted(files.items(), reverse=True):
            if a == app:
                for f in v["fields"]:
                    symbols[(f"{v['package']}.{v['class']}" if v["package"] else v["class"]) + "." + f["field"]] = (path, f["expression"])
        target = next((w for w in ways if w and w in symbols), None)
        if target is None or target in seen:
            return None
        value = plain_value(files, app, *symbols[target], at + 1, (*seen, target))
        if value is None:
            return None
        out.append(value)
    value = "".join(out)
    return value if len(value) <= C.MOST_VALUE else None


SOURCES = {
    "a/A.java": """package a; // a comment
import b.B;
import static b.B.SHARED;
public final class A {
  public static final String ONE = "o\\n\\"e\\u0041\\101"; static final String URL = ("https://" + B.HOST) + ((SHARED)) + '/' ;
  static final String PATH = B.HOST + /* "x"; */ "/p;q" + ONE;
  String notConstant = "x"; static String alsoNot = "y";
  private static final java.lang.String CAST = (String) NEAR.HOST, MORE = "m";
  static final String CALL = B.host(); static final String LONG = "%s";
  static final String SELF = A.SELF + "x"; static final String TO = B.BACK; static final String AFTER = "z" + TO;
}""" % ("l" * 513),
    "b/B.java": 'package b;\ninterface B { static final String HOST = "h.example"; static final String SHARED = "s" + HOST; static final String BACK = a.A.TO; static final String GONE = Nowhere.X; static final String BY = GONE + "y"; }',
    "a/NEAR.java": 'package a; class NEAR { static final String HOST = "near"; }',
    "C.java": "".join(f"static final String N{i} = N{i - 1};\n" for i in range(1, 15)) + 'class C { static final String N0 = "deep"; static final String N0 = "last"; }',
}
ASKED = ["ONE", "URL", "PATH", "CAST", "CALL", "LONG", "SELF", "TO", "AFTER", "A.PATH", "a.A.PATH", "B.GONE", "B.BY", "b.B.SHARED + A.ONE", "SHARED", "NEAR.HOST", "x + 1", "", '"lit" + ("a" + ("b"))', "C.N7", "C.N8", "((((C.N7))))", '"a" + ("b" + C.N6)', '"a" + ("b" + C.N7)', "HOST"]


def test_files_are_parsed_once(spark):
    files = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            files.add(batch.num_rows)
            yield batch

    found = C.units(spark.createDataFrame([("x", p, t) for p, t in SOURCES.items()], "app string, path string, text string").coalesce(1))
    found = found.mapInArrow(counted, found.schema)
    asked = spark.createDataFrame([("x", "a/A.java", 0, "PATH")], "app string, unit string, id long, expression string")
    assert [r.status for r in C.resolved(found, asked).collect()] == ["resolved"] and files.value == len(SOURCES)


def test_constants_match_a_recursion(spark):
    rows = [("x", p, t) for p, t in SOURCES.items()] + [("y", "a/A.java", 'package a; class A { static final String ONE = "other app"; }'), ("y", "empty.java", None)]
    found = C.units(spark.createDataFrame(rows, "app string, path string, text string"))
    asked = [(app, unit, f"{app}{i}{unit}", e) for app, unit in (("x", "a/A.java"), ("x", "C.java"), ("x", "nowhere"), ("y", "a/A.java")) for i, e in enumerate(ASKED)]
    out = {r.id: r for r in C.resolved(found, spark.createDataFrame(asked, "app string, unit string, id string, expression string")).collect()}
    files = {(a, p): C.parse(p, t or "") for a, p, t in rows}
    assert len(out) == len(asked)
    for app, unit, i, e in asked:
        assert out[i].value == plain_value(files, app, unit, e), (unit, e)
        assert (out[i].status == "resolved") == (out[i].value is not None)
    by = {ASKED[i]: out[f"x{i}a/A.java"] for i in range(len(ASKED))}
    assert by["ONE"].value == 'o\n"eAA' and by["URL"].status == "missing" and by["PATH"].value == "h.example/p;qo\n\"eAA"
    assert [d.constant for d in by["PATH"].definitions] == ["a.A.PATH", "b.B.HOST", "a.A.ONE"]
    assert [by[e].status for e in ("SELF", "TO", "AFTER", "CALL", "B.GONE", "B.BY", "C.N7", "C.N8")] == ["cycle", "cycle", "cycle", "missing", "missing", "missing", "resolved", "deep"]
    assert by["C.N7"].value == "last" and by["CAST"].value is None


def test_constants_without_limits(spark):
    """Without a depth nothing is cut: chains beyond it, long values and circles end as they are."""
    found = C.units(spark.createDataFrame([("x", p, t) for p, t in SOURCES.items()], "app string, path string, text string"))
    asked = spark.createDataFrame([("x", "a/A.java", i, e) for i, e in enumerate(["C.N14", "LONG", "AFTER", "B.BY", "C.N8 + LONG + C.N8"])], "app string, unit string, id long, expression string")
    for definitions in ("names", "evidence", "none"):
        out = {r.id: r for r in C.resolved(found, asked, depth=None, definitions=definitions).collect()}
        assert [out[i].value for i in range(5)] == ["last", "l" * 513, None, None, "last" + "l" * 513 + "last"]
        assert [out[i].status for i in range(5)] == ["resolved", "resolved", "cycle", "missing", "resolved"]
        names = [d if definitions == "names" else d.constant for d in out[4].definitions] if definitions != "none" else None
        assert names is None or names == [*(f"C.N{i}" for i in range(8, -1, -1)), "a.A.LONG"]


def test_deep_paths_of_parts_have_values(spark, sf_dir, tmp_path):
    """Parts up to three names deep are no longer the only ones: of every part that hangs on no circle the PATH is known."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").limit(1)
    keys = spark.range(1, 20000, 1111).union(spark.createDataFrame([(k,) for k in (1, 11, 111, 1111, 11111, 111111)], "id long")).distinct()
    part.crossJoin(keys).withColumn("p_partkey", F.col("id")).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    out = {r.k: r for r in code.j21_resolved_constants(spark, str(tmp_path)).collect()}
    assert out[111111].value.count("/") == 5 and out[111111].n == 12 and out[11111].n == 10


def test_constants_of_no_files(spark):
    found = C.units(spark.createDataFrame([], "app string, path string, text string"))
    asked = spark.createDataFrame([("x", "u", 1, '"a" + "b"'), ("x", "u", 2, "A.B")], "app string, unit string, id long, expression string")
    assert sorted((r.id, r.value, r.status) for r in C.resolved(found, asked).collect()) == [(1, "ab", "resolved"), (2, None, "missing")]
    assert C.resolved(found, asked.limit(0)).collect() == []


def test_source_texts_of_all_parts_parse(spark, sf_dir):
    rows = code.java_sources(Tables(spark, sf_dir).part).collect()
    for r in rows:
        u = C.parse(r.path, r.text)
        assert [f["field"] for f in u["fields"]] == ["NAME", "PATH"] and u["class"] == f"P{r.k}"


def plain_kind(message):
    """The classes of a message by plain searches."""
    m = (message or "").strip().lower()
    has = lambda *words: any(w in m for w in words)
    quoted = has("device '") and has(" not found")
    bridge = has("adb", "abb_exec")
    device = bool(m) and (quoted or has(*G.DEVICE))
    runtime = bool(m) and not m.startswith("plan model error:") and (
        has(*G.RUNTIME) or quoted or (m.startswith("phone agent error:") and has("no output from dumpsys window")) or ((bridge or has("shell:")) and has(*G.RUNTIME_BESIDE)) or has("adb shell timeout") or (has("closed") and bridge)
    )
    return device, bool(m) and has(*G.PACKAGE), runtime


KNOWN = {
    "error: device offline": (True, False, True), "adb: failed to run abb_exec. Error: closed": (True, False, True), "error: device '10.12.187.124:5555' not found": (True, False, True),
    "adb install timeout after 300s": (True, False, False), "Failure [INSTALL_PARSE_FAILED_NOT_APK: Failed to parse APK]": (False, True, False), "Failure [INSTALL_FAILED_INVALID_APK]": (False, True, False),
    "adb: protocol fault (no status)": (True, False, True), "Phone Agent error: No output from dumpsys window": (False, False, True), "shell: fork failed: Resource temporarily unavailable": (True, False, True),
    "Plan Model error: resource temporarily unavailable": (True, False, False), "Plan Model error: No output from dumpsys window": (False, False, False), "host worker: fork failed: resource temporarily unavailable": (True, False, False),
    "Phone Agent error: fork failed: resource temporarily unavailable": (True, False, False), "No output from dumpsys window": (False, False, False), "  \n": (False, False, False),
}


def test_error_messages(spark):
    rng = random.Random(3)
    pieces = [*G.SIGNATURES, "x", " ", "device", "not found", "Closed", "\n"]
    made = ["".join(rng.choice([s, s.upper()]) + rng.choice(["", " "]) for s in rng.choices(pieces, k=rng.randint(0, 5))) for _ in range(1500)]
    rows = [(i, m) for i, m in enumerate([*KNOWN, None, "", *made])]
    got = {r.i: (r.device_error, r.package_error, r.runtime_error) for r in G.classified(spark.createDataFrame(rows, "i int, m string").withColumn("hits", F.lit(1)), "m").collect()}
    assert got == {i: plain_kind(m) for i, m in rows}
    assert {m: got[i] for i, m in rows[: len(KNOWN)]} == KNOWN


def test_hits_match_a_plain_scan_of_whole_documents(spark, sf_dir):
    words = ("the", "he", "e", "licensed", "de la", "\n")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for r in G.with_hits(docs, "text", words).collect():
        m = (r.text or "").strip().lower()
        if m.isascii():
            want = sorted((at, w) for w in words for at in range(len(m)) if m.startswith(w, at))
            assert [(h["at"], h["signature"]) for h in r.hits] == want
    with pytest.raises(ValueError):
        G.with_hits(docs, "text", ())


def plain_blocks(text):
    """Function blocks by recursive descent over the lines: (class, function, first line, last line, closed, strings, operations)."""
    lines, out, at, cls = text.split("\n"), [], 0, -1
    step = lambda x: x.count("{") - x.count("}")
    while at < len(lines):
        if not re.match(r"\s*((abstract|base|final|sealed|interface)\s+)?(class|mixin)\s+\S+.*\{\s*$", lines[at]):
            at += 1
            continue
        cls, depth, fn, at = cls + 1, step(lines[at]), 0, at + 1
        while at < len(lines):
            if re.match(r"\s\s(?!//|class\b|mixin\b).*\{\s*$", lines[at]):
                first, inner, strings, ops, closed, at = at, step(lines[at]), set(), [], False, at + 1
                while at < len(lines) and not closed:
                    for q in re.findall(r'"(?:\\.|[^"\\])*"', lines[at]):
                        v = q[1:-1].replace('\\"', '"').replace("\\n", "\n").strip()
                        if v not in B.COMMON and not v.startswith(B.COMMON_STARTS):
                            strings.add(v)
                    if m := re.match(r"\s*(?://\s*)?0x[0-9a-fA-F]+:\s*([^;]*)", lines[at]):
                        if m[1].strip() and not re.match(r"[A-Z][A-Za-z0-9_]+\b", m[1].strip()):
                            ops.append(m[1].strip())
                    inner += step(lines[at])
                    closed, at = inner <= 0, at + 1
                out.append((cls, fn, first + 1, at, closed, sorted(strings), ops))
                fn += 1
                continue
            depth, at = depth + step(lines[at]), at + 1
            if depth <= 0:
                break
    return out


def made_listing(rng):
    pieces = ["class A {", "  abstract class B<T> extends C {", "mixin M on N {", "  void f() {", "  get x => {", "    if (a) {", "  } else {", "  }", "}", "    }", "    // 0x10: mov x1, x2 ; \"tail\"", "0xAb: ldr x3, [sp, #-0x10]!  ; c", "  // 0x1: StackOverflow: check", '    call("say \\"hi\\"", "a.b")', '  "dart:core" "package:meta/x" "é漢"', "  class Inner {", "", "    0x3:"]
    return "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))


def test_blocks_of_nested_and_unclosed_listings(spark):
    rng = random.Random(11)
    rows = [(str(i), made_listing(rng)) for i in range(400)] + [("null", None), ("empty", "")]
    got = {}
    for r in B.blocks(spark.createDataFrame(rows, "path string, text string")).collect():
        got.setdefault(r.path, []).append((r.class_no, r.function_no, r.line, r.last_line, r.closed, r.strings, r.operations))
    assert got == {p: b for p, t in rows if (b := plain_blocks(t or ""))}


def test_block_fingerprints(spark):
    text = 'class A {\n  f() {\n    // 0x1: ldr  X3 , [x27, #0x20]  ; "k"\n    0x2: str w30, [fp, #-8]!\n    0x3: add x26, x1, #12\n    0x4: b 0xff ; [PP+0x1]\n    0x5: ldr x1, [PP+0xAB]\n  }\n  g() {\n    // "dart:io"\n  }\n}'
    (row,) = B.block_features(B.blocks(spark.createDataFrame([("p", text)], "path string, text string"))).collect()
    code = ["ldr reg,[pp,#imm]", "str reg,[stack]", "add thr,reg,#imm", "b imm", "ldr reg,[pp+off]"]
    assert row.strings == ["k"] and row.fingerprint == hashlib.sha256("\n".join(code).encode()).hexdigest()[:16]
    (c,) = B.class_features(B.blocks(spark.createDataFrame([("p", text)], "path string, text string"))).collect()
    assert (c.class_strings, c.fingerprints) == (["k"], [row.fingerprint])


def plain_entry(records):
    """The entry of one app by the ladder, over its libraries as dicts in order of their paths."""
    records = sorted(records, key=lambda r: r["path"].split("/"))
    own = [r for r in records if r["own"]]
    pick = lambda f: next((r for r in own if f(r)), None)
    entry, method, confidence = pick(lambda r: r["has_main"] and r["starts"]), "main_and_runApp", "high"
    if entry is None:
        entry, method, confidence = pick(lambda r: r["has_main"]), "main_only", "medium"
    if entry is None:
        entry, method, confidence = pick(lambda r: r["starts"]), "runApp_only", "low"
    widgets = [{**w, "r": r} for r in own for w in r["widgets"]]
    root, by = None, ""
    if entry:
        for name, f in (("direct", lambda w: {w["class"], w["build_class"]} & set(entry["made"])), ("entry_library", lambda w: w["r"] is entry), ("same_package", lambda w: entry["package"] and w["r"]["package"] == entry["package"])):
            if root is None and sum(bool(f(w)) for w in widgets) == 1:
                root, by = next(w for w in widgets if f(w)), name
    if root is None:
        likely = [w for w in widgets if w["r"]["path"].split("/")[-1].lower() in ("main.dart", "app.dart") or re.search("(App|Root)$", w["class"])]
        if len(likely) == 1 and likely[0]["r"]["package"]:
            root, by = likely[0], "unique_root_widget"
    if entry is None and root is not None:
        entry, method, confidence = root["r"], "root_widget_build_app", "medium"
    elif entry is not None and root is not None and method == "main_only":
        method, confidence = "main_root_widget_build_app", "high" if by == "direct" else "medium"
    if entry is None:
        return "", "", None, "unresolved", "none", "", ""
    package = entry["package"] or (root["r"]["package"] if root else "")
    return package, entry["uri"], entry["path"], method, confidence, root["class"] if root else "", root["r"]["uri"] if root else ""


def test_entries_of_all_customers(spark, sf_dir):
    found = B.libraries(code.listings(Tables(spark, sf_dir).orders)).cache()
    apps = {}
    for r in found.collect():
        apps.setdefault(r.app, []).append(r.asDict(recursive=True))
    got = {r.app: tuple(r[1:]) for r in B.entries(found).select("app", "package", "entry_uri", "entry_path", "method", "confidence", "root_class", "root_uri").collect()}
    assert got == {a: plain_entry(rs) for a, rs in apps.items()}
    assert {g[3] for g in got.values()} == {"main_and_runApp", "main_only", "main_root_widget_build_app", "runApp_only", "unresolved"}
    for r in B.summary(found).collect():
        mine = apps[r.app]
        assert r.library_uris == sorted({x["uri"] for x in mine if x["uri"]})
        root = re.match("package:([^/]+)/", r.entry_uri)
        same = [x for x in mine if (x["root"] == root[1] if root else x["uri"].startswith("file:") and f"/{r.package}/" in x["uri"] if r.entry_uri.startswith("file:") else x["path"] == r.entry_path)] if r.package else []
        assert r.classes == sorted({c for x in same for c in x["classes"]})
        said = {s for x in same for s in x["strings"]}
        assert r.urls == sorted(s for s in said if s.startswith("https://api"))
        assert r.domains == sorted({s[8:-2] for s in said if s.startswith("https://api")} | (said & {"cdn.example.com"}))
    found.unpersist()


def test_listings_are_read_once(spark, sf_dir):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = B.libraries(code.listings(Tables(spark, sf_dir).orders).limit(200).coalesce(1))
    assert B.summary(found.mapInArrow(counted, found.schema)).collect() and read.value == 200


def test_a_library_with_a_state_of_its_widget():
    text = "// lib: , url: package:app/main.dart\nclass Page extends StatefulWidget {\n  State createState() {\n    // AllocateStub -> x\n    r0 = AllocatePageStateStub -> _PageState\n  }\n}\nclass _PageState extends State<Page, X> {\n  build(c) {\n    GetMaterialApp::GetMaterialApp\n  }\n}\nclass :: {\n  static Future<void> main() {\n    Instance_Page\n  }\n}\n"
    r = B.read_library(text)
    assert r["widgets"] == [{"class": "Page", "build_class": "_PageState", "roots": ["GetMaterialApp"]}] and r["made"] == ["Page"] and r["has_main"] and not r["starts"]
    assert r["classes"] == ["Page", "_PageState"] and B._class_name("A<B<C>, D> ") == "A" and B._class_name("A<B") == "A<B"


def test_an_entry_by_its_root_widget_alone(spark):
    widget = "// lib: , url: package:a/x.dart\nclass MyApp extends StatelessWidget {\n  build(c) {\n    WidgetsApp::WidgetsApp\n  }\n}\n"
    rows = [("one", "asm/x.dart", widget), ("two", "asm/x.dart", widget), ("two", "asm/y.dart", widget.replace("MyApp", "YourApp")), ("shared", "asm/x.dart", widget.replace("package:a", "package:dio"))]
    found = B.entries(B.libraries(spark.createDataFrame(rows, "app string, path string, text string"))).collect()
    assert {r.app: (r.package, r.entry_uri, r.method, r.confidence, r.root_class) for r in found} == {
        "one": ("a", "package:a/x.dart", "root_widget_build_app", "medium", "MyApp"), "two": ("", "", "unresolved", "none", ""), "shared": ("", "", "unresolved", "none", ""),
    }


def archive(entries, kind=zipfile.ZIP_DEFLATED, before=b"", note=b""):
    out = io.BytesIO(before)
    out.seek(0, 2)
    with zipfile.ZipFile(out, "a", kind) as z:
        for name, content in entries:
            z.writestr(name, content)
        z.comment = note
    return out.getvalue()


FILES = {
    "plain": archive([("a.txt", "x" * 5000), ("é/漢.bin", b"\0\1"), ("d/", "")]), "before": archive([("a.txt", "x" * 300)], before=b"PK junk" * 9, note=b"a note"),
    "stored": archive([("s.bin", b"raw")], zipfile.ZIP_STORED), "empty": archive([]), "none": b"no archive", "null": None, "cut": archive([("a.txt", "x" * 300)])[:-30],
    "broken": archive([("a.txt", "x")]).replace(b"PK\1\2", b"PK\1\3"), "nested": archive([("in.zip", archive([("deep.zip", archive([("deeper.zip", archive([("t.txt", "end")]))]))]))]),
}


def test_directories_equal_those_of_zipfile(spark, tmp_path):
    rows = [(n, bytearray(c) if c is not None else None) for n, c in FILES.items()]
    got = {}
    for r in A.listed(spark.createDataFrame(rows, "path string, content binary")).collect():
        got.setdefault(r.path, []).append((r.entry, r.length, r.packed, r.method, r.crc, r.at))
        assert r.bytes_read <= min(len(FILES[r.path]), A.TAIL) + 46 * 3 + 100
    want = {}
    for n, c in FILES.items():
        with contextlib.suppress(zipfile.BadZipFile, TypeError):
            want[n] = [(i.filename, i.file_size, i.compress_size, i.compress_type, i.CRC, i.header_offset) for i in zipfile.ZipFile(io.BytesIO(c)).infolist()]
    assert got == {n: w for n, w in want.items() if w} and "before" in got
    tricky = archive([("a.txt", "x" * 300)], before=b"PK", note=b"PK\5\6 is no closing record")
    assert [e["entry"] for e in A.directory(lambda at, n: tricky[at : at + n], len(tricky))] == ["a.txt"]
    big = archive([(f"{i}.bin", random.Random(i).randbytes(200_000)) for i in range(10)], zipfile.ZIP_STORED)
    (tmp_path / "big.zip").write_bytes(big)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    listed = A.listed_in_place(files).collect()
    assert [r.entry for r in listed] == [f"{i}.bin" for i in range(10)] and listed[0].bytes_read < 70_000 < len(big)
    entry = A.directory(lambda at, n: big[at : at + n], len(big))[3]
    assert A.entry_bytes(lambda at, n: big[at : at + n], entry, 1 << 20) == random.Random(3).randbytes(200_000)


def test_large_archives_by_their_wide_records():
    data = archive([("a.bin", b"abc")], zipfile.ZIP_STORED)
    at = data.index(b"PK\1\2")
    name = data[at + 46 : at + 51]
    wide = data[at : at + 20] + b"\xff" * 8 + struct.pack("<HHH", 5, 28, 0) + data[at + 34 : at + 42] + b"\xff" * 4 + name + struct.pack("<HHQQQ", 1, 24, 3, 3, 0)
    record = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(wide), at)
    whole = data[:at] + wide + record + b"PK\6\7" + struct.pack("<IQI", 0, at + len(wide), 1) + b"PK\5\6" + b"\0" * 4 + b"\xff" * 12 + b"\0\0"
    (entry,) = A.directory(lambda at, n: whole[at : at + n], len(whole))
    assert (entry["entry"], entry["length"], entry["packed"], entry["at"]) == ("a.bin", 3, 3, 0)


def test_carving(spark):
    found = {}
    rows = [(n, bytearray(c) if c is not None else None) for n, c in FILES.items()] + [("texts", bytearray(archive([("big.txt", "y" * 101), ("fits.txt", "z" * 100), ("pic.PNG", "p"), ("blob.bin", b"q" * 300)])))]
    for r in A.carved_entries(spark.createDataFrame(rows, "path string, content binary"), most_text=100, most_blob=200).collect():
        found.setdefault(r.path, {})[r.entry] = bytes(r.content)
    assert found["texts"] == {"fits.txt": b"z" * 100, "blob.bin": b"q" * 200}
    assert found["none"] == {"<unassigned>": b"no archive"} and found["null"] == {"<unassigned>": b""}
    assert list(found["nested"]) == ["in.zip!deep.zip!deeper.zip"] and found["nested"]["in.zip!deep.zip!deeper.zip"][:4] == b"PK\3\4"
    whole = dict(A.carved(FILES["before"]))
    assert whole == {"a.txt": b"x" * 300} and dict(A.carved(FILES["cut"])) == {"a.txt": b"x" * 300}
    broken = FILES["before"].replace(b"PK\3\4", b"PK\3\4", 1)
    at = broken.index(b"PK\3\4") + 30 + 5
    assert dict(A.carved(broken[:at] + b"\xff" * 4 + broken[at + 4 :] + FILES["stored"])).keys() == {"s.bin"}


def plain_runs(data):
    out, run = [], bytearray()
    for b in [*data, 0]:
        if b == 9 or 0x20 <= b <= 0x7E:
            run.append(b)
        if len(run) > 8192 or not (b == 9 or 0x20 <= b <= 0x7E):
            text = run.decode().strip() if len(run) >= 3 else ""
            out += [text] if 3 <= len(text) <= 8192 else []
            run = bytearray()
    return out + re.findall("[㐀-䶿一-鿿]{2,128}", data.decode("utf-8", "ignore"))


def test_text_runs_of_random_bytes(spark):
    rng = random.Random(9)
    pieces = [b"abc", b"\t x ", b"\0", "漢".encode(), "字㐀鿿".encode(), "é𐍈".encode(), b"\xe6", b"\xe6\xbc", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\x80", b"\xe0\x80\x80", b"\xff", b"\xf0\x9f"]
    made = [b"".join(rng.choice(pieces) if rng.random() < 0.8 else rng.randbytes(3) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += [b"", b"a" * 8192, b"b" * 8193, b" " + b"c" * 8192, b"d" * 20_000, "漢".encode() * 129, "漢".encode() * 300, rng.randbytes(50_000)]
    for data in made:
        assert A.text_runs(data) == plain_runs(data), data[:80]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(made[:50])] + [(99, None)], "i int, d binary")
    got = {r.i: r.r for r in df.select("i", A.runs(F.col("d")).alias("r")).collect()}
    assert got == {i: plain_runs(d) for i, d in enumerate(made[:50])} | {99: None}


def test_frameworks(spark):
    cases = {
        "one library": (["lib/arm64-v8a/libapp.so"], W.NATIVE), "two folders": (["lib/arm64-v8a/libapp.so", "lib/armeabi-v7a/libflutter.so"], W.NATIVE), "assets": (["assets/flutter_assets/AssetManifest.json"], W.NATIVE),
        "one folder": (["lib/armeabi-v7a/libapp.so", "lib/arm64-v8a/libapp.so", "lib/arm64-v8a/libflutter.so"], W.FLUTTER), "direct": (["assets/apps/__UNI__A/www/index.html"], W.DCLOUD),
        "control": (["assets/dcloud_control.xml"], W.NATIVE), "root": (["assets/apps/__UNI__A/placeholder.txt"], W.NATIVE), "weex": (["lib/arm64-v8a/libweexcore.so"], W.NATIVE), "dots": (["assets/apps/../www/index.html"], W.NATIVE),
        "joint": (["AndroidManifest.xml", "assets/dcloud_control.xml"], W.DCLOUD), "launcher alone": (["AndroidManifest.xml"], W.NATIVE), "tie": (["assets/public/", "assets/widget/", "x/com/uzmap", "capacitor.config.json"], "Capacitor"),
        "most": (["assets/public/", "lib/x/libunity.so", "lib/x/libil2cpp.so"], "Unity"), "not so": (["libunity.so.txt", None], W.NATIVE),
    }
    entries = spark.createDataFrame([(a, i, n) for a, (names, _) in cases.items() for i, n in enumerate(names)], "app string, position int, name string")
    known = spark.createDataFrame([("joint", "io.dcloud.PandoraEntry"), ("launcher alone", "io.dcloud.PandoraEntry"), ("control", "other.Main")], "app string, launcher string")
    out = {r.app: r for r in W.detected(entries, known).collect()}
    assert {a: r.framework for a, r in out.items()} == {a: f for a, (_, f) in cases.items()}
    assert [tuple(m) for m in out["joint"].matches] == [(W.DCLOUD, 2, ["launcher:io.dcloud.PandoraEntry", "assets/dcloud_control.xml"])]
    assert [tuple(m) for m in out["one folder"].matches] == [(W.FLUTTER, 2, ["lib/arm64-v8a/libapp.so", "lib/arm64-v8a/libflutter.so"])]
    assert out["direct"].matches[0].score == 3 and [m.framework for m in out["most"].matches] == ["Unity", "Capacitor"] and [m.score for m in out["tie"].matches] == [2, 2]
    assert (out["most"].confidence, out["assets"].confidence) == ("high", "default")


def test_launchers_of_manifests(spark):
    intent = '<intent-filter>\n<action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></intent-filter>'
    texts = {
        "direct": (f'<manifest package="a.b"><activity android:name="other.X"/><activity android:name="io.dcloud.PandoraEntry" a="1">{intent}</activity></manifest>', "io.dcloud.PandoraEntry"),
        "alias": (f'<manifest package="a.b"><activity-alias android:name=".Y" android:targetActivity="io.dcloud.uniapp.UniAppActivity">{intent}</activity-alias></manifest>', "io.dcloud.uniapp.UniAppActivity"),
        "relative": (f'<manifest package="io.dcloud"><activity android:name=".PandoraEntry">{intent}</activity></manifest>', "io.dcloud.PandoraEntry"),
        "bare": (f'<manifest package="io.dcloud"><activity android:name="PandoraEntry">{intent}</activity></manifest>', "io.dcloud.PandoraEntry"), "no intent": ('<manifest package="a"><activity android:name="io.dcloud.PandoraEntry"></activity></manifest>', None),
        "null": (None, None),
    }
    df = spark.createDataFrame([(n, t) for n, (t, _) in texts.items()], "n string, t string")
    assert {r.n: r.l for r in df.select("n", W.launcher(F.col("t")).alias("l")).collect()} == {n: w for n, (_, w) in texts.items()}


def plain_mentions(text):
    out = []
    for kind, form, g in (("address", r"\b(?:https?|wss?)://[^\s\"'<>\\`]+", 0), ("path", r"([\"'`])(/[A-Za-z0-9_./${}?=&:%-]{2,260})\1", 2), ("string", r"([\"'`])([^\"'`\\]{1,300})\1", 2)):
        out += [(kind, m[g], m.start(), m.end()) for m in re.finditer(form, text, re.I if kind == "address" else 0)]
    return out


def plain_route(path, segments):
    r = path.strip().replace("\\/", "/")
    r = re.sub("/+", "/", ("" if r.startswith("/") else "/").join(["", r]).split("#")[0].split("?")[0].rstrip(".,);]}"))
    first = r.lstrip("/").split("/")[0]
    bad = len(r) < 3 or r in R.SKIPPED or r.lower().startswith(R.SKIPPED_STARTS) or r.split("${")[0].lower().endswith(R.SKIPPED_ENDS)
    return None if bad or not (first in segments or first.lower().startswith("api")) else r


def plain_mined(text, segments):
    rows = []
    for kind, value, start, end in plain_mentions(text):
        around = text[max(0, start - 180) : start], text[end : end + 80]
        v, context = value.strip(), any(re.search(R.CONTEXT, x) for x in around)
        route = service = domain = None
        if kind == "address" or (kind == "string" and v.startswith(("http://", "https://", "ws://", "wss://"))):
            u = urlsplit(v.replace("\\/", "/").rstrip(".,);]}>'\"").replace("&amp;", "&"))
            route = plain_route(u.path, segments) if u.path else None
            name = u.netloc.lower().partition(":")[0]
            if u.netloc and (context or route) and re.fullmatch("[a-z0-9.-]+", name) and ("." in name or name == "localhost") and name not in R.NOISE and not name.endswith(R.NOISE_ENDS):
                service, domain = f"{u.scheme}://{u.netloc}" + (u.path if route and u.path != "/" else ""), u.netloc.lower()
        elif kind == "path" or v.startswith("/") or re.fullmatch(r"[A-Za-z0-9_-]+/[A-Za-z0-9_./${}?=&:-]+", v):
            route = plain_route(v, segments)
        rows.append((kind, value, start, *around, context, route, service, domain))
    return sorted(rows, key=str)


def test_mentions_of_whole_pages(spark, sf_dir):
    segments = (*R.SEGMENTS, "en", "fr", "de", "es")
    texts = {r.page_id: r.text for r in code.scripts(Tables(spark, sf_dir).pages).collect()}
    texts |= {-1: None, -2: "fetch('http:\\/\\/x') \"https://github.com/api\" `ws://h.example.org:1/user/1.png`;axios 'https://a.example.com/api//v1?x=1#y).' \"/api/js\" '/image/a' 'api/x' \"/user//2,\"", -3: "baseUrl" + " " * 200 + "'https://far.example.org/x'" + " " * 79 + "host", -4: "'https://w.vuejs.org/api' 'https://localhost/api/${id}.png' 'HTTPS://Up.example.org/Api/z'"}
    df = spark.createDataFrame(list(texts.items()), "page_id long, text string")
    got = {}
    for r in R.mined(R.mentions(df, "page_id", "text"), "page_id", segments).collect():
        got.setdefault(r.page_id, []).append((r.kind, r.value, r["at"], r.before, r.after, r.in_context, r.route, r.service, r.domain))
    for i, t in texts.items():
        assert sorted(got.get(i, []), key=str) == plain_mined(t or "", segments), i
    assert sum(len(g) for g in got.values()) > len(texts)
    sets = {r.page_id: r for r in R.services(df, "page_id", "text").collect()}
    assert sets[-2].routes and -1 not in sets and sets[0].domains
