"""Code listings of compiled libraries: blocks of classes and functions, and the library in which a program begins.

A listing is read line by line by a small state machine (inside which class, inside which function, how many braces
deep); what it finds are rows, and everything beyond a file is joins and aggregates over those rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines that open a class or a function, address lines, quoted strings, and operations that are not machine code.
_CLASS_LINE = re.compile(r"^\s*(?:abstract\s+|base\s+|final\s+|sealed\s+|interface\s+)?(?:class|mixin)\s+\S+.*\{\s*$")
_FUNCTION_LINE = re.compile(r"^\s{2}(?!//)(?!class\b)(?!mixin\b).*\{\s*$")
_ADDRESS = re.compile(r"^\s*(?://\s*)?(0x[0-9a-fA-F]+):\s*(.*?)\s*$")
_QUOTED = re.compile(r'"(?:\\.|[^"\\])*"')
_GENERIC = re.compile(r"^[A-Z][A-Za-z0-9_]+(?:Instr)?(?:\b|:)")
# Strings that say nothing of a program, whole and by their beginning.
COMMON = (
    "", "dart:async", "dart:collection", "dart:convert", "dart:core", "dart:developer", "dart:ffi", "dart:io", "dart:isolate", "dart:math", "dart:typed_data", "dynamic", "flutter",
    "MaterialApp", "StatelessWidget", "StatefulWidget", "Widget",
)
COMMON_STARTS = (
    "package:flutter/", "package:vector_math/", "package:collection/", "package:async/", "package:characters/", "package:meta/", "package:path/", "package:sky_engine/", "dart:",
)
# What is replaced in an operation, in this order.
_OPERATION = (
    (r"\[pp\+0x[0-9a-f]+\]", "[pp+off]"), (r"\[(?:sp|fp|x29)(?:,\s*#?-?(?:0x[0-9a-f]+|\d+))?\]!?", "[stack]"), (r"\bx27\b", "pp"), (r"\bx26\b", "thr"),
    (r"\b(?:[wx](?:[0-9]|[12][0-9]|3[01])|v[0-9]+|q[0-9]+|d[0-9]+|s[0-9]+)\b", "reg"), (r"\b0x[0-9a-f]+\b", "imm"), (r"#-?\d+\b", "#imm"), (r"\b\d+\b", "imm"), (r"\s+", " "), (r"\s*,\s*", ","),
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\x0b", "a": "\x07", "0": "\0", '"': '"', "'": "'", "\\": "\\", "\n": ""}


def _unquoted(quoted: str) -> str:
    """The value of a string in double quotes; an escape that is none stays as it is."""

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1] or "0", 16)) if int(m[1], 16) < 0x110000 else m[0]
        return _ESCAPES.get(m[2], m[0])

    return re.sub(r"\\(?:(?:x(?=[0-9A-Fa-f]{2})|u(?=[0-9A-Fa-f]{4}))((?<=x)[0-9A-Fa-f]{2}|(?<=u)[0-9A-Fa-f]{4})|(.))", one, quoted[1:-1], flags=re.S)


def _telling(value: str) -> bool:
    return value not in COMMON and not value.startswith(COMMON_STARTS)


def read_blocks(text: str) -> list[dict]:
    """The function blocks of a listing in order; a class or function that is not closed ends with the text."""
    out: list[dict] = []
    classes = -1
    outer = inner = 0
    in_class, block = False, None
    for number, line in enumerate(text.split("\n"), start=1):
        step = line.count("{") - line.count("}")
        if not in_class:
            if "{" in line and _CLASS_LINE.match(line):
                in_class, classes, outer, functions, opened = True, classes + 1, step, 0, number
        elif block is None and "{" in line and _FUNCTION_LINE.match(line):
            block, inner = {"class_no": classes, "class_line": opened, "function_no": functions, "line": number, "last_line": number, "closed": False, "strings": set(), "operations": []}, step
            out.append(block)
            functions += 1
        elif block is not None:
            if '"' in line:
                block["strings"].update(v for q in _QUOTED.findall(line) if _telling(v := _unquoted(q).strip()))
            m = _ADDRESS.match(line) if "0x" in line else None
            operation = m[2].split(";", 1)[0].strip() if m else ""
            if operation and not _GENERIC.match(operation):
                block["operations"].append(operation)
            block["last_line"], inner = number, inner + step
            if inner <= 0:
                block["closed"], block = True, None
        else:
            outer += step
            in_class = outer > 0
    return [{**b, "strings": sorted(b["strings"])} for b in out]


_BLOCK = pa.struct([
    ("class_no", pa.int32()), ("class_line", pa.int32()), ("function_no", pa.int32()), ("line", pa.int32()), ("last_line", pa.int32()), ("closed", pa.bool_()),
    ("strings", pa.list_(pa.string())), ("operations", pa.list_(pa.string())),
])
_BLOCK_SQL = "class_no int, class_line int, function_no int, line int, last_line int, closed boolean, strings array<string>, operations array<string>"


def blocks(listings: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, class_no, class_line, function_no, line, last_line, closed, strings, operations): a row a function block.

    A function is a line of two blanks or more that ends in ``{`` inside a class; its lines go on until its braces are
    closed, classes inside it count as its lines. Numbers of classes and functions count from 0, lines from 1; operations
    are the machine code of its address lines. A null text has no blocks. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_blocks(t or "") for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            rows = pa.array([b for f in found for b in f], _BLOCK)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *rows.flatten()], names=["path", *(f.name for f in _BLOCK)])

    return listings.select(F.col(path).cast("string"), F.col(text).cast("string")).mapInArrow(run, f"path string, {_BLOCK_SQL}")


def normal_operation(c: Column | str) -> Column:
    """An operation in small letters with registers, stack slots, pool offsets and constants as placeholders."""
    x = F.lower(F.col(c) if isinstance(c, str) else c)
    for pattern, by in _OPERATION:
        x = F.regexp_replace(x, pattern, by)
    return F.trim(x)


def block_features(found: DataFrame) -> DataFrame:
    """Blocks with at least one telling string, and ``fingerprint``: 16 hex digits of the SHA-256 of their normal operations."""
    normal = F.filter(F.transform("operations", normal_operation), lambda x: x != "")
    return found.where(F.size("strings") > 0).withColumn("fingerprint", F.left(F.sha2(F.array_join(normal, "\n"), 256), F.lit(16)))


def class_features(found: DataFrame) -> DataFrame:
    """(path, class_no, class_strings, fingerprints) of the classes that have a block with a string."""
    each = block_features(found).groupBy("path", "class_no")
    listed = each.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("strings")))).alias("class_strings"), F.array_sort(F.collect_list(F.struct("function_no", "fingerprint"))).alias("f"))
    return listed.select("path", "class_no", "class_strings", F.col("f.fingerprint").alias("fingerprints"))


# The first line of a library, lines that open classes, main functions, build functions and state factories, and calls that start a program.
_LIBRARY = re.compile(r"^// lib:.*?, url:\s*(.*?)\s*$")
_CLASS_NAME = re.compile(r"^(?:(?:abstract|base|final|sealed|interface)\s+)?(?:class|mixin)\s+(.+?)(?=\s+extends\b|\s+implements\b|\s+with\b|\s+on\b|\s*\{?\s*$)")
_STATE_OF, _WIDGET = re.compile(r"\bextends\s+State<\s*([^>,\s]+)"), re.compile(r"\bextends\s+[A-Za-z0-9_$]*(?:Widget|State)(?:<|\b)")
_MAIN = re.compile(r"^\s+(?:\[closure\]\s+)?static\s+(?:Future(?:<[^>]+>)?|void|dynamic|_)\s+main\s*\(")
_STARTS = re.compile(r"\br\d+\s*=\s*runApp\(\)|\[package:flutter/src/widgets/binding\.dart\]\s+::runApp")
_MADE = re.compile(r"Allocate([A-Za-z_$][A-Za-z0-9_$]*)Stub(?:\s*->\s*([A-Za-z_$][A-Za-z0-9_$]*))?")
_INSTANCE = re.compile(r"\bInstance_([A-Za-z_$][A-Za-z0-9_$]*)\b")
_BUILD, _CREATE = re.compile(r"^\s{2}(?!//).*\bbuild\s*\("), re.compile(r"^\s{2}(?!//).*\bcreateState\s*\(")
# Classes that are the root of a program's surface, and packages that many programs share.
ROOTS = ("MaterialApp", "CupertinoApp", "WidgetsApp", "GetMaterialApp")
SHARED_PACKAGES = (
    "analyzer", "archive", "args", "async", "characters", "collection", "convert", "crypto", "dio", "ffi", "flutter", "http", "intl", "js", "logging", "meta", "path",
    "plugin_platform_interface", "protobuf", "quiver", "typed_data", "vector_math", "web", "xml",
)
_ROOT_CALLS = {r: re.compile(rf"\b(?:Allocate{r}Stub|{r}::{r})\b") for r in ROOTS}


def _class_name(text: str) -> str:
    """A class's name without its type arguments, however nested; an unclosed one stays."""
    name = re.sub("[\r\n\x85  ]+", " ", text)
    while (shorter := re.sub(r"<[^<>]*>", "", name)) != name:
        name = shorter
    return name.strip()


def read_library(text: str) -> dict:
    """URI, classes, strings and signs of a beginning in the listing of one library."""
    uri, owner = "", ""
    classes: dict[str, dict] = {}
    strings, made = set(), set()
    has_main = starts = in_main = False
    creator = None
    for number, line in enumerate(text.split("\n")):
        if not number and (m := _LIBRARY.match(line)):
            uri = m[1]
        if m := _CLASS_NAME.match(line):
            owner = _class_name(m[1])
            owner = "" if owner == "::" else owner
            if owner:
                state_of = _STATE_OF.search(line)
                classes[owner] = {"build": False, "roots": set(), "widget": bool(_WIDGET.search(line)), "owner": state_of[1] if state_of else "", "states": set()}
            continue
        if line == "}":
            owner = ""
        here = classes.get(owner)
        if here and _BUILD.match(line):
            here["build"] = True
        if here and _CREATE.match(line):
            creator = here
        elif creator and line == "  }":
            creator = None
        makes = "Allocate" in line
        names = {m[2] or m[1] for m in _MADE.finditer(line)} if makes else set()
        if creator:
            creator["states"] |= names
        if here and (makes or "::" in line):
            here["roots"].update(r for r, call in _ROOT_CALLS.items() if call.search(line))
        if _MAIN.match(line):
            has_main = in_main = True
        elif in_main and line == "  }":
            in_main = False
        starts = starts or ("runApp" in line and bool(_STARTS.search(line)))
        if in_main:
            made |= names | set(_INSTANCE.findall(line))
        if '"' in line:
            strings.update(_unquoted(q) for q in _QUOTED.findall(line))
    for widget, c in classes.items():
        for state in c["states"] & classes.keys():
            classes[state]["owner"] = widget
    widgets = [{"class": c["owner"] or n, "build_class": n, "roots": sorted(c["roots"])} for n, c in classes.items() if c["build"] and c["widget"] and c["roots"] and n not in ROOTS]
    return {"uri": uri, "has_main": has_main, "starts": starts, "made": sorted(made), "classes": sorted(classes), "strings": sorted(strings), "widgets": widgets}


_LIBRARY_ROW = pa.struct([
    ("uri", pa.string()), ("has_main", pa.bool_()), ("starts", pa.bool_()), ("made", pa.list_(pa.string())), ("classes", pa.list_(pa.string())), ("strings", pa.list_(pa.string())),
    ("widgets", pa.list_(pa.struct([("class", pa.string()), ("build_class", pa.string()), ("roots", pa.list_(pa.string()))]))),
])


def libraries(listings: DataFrame, app: str = "app", path: str = "path", text: str = "text") -> DataFrame:
    """(app, path, uri, has_main, starts, made, classes, strings, widgets, root, package, own): a row a library; no shuffle.

    ``root`` is the package of a package URI, ``package`` also that of a file or of a bare name; ``own`` is false for
    libraries of the platform and of shared packages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([read_library(t or "") for t in batch.column(2).to_pylist()], _LIBRARY_ROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rows.flatten()], names=["app", "path", *(f.name for f in _LIBRARY_ROW)])

    schema = "app string, path string, uri string, has_main boolean, starts boolean, made array<string>, classes array<string>, strings array<string>, widgets array<struct<class: string, build_class: string, roots: array<string>>>"
    rows = listings.select(F.col(app).cast("string"), F.col(path).cast("string"), F.col(text).cast("string")).mapInArrow(run, schema)
    root = F.regexp_extract("uri", "^package:([^/]+)/", 1)
    by_file = F.regexp_extract(F.replace("uri", F.lit("\\"), F.lit("/")), r"/([^/]+)/lib/(?:.+/)?main\.dart$", 1)
    folder = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit(""))
    bare = F.when((F.col("uri") != "") & ~F.col("uri").rlike("[:/]"), F.col("uri")).otherwise("")
    package = F.when(root != "", root).when(F.startswith("uri", F.lit("file:")), F.when(by_file != "", by_file).otherwise(folder)).otherwise(bare)
    own = ~((F.col("uri") == "") | F.startswith("uri", F.lit("dart:")) | F.startswith("uri", F.lit("package:flutter/")) | root.isin(*SHARED_PACKAGES))
    return rows.withColumns({"root": root, "package": package, "own": own})


def _told(found: DataFrame) -> DataFrame:
    """The libraries with what is chosen of their app: the entry ``e``, the root widget ``r`` and ``by``, how it was told. One shuffle by app."""
    every = Window.partitionBy("app")
    name = F.lower(F.substring_index("path", "/", -1))
    rank = F.when(F.col("own") & F.col("has_main") & F.col("starts"), 0).when(F.col("own") & F.col("has_main"), 1).when(F.col("own") & F.col("starts"), 2)
    order = F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.split("path", "/").alias("parts")))
    chosen = F.min_by(F.struct(rank.alias("rank"), "path", "uri", "package", "root", "made"), order).over(every)
    rows = found.withColumn("e", chosen)
    likely = lambda w: name.isin("main.dart", "app.dart") | w["class"].rlike("(?:App|Root)$")
    near = [
        ("direct", lambda w: F.array_contains("e.made", w["class"]) | F.array_contains("e.made", w["build_class"])), ("entry_library", lambda w: F.col("path") == F.col("e.path")),
        ("same_package", lambda w: (F.col("e.package") != "") & (F.col("package") == F.col("e.package"))), ("unique_root_widget", likely),
    ]
    none = F.array().cast("array<struct<class:string,build_class:string,roots:array<string>>>")
    widgets = F.when(F.col("own"), F.coalesce("widgets", none)).otherwise(none)
    rows = rows.withColumns({f"_{n}": F.filter(widgets, on) for n, on in near})
    pick = lambda n: F.struct(F.get(f"_{n}", F.lit(0))["class"].alias("class"), "uri", "package", "path")
    some = lambda n: F.size(f"_{n}") > 0
    sums = {f"{n}_n": F.sum(F.size(f"_{n}")).over(every) for n, _ in near} | {f"{n}_pick": F.min_by(F.when(some(n), pick(n)), F.when(some(n), F.split("path", "/"))).over(every) for n, _ in near}
    packages = F.size(F.collect_set(F.when(some("unique_root_widget") & (F.col("package") != ""), F.col("package"))).over(every))
    rows = rows.withColumns({**sums, "packages": packages})
    ways = [((F.col(f"{n}_n") == 1) & (F.lit(True) if n != "unique_root_widget" else F.col("packages") == 1), n) for n, _ in near]
    root, evidence = F.coalesce(*(F.when(w, F.col(f"{n}_pick")) for w, n in ways)), F.coalesce(*(F.when(w, F.lit(n)) for w, n in ways))
    return rows.select(*found.columns, "e", root.alias("r"), evidence.alias("by"))


def _entry() -> list[Column]:
    """The columns of ``entries`` behind app, by the columns of ``_told``."""
    tier, has_root = F.col("e.rank"), F.col("r").isNotNull()
    method = F.when(tier == 0, "main_and_runApp").when((tier == 1) & has_root, "main_root_widget_build_app").when(tier == 1, "main_only").when(tier == 2, "runApp_only").when(has_root, "root_widget_build_app").otherwise("unresolved")
    confidence = F.when(tier == 0, "high").when(tier == 1, F.when(F.col("by") == "direct", "high").otherwise("medium")).when(tier == 2, "low").when(has_root, "medium").otherwise("none")
    own_package = F.coalesce("e.package", F.lit(""))
    package = F.when(has_root & (own_package == ""), F.col("r.package")).otherwise(own_package)
    text = lambda c: F.coalesce(c, F.lit(""))
    return [package.alias("package"), text(F.coalesce("e.uri", "r.uri")).alias("entry_uri"), F.coalesce("e.path", "r.path").alias("entry_path"), method.alias("method"), confidence.alias("confidence"), text(F.col("r.class")).alias("root_class"), text(F.col("r.uri")).alias("root_uri")]


def entries(found: DataFrame) -> DataFrame:
    """(app, package, entry_uri, entry_path, method, confidence, root_class, root_uri): where each app begins.

    Of an app's own libraries the first by path that has a main function and starts the program is its entry, with high
    confidence; else one with a main function, medium; else one that starts it, low. A root widget, whose build function
    makes the root of the surface, confirms or replaces the entry if one alone is meant: made in main, else in the
    entry's library, else in its package, else the only likely one of the app by its name.
    """
    told = _told(found).groupBy("app").agg(*(F.first(c).alias(c) for c in ("e", "r", "by")))
    return told.select("app", *_entry())


# Whole strings that are a remote address or a domain.
_REMOTE = r"(?i)^(?:https?|wss?|ftp)://[^\s\"'<>\\\]\[{}()]+$"
_DOMAIN = r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|net|org|cn|io|co|cc|app|dev|me|tv|xyz|top|vip|club|cloud|tech|ai|info|biz|site|link|live)(?::\d{1,5})?$"


def summary(found: DataFrame) -> DataFrame:
    """entries with library_uris, and the classes, urls and domains of the libraries of the entry's package, each sorted.

    Listings are read once: all that is told of an app comes from one shuffle of its libraries.
    """
    rows = _told(found).select("app", "path", "uri", "root", "classes", "strings", *_entry())
    of, of_root = F.col("package"), F.regexp_extract("entry_uri", "^package:([^/]+)/", 1)
    same = F.when(of_root != "", F.col("root") == of_root).when(
        F.startswith("entry_uri", F.lit("file:")), F.startswith("uri", F.lit("file:")) & F.contains("uri", F.concat(F.lit("/"), of, F.lit("/")))
    ).otherwise(F.col("path") == F.col("entry_path"))
    main = (of != "") & F.col("entry_path").isNotNull() & same

    def parts(s: Column) -> tuple[Column, Column]:
        """Whether a string is a remote address, and its domain if it is one or names one."""
        where = F.lower(F.regexp_replace(F.regexp_extract(s, "^[A-Za-z]+://([^/?#]*)", 1), "^.*@", ""))
        host, port = F.regexp_replace(where, ":[0-9]*$", ""), F.regexp_extract(where, ":([0-9]+)$", 1)
        good = s.rlike(_REMOTE) & F.contains(host, F.lit(".")) & ~host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") & ~host.rlike(r"^\.|\.\.|\.$|:") & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535)
        named = ~good & s.rlike(_DOMAIN) & (F.coalesce(F.regexp_extract(s, ":([0-9]+)$", 1).try_cast("int"), F.lit(0)) <= 65535)
        return good, F.when(good, F.when(port != "", F.concat(host, F.lit(":"), port.cast("int").cast("string"))).otherwise(host)).when(named, F.lower(s))

    said = F.transform(F.filter("strings", lambda s: F.contains(s, F.lit("."))), lambda s: F.trim(s))  # what has no dot is neither
    remote = F.filter(F.transform(said, lambda s: F.struct(F.when(parts(s)[0], s).alias("url"), parts(s)[1].alias("domain"))), lambda x: x["domain"].isNotNull())
    rows = rows.withColumns({"classes": F.when(main, F.col("classes")), "said": F.when(main, remote)})
    gathered = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(c)))))
    start = ("package", "entry_uri", "entry_path", "method", "confidence", "root_class", "root_uri")
    uris = F.array_sort(F.collect_set(F.when(F.col("uri") != "", F.col("uri")))).alias("library_uris")
    return rows.groupBy("app").agg(*(F.first(c).alias(c) for c in start), uris, gathered("classes").alias("classes"), gathered("said.url").alias("urls"), gathered("said.domain").alias("domains"))
