"""What strings, sources and packages tell: vendors of protection, kinds of strings, noise sources, products in use, kinds of web packages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.functions.text import col
from quarrion.operators.extract import Fingerprint

# Patterns of protection tools in order, with vendor (Chinese, English), product and whether it is open source.
VENDORS: tuple[tuple[str, str, str, str, bool], ...] = (
    (r"bangcle|secshell", "梆梆安全", "Bangcle", "Bangcle / SecShell", False),
    (r"secneo", "梆梆安全", "Bangcle", "Bangcle SecNeo", False),
    (r"\bjiagu\b|qihoo\s*360|360\s*jiagu", "奇虎360", "Qihoo 360", "360加固保", False),
    (r"tencent.*legu|legu|mobile\s*tencent\s*protect|tencent\s*security\s*enterprise|txappentry|stubshell", "腾讯", "Tencent", "腾讯乐固 / 御安全", False),
    (r"\bijiami\b", "爱加密", "Ijiami", "爱加密", False),
    (r"\bnaga\b", "娜迦信息", "Nagain", "娜迦 (Naga)", False),
    (r"\bbaidu\b", "百度", "Baidu", "百度加固", False),
    (r"alibaba|alipay|mobisecenhance|ali\s+security|com/ali/", "阿里巴巴", "Alibaba", "阿里聚安全 / 阿里加固", False),
    (r"\bkiro\b|kiwisec|kiwi\s*enc|kiwivm", "几维安全", "KiwiSec", "几维安全 (KiwiSec)", False),
    (r"tongfu\s*shield|tongfudun|payegis", "通付盾", "Payegis", "通付盾 (Payegis)", False),
    (r"dingxiang", "顶象技术", "DingXiang", "顶象 (DingXiang)", False),
    (r"haiyun", "海云安", "Haiyun'an", "海云安", False),
    (r"dxshield", "东信和平", "DxShield", "DxShield", False),
    (r"appsuit", "Stealien", "Stealien", "AppSuit", False),
    (r"appsealing", "INKA Entworks", "INKA Entworks", "AppSealing", False),
    (r"dexprotector", "Licel", "Licel", "DexProtector", False),
    (r"dexguard", "Guardsquare", "Guardsquare", "DexGuard", False),
    (r"arxan|guardit", "Digital.ai (Arxan)", "Arxan", "Arxan / GuardIT", False),
    (r"whitecryption", "Intertrust", "Intertrust", "whiteCryption SCP", False),
    (r"promon", "Promon", "Promon", "Promon SHIELD", False),
    (r"nhn\s*appguard|appguard", "NHN", "NHN", "AppGuard", False),
    (r"nq\s*shield|netqin|\bnqshield\b", "网秦", "NetQin", "NQ Shield", False),
    (r"\bvirbox\b", "深思数盾", "SenseShield", "Virbox Protector", False),
    (r"\bliapp\b", "Lockin Company", "Lockin", "LIAPP", False),
    (r"\bkony\b", "Kony", "Kony", "Kony", False),
    (r"insidesecure|metafortress|verimatrix", "Verimatrix", "Verimatrix", "Inside Secure / MetaFortress", False),
    (r"apkprotect", "APKProtect", "APKProtect", "APKProtect", False),
    (r"apkguard", "APKGuard", "APKGuard", "APKGuard", False),
    (r"ahope|appshield", "Ahope", "Ahope", "AppShield", False),
    (r"shield\s*sdk|com/shield/android", "SHIELD", "SHIELD", "SHIELD SDK", False),
    (r"quarks\s*appshield|epona", "Quarkslab", "Quarkslab", "Quarks AppShield (Epona)", False),
    (r"\bbshield\b", "BShield", "BShield", "BShield", False),
    (r"proguard", "Guardsquare", "Guardsquare", "ProGuard", True),
    (r"obfuscator-?llvm|\bollvm\b", "OLLVM 项目", "Obfuscator-LLVM", "Obfuscator-LLVM (OLLVM)", True),
    (r"armariris", "复旦大学", "Fudan", "Armariris", True),
    (r"\bhikari\b", "Hikari 项目", "Hikari", "Hikari Obfuscator", True),
    (r"advobfuscator", "Andrivet", "Andrivet", "ADVobfuscator", True),
    (r"blackobfuscator", "CodingGay", "CodingGay", "BlackObfuscator", True),
    (r"stringfog", "MegatronKing", "MegatronKing", "StringFog", True),
    (r"beebyte", "Beebyte", "Beebyte", "Beebyte Obfuscator", False),
    (r"safeengine", "Safengine", "Safengine", "Safengine LLVM", False),
    (r"lsposed", "LSPosed 项目", "LSPosed", "LSPosed Obfuscator", True),
    (r"easyprotector", "lamster2018", "lamster2018", "EasyProtector", True),
    (r"mt\s*protector|mtprotector", "MT管理器", "MT Manager", "MT Protector", False),
    (r"\bupx\b", "UPX 项目", "UPX", "UPX", True),
    (r"kangapack|kangaroo", "其他", "Other", "KangaPack (袋鼠壳)", False),
    (r"qdbh", "其他", "Other", "qdbh packer", False),
    (r"joker", "其他", "Other", "Joker (恶意家族壳)", False),
)


def vendor(description: Column | str) -> Column:
    """(name_cn, name_en, product, open_source) of the first pattern found in a description, else other with the description."""
    text = F.regexp_replace(F.coalesce(col(description), F.lit("")), r"^\s+|\s+$", "")
    one = lambda cn, en, product, free: F.struct(F.lit(cn).alias("name_cn"), F.lit(en).alias("name_en"), product.alias("product"), F.lit(free).alias("open_source"))
    found = [F.when(text.rlike(f"(?i){p}"), one(cn, en, F.lit(product), free)) for p, cn, en, product, free in VENDORS]
    return F.coalesce(*found, one("其他", "Other", F.when(text != "", text).otherwise("Unknown"), False))


def strategy(framework: Column | str) -> Column:
    """How the apps of a framework are clustered, by its name; null without a name."""
    name = F.lower(col(framework))
    has = lambda *words: name.rlike("|".join(map(re.escape, words)))
    return F.when(has("flutter"), "flutter").when(has("dcloud", "uni-app", "uniapp"), "dcloud").when(has("native", "原生"), "native").when(name != "", "framework_component")


def candidates(families: DataFrame, least: int = 5) -> DataFrame:
    """(key, size, rank) of families (key, node) with enough nodes: the largest first, ties by key. Ranks are counted by size, then inside one."""
    from pyspark.sql import Window

    sized = families.groupBy("key").agg(F.count_distinct("node").alias("size")).where(F.col("size") >= least)
    sizes = sized.groupBy("size").agg(F.count("*").alias("n"))
    ahead = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)  # a row a size
    before = sizes.select("size", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return sized.join(before, "size").select("key", "size", (F.col("before") + F.row_number().over(Window.partitionBy("size").orderBy("key"))).alias("rank"))


# Forms of addresses, libraries, routes and names in strings.
_URL = r"(?i)(?:https?|wss?|ftp)://[^\s\"'<>]{4,2048}"
_LIBRARIES = (r"package:[A-Za-z0-9_./@+\-]+", r"file:///[A-Za-z0-9_%./@+~:\-]+", r"org-dartlang-app:[A-Za-z0-9_%./@+~:\-]+")
_ROUTE = r"(?<![A-Za-z0-9])/(?:[A-Za-z0-9_.~:@+\-]+/?){1,12}(?:\?[A-Za-z0-9_%&=.+:@/\-]*)?"
_CAMEL, _STRUCTURED = r"^[a-z][A-Za-z0-9]*(?:\.[a-z][A-Za-z0-9]*)*$", r"^[a-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+$"
# Segments of routes, beginnings and endings of paths that are none.
ROUTE_HINTS = (
    "api", "auth", "login", "logout", "register", "user", "users", "account", "profile", "trade", "order", "orders", "pay", "payment", "wallet", "asset", "assets", "market", "quote", "message", "messages",
    "recharge", "withdraw", "bank", "card", "verify", "captcha", "notice", "config", "bootstrap", "session", "token",
)
NO_ROUTES = ("//", "/assets/", "/flutter_assets/", "/users/", "/home/", "/var/", "/tmp/")
FILE_ENDS = (".dart", ".so", ".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg", ".ttf", ".otf", ".json", ".yaml", ".yml", ".xml", ".html", ".htm", ".js", ".css", ".bin", ".db")
# Hosts and strings of the framework itself, and names that every program has.
FRAMEWORK_HOSTS = (
    "api.flutter.dev", "flutter.dev", "www.flutter.dev", "dart.dev", "www.dart.dev", "pub.dev", "www.pub.dev", "developer.android.com", "www.w3.org", "www.ibm.com", "developer.mozilla.org", "github.com",
)
NOISE_STARTS = ("dart:", "org-dartlang-sdk:", "package:flutter/", "package:flutter_", "package:cupertino_")
NOISE_PARTS = (
    "flutter/src/", "dart-sdk/", "/sdk/lib/", "io.flutter.", "dev.flutter.", "flutter_assets/packages/flutter", "materialicons", "cupertinoicons", "fontmanifest.json", "assetmanifest.json", "kernel_blob.bin",
    "vm_snapshot_data", "isolate_snapshot_data", "flutterengine",
)
COMMON_NAMES = (
    "toString", "hashCode", "runtimeType", "noSuchMethod", "addListener", "removeListener", "notifyListeners", "debugLabel", "debugFillProperties", "debugDescribeChildren", "didChangeDependencies",
    "didUpdateWidget", "deactivate", "dispose", "initState", "createState", "setState", "createElement", "createRenderObject", "updateRenderObject", "build", "mounted", "context", "widget", "child",
    "children", "builder", "listener", "controller", "animation", "duration", "curve", "alignment", "padding", "margin", "semanticLabel", "textDirection", "textAlign", "mainAxisAlignment",
    "crossAxisAlignment",
)
# Signs of which every string of a kind has one: most words have none and are passed over at once.
_TELLING = "[/:_㐀-鿿]|[a-z][A-Z]"
KINDS = ("url", "library_uri", "api_route", "chinese_text", "camel_case", "structured_key")


def _one_of(words: Sequence[str]) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


def is_public_noise(c: Column) -> Column:
    """Strings of the framework itself, and blank ones."""
    low = F.lower(F.trim(c))
    return (low == "") | low.rlike("^" + _one_of(NOISE_STARTS)) | low.rlike(_one_of(NOISE_PARTS))


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"[.,;:)\]}]+$", "")


def string_kinds(c: Column | str) -> Column:
    """An array of (kind, value) for a string: the addresses, libraries and routes in it, and what it is as a whole."""
    v = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    every = lambda text, form: F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), _bare)
    host = lambda u: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1), "^.*@", ""), ":[0-9]*$", ""))
    real = lambda u: host(u).rlike(r"^(?:[^.]+\.)+(?:[a-z]{2,63}|[0-9]{1,3})$") & ~host(u).isin(*FRAMEWORK_HOSTS) & ~host(u).rlike(r"\.(?:flutter|dart)\.dev$")
    urls = F.filter(every(v, _URL), real)
    libraries = F.filter(F.flatten(F.array(*(every(v, p) for p in _LIBRARIES))), lambda u: ~is_public_noise(u))
    path = lambda r: F.substring_index(F.lower(r), "?", 1)
    parts = lambda r: F.filter(F.split(path(r), "/"), lambda s: s != "")
    asks = lambda r: F.get(parts(r), F.lit(0)).rlike(r"^(?:api|v[0-9]+)$") | F.arrays_overlap(parts(r), F.array(*map(F.lit, ROUTE_HINTS)))
    fits = lambda r: F.length(r).between(4, 256) & ~F.lower(r).rlike("^" + _one_of(NO_ROUTES)) & ~path(r).rlike(_one_of(FILE_ENDS) + "$") & (F.size(parts(r)) > 0)
    foreign = F.lower(F.regexp_replace(v, _URL, " ")).rlike("file://|package:")
    routes = F.when(~foreign, F.filter(every(F.regexp_replace(v, _URL, " "), _ROUTE), lambda r: fits(r) & asks(r))).otherwise(F.array().cast("array<string>"))
    chinese = F.length(F.regexp_replace(v, "[^㐀-鿿]", "")) >= 2
    word = F.length(v).between(5, 120) & ~v.rlike(r"[/\\ \t\n?&=#]") & ~v.isin(*COMMON_NAMES)
    whole = lambda kind, on: F.when(on, F.array(F.struct(F.lit(kind).alias("kind"), v.alias("value"))))
    listed = lambda kind, values: F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    camel, structured = word & v.rlike(_CAMEL) & v.rlike("[a-z][A-Z]"), word & v.rlike(_STRUCTURED)
    found = [listed("url", urls), listed("library_uri", libraries), listed("api_route", routes), whole("chinese_text", chinese), whole("camel_case", camel), whole("structured_key", structured)]
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(col(c).rlike(_TELLING) & ~is_public_noise(v), F.concat(*(F.coalesce(x, none) for x in found))).otherwise(none)


# Files of signatures and licences, and beginnings of the paths of frameworks' sources.
SIGNATURE_SOURCE = r"(?i)(?:META-INF/.*\.(?:RSA|DSA|EC|SF|MF)$|NOTICE|LICENSE)"
FRAMEWORK_PATHS = (
    "android/", "androidx/", "com/android/", "dalvik/", "j$/", "java/", "javax/", "sun/", "com/sun/", "jdk/", "libcore/", "org/w3c/", "org/xml/", "org/xmlpull/", "org/json/", "org/apache/", "kotlin/", "kotlinx/",
    "com/google/", "pub/devrel/", "okhttp3/", "okio/", "retrofit2/", "com/squareup/", "io/reactivex/", "com/bumptech/glide/", "org/intellij/", "org/jetbrains/", "org/checkerframework/", "com/facebook/",
    "com/airbnb/", "com/alibaba/", "com/tencent/", "com/bytedance/", "javax/xml/",
)


def worth_keeping(values: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """values without those whose other sources are all signatures or licences, or whose Java sources are all a framework's.

    A Java source is a file ending in .java; its path begins behind ``sources/`` where that occurs.
    """
    java = F.endswith(source, F.lit(".java"))
    path = F.when(F.contains(source, F.lit("sources/")), F.regexp_extract(source, r"(?s)^.*?sources/(.*)$", 1)).otherwise(F.col(source))
    other = ~java & ~F.col(source).rlike(SIGNATURE_SOURCE)
    framework = path.rlike("^" + _one_of(FRAMEWORK_PATHS))
    judged = values.groupBy(*keys).agg(F.bool_or(F.when(~java, other)).alias("_other"), F.bool_and(F.when(java, framework)).alias("_framework"))
    good = judged.where("coalesce(_other, true) and not coalesce(_framework, false)").select(*keys)
    return values.join(good, list(keys), "left_semi")


def products_in_use(texts: DataFrame, known: Sequence[Fingerprint], app: str = "app", source: str = "source", text: str = "text") -> DataFrame:
    """(app, product, prefixes): products of which an app has a name by prefix, and whose pattern it holds if they have one.

    A prefix counts in a text, dotted or with slashes, where no further name character follows, and as a part of a source's
    path; a pattern counts only in sources that are not the product's own.
    """
    normal = F.concat(F.lit("."), F.regexp_replace(F.col(source), r"[\\/]", "."), F.lit("."))
    is_code = F.lower(F.col(source)).rlike(r"\.(?:java|kt|smali)$")
    slashed = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.col(source), r"\\", "/"), "^/+|/+$", ""))
    marks = []
    for k in known:
        said = [F.col(text).rlike(_one_of((p, p.replace(".", "/"))) + r"(?:[./;$\x00]|$)") | F.contains(normal, F.lit(f".{p}.")) for p in k.prefixes]
        named = F.array_compact(F.array(*(F.when(s, F.lit(p)) for s, p in zip(said, k.prefixes, strict=True)))) if said else F.array().cast("array<string>")
        own = is_code & F.coalesce(slashed.rlike("/" + _one_of([p.replace(".", "/") for p in k.prefixes]) + "/"), F.lit(False)) if k.prefixes else F.lit(False)
        seen = F.lit(True) if k.recognised_by is None else ~own & F.col(text).rlike(f"(?m){k.recognised_by}")
        marks.append(F.struct(F.lit(k.product).alias("product"), F.coalesce(named, F.array().cast("array<string>")).alias("named"), F.coalesce(seen, F.lit(False)).alias("seen")))
    rows = texts.select(F.col(app).alias("app"), F.explode(F.array(*marks)).alias("m")).select("app", "m.*").where("size(named) > 0 or seen")
    found = rows.groupBy("app", "product").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("named")))).alias("prefixes"), F.bool_or("seen").alias("seen"))
    return found.where("size(prefixes) > 0 and seen").select("app", "product", "prefixes")


# Marks of views in scripts.
VIEW_MARKS = ("web-view", "plus.webview", "createWebview", "webviewUrl", "loadURL(")
MIXED, UNI, SHELL, UNKNOWN = "混合", "uni-app", "h5壳", "unknown"


def web_packages(entries: DataFrame, app: str = "app", name: str = "name", text: str = "text") -> DataFrame:
    """(app, tech_type, confused, details) of the entries of web packages, in one pass over names and texts.

    ``details`` are the signs of obfuscated scripts: the name of its loader, and manifests that configure it or mention it
    in broken JSON, sorted.
    """
    n, t = F.col(name), F.coalesce(F.col(text), F.lit(""))
    script = n.rlike(r"/(?:app-service\.js|app-config-service\.js|app-view\.js|index\.html)$")
    manifest = F.startswith(n, F.lit("assets/apps/")) & n.rlike(r"/(?:manifest|mani)\.json$") & (t != "")
    value = lambda path: F.get_json_object(t, path)
    whole = value("$").isNotNull() & F.trim(t).rlike(r"^[\[{]")
    set_to = lambda v: v.isNotNull() & ~v.isin("", "{}", "[]")
    signs = [F.when(manifest & whole & set_to(value(path)), F.concat(n, F.lit(f":{label}"))) for label, path in (("plus.confusion", "$.plus.confusion"), ("app-plus.confusion", "$['app-plus'].confusion"), ("confusion", "$.confusion"))]
    signs.append(F.when(manifest & ~whole & F.contains(t, F.lit("confusion")), F.concat(n, F.lit(":confusion_text"))))
    signs.append(F.when(F.endswith(n, F.lit("/app-confusion.js")), F.lit("app-confusion.js")))
    has_id = n.rlike(r"^assets/apps/[^/]+/")
    uni = n.rlike(r"/app-(?:config-)?service\.js$") | (script & t.rlike("__uniRoutes|__uniConfig"))
    view = n.rlike("/www/hybrid/html/") | (script & t.rlike(_one_of(VIEW_MARKS)))
    found = entries.groupBy(F.col(app).alias("app")).agg(F.bool_or(uni).alias("uni"), F.bool_or(view).alias("view"), F.bool_or(has_id).alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(*signs)))))).alias("details"))
    tech = F.when(F.col("uni"), F.when(F.col("view"), MIXED).otherwise(UNI)).when(F.col("id"), SHELL).otherwise(UNKNOWN)
    return found.select("app", tech.alias("tech_type"), (F.size("details") > 0).alias("confused"), "details")


# Beginnings of files by kind, in bytes.
MAGIC = (("application/zip", "504B0304"), ("application/zip", "504B0506"), ("application/gzip", "1F8B"), ("application/pdf", "25504446"), ("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"), ("application/x-elf", "7F454C46"), ("application/vnd.android.dex", "6465780A"))


def mime_type(content: Column | str) -> Column:
    """The type of a file by its first bytes; text where the first 8 192 hold no zero byte, else octets; null for null."""
    head = F.hex(F.substring(col(content), 1, 16))
    text = ~F.substring(col(content), 1, 8192).cast("binary").isNull() & ~F.hex(F.substring(col(content), 1, 8192)).rlike("^(?:..)*?00")
    named = F.coalesce(*(F.when(F.startswith(head, F.lit(m)), F.lit(kind)) for kind, m in MAGIC))
    return F.when(col(content).isNotNull(), F.coalesce(named, F.when(text, "text/plain").otherwise("application/octet-stream")))
