"""The framework of a package by the names of its entries: rules with evidence, scores, and a stable maximum.

Every rule asks for entries; what it finds is evidence, and the amount is its score. Two rules ask for more: one for two
libraries in one folder, one for a resource that decides alone or a launcher that confirms weaker signs. All evidence of
an app is gathered in one aggregation of its entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLUTTER, DCLOUD, NATIVE = "Flutter", "uni-app/DCloud", "原生 (Native Android)"
# Frameworks in order, and what names of libraries (so) and of entries (path) hold under each.
RULES: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = (
    (FLUTTER, ()),
    ("React Native", (("path", "index.android.bundle"), ("so", "libhermes"), ("so", "libreactnativejni"), ("so", "libjsc"))),
    (DCLOUD, ()),
    ("Unity", (("so", "libil2cpp.so"), ("so", "libunity.so"), ("path", "global-metadata.dat"), ("path", "assets/bin/Data"))),
    ("Unreal Engine", (("so", "libUE4.so"), ("so", "libUnreal"))),
    ("Xamarin/.NET MAUI", (("so", "libmonodroid"), ("so", "libxamarin"), ("so", "libmonosgen"), ("path", "assemblies/"))),
    ("Cordova/PhoneGap", (("path", "assets/www/cordova.js"), ("path", "assets/www/cordova_plugins"), ("path", "res/xml/config.xml"))),
    ("Capacitor", (("path", "assets/public/"), ("path", "capacitor.config.json"), ("path", "capacitor.plugins.json"))),
    ("APICloud", (("path", "assets/widget/"), ("path", "com/uzmap"), ("path", "com/apicloud"))),
    ("Cocos2d-x", (("so", "libcocos2d"), ("so", "libcocos"), ("path", "assets/src/project.json"))),
)
# The pair of libraries, resources that decide alone, roots and signs that a launcher confirms, and the launchers.
PAIR = ("libapp.so", "libflutter.so")
DIRECT, ROOT = r"^assets/apps/([^/]+)/www/(?:manifest\.json|index\.html|app-config-service\.js)$", r"^assets/apps/([^/]+)(?:/|$)"
APP_ID, CONTROL, WEEX = r"^(?!\.{1,2}$)[A-Za-z0-9_.-]+$", "dcloud_control.xml", "libweexcore.so"
LAUNCHERS = ("io.dcloud.PandoraEntry", "io.dcloud.PandoraEntryActivity", "io.dcloud.uniapp.UniAppActivity")


def _first(on: Column, value: Column) -> Column:
    """The value of the first entry for which the condition holds."""
    return F.min_by(F.when(on, value), F.when(on, F.col("position")))


def detected(entries: DataFrame, launchers: DataFrame | None = None) -> DataFrame:
    """(app, framework, confidence, matches): of entries (app, position, name) and launchers (app, launcher).

    ``matches`` has (framework, score, evidence) of all frameworks with evidence, the highest score first, at ties in the
    order of RULES; the first is the app's. From a score of 2 on confidence is high, else low; an app without evidence is
    NATIVE by default. An app has its row if it has an entry; null names are none. One shuffle, by app.
    """
    name, last = F.col("name"), F.substring_index("name", "/", -1)
    is_library = F.endswith(name, F.lit(".so"))
    found: list[Column] = []
    for i, (_, signs) in enumerate(RULES):
        for j, (kind, sign) in enumerate(signs):
            on = is_library & F.contains(last, F.lit(sign)) if kind == "so" else F.contains(name, F.lit(sign))
            found.append(_first(on, F.concat(F.lit("lib/*/"), last) if kind == "so" else name).alias(f"e{i}_{j}"))
    folder = F.regexp_extract(name, r"^lib/([^/]+)/[^/]+\.so$", 1)
    both = [F.collect_set(F.when(name == F.concat(F.lit("lib/"), folder, F.lit(f"/{lib}")), folder)).alias(f"abis{i}") for i, lib in enumerate(PAIR)]
    app_id = lambda pattern: F.regexp_extract(name, pattern, 1)
    weak = [_first(last == CONTROL, name).alias("control"), _first(app_id(ROOT).rlike(APP_ID), name).alias("root"), _first(last == WEEX, name).alias("weex")]
    direct = _first(app_id(DIRECT).rlike(APP_ID), F.struct(F.concat(F.lit("assets/apps/"), app_id(DIRECT), F.lit("/www/")).alias("folder"), name.alias("name"))).alias("direct")
    apps = entries.groupBy("app").agg(*found, *both, *weak, direct)
    if launchers is None:
        apps = apps.withColumn("launcher", F.lit(None).cast("string"))
    else:
        known = launchers.where(F.col("launcher").isin(*LAUNCHERS)).groupBy(F.col("app").alias("_app")).agg(F.min("launcher").alias("launcher"))
        apps = apps.join(known, F.col("app") == F.col("_app"), "left").drop("_app")

    def match(i: int, framework: str, score: Column, evidence: Column) -> Column:
        return F.struct((-score).cast("int").alias("less"), F.lit(i).alias("order"), F.lit(framework).alias("framework"), score.cast("int").alias("score"), evidence.alias("evidence"))

    abi, sign = F.array_min(F.array_intersect("abis0", "abis1")), F.coalesce("control", "root", "weex")
    matches = []
    for i, (framework, signs) in enumerate(RULES):
        if framework == FLUTTER:
            m = F.when(abi.isNotNull(), match(i, framework, F.lit(2), F.array(*(F.concat(F.lit("lib/"), abi, F.lit(f"/{lib}")) for lib in PAIR))))
        elif framework == DCLOUD:
            joint = F.when(sign.isNotNull() & F.col("launcher").isNotNull(), match(i, framework, F.lit(2), F.array(F.concat(F.lit("launcher:"), "launcher"), sign)))
            m = F.when(F.col("direct").isNotNull(), match(i, framework, F.lit(3), F.array("direct.folder", "direct.name"))).otherwise(joint)
        else:
            evidence = F.array_compact(F.array(*(F.col(f"e{i}_{j}") for j in range(len(signs)))))
            m = F.when(F.size(evidence) > 0, match(i, framework, F.size(evidence), evidence))
        matches.append(m)
    ranked = apps.select("app", F.array_sort(F.array_compact(F.array(*matches))).alias("ranked"))
    best = F.get("ranked", F.lit(0))
    shown = F.transform("ranked", lambda m: F.struct(m["framework"].alias("framework"), m["score"].alias("score"), m["evidence"].alias("evidence")))
    return ranked.select("app", F.coalesce(best["framework"], F.lit(NATIVE)).alias("framework"), F.when(best.isNull(), "default").when(best["score"] >= 2, "high").otherwise("low").alias("confidence"), shown.alias("matches"))


def launcher(manifest: Column) -> Column:
    """The first activity of a manifest in plain XML that the launcher shows, an alias by its target, with its whole name; null if none."""
    package = F.regexp_extract(manifest, r"<manifest\b[^>]*?\bpackage\s*=\s*[\"']([^\"']*)", 1)
    whole = F.regexp_extract_all(manifest, F.lit(r"(?s)(<(?:activity-alias|activity)\b[^>]*?(?:/>|>.*?</activity(?:-alias)?\s*>))"), F.lit(1))

    def shown(x: Column) -> Column:
        filters = F.regexp_extract_all(x, F.lit(r"(?s)<intent-filter\b[^>]*>(.*?)</intent-filter\s*>"), F.lit(1))
        return F.exists(filters, lambda f: f.rlike(r"(?s)<action\b[^>]*[\"']android\.intent\.action\.MAIN[\"']") & f.rlike(r"(?s)<category\b[^>]*[\"']android\.intent\.category\.LAUNCHER[\"']"))

    def name(x: Column) -> Column:
        head = F.regexp_extract(x, r"(?s)^(<[^>]*>)", 1)
        given = F.when(F.startswith(x, F.lit("<activity-alias")), F.regexp_extract(head, r"\bandroid:targetActivity\s*=\s*[\"']([^\"']*)", 1)).otherwise(F.regexp_extract(head, r"\bandroid:name\s*=\s*[\"']([^\"']*)", 1))
        return F.when(F.startswith(given, F.lit(".")), F.concat(package, given)).when((given != "") & ~F.contains(given, F.lit(".")) & (package != ""), F.concat(package, F.lit("."), given)).otherwise(given)

    names = F.transform(F.filter(whole, shown), name)
    known = F.filter(names, lambda n: n.isin(*LAUNCHERS))
    return F.coalesce(F.get(known, F.lit(0)), F.get(F.filter(names, lambda n: n != ""), F.lit(0)))
