"""Families of applications by the libraries they are built of, and by their own classes where libraries tell nothing.

Two applications are linked by the weight of what they share. Every linked pair shares one of the rarer features that make
up most of either's weight, so only those are joined. Groups are strict: all members share a feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.operators.families import _pairs, cores, prefixes, strict_groups
from quarrion.storage import by_merge, checkpointed

# Packages that many applications share, endings of packages of platforms, and class names that say nothing.
COMMON_PACKAGES = (
    "analyzer", "archive", "args", "asn1lib", "async", "bloc", "characters", "clock", "collection", "convert", "crypto", "dio", "encrypt", "equatable", "ffi", "file", "flutter_bloc",
    "flutter_localizations", "flutter_riverpod", "flutter_svg", "get", "get_it", "go_router", "html", "http", "http_parser", "intl", "js", "json_annotation", "logging", "meta", "mime", "nested", "path",
    "plugin_platform_interface", "pointycastle", "pool", "protobuf", "provider", "riverpod", "rxdart", "source_span", "stack_trace", "stream_channel", "synchronized", "typed_data", "uuid", "vector_math",
    "web", "web_socket_channel", "win32", "xml", "yaml",
)
PLATFORM_ENDS = ("_android", "_ios", "_linux", "_macos", "_platform_interface", "_web", "_windows")
GENERIC_CLASSES = (
    "App", "Application", "BaseModel", "BasePage", "BaseState", "BaseView", "Config", "Constants", "Controller", "Error", "Home", "HomePage", "HttpClient", "Loading", "LoginPage", "MainPage", "Model",
    "MyApp", "Network", "Response", "Result", "Router", "Service", "Settings", "SplashPage", "State", "Utils", "ViewModel",
)
# Features that a node has and a pair shares at least, likeness and containment by weight, and the share of applications that a foreign package may have.
LEAST, LIKENESS, CONTAINED, FOREIGN_SHARE = 8, 0.58, 0.68, 0.20


def library_features(uris: DataFrame) -> DataFrame:
    """Distinct (node, feature) of rows (node, package, uri) that tell applications apart.

    Out go libraries of the platform, of common packages and platform parts of others, of packages that more than 20 of a
    hundred nodes (and more than 8) use, and cached files; the node's own package stays in any case.
    """
    root = F.regexp_extract("uri", "^package:([^/]+)/", 1)
    rows = uris.select("node", "package", F.trim("uri").alias("uri")).where("uri <> ''").distinct().withColumn("root", root)
    n = uris.select("node").distinct().count()
    df = rows.where("root <> ''").select("node", "root").distinct().groupBy("root").agg(F.count("*").alias("df"))
    foreign = (F.col("root") != "") & ~F.col("root").eqNullSafe(F.col("package"))
    dull = F.col("root").isin(*COMMON_PACKAGES) | F.col("root").rlike("(?:" + "|".join(PLATFORM_ENDS) + ")$") | (F.col("df") > max(8, int(FOREIGN_SHARE * n)))
    out = F.startswith("uri", F.lit("dart:")) | F.startswith("uri", F.lit("package:flutter/")) | (F.startswith("uri", F.lit("file:")) & F.contains("uri", F.lit("/.pub-cache/")))
    return rows.join(by_merge(df), "root", "left").where(~out & ~(foreign & F.coalesce(dull, F.lit(False)))).select("node", F.col("uri").alias("feature")).distinct()


def is_telling_class(c: Column) -> Column:
    """Class names of four letters or more that are neither generic nor private."""
    name = F.trim(F.regexp_replace(c, "<.*>", ""))
    return (F.length(name) >= 4) & ~name.isin(*GENERIC_CLASSES) & ~name.rlike("^[_$]")


def weighted_links(members: DataFrame, *, least: int = LEAST, likeness: float = LIKENESS, contained: float = CONTAINED) -> DataFrame:
    """(l, r, shared, likeness, containment) of the linked nodes of distinct rows (node, feature), by idf weights.

    Nodes with fewer than ``least`` features take no part. Linked are pairs that share as many, of which the shared weight
    reaches a part of the whole and a part of the lighter node's.
    """
    size = members.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    fit = checkpointed(members.join(by_merge(size), "node").select("node", "feature"))
    n = fit.select("node").distinct().count()
    df = fit.groupBy("feature").agg(F.count("*").alias("df"))
    weighed = checkpointed(fit.join(by_merge(df), "feature").select("node", "feature", "df", (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("weight")))
    total = weighed.groupBy("node").agg(F.sum("weight").alias("total"))
    met = _pairs(prefixes(weighed, F.col("weight"), F.lit(likeness)))
    left = met.join(by_merge(weighed.select(F.col("node").alias("l"), "feature", "weight")), "l")
    sums = left.join(by_merge(weighed.select(F.col("node").alias("r"), "feature")), ["r", "feature"]).groupBy("l", "r").agg(F.count("*").alias("shared"), F.sum("weight").alias("both"))
    lw, rw = total.select(F.col("node").alias("l"), F.col("total").alias("lw")), total.select(F.col("node").alias("r"), F.col("total").alias("rw"))
    rated = sums.join(by_merge(lw), "l").join(by_merge(rw), "r").withColumns({"likeness": F.col("both") / (F.col("lw") + F.col("rw") - F.col("both")), "containment": F.col("both") / F.least("lw", "rw")})
    return rated.where((F.col("shared") >= least) & (F.col("likeness") >= likeness) & (F.col("containment") >= contained)).select("l", "r", "shared", "likeness", "containment")


def _families(members: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(family, node, stage), and (family, stage, fingerprint): what all members share, the rarest first."""
    groups = checkpointed(strict_groups(checkpointed(weighted_links(members)), members).select("family", "node"))
    fit = members.join(by_merge(members.groupBy("node").agg(F.count("*").alias("k")).where(F.col("k") >= LEAST)), "node")
    df = fit.groupBy("feature").agg(F.count("*").alias("df"))
    shared = cores(groups, members).join(by_merge(df), "feature").groupBy("family").agg(F.array_sort(F.collect_list(F.struct("df", "feature"))).alias("f"))
    return groups.withColumn("stage", F.lit(stage)), shared.select("family", F.lit(stage).alias("stage"), F.col("f.feature").alias("fingerprint"))


def library_families(uris: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Families (family, node, stage) and their fingerprints (family, stage, fingerprint), a family named by its least node.

    First by libraries (node, package, uri); nodes that have no family then by their own classes (node, class).
    """
    first, marks = _families(checkpointed(library_features(uris)), "libraries")
    own = classes.where(is_telling_class(F.col("class"))).select("node", F.trim("class").alias("feature")).distinct()
    second, more = _families(checkpointed(own.join(by_merge(first.select("node")), "node", "left_anti")), "classes")
    return first.unionByName(second), marks.unionByName(more)
