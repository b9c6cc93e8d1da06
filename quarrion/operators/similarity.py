"""Set similarity over (node, feature) tables: weights, pair joins, families and their fingerprints."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.operators.graph import components
from quarrion.storage import by_merge, checkpointed

#: Features that are told apart by frequency when sets are ordered; all others count as rarer.
FREQUENT = 100_000
#: Features that a task orders at a time, sets that are compared in one block, and ids up to which a table is broadcast.
ORDERED, BLOCK, FEW_IDS = 2_000_000, 500, 1_000_000
# Least weights of the items that a vector's bitmaps tell of.
HEAVY = (8, 16, 32, 64)
#: 64-bit words of the bitmap that a set sends along with its first items.
MARKS = 4


def features(df: DataFrame, node: str, items: Column | str) -> DataFrame:
    """Distinct (node, feature) rows of an array column; blanks and nulls give none."""
    c = F.col(items) if isinstance(items, str) else items
    return df.select(F.col(node).alias("node"), F.explode(c).alias("feature")).where("trim(feature) <> ''").distinct()


def document_frequency(members: DataFrame) -> DataFrame:
    return members.groupBy("feature").agg(F.count("*").alias("df"))


def frequent(members: DataFrame, least: int, most: int | Column) -> DataFrame:
    """The rows whose feature occurs in at least and at most so many nodes."""
    df = document_frequency(members).where((F.col("df") >= least) & (F.col("df") <= most))
    return members.join(df, "feature")


def idf(members: DataFrame, smooth: bool = True) -> DataFrame:
    """(feature, df, idf): ln((n+1)/(df+1)) + 1, or the plain ln(n/df)."""
    n = members.select("node").distinct().agg(F.count("*").alias("n"))
    value = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1 if smooth else F.log(F.col("n") / F.col("df"))
    return document_frequency(members).join(F.broadcast(n), F.lit(True)).select("feature", "df", value.alias("idf"))  # n is one row


def ordered_sets(members: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node, items): the features of each node from rare to frequent, as structs of the number of nodes that have them, their hash, and their idf squared if ``weights`` are given.

    Features are told by 64 bits. Meant for short sets, which travel with each of their features.
    """
    hashed = members.where("node is not null and feature is not null").select("node", F.xxhash64("feature").alias("item"))
    known = hashed.groupBy("item").agg(F.count("*").alias("df"))
    if weights is not None:
        known = known.join(by_merge(weights.select(F.xxhash64("feature").alias("item"), (F.col("idf") * F.col("idf")).alias("w2"))), "item")
    return hashed.join(by_merge(known), "item").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", *(c for c in known.columns if c != "df")))).alias("items"))


def _meetings(at: DataFrame, fits: Column | None = None) -> DataFrame:
    """Pairs of rows (item, node, before, after, ...) that meet at an item, columns with l_ and r_ in front, l_node < r_node; each pair once, at its first common item.

    ``before`` and ``after`` are the items of a node on either side, all in one order, and the rows are those of a beginning
    of each. Nothing is shuffled by pairs.
    """
    side = lambda s: at.select("item", *(F.col(c).alias(f"{s}_{c}") for c in at.columns if c != "item"))
    met = side("l").join(by_merge(side("r")), "item").where("l_node < r_node")
    met = met if fits is None else met.where(fits)
    return met.where(~F.arrays_overlap("l_before", "r_before"))


def _placed(sets: DataFrame, *more: str) -> DataFrame:
    """(item, node, df, n, before, after, ...) of nodes (node, items, ...): a row an item; further columns are expressions in ``pos``."""
    each = sets.select("*", F.posexplode("items").alias("pos", "x"))
    own = F.col("items.item")
    return each.select(F.col("x.item").alias("item"), "node", F.col("x.df").alias("df"), F.size("items").alias("n"), F.slice(own, F.lit(1), F.col("pos")).alias("before"), F.slice(own, F.col("pos") + 2, F.size("items")).alias("after"), *map(F.expr, more))


def pair_overlaps(members: DataFrame, most_df: int) -> DataFrame:
    """(l, r, shared, l_size, r_size, jaccard, containment) of the pairs that share a feature of at most ``most_df`` nodes, l < r.

    An inverted-index join: a feature brings at most most_df squared pairs. Counts and sizes are of all features; the sets
    travel with their rarer features, and rare features come first in them.
    """
    met = _meetings(_placed(ordered_sets(members)).where(F.col("df") <= most_df).drop("df"))
    shared = F.when(F.arrays_overlap("l_after", "r_after"), F.size(F.array_intersect("l_after", "r_after"))).otherwise(0) + 1
    sized = met.select(F.col("l_node").alias("l"), F.col("r_node").alias("r"), shared.cast("long").alias("shared"), F.col("l_n").cast("long").alias("l_size"), F.col("r_n").cast("long").alias("r_size"))
    return sized.select("*", (F.col("shared") / (F.col("l_size") + F.col("r_size") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("l_size", "r_size")).alias("containment"))


def pairs_above(members: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """(l, r, shared, l_size, r_size, jaccard) of all pairs of rows (node, feature) at or above a threshold, l < r.

    Empty sets have no pair. No pair is lost, however frequent its features are.
    """
    return set_pairs_above(member_sets(members), threshold, strict)


def short_pairs_above(members: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """(l, r, shared, l_size, r_size, jaccard) of all pairs of short sets of rows (node, feature) at or above a threshold, l < r.

    Features are ordered from rare to frequent. What two sets share from their first common feature on is at most the
    shorter of the two rests that begin with it; pairs for which that is too little are dropped where they meet, others
    are counted there.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    reaches = lambda x: x > threshold if strict else x >= threshold
    jaccard = lambda shared: shared / (F.col("l_n") + F.col("r_n") - shared)
    each = _placed(ordered_sets(members), "size(items) - pos AS rest").drop("df")
    met = _meetings(each.where(reaches(F.col("rest") / F.col("n"))), reaches(jaccard(F.least("l_rest", "r_rest"))))
    shared = F.size(F.array_intersect("l_after", "r_after")) + 1
    sized = met.select(F.col("l_node").alias("l"), F.col("r_node").alias("r"), shared.cast("long").alias("shared"), F.col("l_n").cast("long").alias("l_size"), F.col("r_n").cast("long").alias("r_size"))
    return sized.withColumn("jaccard", F.col("shared") / (F.col("l_size") + F.col("r_size") - F.col("shared"))).where(reaches(F.col("jaccard")))


def short_cosines_above(members: DataFrame, weights: DataFrame, least: float) -> DataFrame:
    """(l, r, shared, cosine) of all pairs of short sets at or above a cosine, with the square of a feature's weight as its share of the product.

    Features are ordered from rare to frequent. What two vectors share from their first common feature on is at most that
    feature's share and the product of their lengths behind it (Cauchy and Schwarz), each as a part of the whole vector;
    pairs that fail that are dropped where they meet, others are rated there.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must lie above 0 and not above 1")
    sets = ordered_sets(members, weights).withColumn("norm2", F.aggregate("items", F.lit(0.0), lambda a, x: a + x["w2"]))
    behind = "aggregate(slice(items, pos + 2, size(items)), 0D, (a, x) -> a + x.w2) AS behind"
    each = _placed(sets, "norm2", "x.w2 AS own", behind, "slice(items.w2, pos + 2, size(items)) AS w").drop("df", "n")
    first = each.where((F.col("own") > 0) & (F.col("own") + F.col("behind") >= least * least * F.col("norm2") * (1 - 1e-9)))
    norms, enough = F.sqrt(F.col("l_norm2") * F.col("r_norm2")), least * (1 - 1e-9)
    more = F.arrays_overlap("l_after", "r_after")
    bound = F.col("l_own") + F.sqrt(F.col("l_behind") * F.col("r_behind")) >= enough * norms
    met = _meetings(first, bound & ((F.col("l_own") >= enough * norms) | more))
    both = F.array_intersect("l_after", "r_after")
    rest = F.aggregate(F.zip_with("l_after", "l_w", lambda x, w: F.when(F.array_contains("r_after", x), w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    dot = F.col("l_own") + F.when(more, rest).otherwise(0.0)
    shared = F.when(more, F.size(both)).otherwise(0) + 1
    rated = met.select(F.col("l_node").alias("l"), F.col("r_node").alias("r"), shared.cast("long").alias("shared"), (dot / norms).alias("cosine"))
    return rated.where(F.col("cosine") >= least)


def _first_weights(classes: DataFrame, least: float, part: float) -> DataFrame:
    """(cls, norm2, item, own, left, shorter, m0, ...): the first items of each vector from heavy to light, up to which two alike share ``part`` of the smaller.

    ``left`` weighs what lies from an item on. The marks are bitmaps of items of 8, 16, 32 and 64 or more, a bit for whether an odd
    number of them falls there: where two differ in a bit, they differ in an item of that weight.
    """
    names, tiny = [f"m{i}" for i in range(2 * len(HEAVY))], 1e-9

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[list] = [[] for _ in range(6 + len(names))]
            for cls, items, w in zip(batch.column("cls").to_pylist(), batch.column("items"), batch.column("w"), strict=True):
                item, weight = items.values.to_numpy(), w.values.to_numpy()
                order = np.lexsort((item, -weight))
                own = weight[order]
                left = np.cumsum(own[::-1])[::-1]
                norm2 = math.fsum(weight.tolist())
                kept = (left >= ((least * least - part) - tiny) * norm2) & (own > 0)
                n = int(kept.sum())
                marks = []
                for i, lower in enumerate(HEAVY):
                    upper = HEAVY[i + 1] if i + 1 < len(HEAVY) else math.inf
                    bit = item[(weight >= lower) & (weight < upper)] & 127
                    odd = np.flatnonzero(np.bincount(bit, minlength=128) & 1)
                    marks += [int(np.bitwise_xor.reduce(np.left_shift(np.int64(1), odd[odd >> 6 == j] & 63))) for j in (0, 1)]
                row = [np.full(n, cls), np.full(n, norm2), item[order][kept], own[kept], left[kept], left[kept] >= (least - part - tiny) * norm2, *(np.full(n, m) for m in marks)]
                for column, values in zip(got, row, strict=True):
                    column.append(values)
            kinds = [np.int64, np.float64, np.int64, np.float64, np.float64, np.bool_, *[np.int64] * len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k) if c else np.array([], k)) for c, k in zip(got, kinds, strict=True)], names=["cls", "norm2", "item", "own", "left", "shorter", *names])

    return classes.select("cls", "items", "w").mapInArrow(first, "cls long, norm2 double, item long, own double, left double, shorter boolean, " + ", ".join(f"{m} long" for m in names))


def cosines_above(members: DataFrame, weights: DataFrame, least: float) -> DataFrame:
    """(l, r, shared, cosine) of all pairs at or above a weighted cosine, with the square of a feature's weight as its share of the product.

    Made of classes of equal sets. Of two vectors alike the smaller shares ``least`` of its weight at least, the larger the
    square of that; so they share an item among the first of both, heavy ones first, and more weight of these as each set
    gives ``part`` more. A meeting leaves at most what lies before and behind it in both; that, the weights and the bitmaps drop
    others in the join. Pairs that share enough there are rated on whole sets, in blocks to which each set is sent once.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must lie above 0 and not above 1")
    t, tiny, part = float(least), 1e-9, min(0.03, least * least / 4)
    each = members.where("node is not null").join(by_merge(weights.select("feature", (F.col("idf") * F.col("idf")).alias("w2"))), "feature")
    made = each.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("feature").alias("item"), "w2"))).alias("x"))
    sets = checkpointed(made.select("node", F.xxhash64("x.item").alias("cls"), F.col("x.item").alias("items"), F.col("x.w2").alias("w")))
    own = sets.select("node", "cls", F.size("items").cast("long").alias("size"), F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("norm2"))
    first = _first_weights(sets.select("cls", "items", "w").dropDuplicates(["cls"]), t, part)
    marks = first.columns[6:]
    band = F.floor(F.log("norm2") / max(-2 * math.log(t), tiny) + tiny)
    side = lambda df, s, bands: df.select(F.xxhash64("item", bands).alias("key"), *(F.col(c).alias(f"{s}_{c}") for c in ("cls", "norm2", "own", "left", *marks)))
    small = side(first.where("shorter").withColumn("band", F.explode(F.array(band, band + 1))), "s", F.col("band"))
    large = side(first, "g", band)
    ordered = (F.col("s_norm2") < F.col("g_norm2")) | ((F.col("s_norm2") == F.col("g_norm2")) & (F.col("s_cls") < F.col("g_cls")))
    need = t * F.sqrt(F.col("s_norm2") * F.col("g_norm2")) * (1 - tiny)
    comparable = F.least("s_norm2", "g_norm2") >= need
    placed = F.least(F.col("s_norm2") - F.col("s_left"), F.col("g_norm2") - F.col("g_left")) + F.least("s_left", "g_left") >= need
    differing = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"s_{m}").bitwiseXOR(F.col(f"g_{m}"))) * float(HEAVY[i // 2]) for i, m in enumerate(marks)))
    met = small.join(large.hint("merge"), "key").where(ordered & comparable & placed & (F.col("s_norm2") + F.col("g_norm2") - differing >= 2 * need))
    times = met.groupBy(F.col("s_cls").alias("l"), F.col("g_cls").alias("r")).agg(F.sum("s_own").alias("met"), F.first("s_norm2").alias("l_norm2"), F.first("g_norm2").alias("r_norm2"))
    pairs = checkpointed(times.where(F.col("met") >= (part - 2 * tiny) * F.col("l_norm2")).drop("met"))
    rated = _alike(pairs.select("l", "r"), sets).join(pairs, ["l", "r"]).select("l", "r", "shared", (F.col("dot") / F.sqrt(F.col("l_norm2") * F.col("r_norm2"))).alias("cosine"))
    node = lambda side: own.select(F.col("cls").alias(f"{side}_cls"), F.col("node").alias(side))
    far = rated.where(F.col("cosine") >= least).withColumnsRenamed({"l": "a_cls", "r": "b_cls"}).join(node("a"), "a_cls").join(node("b"), "b_cls")
    out = far.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), "shared", "cosine")
    copies = own.where("norm2 > 0").select("cls", F.col("node").alias("l"), "size").join(own.select("cls", F.col("node").alias("r")), "cls").where("l < r")
    return out.unionByName(copies.select("l", "r", F.col("size").alias("shared"), F.lit(1.0).alias("cosine")))


def feature_sets(rows: DataFrame, node: str, items: Column) -> DataFrame:
    """(node, cls, items): the sorted hashes of a node's distinct features, of rows with an array of features.

    ``cls`` tells equal sets. Features are told by 64 bits. Nodes without features are left out, and rows of one node are
    one set; only those are shuffled.
    """
    hashed = F.transform(items, lambda x: F.xxhash64(x))
    each = rows.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), hashed.alias("items"))
    again = checkpointed(each.groupBy("node").count().where("count > 1").select("node"))
    if again.count():
        joined = each.join(again, "node", "left_semi").groupBy("node").agg(F.flatten(F.collect_list("items")).alias("items"))
        each = each.join(again, "node", "left_anti").unionByName(joined)
    own = each.select("node", F.array_sort(F.array_distinct("items")).alias("items"))
    return own.select("node", F.xxhash64("items").alias("cls"), "items")


def _of_classes(sets: DataFrame) -> DataFrame:
    """(node, cls, size) of the nodes whose sets are not empty."""
    return checkpointed(sets.select("node", "cls", F.size("items").cast("long").alias("size"))).where("size > 0")


def member_sets(members: DataFrame) -> DataFrame:
    """(node, cls, items) of rows (node, feature)."""
    own = members.where("node is not null and feature is not null").groupBy("node").agg(F.array_sort(F.collect_set(F.xxhash64("feature"))).alias("items"))
    return own.select("node", F.xxhash64("items").alias("cls"), "items")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT commonest items, sorted, and in how many sets each is."""
    df = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    rows = df.orderBy(F.desc("df"), "item").limit(FREQUENT).toPandas().sort_values("item")
    return rows["item"].to_numpy(np.int64), rows["df"].to_numpy(np.int64)


def _first_items(sets: DataFrame, threshold: float, part: float) -> DataFrame:
    """(cls, size, rank, item, shorter, m0, m1, ...): the first items of each set from rare to frequent, of which two sets alike share 1 + part of the smaller.

    ``shorter`` tells those that are enough in the smaller of two sets. Sets are ordered in the tasks that hold them: any
    order that all sets have in common serves, so only the frequent items' counts are sent to the tasks. The marks are a
    bitmap of the whole set, a bit for whether an odd number of its items falls there: two differ in no more bits than the
    sets do in items.
    """
    names = [f"m{i}" for i in range(MARKS)]
    shared = sets.sparkSession.sparkContext.broadcast(_frequent(sets))
    tiny = 1e-9

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = shared.value
        for batch in batches:
            lists = batch.column("items")
            ends, flat, cls = lists.offsets.to_numpy(), lists.values.to_numpy(), batch.column("cls").to_numpy()
            at = 0
            while at < len(cls):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + ORDERED, side="right")) - 1)
                item, size = flat[ends[at] : ends[to]], np.diff(ends[at : to + 1])
                row = np.repeat(np.arange(to - at), size)
                bit = item & (64 * MARKS - 1)
                one, starts, has = np.left_shift(np.int64(1), bit & 63), (np.cumsum(size) - size)[size > 0], np.cumsum(size > 0) - 1
                marks = [np.bitwise_xor.reduceat(np.where(bit >> 6 == i, one, 0), starts) if len(starts) else one for i in range(MARKS)]
                place = np.minimum(np.searchsorted(known, item), max(len(known) - 1, 0))
                count = np.where(known[place] == item, df[place], 0) if len(known) else np.zeros(len(item), np.int64)
                item = item[np.lexsort((item, count, row))]
                rank = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size) + 1
                n = size[row]
                more = 1 + np.floor(n * part)
                kept = rank <= n - np.ceil(n * threshold - tiny) + more
                shorter = rank <= n - np.ceil(n * (2 * threshold / (1 + threshold)) - tiny) + more
                yield pa.RecordBatch.from_arrays([pa.array(cls[at:to][row][kept]), pa.array(n[kept].astype(np.int32)), pa.array(rank[kept].astype(np.int32)), pa.array(item[kept]), pa.array(shorter[kept]), *(pa.array(m[has[row[kept]]]) for m in marks)], names=["cls", "size", "rank", "item", "shorter", *names])
                at = to

    return sets.select("cls", "items").mapInArrow(first, "cls long, size int, rank int, item long, shorter boolean, " + ", ".join(f"{m} long" for m in names))


def _few(ids: DataFrame, n: int) -> DataFrame:
    """n ids, to be broadcast if there are few."""
    return F.broadcast(ids) if n <= FEW_IDS else ids


def _sets_of(sets: DataFrame, only: DataFrame, n: int) -> DataFrame:
    """(cls, items), and w where sets have it, one row for each of n classes (cls)."""
    return sets.select("cls", "items", *(["w"] if "w" in sets.columns else [])).join(_few(only, n), "cls", "left_semi").dropDuplicates(["cls"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(l, r, shared) of pairs (l, r) of classes, and the weight ``dot`` of what they share where sets have weights w. Sets are compared in blocks, to which each is sent once.

    A block holds the sets of whole components of the pairs; a component of more than BLOCK sets takes several blocks, and
    pairs between two of these get a block of their own.
    """
    pairs = checkpointed(pairs)
    found = checkpointed(components(pairs, "l", "r"))
    n = found.count()
    large = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    seq = F.row_number().over(Window.partitionBy("component").orderBy("node"))
    big = found.join(large.select("component"), "component", "left_semi").withColumn("slot", F.xxhash64("component", F.floor(seq / BLOCK)))
    small = found.join(large.select("component"), "component", "left_anti").withColumn("slot", F.pmod(F.xxhash64("component"), F.lit(max(1, n // BLOCK))))
    slots = checkpointed(big.select("node", "slot").unionByName(small.select("node", "slot")))
    at = lambda side: slots.select(F.col("node").alias(side), F.col("slot").alias(f"{side}_slot"))
    placed = pairs.join(at("l"), "l").join(at("r"), "r").select("l", "r", F.least("l_slot", "r_slot").alias("a"), F.greatest("l_slot", "r_slot").alias("b"))
    wanted = placed.select("a", "b", F.explode(F.array("l", "r")).alias("cls")).distinct()
    weighed = ["w"] if "w" in sets.columns else []
    held = _sets_of(sets, slots.select(F.col("node").alias("cls")), n).join(wanted, "cls").select(F.col("a").alias("c"), F.col("b").alias("d"), "cls", "items", *weighed)

    def compare(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        own = {c: set(x.tolist()) for c, x in zip(s["cls"].tolist(), s["items"], strict=True)}
        return pd.DataFrame({"l": p["l"], "r": p["r"], "shared": [len(own[x] & own[y]) for x, y in zip(p["l"].tolist(), p["r"].tolist(), strict=True)]}).astype("int64")

    def weigh(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        own = {c: dict(zip(x.tolist(), w.tolist(), strict=True)) for c, x, w in zip(s["cls"].tolist(), s["items"], s["w"], strict=True)}
        both = [own[x].keys() & own[y].keys() for x, y in zip(p["l"].tolist(), p["r"].tolist(), strict=True)]
        dots = [math.fsum(own[x][i] for i in b) for x, b in zip(p["l"].tolist(), both, strict=True)]
        return pd.DataFrame({"l": p["l"], "r": p["r"], "shared": [len(b) for b in both], "dot": dots}).astype({"l": "int64", "r": "int64", "shared": "int64", "dot": "float64"})

    held = placed.groupBy("a", "b").cogroup(held.groupBy("c", "d"))
    return held.applyInPandas(weigh, "l long, r long, shared long, dot double") if weighed else held.applyInPandas(compare, "l long, r long, shared long")


def _class_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(l, r, l_size, r_size) of classes of equal sets, of sets (cls, items), among which are all at or above a threshold.

    Every set is ordered from rare to frequent items. Two that are alike share one of the first few of each: of the
    smaller, fewer (its part in the overlap is larger). Sizes are cut into bands, so an item joins only sets of
    comparable size. A meeting at ranks i and j leaves min(i, j) + min(rest, rest) shared items at most, and bitmaps that
    differ in d bits half of what both sizes exceed d by; those that fail that are dropped in the join itself, before
    anything is shuffled by pairs. Each set gives ``part`` more of its items than are needed to meet once, so
    that large sets that are alike meet as many times more; pairs that do are counted on whole sets.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    t, tiny, part = F.lit(float(threshold)), 1e-9, min(0.03, threshold / 4)
    marks = [f"m{i}" for i in range(MARKS)]
    first = _first_items(sets, threshold, part)
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / threshold) + tiny) if threshold < 1 else F.col("size").cast("long")
    side = lambda df, s, bands: df.select(F.xxhash64("item", bands).alias("key"), *(F.col(c).alias(f"{s}_{c}") for c in ("cls", "size", "rank", *marks))).repartition("key").distinct()
    bands = F.array(band, band + 1) if threshold < 1 else F.array(band)
    small = side(first.where("shorter").withColumn("band", F.explode(bands)), "s", F.col("band"))
    large = side(first, "g", band)
    need = F.ceil((F.col("s_size") + F.col("g_size")) * (t / (1 + t)) - tiny)
    ordered = (F.col("s_size") < F.col("g_size")) | ((F.col("s_size") == F.col("g_size")) & (F.col("s_cls") < F.col("g_cls")))
    comparable = F.col("s_size") >= F.col("g_size") * t - tiny
    placed = F.least("s_rank", "g_rank") + F.least(F.col("s_size") - F.col("s_rank"), F.col("g_size") - F.col("g_rank")) >= need
    differing = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"s_{m}").bitwiseXOR(F.col(f"g_{m}"))) for m in marks))
    met = small.join(large.hint("merge"), "key").where(ordered & comparable & placed & (F.col("s_size") + F.col("g_size") - differing >= 2 * need))
    times = met.groupBy(F.col("s_cls").alias("l"), F.col("g_cls").alias("r")).agg(F.count("*").alias("n"), F.first("s_size").alias("l_size"), F.first("g_size").alias("r_size"))
    return checkpointed(times.where(F.col("n") >= 1 + F.floor(F.col("l_size") * part)).drop("n"))


def candidates_above(members: DataFrame, threshold: float) -> DataFrame:
    """(l, r), l < r: pairs of nodes of rows (node, feature) among which are all at or above a threshold, copies included."""
    sets = checkpointed(member_sets(members))
    own = sets.where("size(items) > 0").select("node", "cls")
    node = lambda side: own.select(F.col("cls").alias(f"{side}_cls"), F.col("node").alias(side))
    far = _class_candidates(sets, threshold).select(F.col("l").alias("a_cls"), F.col("r").alias("b_cls")).join(node("a"), "a_cls").join(node("b"), "b_cls")
    copies = node("a").join(node("b"), F.col("a_cls") == F.col("b_cls")).where("a < b")
    return far.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r")).unionByName(copies.select(F.col("a").alias("l"), F.col("b").alias("r")))


def class_pairs_above(sets: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """(l, r, shared, l_size, r_size, jaccard) of all classes of equal sets, of sets (cls, items), at or above a threshold."""
    pairs = _class_candidates(sets, threshold)
    rated = _alike(pairs.select("l", "r"), sets).join(pairs, ["l", "r"]).withColumn("jaccard", F.col("shared") / (F.col("l_size") + F.col("r_size") - F.col("shared")))
    found = rated.where(F.col("jaccard") > threshold if strict else F.col("jaccard") >= threshold)
    return found.select("l", "r", "shared", F.col("l_size").cast("long").alias("l_size"), F.col("r_size").cast("long").alias("r_size"), "jaccard")


def set_pairs_above(sets: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """(l, r, shared, l_size, r_size, jaccard) of all pairs of nodes, l < r: those of classes, and of copies, are made out last."""
    pairs = class_pairs_above(sets, threshold, strict)
    own = _of_classes(sets)
    node = lambda side: own.select(F.col("cls").alias(f"{side}_cls"), F.col("node").alias(side))
    far = pairs.withColumnsRenamed({"l": "a_cls", "r": "b_cls"}).join(node("a"), "a_cls").join(node("b"), "b_cls")
    turned = F.col("a") > F.col("b")
    either = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    out = far.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), "shared", either("l_size", "r_size").alias("l_size"), either("r_size", "l_size").alias("r_size"), "jaccard")
    if strict and threshold >= 1:
        return out
    copies = own.select("cls", F.col("node").alias("l"), "size").join(own.select("cls", F.col("node").alias("r")), "cls").where("l < r")
    same = F.col("size")
    return out.unionByName(copies.select("l", "r", same.alias("shared"), same.alias("l_size"), same.alias("r_size"), F.lit(1.0).alias("jaccard")))


def set_families(sets: DataFrame, threshold: float, strict: bool = False, least: int = 2, pairs: DataFrame | None = None) -> DataFrame:
    """(node, cls, family, size): components of nodes whose sets are alike, found over classes; a family is named by its least node.

    ``pairs`` are the classes' pairs where these are known.
    """
    own = _of_classes(sets).drop("size")
    pairs = class_pairs_above(sets, threshold, strict) if pairs is None else pairs
    copies = own.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1")
    edges = pairs.select("l", "r")
    if not (strict and threshold >= 1):
        edges = edges.unionByName(copies.select(F.col("cls").alias("l"), F.col("cls").alias("r")))
    found = checkpointed(own.join(components(edges, "l", "r").withColumnRenamed("node", "cls"), "cls"))
    size = found.groupBy("component").agg(F.min("node").alias("family"), F.count("*").alias("size")).where(F.col("size") >= least)
    return found.join(size, "component").select("node", "cls", "family", "size")


def families(links: DataFrame, least: int = 2) -> DataFrame:
    """(node, family, size) of the components of links (l, r) with at least so many nodes."""
    found = components(links, "l", "r").select("node", F.col("component").alias("family"))
    size = found.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return found.join(size, "family").select("node", "family", "size")


def staged_families(stages: list[tuple[str, DataFrame]], threshold: float, least: int = 3) -> DataFrame:
    """(node, stage, family, size): each stage clusters the nodes of its sets (node, cls, items) that earlier stages left over."""
    out: DataFrame | None = None
    for name, sets in stages:
        if out is None:
            rest = sets
        else:
            placed = checkpointed(out.select("node"))
            rest = sets.join(_few(placed, placed.count()), "node", "left_anti")
        found = set_families(rest, threshold, least=least).select("node", "family", "size").withColumn("stage", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def fingerprints(assigned: DataFrame, sets: DataFrame, names: DataFrame, most: int = 20) -> DataFrame:
    """(family, fingerprint): the features all members share, the rarest first.

    ``assigned`` has (family, cls) of sets (node, cls, items), ``names`` rows (feature) of all features, repeated or not.
    """
    each = checkpointed(assigned.select("family", "cls").distinct())
    whole = each.groupBy("family").agg(F.count("*").alias("whole"))
    held = _sets_of(sets, each.select("cls").distinct(), each.count()).join(each, "cls").select("family", F.explode("items").alias("item"))
    common = checkpointed(held.groupBy("family", "item").agg(F.count("*").alias("has")).join(whole, "family").where("has = whole").select("family", "item"))
    wanted = checkpointed(common.select("item").distinct())
    n = wanted.count()
    df = sets.select(F.explode("items").alias("item")).join(_few(wanted, n), "item", "left_semi").groupBy("item").agg(F.count("*").alias("df"))
    spelt = names.select(F.xxhash64("feature").alias("item"), "feature").join(_few(wanted, n), "item", "left_semi").groupBy("item").agg(F.first("feature").alias("feature"))
    rank = F.row_number().over(Window.partitionBy("family").orderBy("df", "feature"))
    few = common.join(df, "item").join(spelt, "item").withColumn("n", rank).where(F.col("n") <= most)
    return few.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "feature"))), lambda x: x["feature"]).alias("fingerprint"))


def mode_share(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, share): the most frequent value of each key (ties: the least) and its share."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n")).alias("m"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.sum("n").alias("total"))
    return best.select(*keys, value, F.col("m.n").alias("n"), (F.col("m.n") / F.col("total")).alias("share"))


def without_contained(names: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) without values that are the end of a longer one of the same key, by its dot-separated ends."""
    parts = F.split(value, r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    inside = names.select(key, F.explode(ends).alias(value)).where(f"{value} <> ''").distinct()
    return names.select(key, value).distinct().join(inside, [key, value], "left_anti")


def _linkage(n: int, edges: list[tuple[float, int, int]], cut: float) -> list[int]:
    """Complete linkage of n nodes up to a distance below 1: the closest pair of clusters merges first, at ties the first.

    Nodes without an edge are at distance 1, so only clusters all of whose nodes are linked can merge: what is held are
    edges between clusters, and two that merge keep the neighbours they share.
    """
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for d, i, j in edges:
        if d <= cut:
            near[i][j] = near[j][i] = d
    heap = [(d, i, j) for i in range(n) for j, d in near[i].items() if i < j]
    heapq.heapify(heap)
    label = list(range(n))
    members = [[i] for i in range(n)]
    while heap:
        d, i, j = heapq.heappop(heap)
        if near[i].get(j) != d:
            continue  # of a pair that has merged or moved apart since
        both = {k: max(e, near[j][k]) for k, e in near[i].items() if k in near[j]}
        for k in near[i]:
            near[k].pop(i, None)
        for k in near[j]:
            near[k].pop(j, None)
        near[i], near[j] = both, {}
        for k, e in both.items():
            near[k][i] = e
            heapq.heappush(heap, (e, min(i, k), max(i, k)))
        for k in members[j]:
            label[k] = i
        members[i] += members[j]
        members[j] = []
    return label


def linkage_clusters(links: DataFrame, assigned: DataFrame, cut: float, largest: int | None = None) -> DataFrame:
    """(node, family, cluster, mean_similarity): complete linkage inside each component of links (l, r, jaccard).

    Pairs without a link are at distance 1, which ``cut`` lies below. A task holds the links of a component; with
    ``largest`` given, a component of more nodes fails. The mean counts a node's likeness to itself. Where ``assigned`` has
    ``copies``, a node stands for as many of itself, which any order of merging joins first; a row of result is then a node's
    with its copies, and a node without other links takes part by one to itself.
    """
    counted = "copies" in assigned.columns
    copies = F.col("copies").cast("long") if counted else F.lit(1).cast("long")
    part = assigned.select(F.col("node").alias("l"), "family", copies.alias("l_copies"))
    edges = links.join(part, "l").join(assigned.select(F.col("node").alias("r"), copies.alias("r_copies")), "r").select("family", "l", "r", "jaccard", "l_copies", "r_copies")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["l"]) | set(pdf["r"]))
        if largest is not None and len(nodes) > largest:
            raise ValueError(f"a component has {len(nodes)} nodes; complete linkage takes {largest} at most")
        at = {x: i for i, x in enumerate(nodes)}
        rows = [(1 - s, *sorted((at[x], at[y]))) for x, y, s in zip(pdf["l"], pdf["r"], pdf["jaccard"], strict=True) if x != y]
        label = _linkage(len(nodes), rows, cut)
        times = dict(zip(pdf["l"], pdf["l_copies"], strict=True)) | dict(zip(pdf["r"], pdf["r_copies"], strict=True))
        many = [times[x] for x in nodes]
        size, total = Counter(), [float(m) for m in many]
        for x, m in zip(label, many, strict=True):
            size[x] += m
        for d, i, j in rows:
            if label[i] == label[j]:
                total[i] += (1 - d) * many[j]
                total[j] += (1 - d) * many[i]
        mean = [total[k] / size[label[k]] for k in range(len(nodes))]
        found = pd.DataFrame({"node": nodes, "family": pdf["family"].iloc[0], "cluster": [nodes[x] for x in label], "mean_similarity": mean})
        return found.assign(copies=many) if counted else found

    if not cut < 1:
        raise ValueError("the cut must lie below 1, the distance of nodes without a link")
    kind = assigned.schema["node"].dataType.simpleString()
    return edges.groupBy("family").applyInPandas(cluster, f"node {kind}, family {kind}, cluster {kind}, mean_similarity double" + ", copies long" * counted)


def medoids(clusters: DataFrame, least: int = 5) -> DataFrame:
    """(cluster, size, medoid): the member most like the others (ties: the least), of clusters with enough members, copies included."""
    best = F.min_by("node", F.struct(-F.round("mean_similarity", 12), F.col("node")))
    size = F.sum("copies") if "copies" in clusters.columns else F.count("*")
    return clusters.groupBy("cluster").agg(size.alias("size"), best.alias("medoid")).where(F.col("size") >= least)
