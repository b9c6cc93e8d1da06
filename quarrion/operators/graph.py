"""Graph operators over edge tables: connected components and k-core."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.storage import by_merge, checkpointed


#: Edges that one task works on; small graphs are not dealt out to more tasks than that takes.
EDGES_A_TASK = 50_000
#: Neighbours from which on a node is a hub: its edges meet it by a broadcast join (there are at most 2 / HUB hubs an edge).
HUB = 200_000
#: Plain peels of a two-core before whole chains are looked for.
PEELS = 6


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set, to see that an iteration changed nothing."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("cast(xxhash64(b, a) % 1000003 as long)"))).first())


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node number that each of n nodes reaches over edges (u, v)."""
    label = np.arange(n)
    while True:
        x, y = label[u], label[v]
        if not (apart := x != y).any():
            return label
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) of the same components as the edges: each task joins what it holds, EDGES_A_TASK edges at a time."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        edges = pa.Table.from_batches(held)
        ends = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        code = rank[ends.indices.to_numpy()]
        label = least_labels(len(order), code[: len(edges)], code[len(edges) :])
        alone = np.bincount(label, minlength=len(order)) == 1
        node = np.flatnonzero((label != np.arange(len(order))) | alone[label])
        names = ends.dictionary.take(pa.array(order))
        return pa.RecordBatch.from_arrays([names.take(pa.array(node)), names.take(pa.array(label[node]))], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= EDGES_A_TASK:
            yield stars()
            held.clear()
    if held:
        yield stars()


def _to_least(both: DataFrame, hubs_possible: bool) -> DataFrame:
    """(b, m) of rows (a, b) with b >= a: m is the least of a and its neighbours."""
    stat = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d")).select("a", F.least("a", "m").alias("m"), "d")
    down = both.where("b >= a")
    if not hubs_possible:
        return down.join(by_merge(stat), "a").select("b", "m")
    hubs = F.broadcast(stat.where(F.col("d") > HUB).select("a", "m"))
    rest = down.join(hubs.select("a"), "a", "left_anti").join(by_merge(stat.where(F.col("d") <= HUB)), "a")
    return down.join(hubs, "a").select("b", "m").union(rest.select("b", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its least node.

    Every task joins the edges of a range of nodes into stars, and stars that share a node are linked
    by their centres. On these links large-star and small-star rounds alternate: every node links its
    larger neighbours, then its smaller ones, to the least node it knows. Paths shorten by a constant factor a round, and no round
    holds a neighbourhood in one row; hubs meet their edges without a shuffle on the hub. Self-loops
    give a component of one; null ends are ignored. Rounds go on until nothing changes; the number of
    rounds grows with the logarithm of the nodes, and running out of ``max_rounds`` is an error.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    now = checkpointed(raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = max(1, -(-now.count() // EDGES_A_TASK))
    if tasks == 1:  # one task holds all edges, so its stars are the components
        stars = now.coalesce(1).mapInArrow(_contracted, now.schema)
        return stars.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component")).distinct()
    # A task gets a range of nodes: where neighbours lie near each other, its stars hold whole stretches of the graph.
    stars = checkpointed(now.repartitionByRange(tasks, "a", "b").mapInArrow(_contracted, now.schema))
    ends = stars.union(stars.select(F.col("b").alias("a"), "b"))
    labels = ends.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.collect_set("b").alias("bs"))
    labels = checkpointed(labels.select(F.col("a").alias("node"), F.col("m").alias("label"), F.when(F.col("m") < F.col("most"), F.col("bs")).alias("others")))
    # Stars that share a node are linked; their centres are a smaller graph of the same components.
    met = labels.where("others is not null").select(F.explode("others").alias("a"), F.col("label").alias("b")).where("a > b").distinct()
    found = _rounds(met, max_rounds).withColumnsRenamed({"node": "label"})
    return labels.select("node", "label").join(by_merge(found), "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def _rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), a > b, by rounds of large and small stars."""
    now = checkpointed(edges)
    tasks = max(1, -(-now.count() // EDGES_A_TASK))
    now = checkpointed(now.coalesce(tasks).mapInArrow(_contracted, now.schema))
    if tasks == 1:
        return now.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component")).distinct()
    before = _state(now)
    now = now.coalesce(tasks)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both, before[0] > HUB).select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        down = large.where("a > b")
        lowest = down.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = down.join(by_merge(lowest), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.coalesce(tasks).union(lowest.select("a", F.col("m").alias("b"))).union(large.where("a = b")).distinct().coalesce(tasks))
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which neither end is among the nodes."""
    return edges.join(by_merge(nodes.select(F.col("node").alias("a"))), "a", "left_anti").join(by_merge(nodes.select(F.col("node").alias("b"))), "b", "left_anti").select("a", "b")


def _hanging(edges: DataFrame) -> DataFrame:
    """(node): nodes of one neighbour, and the whole chains of nodes with two neighbours that begin at them."""
    degree = checkpointed(_degrees(edges))
    ends, links = degree.where("count = 1").select("node"), degree.where("count = 2").select("node")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    chain = edges.join(by_merge(links.withColumnRenamed("node", "a")), "a", "left_semi").join(by_merge(links.withColumnRenamed("node", "b")), "b", "left_semi")
    chain = links.select(F.col("node").alias("a"), F.col("node").alias("b")).union(chain.select("a", "b"))
    found = components(chain)
    touched = both.join(by_merge(ends.withColumnRenamed("node", "a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
    gone = found.join(by_merge(touched), "node", "left_semi").select("component").distinct()
    return ends.union(found.join(by_merge(gone), "component", "left_semi").select("node")).distinct()


def k_core(edges: DataFrame, k: int = 2, a: str = "a", b: str = "b") -> DataFrame:
    """The edges (a, b) of the k-core: nodes with fewer than k neighbours go, again and again until none is left to go.

    There is no limit of rounds. Of a two-core whole chains go at once after ``PEELS`` rounds, so a
    long path takes a few rounds more and not one for each of its nodes.
    """
    now = checkpointed(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    size, turn = now.count(), 0
    while True:
        chains = k == 2 and turn >= PEELS
        now = checkpointed(_without(now, _hanging(now) if chains else _degrees(now).where(F.col("count") < k)))
        left, turn = now.count(), turn + 1
        if left == size:
            return now
        size = left
