"""Near-duplicate documents by an LSH forest.

A document is the set of its distinct word shingles, and documents with one set count once. The
signature of a set has one minimum for each of ``MINIMA`` hash functions, one byte each. Tree t sorts
all signatures as they read from minimum ``t * STEP`` on. In that order the nearest rows are those
with the longest common prefix: a row meets the ``NEAR`` rows before it, as far as they share at least
``SHALLOW`` minima. Where signatures are sparse that is all of such a region; where they are dense,
only deeper prefixes lie that near, so the depth follows the region. A pair that meets is a candidate
if the signatures' estimate is not ``SLACK`` or more below the least similarity. A run of more than
``NEAR`` rows that share ``DEEP`` minima is too dense for that, and all of it are candidates, linked
in a row: no pair is lost to the number of neighbours.

Candidates form regions; each is then confirmed on full sets, all pairs of it that are not yet
connected, with exact bounds (set sizes, bucket counts) that spare most comparisons. Regions beyond
``BLOCK`` sets are confirmed in blocks; what is then not in the region's largest class is compared
with every block of the region.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm import words as W
from quarrion.operators.graph import components, least_labels
from quarrion.storage import checkpointed

#: Words of a shingle; similarity in hundredths. The defaults of the general operator and of the query.
SHINGLE, PERCENT = 5, 80
#: Trees, and minima by which their orders are apart.
TREES, STEP = 16, 4
MINIMA = TREES * STEP
#: Least common prefix of candidates, common prefix of runs that are candidates as a whole, rows before a row that it meets.
SHALLOW, DEEP, NEAR = 3, 6, 64
#: How far the estimate of a candidate may be below the least similarity: 4 to 5 standard deviations of 64 minima.
SLACK = 0.2
#: Rows of an order that a task looks at at once.
CHUNK = 16_384
#: Sets that one task confirms at once, and sets that every block of a larger component gets.
BLOCK, PIVOTS = 2000, 8

_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than n words is one shingle."""
    for part in W.groups(texts):
        w = W.split([t.lower() for t in texts[part]], W.BLANKS)
        h = w.hashes()
        runs = W.run_hashes(h, n)
        for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield np.unique(runs[lo : hi - n + 1]) if hi - lo >= n else W.run_hashes(h[lo:hi], hi - lo) if hi > lo else runs[:0]


def _signature(s: np.ndarray) -> bytes:
    """A byte of the minimum of each hash function."""
    least = np.full(len(_MULT), np.iinfo(np.uint64).max)
    for lo in range(0, len(s), 4096):
        least = np.minimum(least, ((s[None, lo : lo + 4096] ^ _XOR[:, None]) * _MULT[:, None]).min(axis=1))
    return (W.mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = W.as_bytes(batch.column(2))
        size, key, sig = [], [], []
        for s in shingle_sets(texts, n):
            size.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(_signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_key", "sig"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, prefix, set_key) of rows (set_key, sig); a tree's prefix is the whole signature, turned to begin at the tree's first minimum."""
    for batch in batches:
        sigs = batch.column(1).to_pylist()
        for tree in range(TREES):
            at = STEP * tree
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sigs), tree, np.int32)), pa.array([s[at:] + s[:at] for s in sigs], pa.binary()), batch.column(0)], names=["tree", "prefix", "set_key"])


def neighbours(tree: np.ndarray, sig: np.ndarray, least: float) -> np.ndarray:
    """The least row that each row of a sorted order is a candidate with, directly or by others."""
    n = len(sig)
    if n < 2:
        return np.arange(n)
    common = np.cumprod(sig[1:] == sig[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])  # with the row before
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def within(depth: int, back: int) -> np.ndarray:
        """Rows that share the depth with all of the given number of rows before them."""
        short = np.concatenate(([0, 0], np.cumsum(common < depth)))  # short[i + 1]: breaks before row i or earlier
        at = np.arange(back, n)
        return at[short[at + 1] == short[at - back + 1]]

    for back in range(1, min(NEAR, n - 1) + 1):
        at = within(SHALLOW, back)
        if not len(at):
            break
        for lo in range(0, len(at), 1 << 16):
            i = at[lo : lo + (1 << 16)]
            like = (sig[i] == sig[i - back]).sum(axis=1) >= least * MINIMA
            u.append(i[like])
            v.append(i[like] - back)
    if n > NEAR:
        dense = np.zeros(n + 1, dtype=np.int64)
        ends = within(DEEP, NEAR)
        np.add.at(dense, ends - NEAR + 1, 1)
        np.add.at(dense, ends + 1, -1)
        i = np.flatnonzero(np.cumsum(dense[:-1]) > 0)
        u.append(i)
        v.append(i - 1)
    return least_labels(n, np.concatenate(u), np.concatenate(v))


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("part", pa.int32()), ("last", pa.bool_()), ("tree", pa.int32()), ("prefix", pa.binary())])


def _edges(rows: pa.Table, least: float) -> list[pa.Array]:
    """Columns (a, b) that link each row of a sorted table (tree, prefix, set_key) to its least candidate."""
    sig = np.frombuffer(b"".join(rows.column("prefix").to_pylist()), dtype=np.uint8).reshape(-1, MINIMA)
    label = neighbours(rows.column("tree").to_numpy(), sig, least)
    at = np.flatnonzero(label != np.arange(len(label)))
    keys = rows.column("set_key").combine_chunks()
    return [keys.take(pa.array(at)), keys.take(pa.array(label[at]))]


def _along(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Candidate edges of a sorted partition, and its first and last rows (part not null), which the seams between partitions are made of.

    A partition of NEAR rows or fewer has no last rows: all of its rows are first ones.
    """
    part, held, started = TaskContext.get().partitionId(), None, False

    def seam(rows: pa.Table, last: bool) -> pa.RecordBatch:
        n = rows.num_rows
        columns = [rows.column("set_key").combine_chunks(), pa.nulls(n, pa.binary()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, last)), rows.column("tree").combine_chunks(), rows.column("prefix").combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, schema=_EDGE)

    def linked(rows: pa.Table) -> pa.RecordBatch:
        a, b = _edges(rows, least)
        return pa.RecordBatch.from_arrays([a, b, *(pa.nulls(len(a), f.type) for f in list(_EDGE)[2:])], schema=_EDGE)

    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not started and held.num_rows > NEAR:
            yield seam(held.slice(0, NEAR + 1), False)
            started = True
        if held.num_rows >= CHUNK:
            yield linked(held)
            held = held.slice(held.num_rows - NEAR - 1)
    if held is not None:
        yield linked(held)
        yield seam(held.slice(max(0, held.num_rows - NEAR - 1)), True) if started else seam(held, False)


def candidate_edges(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) of keys that join the candidates of rows (set_key, sig), a row at most for each row of an order."""
    least = percent / 100 - SLACK
    trees = sets.select("set_key", "sig").mapInArrow(_trees, "tree int, prefix binary, set_key binary")
    ordered = trees.repartitionByRange("tree", "prefix", "set_key").sortWithinPartitions("tree", "prefix", "set_key")
    found = checkpointed(ordered.mapInArrow(lambda b: _along(b, least), "a binary, b binary, part int, last boolean, tree int, prefix binary"))
    ends = found.where("part is not null")
    # The end of a partition, all short ones behind it and the beginning of the next that is not short make a seam.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = ends.groupBy("part").agg(F.max(F.col("last").cast("int")).alias("long")).select("part", F.coalesce(F.sum("long").over(before), F.lit(0)).alias("seam"))
    seams = ends.join(F.broadcast(parts), "part").select((F.col("seam") + F.col("last").cast("int")).alias("seam"), "tree", "prefix", F.col("a").alias("set_key"))

    def across(rows: pa.Table) -> pa.Table:
        return pa.table(_edges(rows.sort_by([("tree", "ascending"), ("prefix", "ascending"), ("set_key", "ascending")]), least), names=["a", "b"])

    met = seams.groupBy("seam").applyInArrow(across, "a binary, b binary")
    return found.where("part is null").select("a", "b").union(met).distinct()


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def confirm(sets: list[np.ndarray], percent: int, known: list[int] | None = None, side: np.ndarray | None = None) -> list[int]:
    """The least index connected to each set by links of at least the similarity.

    ``known`` names sets that are connected already, ``side`` two sides of which only pairs across
    are to be compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    buckets = 512
    counts = np.zeros((n, buckets), dtype=np.uint16)
    for i, s in enumerate(sets):
        counts[i] = np.minimum(np.bincount((s % np.uint64(buckets)).astype(np.int64), minlength=buckets), 65535)
    capped = counts.max(initial=0) == 65535
    tree = _Union(n)
    first: dict[int, int] = {}
    for i, k in enumerate(known or ()):
        tree.join(i, first.setdefault(k, i))
    order = np.lexsort((np.arange(n), size))
    sizes = size[order]
    for p in range(1, n):
        i = int(order[p])
        lo = int(np.searchsorted(sizes, -(-percent * size[i] // 100)))
        if lo >= p:
            continue
        cand = order[lo:p]
        if side is not None:
            cand = cand[side[cand] != side[i]]
        need = -(-percent * (size[i] + size[cand]) // (100 + percent))
        if not capped:
            good = np.concatenate([np.minimum(counts[cand[x : x + 1024]], counts[i]).sum(axis=1, dtype=np.int64) for x in range(0, len(cand), 1024)] or [np.zeros(0, np.int64)]) >= need
            cand, need = cand[good], need[good]
        for j, least in zip(cand.tolist(), need.tolist(), strict=True):
            if tree.find(i) == tree.find(j):
                continue
            if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= least:
                tree.join(i, j)
    return [tree.find(i) for i in range(n)]


def _confirm_block(table: pa.Table, n: int, percent: int) -> pa.Table:
    """Edges (a, b) from every set of a block to the least one connected with it."""
    keys = table.column("set_key").to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    texts = W.as_bytes(table.column("text"))
    sets = list(shingle_sets([texts[i] for i in order], n))
    keys = [keys[i] for i in order]
    known, side = None, None
    if "known" in table.column_names:
        k, s = table.column("known").to_pylist(), table.column("side").to_pylist()
        known, side = [k[i] for i in order], np.array([s[i] for i in order])
    root = confirm(sets, percent, known, side)
    return pa.table([pa.array(keys, pa.binary()), pa.array([keys[r] for r in root], pa.binary())], names=["a", "b"])


def _classes(documents: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(set_key, class) of the sets that are candidates; sets has (set_key, doc, text_key, sig), a class is named by its least key."""
    near = components(candidate_edges(sets, percent)).select(F.col("node").alias("set_key"), F.col("component").alias("region"))
    size = near.groupBy("region").agg(F.count("*").alias("size"))
    n_blocks = F.ceil(F.col("size") / BLOCK)
    placed = near.join(size, "region").join(sets.select("set_key", "doc", "text_key"), "set_key")
    placed = checkpointed(placed.select("set_key", "doc", "text_key", "region", "size", F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("set_key"), n_blocks)).otherwise(0).alias("block")))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), _text_key().alias("text_key"))
    found = texts.join(placed, ["doc", "text_key"]).dropDuplicates(["set_key"])
    large = placed.where(F.col("size") > BLOCK)
    ddl = "a binary, b binary"
    if large.isEmpty():
        edges = found.groupBy("region").applyInArrow(lambda t: _confirm_block(t, n, percent), ddl)
        return components(edges).select(F.col("node").alias("set_key"), F.col("component").alias("class"))
    found = checkpointed(found.select("set_key", "text", "region", "size", "block"))
    chance = F.pmod(F.xxhash64("set_key", F.lit(1)), F.ceil(F.col("size") / PIVOTS)) == 0
    regions = large.groupBy("region").agg(F.max("size").alias("size"), F.slice(F.sort_array(F.collect_set(F.when(chance, F.col("set_key")))), 1, 2 * PIVOTS).alias("pivots"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block")
    pivots = regions.select("region", "size", F.explode("pivots").alias("set_key")).select("region", "set_key", every)
    extra = found.select("set_key", "text").join(pivots, "set_key").select("set_key", "text", "region", "block")
    blocks = found.select("set_key", "text", "region", "block").unionByName(extra).dropDuplicates(["set_key", "region", "block"])
    edges = checkpointed(blocks.groupBy("region", "block").applyInArrow(lambda t: _confirm_block(t, n, percent), ddl))
    classes = checkpointed(components(edges).select(F.col("node").alias("set_key"), F.col("component").alias("class")))
    # Of two sets that are still apart one at least is outside the largest class of its region: those are dealt into
    # blocks of their own, which meet every block of the region.
    counts = large.join(classes, "set_key").groupBy("region", "class").agg(F.count("*").alias("n"))
    apart = counts.groupBy("region").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    rest = found.where(F.col("size") > BLOCK).join(classes, "set_key").join(apart, "region")
    minor_blocks = F.ceil((F.col("all") - F.col("most")) / BLOCK)
    minor = rest.where("class <> main").withColumn("p", F.pmod(F.xxhash64("set_key", F.lit(2)), minor_blocks))
    columns = ["set_key", "text", "region", F.col("class").alias("known"), "p", "q", "side"]
    one = minor.withColumns({"q": F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)), "side": F.lit(0)}).select(*columns)
    other = rest.withColumns({"q": F.col("block").cast("long"), "p": F.explode(F.sequence(F.lit(0).cast("long"), minor_blocks - 1)), "side": F.lit(1)}).select(*columns)
    crossing = one.unionByName(other).groupBy("region", "p", "q").applyInArrow(lambda t: _confirm_block(t, n, percent), ddl)
    return components(edges.union(crossing)).select(F.col("node").alias("set_key"), F.col("component").alias("class"))


def _text_key():
    """A key of the text of a row, null for a null text."""
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def _judged(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) per row of documents."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    sigs = checkpointed(rows.mapInArrow(lambda b: _signatures(b, n), "doc_id long, text_key binary, n_shingles long, set_key binary, sig binary"))
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    sets = sigs.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(first, F.first("sig").alias("sig"))
    sets = sets.select("set_key", F.col("first.doc_id").alias("doc"), F.col("first.text_key").alias("text_key"), "sig")
    classes = checkpointed(_classes(documents, sets, n, percent))
    members = sets.select("set_key", "doc").join(classes, "set_key")
    named = members.groupBy("class").agg(F.min("doc").alias("component"))
    inside = members.join(named, "class").select("set_key", "component")
    found = sets.select("set_key", "doc").join(inside, "set_key", "left").select("set_key", F.coalesce("component", "doc").alias("found"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    out = sigs.select("doc_id", "text_key", "n_shingles", "set_key").join(found, "set_key", "left").select("doc_id", "text_key", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(documents: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id and kept.

    Two documents are linked if their shingle sets have a similarity of at least ``percent``
    hundredths; component_id is the least doc_id reachable. Null and empty texts have no shingles and
    are linked with nothing. A row without id is linked with nothing, has a null component and is kept.
    Rows that repeat a doc_id are judged each by its own text.
    """
    return _judged(documents, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(documents: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without those that have a near duplicate of smaller doc_id in their component; columns stay.

    Rows that repeat a doc_id are judged each by its own text.
    """
    gone = _judged(documents, shingle, percent).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_text")).distinct()
    return documents.join(gone, (documents["doc_id"].cast("long") == gone["_gone"]) & (_text_key() == gone["_text"]), "left_anti")
