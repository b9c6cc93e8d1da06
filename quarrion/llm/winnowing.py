"""Benchmark decontamination by winnowing.

Every window of ``w`` consecutive k-grams keeps its least hash as a fingerprint, with
``w + k - 1 = span``: two texts that share ``span`` words share a fingerprint. Documents and
benchmark items are fingerprinted alike and joined on fingerprints; each hit is extended to the
windows of ``span`` words around it, and those are looked up among the windows of the items by
128-bit hashes. Items shorter than ``span`` are one window of their own length; for each such length
a document's runs of that length are looked up.

Words are runs of ASCII digits, letters (A-Z lowered) and code points beyond ASCII.

The index of the benchmark goes to the tasks as a broadcast only while it has at most
``max_windows`` windows; beyond it the same steps run as shuffle joins (`_by_joins`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import words as W
from quarrion.llm.substring import _sliding_min

#: Words of a window and of a k-gram.
SPAN, GRAM = 10, 5
#: Windows of the benchmark that may be broadcast (24 bytes each, and 8 for each fingerprint).
MAX_WINDOWS = 2_000_000

_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _lowered(texts: list[bytes]) -> W.Words:
    return W.split([t.lower() for t in texts], W.NOT_WORD)


def _fingerprints(w: W.Words, grams: np.ndarray, span: int, k: int) -> np.ndarray:
    """Starts of the k-grams that winnowing keeps (of each window the least, at ties all equal ones)."""
    starts = w.runs(span)
    if not len(starts):
        return starts
    wide = span - k + 1
    least = _sliding_min(grams, wide)[starts]
    kept = np.zeros(len(grams), dtype=bool)
    for j in range(wide):
        at = starts + j
        kept[at[grams[at] == least]] = True
    return np.flatnonzero(kept)


def _item_windows(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (item, length, h1, h2, prints) of the windows of items; prints are the fingerprints in it."""
    for batch in batches:
        items, texts = batch.column(0).to_pylist(), W.as_bytes(batch.column(1))
        for part in W.groups(texts):
            w = _lowered(texts[part])
            a, b = w.hashes(0), w.hashes(1)
            grams = W.run_hashes(a, k)
            kept = np.zeros(len(grams) + 1, dtype=bool)
            kept[_fingerprints(w, grams, span, k)] = True
            rows = []
            long_at = w.runs(span)
            h1, h2 = W.run_hashes(a, span, 0), W.run_hashes(b, span, 1)
            for s in long_at.tolist():
                prints = [int(g) for g, x in zip(grams[s : s + span - k + 1].view(np.int64), kept[s : s + span - k + 1], strict=True) if x]
                rows.append((items[part][w.text[s]], span, int(h1[s].view(np.int64)), int(h2[s].view(np.int64)), prints))
            for i, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                if 0 < hi - lo < span:
                    x, y = W.run_hashes(a[lo:hi], hi - lo, 0)[0], W.run_hashes(b[lo:hi], hi - lo, 1)[0]
                    rows.append((items[part][i], hi - lo, int(x.view(np.int64)), int(y.view(np.int64)), []))
            item, length, c1, c2, prints = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(length, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(prints, pa.list_(pa.int64()))],
                names=["item", "length", "h1", "h2", "prints"],
            )


def item_windows(benchmark: DataFrame, *, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """Distinct windows of the items with their hashes and fingerprints; a null or empty text has none."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _item_windows(b, span, k), "item string, length int, h1 long, h2 long, prints array<long>").dropDuplicates(["item", "length", "h1", "h2"])


class _Set64:
    """Membership of 64-bit hashes: a table of flags rules most out, a binary search decides."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.uint64((1 << max(16, min(27, 4 + int(len(self.values)).bit_length()))) - 1)
        self.flags = np.zeros(int(self.bits) + 1, dtype=bool)
        self.flags[self.values & self.bits] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that are members."""
        at = np.flatnonzero(self.flags[h & self.bits])
        if not len(at) or not len(self.values):
            return at[:0]
        i = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        return at[self.values[i] == h[at]]


@dataclass
class _Lookup:
    """Windows of one length: hashes sorted by the first, and the items of each distinct window."""

    length: int
    h1: np.ndarray
    h2: np.ndarray
    at: np.ndarray
    item: np.ndarray

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the given windows that are known, and the number of the known window of each."""
        hits, which = [], []
        lo, hi = np.searchsorted(self.h1, h1, "left"), np.searchsorted(self.h1, h1, "right")
        while (more := np.flatnonzero(lo < hi)).size:
            good = more[self.h2[lo[more]] == h2[more]]
            hits.append(good)
            which.append(lo[good])
            lo[more] += 1
        return (np.concatenate(hits), np.concatenate(which)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Index:
    """The windows and fingerprints of a benchmark in memory; its size has been checked."""

    def __init__(self, rows: pa.Table, span: int, k: int):
        self.span, self.k = span, k
        names, code = np.unique(np.array(rows.column("item").to_pylist(), dtype=object).astype(str), return_inverse=True)
        self.names = names.tolist()  # sorted by code point
        self.shared: dict[bytes, str] = {}
        length = rows.column("length").to_numpy()
        h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        prints = rows.column("prints").combine_chunks()
        self.prints = _Set64(prints.flatten().to_numpy().view(np.uint64) if len(prints) else np.zeros(0, np.uint64))
        self.windows: dict[int, _Lookup] = {}
        self.short: dict[int, _Set64] = {}
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            own = own[np.lexsort((code[own], h2[own], h1[own]))]
            x, y, item = h1[own], h2[own], code[own]
            new = np.ones(len(own), dtype=bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            self.windows[n] = _Lookup(n, x[new], y[new], np.append(np.flatnonzero(new), len(own)), item)
            if n < span:
                self.short[n] = _Set64(x)

    def occurrences(self, w: W.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, start word, known window) of all windows of items in the texts."""
        a, b = w.hashes(0), None
        if self.span in self.windows and len(a) >= self.span:
            grams = W.run_hashes(a, self.k)
            kept = _fingerprints(w, grams, self.span, self.k)
            hits = kept[self.prints.find(grams[kept])]
            if len(hits):
                near = np.zeros(len(a), dtype=bool)
                for j in range(self.span - self.k + 1):
                    near[hits[hits >= j] - j] = True
                runs = np.zeros(len(a), dtype=bool)
                runs[w.runs(self.span)] = True
                at = np.flatnonzero(near & runs)
                b = w.hashes(1)
                found, which = self.windows[self.span].find(W.run_hashes(a, self.span, 0)[at], W.run_hashes(b, self.span, 1)[at])
                yield self.span, at[found], which
        for n, members in self.short.items():
            at = w.runs(n)
            h = W.run_hashes(a, n, 0)
            at = at[members.find(h[at])]
            if len(at):
                b = w.hashes(1) if b is None else b
                found, which = self.windows[n].find(h[at], W.run_hashes(b, n, 1)[at])
                yield n, at[found], which

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of each text: words, hit words, items, and the digest of the items' ids."""
        w = _lowered(texts)
        cover = np.zeros(len(w) + 1, dtype=np.int32)
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        for n, at, which in self.occurrences(w):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            known = self.windows[n]
            seen = np.unique(np.stack([w.text[at], which], axis=1), axis=0)
            each = known.at[seen[:, 1] + 1] - known.at[seen[:, 1]]
            step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            item = known.item[np.repeat(known.at[seen[:, 1]], each) + step]
            pairs.append(np.unique(np.stack([np.repeat(seen[:, 0], each), item], axis=1), axis=0))
        n_hit = np.bincount(w.text[np.cumsum(cover[:-1]) > 0], minlength=len(texts))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        n_items = np.bincount(pairs[:, 0], minlength=len(texts))
        cut = np.cumsum(n_items)
        sha = [self._digest(pairs[hi - n : hi, 1]) for n, hi in zip(n_items.tolist(), cut.tolist(), strict=True)]
        return np.diff(w.first), n_hit, n_items, sha

    def _digest(self, items: np.ndarray) -> str:
        if (key := items.tobytes()) not in self.shared:
            if len(self.shared) > 10_000:
                self.shared.clear()
            self.shared[key] = hashlib.sha256(",".join(self.names[i] for i in items).encode()).hexdigest()
        return self.shared[key]


def _judged(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = W.as_bytes(batch.column(1))
        for part in W.groups(texts):
            n_words, n_hit, n_items, sha = index.judge(texts[part])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.start, part.stop - part.start), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )


def _doc_prints(batches: Iterator[pa.RecordBatch], span: int, k: int, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (text_key, length, print, at): fingerprints, and the runs whose length a short item has."""
    for batch in batches:
        texts = W.as_bytes(batch.column(1))
        for part in W.groups(texts):
            keys = batch.column(0).slice(part.start, part.stop - part.start)
            w = _lowered(texts[part])
            a = w.hashes(0)
            grams = W.run_hashes(a, k)
            found = [(span, at := _fingerprints(w, grams, span, k), grams[at])]
            found += [(n, at := w.runs(n), W.run_hashes(a, n)[at]) for n in lengths]
            for n, at, h in found:
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(w.text[at])), pa.array(np.full(len(at), n), pa.int32()), pa.array(h.view(np.int64)), pa.array(at - w.first[w.text[at]], pa.int32())],
                    names=["text_key", "length", "print", "at"],
                )


def _extended(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (text_key, at, length, h1, h2): windows around the hits of rows (text_key, text, hits)."""
    for batch in batches:
        for key, text, hits in zip(batch.column(0).to_pylist(), W.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            w = _lowered([text])
            a, b = w.hashes(0), w.hashes(1)
            starts = {(h["length"], h["at"] - j) for h in hits for j in range(span - k + 1 if h["length"] == span else 1)}
            for n in {n for n, _ in starts}:
                at = np.array(sorted(s for m, s in starts if m == n and 0 <= s <= len(a) - n), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(np.full(len(at), n), pa.int32()), pa.array(W.run_hashes(a, n, 0)[at].view(np.int64)), pa.array(W.run_hashes(b, n, 1)[at].view(np.int64))],
                    names=["text_key", "at", "length", "h1", "h2"],
                )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word and hit counts of rows (text_key, doc_id, text, spans, items)."""
    for batch in batches:
        texts = W.as_bytes(batch.column(2))
        n_words = np.concatenate([np.diff(_lowered(texts[p]).first) for p in W.groups(texts)]) if texts else np.zeros(0, np.int64)
        n_hit = []
        for spans in batch.column(3).to_pylist():
            hit, upto = 0, 0
            for lo, hi in sorted((s["at"], s["at"] + s["length"]) for s in spans or ()):
                hit += max(0, hi - max(lo, upto))
                upto = max(upto, hi)
            n_hit.append(hit)
        items = [sorted(x or ()) for x in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([n > 0 for n in n_hit])],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def _text_key():
    """128 bits that stand for the text of a row; null for a null text."""
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def _found(docs: DataFrame, windows: DataFrame, span: int, k: int) -> DataFrame:
    """Rows (text_key, at, length, item) of the windows that occur in rows (text_key, text): fingerprints and windows meet in shuffle joins."""
    lengths = [r[0] for r in windows.where(F.col("length") < span).select("length").distinct().collect()]  # below span, so a handful
    texts = docs.select("text_key", "text").where("text_key is not null").dropDuplicates(["text_key"])
    prints = texts.mapInArrow(lambda b: _doc_prints(b, span, k, lengths), "text_key binary, length int, print long, at int")
    long_prints = windows.where(F.col("length") == span).select("length", F.explode("prints").alias("print"))
    wanted = long_prints.unionByName(windows.where(F.col("length") < span).select("length", F.col("h1").alias("print"))).distinct()
    hits = prints.join(wanted, ["length", "print"], "left_semi").groupBy("text_key").agg(F.collect_list(F.struct("length", "at")).alias("hits"))
    around = texts.join(hits, "text_key").select("text_key", "text", "hits").mapInArrow(lambda b: _extended(b, span, k), "text_key binary, at int, length int, h1 long, h2 long")
    return around.join(windows.select("item", "length", "h1", "h2"), ["length", "h1", "h2"]).select("text_key", "at", "length", "item")


def _by_joins(docs: DataFrame, windows: DataFrame, span: int, k: int) -> DataFrame:
    """The same result as with a broadcast index."""
    keyed = docs.withColumn("text_key", _text_key())
    marks = _found(keyed, windows, span, k).groupBy("text_key").agg(F.collect_set(F.struct("at", "length")).alias("spans"), F.collect_set("item").alias("items"))
    return keyed.join(marks, "text_key", "left").select("text_key", "doc_id", "text", "spans", "items").mapInArrow(_counts, _OUT)


def _clean(batches: Iterator[pa.RecordBatch], index: Index, text_at: int) -> Iterator[pa.RecordBatch]:
    """The rows in which no window of an item occurs."""
    for batch in batches:
        texts = W.as_bytes(batch.column(text_at).cast(pa.string()))
        hit = [index.judge(texts[part])[1] > 0 for part in W.groups(texts)]
        yield batch.filter(pa.array(~np.concatenate(hit))) if hit else batch


def _windows_of(benchmark: DataFrame, span: int, k: int) -> DataFrame:
    if not 0 < k <= span:
        raise ValueError("k must lie between 1 and span")
    return item_windows(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), span=span, k=k)


def _index(windows: DataFrame, span: int, k: int, max_windows: int):
    """A broadcast index, or None if the benchmark has more than max_windows windows."""
    if windows.limit(max_windows + 1).count() > max_windows:
        return None
    return windows.sparkSession.sparkContext.broadcast(Index(windows.toArrow(), span, k))


def contamination(documents: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = GRAM, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: words, words inside an occurrence of a benchmark window, and the items met.

    Null and empty texts have no words; items without words match nothing; items with equal ids
    count as one item; an empty benchmark leaves every document clean. Items with a null id take
    part under the id "" (the empty string).
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = _windows_of(benchmark, span, k)
    index = _index(windows, span, k, max_windows)
    if index is None:
        return _by_joins(docs, windows, span, k)
    return docs.mapInArrow(lambda b: _judged(b, index.value), _OUT)


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = GRAM, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without those that hold a benchmark window; columns and texts stay as they are.

    Null and empty texts stay. Every row is judged by its own text, with a broadcast index and with
    joins alike, whatever its id.
    """
    windows = _windows_of(benchmark, span, k)
    index = _index(windows, span, k, max_windows)
    if index is not None:
        text_at = documents.columns.index("text")
        return documents.mapInArrow(lambda b: _clean(b, index.value, text_at), documents.schema)
    docs = documents.select(F.col("text").cast("string").alias("text"), _text_key().alias("text_key"))
    bad = _found(docs, windows, span, k).select(F.col("text_key").alias("_bad")).distinct()
    return documents.join(bad, _text_key() == bad["_bad"], "left_anti")
