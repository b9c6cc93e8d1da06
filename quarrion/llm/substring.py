"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``k`` consecutive words. The minimiser of a window is the least hash among its runs of
``m`` words; consecutive windows with one minimiser overlap in all but one word each, so they travel
together as one packed string (a super-k-mer) to the bucket of their minimiser. Equal windows have
equal minimisers and meet in one bucket, where a sort finds all but the first occurrence of each.

Before the shuffle every task drops the windows that it has seen itself (only the first of a group
travels), so a passage that a third of the corpus shares reaches its bucket once per group of
texts. A super-k-mer packs the words themselves; the rows of one bucket and group are compressed as
one block. A bucket is worked off in passes over hash ranges, so its memory has a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import words as W

#: Words of a window, and words of the runs among which the minimiser is chosen.
WINDOW, MINIMISER = 20, 3
#: Bytes of text that a task packs together (of which only the first of equal windows travels), and level of compression.
PACKED_BYTES, LEVEL = 2_000_000, 6
#: Windows that a bucket sorts in one pass.
PASS_WINDOWS = 1_500_000
#: Stands for the id of a row without one, which comes last.
NO_ID = int(np.iinfo(np.int64).max)
#: Ids of several rows that may be broadcast (some 10 bytes each); beyond that every row is told by its text's hash.
FEW_REPEATED = 1_000_000

_SPANS = pa.schema([("doc", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
#: Documents as arrays (doc, t1, t2): the id, and the two halves of the text's hash where rows share an id, else zeros.
Docs = tuple[np.ndarray, np.ndarray, np.ndarray]
_PACKED = pa.schema([("bucket", pa.int32()), ("local", pa.bool_()), ("windows", pa.int32()), ("block", pa.binary())])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    done, out = 1, x
    while done * 2 <= w:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (w - done)], out[w - done :]) if done < w else out


def _differ(docs: Docs, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the documents at the places a are others than those at b."""
    return np.logical_or.reduce([x[a] != x[b] for x in docs])


def _repeats(h1: np.ndarray, h2: np.ndarray, docs: Docs, pos: np.ndarray) -> np.ndarray:
    """Indices of windows of which an equal one starts earlier (document of lower order, or earlier in it)."""
    order = np.argsort(h1, kind="stable")
    same = h1[order][1:] == h1[order][:-1]
    several = np.zeros(len(h1), dtype=bool)
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    few = np.flatnonzero(several)
    few = few[np.lexsort((pos[few], *(x[few] for x in reversed(docs)), h2[few], h1[few]))]
    if not len(few):
        return few
    new = np.ones(len(few), dtype=bool)
    new[1:] = (h1[few][1:] != h1[few][:-1]) | (h2[few][1:] != h2[few][:-1])
    lead = few[np.maximum.accumulate(np.where(new, np.arange(len(few)), 0))]
    return few[_differ(docs, few, lead) | (pos[few] != pos[lead])]


def _spans(docs: Docs, pos: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Windows as word spans [lo, hi) of a document; windows with consecutive starts become one span."""
    order = np.lexsort((pos, *reversed(docs)))
    docs, pos = tuple(x[order] for x in docs), pos[order]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = _differ(docs, slice(1, None), slice(None, -1)) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(pos) - 1)
    return *(x[at] for x in docs), pos[at], pos[last] + k


def _pack(docs: Docs, pos: np.ndarray, count: np.ndarray, body: bytes) -> bytes:
    doc, *halves = docs
    told = any(x.any() for x in halves)
    head = np.array([len(doc), told], dtype="<i8").tobytes()
    steps = np.diff(doc, prepend=np.int64(0))  # documents come in order, so most steps are small
    tells = b"".join(x.astype("<i8").tobytes() for x in halves) if told else b""
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + steps.astype("<i8").tobytes() + tells + pos.astype("<i4").tobytes() + count.astype("<i4").tobytes() + body)


def _unpack(block: bytes) -> tuple[Docs, np.ndarray, np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, told = np.frombuffer(data, dtype="<i8", count=2).tolist()
    ids = np.frombuffer(data, dtype="<i8", count=3 * n if told else n, offset=16)
    none = np.zeros(n, dtype=np.int64)
    docs = (np.cumsum(ids[:n]), ids[n : 2 * n] if told else none, ids[2 * n :] if told else none)
    at = 16 + 8 * len(ids)
    pos, count = np.frombuffer(data, dtype="<i4", count=2 * n, offset=at).reshape(2, n)
    return docs, pos, count, data[at + 8 * n :]


def _packed_group(docs: Docs, texts: list[bytes], k: int, m: int, buckets: int) -> Iterator[tuple[int, bool, int, bytes]]:
    """Rows (bucket, local, windows, block) of one group of texts, given in the order of their documents."""
    w = W.split(texts, W.BLANKS)
    at = w.runs(k)
    if not len(at):
        return
    a, b = w.hashes(0), w.hashes(1)
    h1, h2 = W.run_hashes(a, k, 0)[at], W.run_hashes(b, k, 1)[at]
    docs, pos = tuple(x[w.text[at]] for x in docs), at - w.first[w.text[at]]
    again = _repeats(h1, h2, docs, pos)
    if len(again):
        *d, lo, hi = _spans(tuple(x[again] for x in docs), pos[again], k)
        for part in np.array_split(np.arange(len(lo)), max(1, len(lo) // 50_000)):
            yield int(d[0][part[0]] % buckets), True, 0, _pack(tuple(x[part] for x in d), lo[part], hi[part], b"")
    least = _sliding_min(W.run_hashes(a, m, 0), k - m + 1)[at]
    stays = np.ones(len(at), dtype=bool)
    stays[again] = False
    at, docs, pos, least = at[stays], tuple(x[stays] for x in docs), pos[stays], least[stays]
    if not len(at):
        return
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (w.text[at[1:]] != w.text[at[:-1]])
    lead = np.flatnonzero(new)
    last = np.append(lead[1:] - 1, len(at) - 1)
    bucket = (W.mix(least[lead]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    lead, last, bucket = lead[order], last[order], bucket[order]
    lo, hi = w.start[at[lead]].tolist(), w.end[at[last] + k - 1].tolist()
    count = last - lead + k
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        body = b" ".join([w.raw[x:y] for x, y in zip(lo[i:j], hi[i:j], strict=True)])
        yield int(bucket[i]), False, int((count[i:j] - k + 1).sum()), _pack(tuple(x[lead[i:j]] for x in docs), pos[lead[i:j]], count[i:j], body)


def _to_buckets(batches: Iterator[pa.RecordBatch], k: int, m: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts = tuple(W.ids(batch.column(i)) for i in range(3)), W.as_bytes(batch.column(3))
        order = np.lexsort(tuple(reversed(docs)))
        once = np.ones(len(order), dtype=bool)
        once[1:] = _differ(docs, order[1:], order[:-1])  # equal rows are one document
        order = order[once]
        docs, texts = tuple(x[order] for x in docs), [texts[i] for i in order]
        for part in W.groups(texts, PACKED_BYTES):
            rows = list(_packed_group(tuple(x[part] for x in docs), texts[part], k, m, buckets))
            for i in range(0, len(rows), 256):
                bucket, local, windows, block = zip(*rows[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(local), pa.array(windows, pa.int32()), pa.array(block, pa.binary())], schema=_PACKED)


def _windows(block: bytes, k: int) -> tuple[np.ndarray, ...]:
    """Hashes, document (three arrays) and start of all windows in a packed block."""
    docs, pos, count, body = _unpack(block)
    w = W.split([body], W.BLANKS)
    first = np.cumsum(count) - count
    each = count - k + 1
    which = np.repeat(np.arange(len(count)), each)
    step = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
    at = first[which] + step
    return W.run_hashes(w.hashes(0), k, 0)[at], W.run_hashes(w.hashes(1), k, 1)[at], *(x[which] for x in docs), pos[which] + step


def _bucket_spans(table: pa.Table, k: int) -> pa.Table:
    """Spans of the repeated windows of one bucket, and those that the tasks had found already."""
    out = []
    local = table.column("local").to_pylist()
    blocks = table.column("block").to_pylist()
    mine = [b for b, x in zip(blocks, local, strict=True) if not x]
    for block in (b for b, x in zip(blocks, local, strict=True) if x):
        docs, lo, hi, _ = _unpack(block)
        out.append((*docs, lo, hi))
    passes = max(1, -(-sum(table.column("windows").to_pylist()) // PASS_WINDOWS))
    for p in range(passes):
        found = []
        for block in mine:
            x = _windows(block, k)
            found.append(tuple(v[(x[0] >> np.uint64(8)) % np.uint64(passes) == p] for v in x) if passes > 1 else x)
        if found:
            h1, h2, *docs, pos = (np.concatenate(v) for v in zip(*found, strict=True))
            again = _repeats(h1, h2, tuple(docs), pos)
            if len(again):
                out.append(_spans(tuple(x[again] for x in docs), pos[again], k))
    if not out:
        return _SPANS.empty_table()
    columns = (np.concatenate(v) for v in zip(*out, strict=True))
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SPANS, strict=True)], schema=_SPANS)


def _rows(documents: DataFrame, columns: list) -> DataFrame:
    """The columns of documents with the document of each row: ``_doc``, ``_t1`` and ``_t2``.

    Rows of one id are told by a hash of 128 bits of their texts; an id that one row alone has needs none.
    """
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    halves = (F.xxhash64(text), F.xxhash64(F.lit(0x5DEECE66D), text))
    repeated = documents.select(doc.alias("_id")).groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id", F.lit(True).alias("_shared"))
    number = repeated.count()
    if not number:
        return documents.select(*columns, doc.alias("_doc"), *(F.lit(0).cast("long").alias(n) for n in ("_t1", "_t2")))
    own = documents.select(*columns, doc.alias("_doc"), *(h.alias(n) for h, n in zip(halves, ("_t1", "_t2"), strict=True)))
    if number > FEW_REPEATED:
        return own
    found = own.join(F.broadcast(repeated), F.col("_doc") == F.col("_id"), "left")
    return found.withColumns({n: F.when(F.col("_shared"), F.col(n)).otherwise(F.lit(0)) for n in ("_t1", "_t2")}).drop("_id", "_shared")


def _found(rows: DataFrame, k: int, m: int, buckets: int | None) -> DataFrame:
    if buckets is None:
        buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * rows.rdd.getNumPartitions())
    packed = rows.mapInArrow(lambda batches: _to_buckets(batches, k, m, buckets), "bucket int, local boolean, windows int, block binary")
    return packed.groupBy("bucket").applyInArrow(lambda table: _bucket_spans(table, k), "doc long, t1 long, t2 long, lo int, hi int")


def repeated_spans(documents: DataFrame, *, k: int = WINDOW, m: int = MINIMISER, buckets: int | None = None) -> DataFrame:
    """Word spans (doc, t1, t2, lo, hi) covered by windows whose words also start earlier.

    Earlier means a smaller doc_id, or an earlier start in the same document; a row without id is NO_ID, the last. Rows
    that share an id, or have none, are documents of their own, told by the hash (t1, t2) of their text, whose order is
    theirs; (0, 0) where the id is enough. Equal rows, of one id and text, are one document. A null text has no words.
    ``buckets`` follows the number of input splits unless given.
    """
    text = F.col("text").cast("string").alias("text")
    return _found(_rows(documents, [text]).select("_doc", "_t1", "_t2", "text"), k, m, buckets)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts and kept text of rows (text, spans, ...); the other columns stay."""
    for batch in batches:
        names = batch.schema.names
        texts, spans = W.as_bytes(batch.column(names.index("text"))), batch.column(names.index("spans")).to_pylist()
        n_words, n_removed, kept = [], [], []
        for text, cut in zip(texts, spans, strict=True):
            w = text.split()  # bytes split at a blank and the controls 9 to 13 alone
            n_words.append(len(w))
            if cut:
                gone = np.zeros(len(w) + 1, dtype=np.int32)
                np.add.at(gone, np.minimum([s["lo"] for s in cut], len(w)), 1)
                np.add.at(gone, np.minimum([s["hi"] for s in cut], len(w)), -1)
                stays = np.cumsum(gone[:-1]) == 0
                w = [w[i] for i in np.flatnonzero(stays)]
            n_removed.append(n_words[-1] - len(w))
            kept.append(b" ".join(w))
        rest = [(n, batch.column(i)) for i, n in enumerate(names) if n not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays(
            [c for _, c in rest] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=[n for n, _ in rest] + ["n_words", "n_removed", "kept_text"],
        )


def _kept_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        names = batch.schema.names
        sha = [hashlib.sha256(t).hexdigest() for t in W.as_bytes(batch.column(names.index("kept_text")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index(n)) for n in ("doc_id", "n_words", "n_removed")] + [pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _with_spans(documents: DataFrame, columns: list, k: int, m: int) -> DataFrame:
    """The columns, one of which is text, and the spans of each row."""
    left = _rows(documents, columns)
    spans = _found(left.select("_doc", "_t1", "_t2", "text"), k, m, None).groupBy("doc", "t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    same = (left["_doc"] == spans["doc"]) & (left["_t1"] == spans["t1"]) & (left["_t2"] == spans["t2"])
    return left.join(spans, same, "left").drop("_doc", "_t1", "_t2", "doc", "t1", "t2").withColumnRenamed("_spans", "spans")


def remove_repeats(documents: DataFrame, *, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """documents with repeated windows cut out of ``text``; documents without a cut keep their text as it is.

    Rows that share an id or have none are judged each by itself (see ``repeated_spans``); equal rows fare alike.
    A cut text is its kept words joined by one space. Other columns stay, but for n_chars, which
    follows the text where the column exists. Null and empty texts stay as they are; an empty table
    gives an empty one.
    """
    shape = documents.schema
    rest = [F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(documents.columns)]
    full = _with_spans(documents, [*rest, F.col("text").cast("string").alias("text")], k, m)
    schema = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(shape))
    done = full.mapInArrow(_kept, f"{schema}, n_words long, n_removed long, kept_text string")
    cut = F.col("n_removed") > 0
    out = []
    for i, name in enumerate(documents.columns):
        c = F.col(f"_c{i}")
        if name == "text":
            c = F.when(cut, F.col("kept_text")).otherwise(c)
        elif name == "n_chars":
            c = F.when(cut, F.length("kept_text").cast(shape[name].dataType)).otherwise(c)
        out.append(c.alias(name))
    return done.select(*out)


def repeat_digests(documents: DataFrame, *, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    full = _with_spans(documents, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")], k, m)
    return full.mapInArrow(_kept_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
