"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last ``ROLL`` bytes ends a chunk wherever it is divisible by the block size,
a power of two; each chunk gives one letter of the signature. A fingerprint holds the signatures of
two neighbouring block sizes, ``size:first:second``, so texts whose sizes differ by a factor of
two can still be compared; likeness is one minus the edit distance of signatures at a common block
size, divided by the longer length. The block size is the least with about ``LETTERS`` chunks, and
is doubled while a text that repeats itself gives far more of them; where nothing ends a chunk, its
length does. At block size 1 every byte is a chunk, so short texts compare byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm import words as W
from quarrion.storage import checkpointed

#: Bytes of the rolling hash, chunks aimed at, and block sizes after which a chunk ends in any case.
ROLL, LETTERS, LONGEST = 7, 64, 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_ALPHABET = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_ROLL_MULT, _CHUNK_MULT = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25


def _signature(total: np.ndarray, down: np.ndarray, roll: np.ndarray, size: int) -> str:
    """Letters of the chunks that a block size gives."""
    n = len(roll)
    ends = np.flatnonzero((roll & np.uint64(size - 1)) == 0) + 1 if size > 1 else np.arange(1, n + 1)
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate(([0], ends[:-1]))
    more = (ends - starts - 1) // (LONGEST * size)
    if more.any():
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate((ends, np.repeat(starts, more) + step * LONGEST * size)))
        starts = np.concatenate(([0], ends[:-1]))
    h = W.mix((total[ends] - total[starts]) * down[starts])
    return _ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """The fingerprint of a text; the empty text has the empty signatures."""
    buf = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(buf)
    if not n:
        return "1::"
    up, down = W.powers(_CHUNK_MULT, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(buf * up[:-1], out=total[1:])
    roll = buf.copy()
    weight = _ROLL_MULT
    for back in range(1, min(ROLL, n)):
        roll[back:] += buf[:-back] * np.uint64(weight)
        weight = weight * _ROLL_MULT % (1 << 64)
    roll = W.mix(roll)
    size = 1
    while size * LETTERS < n:
        size *= 2
    while np.count_nonzero((roll & np.uint64(size - 1)) == 0) > 4 * LETTERS and size < n:
        size *= 2
    return f"{size}:{_signature(total, down, roll, size)}:{_signature(total, down, roll, size * 2)}"


def distance(a: str, b: str) -> int:
    """Edit distance (insert, delete, replace) with all rows of a column in one integer."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        eq = masks.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(zero | up) & full), up & zero
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | (~(zero | plus) & full), plus & zero
    return score


def likeness(x: str, y: str) -> float:
    """0 to 1: of the common block sizes the best; 0 if no block size is common, 1 for two empty texts."""
    if x == y:
        return 1.0
    (p, a1, a2), (q, b1, b2) = (s.split(":") for s in (x, y))
    p, q = int(p), int(q)
    pairs = [(s, t) for m, s in ((p, a1), (2 * p, a2)) for k, t in ((q, b1), (2 * q, b2)) if m == k]
    return max((1 - distance(s, t) / max(len(s), len(t)) for s, t in pairs if s or t), default=0.0)


def _edited(text: str, following: str) -> str:
    """text with its last third replaced by as many leading code points of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _row(doc_id: int | None, text: str, own: str, following: str, next_own: str) -> tuple:
    edited = _edited(text, following).encode()
    changed = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_own)


_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (range, closing, doc_id, text), ordered; the closing row of a range only follows its last document."""
    before = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            out = []
            for part, closing, doc_id, text in zip(*(batch.column(i).slice(lo, 500).to_pylist() for i in range(4)), strict=True):
                own = fingerprint(text.encode())
                if before:
                    out.append(_row(*before, text, own))
                before = None if closing else (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(_RESULT), _RESULT, strict=True)], schema=_RESULT)


def _range_of(cuts: list[int]):
    """The number of an id's range, from the largest ids down, by a binary search among the cuts; null ids are the last range."""
    known = np.array(cuts, dtype=np.int64)

    def number(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            ids = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
            at = np.where(column.is_null().to_numpy(zero_copy_only=False), len(known) + 1, len(known) - np.searchsorted(known, ids, side="left"))
            yield pa.array(at, pa.int32())

    return F.arrow_udf(number, "int")


def fingerprints(documents: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness of both and of the next document.

    The next document is the one of the next smaller doc_id (after the last comes the first); null ids
    come last, equal ids are ordered by their text. A null text counts as empty. A single document is
    its own next. Ids are cut into ``ranges`` of about equal counts; each is worked off in order, with
    the first document of the following range behind its last.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        ranges = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.rdd.getNumPartitions())
    steps = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", steps, 10 * ranges)).first()[0] or []))
    rows = rows.withColumn("range", _range_of(cuts)(F.col("doc_id")))
    tops = checkpointed(rows.groupBy("range").agg(F.max("doc_id").alias("top")).withColumnRenamed("range", "r"))  # one row a range
    heads = rows.join(F.broadcast(tops), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("range").agg(F.min("text").alias("text"))
    order = Window.orderBy("r")  # numbers of the ranges alone; texts are joined to them
    follows = tops.select("r", F.coalesce(F.lead("r").over(order), F.first("r").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("range"))
    closing = heads.join(F.broadcast(follows), "range").select(F.col("r").alias("range"), F.lit(True).alias("closing"), F.lit(None).cast("long").alias("doc_id"), "text")
    every = rows.select("range", F.lit(False).alias("closing"), "doc_id", "text").unionByName(closing)
    return every.repartition("range").sortWithinPartitions("range", "closing", F.col("doc_id").desc_nulls_last(), "text").mapInArrow(_along, _DDL)
