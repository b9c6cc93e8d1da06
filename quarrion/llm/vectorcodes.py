"""Compression of vectors into codes of codebook entries, with norm-of-sum bounds.

Vectors are cut into parts, each with a codebook; rounds of assigning every part to its nearest entry and moving
the entries to the means of their parts fit the codebooks, exactly and in integers. A part keeps with its entry
a lower bound of its distance to all other entries and the round in which it was measured (its stamp). In a later
round the bound still holds less the way that the other entries have gone since. That way is the true net
displacement between the entry of the stamp's round and that of today, from the retained history of the codebooks:
the norm of the sum of all moves, not the sum of their norms, so an entry that goes there and back costs nothing.
Where the part's own distance is below the bound, no other entry can be nearer or as near; all other parts are
measured against all entries again.

The state of a row (integers, codes, bounds, stamps) is written after each pass, so a lost executor costs its part of
one pass. What meets in the driver are the codebooks alone, ENTRIES vectors however many rows there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.storage import checkpointed

#: Parts of a vector, entries of a part's codebook, rounds of fitting, and integer steps in one unit of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers stop at this absolute value, so that errors of 8 192 components stay within 64 bits.
LARGEST = 1 << 24
#: Parts measured against all entries at once.
BLOCK = 1 << 14
#: Labels whose sums may be broadcast (some 20 bytes each), and salts of a label beyond that.
FEW_LABELS, SALTS = 200_000, 64

_STATE = "vec_id long, label long, ints array<int>, code binary, bound binary, stamp binary, rescans int"


def kept_vectors(embeddings: DataFrame, *, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints) of the rows whose vector is there and all finite: floor(scale * component), within LARGEST."""
    vec = F.col("embedding").cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vec, lambda x: F.floor(F.greatest(F.lit(-LARGEST / scale), F.least(F.lit(LARGEST / scale), x)) * scale).cast("int"))
    return embeddings.where(vec.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), ints.alias("ints"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of one matrix; shorter ones end in zeros."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = flat[offsets[0] : offsets[-1]]
    return out


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row of the matrix as bytes."""
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: type, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), parts).copy()


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """For each earlier codebook, part and entry: the longest net way that any other entry has gone from then to the last codebook."""
    now = history[-1]
    out = np.zeros((len(history), *now.shape[:2]))
    for stamp, then in enumerate(history[:-1]):
        net = np.sqrt(((now - then).astype(np.float64) ** 2).sum(axis=2))
        if now.shape[1] > 1:
            two = np.sort(net, axis=1)[:, -2:]
            out[stamp] = np.where(net.argmax(axis=1)[:, None] == np.arange(now.shape[1]), two[:, :1], two[:, 1:])
    return out


def _squares(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each entry, exact."""
    out = np.zeros((len(vectors), len(entries)), dtype=np.int64)
    for i in range(vectors.shape[1]):
        out += (vectors[:, i, None] - entries[None, :, i]) ** 2
    return out


def assign(vectors: np.ndarray, history: list[np.ndarray], moved: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """Sets code, bound and stamp (each rows x parts) to the entries nearest now; how many parts of each row were measured anew.

    ``vectors`` is rows x parts x width, ``moved`` comes from ``displacements``. A bound of -1 stands for none.
    """
    now, part = history[-1], np.arange(vectors.shape[1])
    own = ((vectors - now[part, code]) ** 2).sum(axis=2)
    holds = bound.astype(np.float64) - moved[stamp, part, code]
    rest = ~(np.sqrt(own.astype(np.float64)) * (1 + 1e-9) < holds * (1 - 1e-9))
    for p in part:
        for rows in np.array_split(at := np.flatnonzero(rest[:, p]), len(at) // BLOCK + 1):
            d = _squares(vectors[rows, p], now[p])
            code[rows, p] = first = d.argmin(axis=1)
            d[np.arange(len(rows)), first] = np.iinfo(np.int64).max
            bound[rows, p] = np.nextafter(np.sqrt(d.min(axis=1).astype(np.float64)).astype(np.float32), np.float32(0))
            stamp[rows, p] = len(history) - 1
    return rest.sum(axis=1)


def _passed(batches: Iterator[pa.RecordBatch], history: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows with their state after one more pass."""
    moved = displacements(history)
    parts, _, width = history[0].shape
    for batch in batches:
        vectors = _matrix(batch.column("ints"), parts * width).reshape(len(batch), parts, width)
        state = [_unpacked(batch.column(n), kind, parts) for n, kind in (("code", np.uint8), ("bound", np.float32), ("stamp", np.uint8))]
        anew = assign(vectors, history, moved, *state)
        names, columns = batch.schema.names, list(batch.columns)
        for n, x in zip(("code", "bound", "stamp"), state, strict=True):
            columns[names.index(n)] = _packed(x)
        columns[names.index("rescans")] = pa.array(np.asarray(batch.column("rescans")) + anew, pa.int32())
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _partial_sums(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """(at, total, n): the sums of a task's parts by component of the codebooks, and their counts."""
    parts, entries, width = shape
    sums, counts = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
    for batch in batches:
        vectors = _matrix(batch.column("ints"), parts * width).reshape(len(batch), parts, width)
        code = _unpacked(batch.column("code"), np.uint8, parts)
        for p in range(parts):
            counts[p] += np.bincount(code[:, p], minlength=entries)
            for i in range(width):  # sums of a batch stay below 2**53
                sums[p, :, i] += np.bincount(code[:, p], weights=vectors[:, p, i], minlength=entries).astype(np.int64)
    at = np.flatnonzero(np.repeat(counts.ravel(), width))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.ravel()[at], pa.int64()), pa.array(np.repeat(counts.ravel(), width)[at], pa.int64())], names=["at", "total", "n"])


def _moved_on(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks with every entry at floor(sum / count) of its parts; an entry without a part stays."""
    shape = book.shape
    sums = state.select("ints", "code").mapInArrow(lambda b: _partial_sums(b, shape), "at int, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    found = sums.toPandas()  # a row a component of the codebooks at most
    flat = book.ravel().copy()
    flat[found["at"].to_numpy()] = found["total"].to_numpy() // found["n"].to_numpy()
    return flat.reshape(shape)


def _first_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids, as parts x entries x width."""
    widest = kept.agg(F.max(F.size("ints")).alias("w")).first().w or 0
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    width = -(-widest // parts)
    book = np.zeros((len(rows), parts * width), dtype=np.int64)
    for i, r in enumerate(rows):
        book[i, : len(r.ints)] = r.ints
    return book.reshape(len(rows), parts, width).transpose(1, 0, 2)


def fitted(embeddings: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, ints, code, bound, stamp, rescans) of the kept vectors, and the history of the codebooks.

    At most 256 entries. The first codebooks hold the vectors of the smallest ids, null ids last and equal ids in the
    order of their integers; fewer vectors give fewer entries. Vectors shorter than the longest count as ending in
    zeros, as does a length that ``parts`` does not divide. ``rescans`` counts the parts measured against all entries.
    """
    if not 0 < entries <= 256 or rounds > 255:
        raise ValueError("a code has one byte a part, and a stamp one byte")
    kept = checkpointed(kept_vectors(embeddings, scale=scale))
    history = [_first_codebooks(kept, parts, entries)]
    none = F.unhex(F.lit(np.full(parts, -1, dtype=np.float32).tobytes().hex()))
    zeros = F.unhex(F.lit("00" * parts))
    state = kept.select("vec_id", "label", "ints", zeros.alias("code"), none.alias("bound"), zeros.alias("stamp"), F.lit(0).alias("rescans"))
    if not history[0].size:
        return state, history
    for number in range(rounds + 1):
        if number:
            history.append(_moved_on(state, history[-1]))
        known = list(history)
        state = checkpointed(state.mapInArrow(lambda b, known=known: _passed(b, known), _STATE))
    return state, history


def _errors(batches: Iterator[pa.RecordBatch], book: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, code, error, rescans), the code in hex."""
    parts, _, width = book.shape
    for batch in batches:
        vectors = _matrix(batch.column("ints"), parts * width).reshape(len(batch), parts, width)
        code = _unpacked(batch.column("code"), np.uint8, parts)
        error = ((vectors - book[np.arange(parts), code]) ** 2).sum(axis=(1, 2)) if book.size else np.zeros(len(code), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64()), batch.column("rescans")], names=["vec_id", "label", "code", "error", "rescans"])


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components of the codebooks in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compressed(embeddings: DataFrame, **options) -> DataFrame:
    """Per kept vector: vec_id, label, code, error, label_error, codebooks_sha256 and rescans.

    Rows without a vector, or with a null or non-finite component, are left out; an empty vector is one without
    components, with error 0. Null labels are one label. Repeated rows and ids stay rows of their own. An empty
    table gives an empty one. Only vec_id, embedding and label are read.
    """
    state, history = fitted(embeddings, **options)
    book = history[-1]
    coded = state.mapInArrow(lambda b: _errors(b, book), "vec_id long, label long, code string, error long, rescans int")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    found = sums.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0))}).drop("label")
    keyed = coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0).cast("long"))})
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        joined = keyed.join(F.broadcast(found), ["_none", "_label"])
    else:  # a label that a third of all rows share is dealt over SALTS tasks
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, ["_none", "_label", "_salt"])
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"), "rescans")
