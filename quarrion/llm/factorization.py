"""Quality scores by a factorisation machine.

A text is a sparse vector: hashed words (their share of the text, damped), structure statistics
and metadata. The machine adds to a linear model the inner product of low-rank factors for every pair
of features, summed in linear time:

    sum over i<j of <v_i, v_j> x_i x_j  =  1/2 sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

Training reads a bounded sample of labelled rows (``max_rows``), in one task; the driver gets the
weights alone. Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import words as W

#: Buckets of hashed words, rank of the factors, labelled rows that training may read, threshold of the label.
BUCKETS, RANK, MAX_ROWS, THRESHOLD = 1 << 11, 6, 4000, 0.3
#: Passes over the sample, rows of a step, step size, decay of the weights.
EPOCHS, BATCH, STEP, DECAY = 30, 64, 0.02, 1e-4

_UPPER = W.separators((0x41, 0x5A))
_LOWER = W.separators((0x61, 0x7A))
_DIGIT = W.separators((0x30, 0x39))
_MARKS = W.separators((0x21, 0x22), (0x2D, 0x2D), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F), (0x27, 0x29))
_ODD = W.separators((0x23, 0x26), (0x2A, 0x2B), (0x2F, 0x2F), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0x21, 0x21))
_PIPE = W.separators((0x7C, 0x7C))
_LINE = W.separators((0x0A, 0x0A))
_BEYOND = W.separators((0x80, 0xFF))
STRUCTURE = ("bias of size", "log chars", "log words", "upper", "lower", "digits", "marks", "odd", "pipes", "lines", "beyond ascii", "word length", "repeats", "distinct", "top word", "long words", "caps words", "odd ends", "mean line", "repeated lines")


def _shares(flags: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[offsets[1:]] - total[offsets[:-1]]) / size


def features(texts: list[bytes], n_chars: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """One row of float32 a text: ``buckets`` hashed words, then the structure statistics. Whole texts are read."""
    w = W.split(texts, W.BLANKS)
    h = w.hashes()
    n = np.diff(w.first)
    size = np.array([len(t) for t in texts], dtype=np.float64)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    some, words = np.maximum(size, 1), np.maximum(n, 1).astype(np.float64)
    x = np.zeros((len(texts), buckets + len(STRUCTURE)), dtype=np.float32)
    code = w.text * buckets + (h % np.uint64(buckets)).astype(np.int64)
    counts = np.bincount(code, minlength=len(texts) * buckets).reshape(len(texts), buckets)
    x[:, :buckets] = np.sqrt(counts / words[:, None]) * 0.5
    length = (w.end - w.start).astype(np.float64)
    mean = lambda v: np.bincount(w.text, weights=v, minlength=len(texts)) / words
    again = np.zeros(len(w), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    order = np.lexsort((h, w.text))
    new = np.ones(len(w), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])
    lead = np.flatnonzero(new)
    times = np.diff(np.append(lead, len(w)))
    top = np.zeros(len(texts))
    np.maximum.at(top, w.text[order][lead], times)
    upper, beyond = _UPPER[w.buf], _BEYOND[w.buf]
    ups = np.concatenate(([0], np.cumsum(upper)))
    lows = np.concatenate(([0], np.cumsum(_LOWER[w.buf])))
    caps = (ups[w.end] - ups[w.start] > 1) & (lows[w.end] == lows[w.start])
    odd_end = _ODD[w.buf[w.end - 1]] if len(w) else np.zeros(0)
    lines = _shares(_LINE[w.buf], at, some)
    split = [t.split(b"\n") for t in texts]
    repeated = np.array([1 - len(set(s)) / len(s) for s in split])
    columns = (
        np.log1p(1000 / (1 + words)) / 4, np.log1p(n_chars) / 10, np.log1p(n) / 10, _shares(upper, at, some), _shares(_LOWER[w.buf], at, some), _shares(_DIGIT[w.buf], at, some) * 4,
        _shares(_MARKS[w.buf], at, some) * 4, _shares(_ODD[w.buf], at, some) * 8, _shares(_PIPE[w.buf], at, some) * 8, lines * 8, _shares(beyond, at, some),
        np.minimum(mean(length), 40) / 10, mean(again), np.bincount(w.text[order][lead], minlength=len(texts)) / words, top / words, mean(length > 20), mean(caps), mean(odd_end),
        np.log1p(size / np.array([len(s) for s in split])) / 8, repeated,
    )
    for i, c in enumerate(columns):
        x[:, buckets + i] = c
    return x


@dataclass
class Machine:
    """Weights of a trained machine; ``spread`` scales the structure columns."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, row) -> Machine:
        """A machine of a row of weights, as _fitted gives it."""
        w, v, centre, spread = (np.frombuffer(row[c], dtype=np.float32) for c in ("w", "v", "centre", "spread"))
        return cls(row["w0"], w, v.reshape(len(w), -1), centre, spread)

    def scale(self, x: np.ndarray) -> np.ndarray:
        b = x.shape[1] - len(self.centre)
        x[:, b:] = np.clip((x[:, b:] - self.centre) / self.spread, -4, 4) * 0.5
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for scaled rows, by the identity above."""
        s = x @ self.v
        z = self.w0 + x @ self.w + 0.5 * ((s * s).sum(axis=1) - (x * x) @ (self.v * self.v).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Adam on the log loss. Without rows the machine says 0.5 to every text, with one label it leans to that label."""
    rng, extra = np.random.default_rng(seed), len(STRUCTURE)
    d = x.shape[1]
    centre = x[:, d - extra :].mean(axis=0) if len(x) else np.zeros(extra, np.float32)
    spread = x[:, d - extra :].std(axis=0) + 1e-3 if len(x) else np.ones(extra, np.float32)
    m = Machine(0.0, np.zeros(d, np.float32), (rng.standard_normal((d, rank)) * 0.02).astype(np.float32), centre.astype(np.float32), spread.astype(np.float32))
    if not len(x):
        m.v[:] = 0
        return m
    x = m.scale(x.copy())
    prior = np.clip(y.mean(), 0.02, 0.98)
    m.w0 = float(np.log(prior / (1 - prior)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    bias = [0.0, 0.0]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            t += 1
            part = order[lo : lo + BATCH]
            b, s = x[part], x[part] @ m.v
            e = ((m.score(b) - y[part]) / len(part)).astype(np.float32)
            g_v = b.T @ (e[:, None] * s) - m.v * ((b * b).T @ e)[:, None] + DECAY * m.v
            g_w = b.T @ e + DECAY * m.w
            rate = STEP * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, (a, q) in ((m.w, g_w, moments[0]), (m.v, g_v, moments[1])):
                a *= 0.9
                a += 0.1 * g
                q *= 0.999
                q += 0.001 * g * g
                p -= rate * a / (np.sqrt(q) + 1e-8)
            g = float(e.sum())
            bias = [0.9 * bias[0] + 0.1 * g, 0.999 * bias[1] + 0.001 * g * g]
            m.w0 -= rate * bias[0] / (bias[1] ** 0.5 + 1e-8)
    return m


def _feature_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (label, x) of rows (label, text, n); x is the row of features as bytes."""
    for batch in batches:
        texts, n = W.as_bytes(batch.column(1)), batch.column(2).to_numpy()
        for part in W.groups(texts):
            x = features(texts[part], n[part], buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


_MACHINE = "w0 double, w binary, v binary, centre binary, spread binary"


def _fitted(batches: Iterator[pa.RecordBatch], buckets: int, rank: int) -> Iterator[pa.RecordBatch]:
    """The weights learnt from the rows (label, x) of a bounded sample, which one task holds (a limit made it one partition)."""
    data = sorted(r for batch in batches for r in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
    x = np.frombuffer(b"".join(r for r, _ in data), dtype=np.float32).reshape(len(data), buckets + len(STRUCTURE))
    m = fit(x, np.array([y for _, y in data], dtype=np.float64), rank=rank)
    yield pa.RecordBatch.from_arrays([pa.array([m.w0])] + [pa.array([a.astype(np.float32).tobytes()], pa.binary()) for a in (m.w, m.v, m.centre, m.spread)], names=["w0", "w", "v", "centre", "spread"])


def _text_columns(documents: DataFrame) -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [text.alias("text"), F.length(text).cast("double").alias("n")]


def held_out(doc_id) -> F.Column:
    """True for the rows that no label may be learnt from: crc32 of the id as text is divisible by 5 (null id: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, rank: int = RANK) -> Machine:
    """A machine from at most ``max_rows`` labelled documents that are not held out.

    The sample is the same at every run: the rows with the least hash of their id. Labels repeated
    for one id are averaged (1 from 0.5 on); null labels and null ids are left out. Of documents that
    repeat an id the one with the least text is read.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("q"))
        .where(F.col("q").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.when(F.avg("q") >= 0.5, 1.0).otherwise(0.0).alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    own = documents.select(F.col("doc_id").cast("long").alias("_id"), *_text_columns(documents))
    rows = own.join(F.broadcast(wanted), "_id")  # at most max_rows ids
    one = rows.groupBy("_id").agg(F.min(F.struct("text", "n", "label")).alias("row"))
    sample = one.select("row.label", "row.text", "row.n").mapInArrow(lambda b: _feature_rows(b, buckets), "label double, x binary").limit(max_rows)  # one partition; no row is cut
    found = sample.mapInArrow(lambda b: _fitted(b, buckets, rank), _MACHINE).collect()  # one row of weights
    return Machine.of(found[0]) if found else fit(np.zeros((0, buckets + len(STRUCTURE)), np.float32), np.zeros(0), rank=rank)


def _scores(texts: list[bytes], n: np.ndarray, machine: Machine, buckets: int) -> np.ndarray:
    return np.concatenate([machine.score(machine.scale(features(texts[p], n[p], buckets))) for p in W.groups(texts, W.GROUP_BYTES)] or [np.zeros(0)])


def _scored(batches: Iterator[pa.RecordBatch], machine: Machine, buckets: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (..., score, predicted) of rows (..., text, n)."""
    for batch in batches:
        k = batch.num_columns - 2
        score = _scores(W.as_bytes(batch.column(k)), batch.column(k + 1).to_numpy(), machine, buckets)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(k)] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[:k], "score", "predicted"])


def _good(batches: Iterator[pa.RecordBatch], machine: Machine, buckets: int, threshold: float, text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = W.as_bytes(batch.column(text_at).cast(pa.string()))
        n = np.array([len(t) if t.isascii() else len(t.decode()) for t in texts], dtype=np.float64)
        yield batch.filter(pa.array(_scores(texts, n, machine, buckets) >= threshold)) if texts else batch


def quality_scores(documents: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on).

    A null text is scored as the empty text, which gets a score as any other. Without usable labels
    every score is 0.5.
    """
    sc = documents.sparkSession.sparkContext
    machine = sc.broadcast(train(documents, labels, max_rows=max_rows, buckets=buckets))
    doc_id = F.col("doc_id").cast("long")
    rows = documents.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), *_text_columns(documents))
    return rows.mapInArrow(lambda b: _scored(b, machine.value, buckets, threshold), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    machine = documents.sparkSession.sparkContext.broadcast(train(documents, labels, max_rows=max_rows, buckets=buckets))
    text_at = documents.columns.index("text")
    return documents.mapInArrow(lambda b: _good(b, machine.value, buckets, threshold, text_at), documents.schema)
