"""The factorisation machine against its definition, on held-out labels and on odd rows."""

import zlib

import numpy as np
import pytest

from quarrion.llm import factorization as fm

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, source string, score string", "doc_id long, quality int"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    d, n = 12, 5
    m = fm.Machine(0.3, rng.normal(size=d).astype(np.float32), rng.normal(size=(d, 4)).astype(np.float32), np.zeros(0, np.float32), np.ones(0, np.float32))
    x = rng.normal(size=(n, d)).astype(np.float32)
    pairs = [sum(float(m.v[i] @ m.v[j]) * r[i] * r[j] for i in range(d) for j in range(i + 1, d)) for r in x]
    z = 0.3 + x @ m.w + np.array(pairs)
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-z)), atol=1e-4)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r for r in fm.quality_scores(docs, labels).collect()}
    assert len(scored) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in scored.items())
    unseen = [i for i in truth if scored[i].held_out]
    assert len(unseen) > 40
    assert sum(scored[i].predicted == truth[i] for i in unseen) >= 0.9 * len(unseen)


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", fm.F.when(fm.held_out(fm.F.col("doc_id")), 1 - fm.F.col("quality")).otherwise(fm.F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in fm.quality_scores(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_weights_travel_unchanged():
    rng = np.random.default_rng(5)
    x = rng.random((40, 8 + len(fm.STRUCTURE))).astype(np.float32)
    y = (x[:, 0] > 0.5).astype(np.float64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])
    (row,) = next(fm._fitted(iter([batch]), 8, 3)).to_pylist()
    m = fm.Machine.of(row)
    order = sorted(range(40), key=lambda i: (x[i].tobytes(), y[i]))
    direct = fm.fit(x[order], y[order], rank=3)
    assert m.w0 == direct.w0 and np.array_equal(m.v, direct.v) and np.array_equal(m.w, direct.w)


@pytest.mark.parametrize("labelled", [[], [(None, 1), (1, None)]])
def test_without_usable_labels_every_score_is_one_half(spark, labelled):
    docs = frame(spark, [(1, "a b", "s", "x"), (2, None, None, None), (None, "", "s", "x")], DOCS)
    assert [r.score for r in fm.quality_scores(docs, frame(spark, labelled, LABELS)).collect()] == [0.5] * 3


def test_odd_rows(spark):
    rows = [(i, f"word{i % 7} and some more words here", "s", "x") for i in range(40)] + [(None, None, None, None), (41, "", "s", None), (42, "x" * 300_000, "s", "y"), (3, "twice", "s", "y")]
    labels = frame(spark, [(i, i % 2) for i in range(40)] + [(1, 0), (99, 1), (None, 1)], LABELS)
    docs = frame(spark, rows, DOCS)
    got = fm.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    kept = fm.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = {(r.doc_id, r.score) for r in got if r.predicted}
    assert kept.count() == sum(r.predicted for r in got) and len(good) <= kept.count()
    assert fm.quality_scores(docs.limit(0), labels).count() == 0


def test_documents_that_repeat_an_id_do_not_depend_on_order(spark):
    from quarrion.llm import factorization as fm

    rows = [(i, f"{'good plain words here' if i % 2 else 'BAD | stuff | 99'} {i}", i % 2) for i in range(1, 60)]
    docs = [(i, t) for i, t, _ in rows] + [(i, t + " again") for i, t, _ in rows[:30] for _ in range(3)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    a, b = (fm.train(spark.createDataFrame(d, "doc_id long, text string").repartition(n), labels, max_rows=20) for d, n in ((docs, 3), (docs[::-1], 5)))
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()
