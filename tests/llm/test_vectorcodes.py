import hashlib
import random

import duckdb
import numpy as np
import pytest

from quarrion.llm import queries, vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """(rows by the definition, digest of the codebooks), with plain integers and all distances."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            kept.append((i, [int(np.floor(float(np.float32(x)) * 256)) for x in v], label))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label, v) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[cut(v, p) for _, v, *_ in first] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((square(cut(v, p), c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, *_ in kept:
                groups.setdefault(near(v, p)[1], []).append(cut(v, p))
            for j, g in groups.items():
                books[p][j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    out, labels = [], {}
    for i, v, label, _ in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
        labels[label] = labels.get(label, 0) + out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, e, labels[label], sha) for i, label, code, e in out), key=str)


def shown(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def made(n, dim, seed=1):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(5)]
    return [(i, [float(np.float32(m + rng.gauss(0, 0.05))) for m in rng.choice(middles)], rng.choice([0, 1, 1, 1, None])) for i in range(n)]


def test_matches_brute_force_with_odd_rows(spark):
    rows = made(300, 32)
    rows += [(400, None, 1), (401, [0.5, None] * 16, 1), (402, [float("nan")] * 32, 1), (403, [float("inf")] * 32, None), (404, [float("-inf")] + [0.0] * 31, 2)]
    rows += [(5, rows[7][1], 3), (5, rows[7][1], 3), (None, rows[9][1], 3), (410, [0.1] * 7, 2), (411, [], 2), (412, [-0.001] * 32, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = vectorcodes.compressed(df.selectExpr("*", "1 as code", "2 as ints", "3 as _label"))
    assert shown(out) == brute(rows)


@pytest.mark.parametrize(("n", "dim"), [(3, 16), (1, 5), (200, 21)])
def test_few_rows_and_lengths_that_do_not_divide(spark, n, dim):
    rows = made(n, dim, seed=n)
    assert shown(vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table_and_only_empty_vectors(spark):
    assert vectorcodes.compressed(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [], 4), (2, [], 4), (3, None, 4)]
    got = vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in sorted(got, key=lambda r: r.vec_id)] == [(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)]


def test_huge_components_stop_at_the_largest(spark):
    rows = [(1, [3e38] * 16, 0), (2, [-3e38] * 16, 0), (3, [0.0] * 16, 0)]
    got = {r.vec_id: r for r in vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].error == got[2].error == got[3].error == 0 and len({r.code for r in got.values()}) == 3


def test_many_labels_by_salts(spark, monkeypatch):
    rows = made(120, 16)
    monkeypatch.setattr(vectorcodes, "FEW_LABELS", 1)
    monkeypatch.setattr(vectorcodes, "SALTS", 3)
    assert shown(vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_bounds_give_what_a_full_search_gives():
    rng = np.random.default_rng(5)
    for trial in range(30):
        parts, entries, width, n = 3, rng.integers(1, 20), rng.integers(1, 4), 200
        vectors = rng.integers(-12, 12, (n, parts, width))
        history = [rng.integers(-12, 12, (parts, entries, width))]
        code, bound, stamp = np.zeros((n, parts), np.uint8), np.full((n, parts), -1, np.float32), np.zeros((n, parts), np.uint8)
        for _ in range(5):
            vectorcodes.assign(vectors, history, vectorcodes.displacements(history), code, bound, stamp)
            d = ((vectors[:, :, None, :] - history[-1][None]) ** 2).sum(axis=3)
            assert (code == d.argmin(axis=2)).all(), trial
            history.append(history[-1] + rng.integers(-1, 2, history[-1].shape))


def test_an_entry_that_comes_back_costs_no_search():
    """The net way from the stamp's round is 0 where the accumulated way is beyond every bound."""
    vectors = np.array([[[0]], [[100]]])
    books = [np.array([[[0], [100]]]), np.array([[[0], [900]]]), np.array([[[0], [100]]])]
    code, bound, stamp = np.array([[0], [1]], np.uint8), np.array([[99.9], [99.9]], np.float32), np.zeros((2, 1), np.uint8)
    assert vectorcodes.assign(vectors, books, vectorcodes.displacements(books), code, bound, stamp).tolist() == [0, 0]
    drift = sum(abs(int(b[0, 1, 0]) - int(a[0, 1, 0])) for a, b in zip(books, books[1:], strict=False))
    assert drift > 99.9


def test_bounds_save_searches_on_whole_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = vectorcodes.compressed(df)
    anew, rows = out.selectExpr("sum(rescans)", "count(*)").first()
    assert rows == df.count() and 16 * rows < anew < 3 * 16 * rows


def test_sql_gives_the_same_rows(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    cur = con.execute(queries.ORACLES["op12_vector_codes"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(n)] for n in sorted(names)) for r in cur.fetchall())
    out = queries.op12_vector_codes(spark, sf_dir)
    assert sorted(out.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in sorted(names)) for r in out.collect()) == want
