import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrion.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    target = shares(sizes)
    taken, least = defaultdict(int), {}
    by_id = defaultdict(list)
    for i, text, source in docs:
        by_id[i].append((source, len(WORD.findall(text or ""))))
    for r in rows:
        source, size = by_id[r.doc_id][0]
        assert r.size in [s for _, s in by_id[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        taken[source] += r.taken
        if r.taken < 2 * r.size:
            least[source] = min(least.get(source, 10**9), r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(1, least.get(s, 0)), (s, taken[s], target[s])


def test_targets_and_copies(spark):
    docs = [(i * 17 % 1000, " ".join(["w"] * (1 + i * i % 97)), None if i % 11 == 0 else f"s{i % 3}" if i % 2 else "Z") for i in range(400)]
    docs += [(5000, None, "s0"), (5001, "", "empty"), (5002, " \t", None), (5003, "x", "tiny")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, copies int").repartition(5)
    rows = mixing.mixture(df).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    assert sorted(map(tuple, mixing.mixture(df.repartition(3)).collect())) == sorted(map(tuple, rows))
    kept = mixing.mix(df)
    assert kept.columns == df.columns
    assert {r.doc_id: r.copies * len(WORD.findall(r.text)) for r in kept.collect()} == {r.doc_id: r.taken for r in rows if r.taken}


def test_whole_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(mixing.mixture(df).collect(), [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()])


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", "t"), (None, "c d e", None)], "doc_id long, text string, source string")
    assert sorted(r.size for r in mixing.mixture(df).collect()) == [2, 2, 3, 3]
    assert mixing.mixture(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []
    silent = spark.createDataFrame([(1, "", "s"), (2, None, "t")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mixture(silent).collect()] == [(0.0, 0), (0.0, 0)]


def dual(cells, target, most=2):
    """Multipliers by plain descent of the same dual: rates of cells (source, size, n) from a bisection for each source inside one for mu."""
    import numpy as np

    size, n = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    words, length = size * n, np.log1p(size)
    centre = (words * length).sum() / words.sum()
    spread = np.sqrt((words * length**2).sum() / words.sum() - centre**2)
    x, source = (length - centre) / spread, np.array([c[0] for c in cells])

    def rates(mu):
        r = np.zeros(len(cells))
        for s, t in target.items():
            at = source == s
            lo, hi = -30.0, 30.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (words[at] * np.minimum(most, np.exp(mid + mu * x[at]))).sum() < t else (lo, mid)
            r[at] = np.minimum(most, np.exp(lo + mu * x[at]))
        return r

    lo, hi = -20.0, 20.0
    for _ in range(100):
        mu = (lo + hi) / 2
        lo, hi = (mu, hi) if (words * x * rates(mu)).sum() + mixing.RIDGE * words.sum() * mu < 0 else (lo, mu)
    return mu, rates(mu)


def test_newton_solves_the_joint_dual(spark):
    cells = [("a", 3, 40), ("a", 30, 9), ("a", 300, 1), ("b", 3, 10), ("b", 100, 10), ("b", 900, 2), ("c", 50, 7), ("c", 5, 1)]
    sizes = defaultdict(int)
    for s, size, n in cells:
        sizes[s] += size * n
    target = shares(sizes)
    mu, rates = dual(cells, target)
    frame = spark.createDataFrame(cells, "key string, size long, n long")
    lam, got, centre, spread = mixing.balanced(frame, spark.createDataFrame([(s, sizes[s], t) for s, t in target.items()], "key string, source_size long, target double"))
    assert got == pytest.approx(mu, abs=1e-5) and abs(got) > 1e-3
    x = (F.log1p(F.col("size").cast("double")) - centre) / spread
    rows = frame.join(lam, "key").select("key", "size", F.coalesce(F.least(F.lit(2.0), F.exp(F.col("lam") + got * x)), F.lit(2.0)).alias("r")).collect()
    assert {(r.key, r.size): r.r for r in rows} == pytest.approx({(c[0], c[1]): r for c, r in zip(cells, rates, strict=True)}, abs=1e-4)


def test_rates_follow_the_tilt(spark):
    """The copies of many equal documents are the whole part of their rate and the rest in proportion."""
    docs = [(i, " ".join(["w"] * (4 if i % 3 else 40)), "ab"[i % 7 > 2]) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mixture(df).collect()
    check(rows, docs)
    cells, sizes = defaultdict(int), defaultdict(int)
    for i, text, source in docs:
        cells[source, len(text.split())] += 1
        sizes[source] += len(text.split())
    cells = [(*k, n) for k, n in cells.items()]
    _, rates = dual(cells, shares(sizes))
    taken = defaultdict(int)
    for r in rows:
        taken[docs[r.doc_id][2], r.size] += r.taken
    for (source, size, n), rate in zip(cells, rates, strict=True):
        assert taken[source, size] / (size * n) == pytest.approx(rate, abs=0.06)


def test_many_sources_go_the_salted_way_with_the_same_result(spark, monkeypatch):
    docs = [(i, " ".join(["w"] * (1 + i * i % 37)), None if i % 11 == 0 else f"s{i % 3}") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    few = sorted(map(tuple, mixing.mixture(df).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(tuple, mixing.mixture(df).collect())) == few


def test_columns_of_any_name_stay(spark):
    rows = [(i, "a b c", "s", i, i + 1, "x", 2.0, True, "size") for i in range(6)] + [(None, "d", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _words int, _id long, _source string, _size double, _copies boolean, size string")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copies"]
    kept = {r.doc_id: r for r in out.collect()}
    assert kept and all(tuple(kept[r[0]])[:-1] == r for r in rows if r[0] in kept)
    again = mixing.mix(docs.withColumn("copies", mixing.F.lit("old"))).collect()
    assert sorted(str(r.copies) for r in again) == sorted(str(r.copies) for r in kept.values())
