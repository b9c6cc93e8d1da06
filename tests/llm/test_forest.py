import random
import re

import numpy as np
import pytest

from quarrion.llm import forest


def brute(rows, n=3, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d is None, d, len(sets[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows))


def corpus(seed=5, groups=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["É", "ß"]
    rows, ids = [], iter(rng.sample(range(10_000), 2000))
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(2, 120))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((next(ids), rng.choice([" ", "\n", "\t"]).join(w)))
        rows.append((next(ids), " ".join(base).upper()))
    return rows + [(20_000, None), (20_001, ""), (20_002, " \t"), (20_003, "one two"), (20_004, "ONE  two"), (20_005, "two one"), (20_006, "x"), (20_007, "x x x x x")]


def result(df):
    return sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("block", [2000, 4])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "src") for i, t in rows], "doc_id long, text string, class string").repartition(4)
    out = forest.near_duplicates(df, shingle=3, percent=85)
    got = result(out)
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (5, text), (5, text), (3, text + " i j k l"), (4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in forest.near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == {(None, None, True), (5, 5, True), (3, 3, True), (4, 4, True)}
    assert forest.near_duplicates(df.limit(0)).collect() == []


def test_repeated_ids_with_other_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (5, a + " y"), (5, "quite another text of id five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(forest.near_duplicates(df, shingle=3, percent=85)) == brute(rows)
    kept = forest.keep_first(df, shingle=3, percent=85).collect()
    assert sorted(tuple(r) for r in kept) == sorted([rows[0], rows[1], rows[5]])


def test_neighbours_of_dense_and_sparse_regions():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 256, (900, forest.MINIMA), dtype=np.uint8)
    sig[:300, : forest.DEEP] = 7  # too dense: all of it is one region
    sig[300:340, : forest.SHALLOW] = 9  # estimates decide: 20 copies of one signature, the others by chance
    sig[300:320] = sig[300]
    order = np.lexsort(sig.T[::-1])
    label = forest.neighbours(np.zeros(900, np.int32), sig[order], 0.65)
    region = {}
    for row, at in enumerate(order.tolist()):
        region.setdefault(int(label[row]), set()).add(at)
    assert sorted(map(len, region.values()), reverse=True)[:3] == [300, 20, 1]
    assert set(range(300)) in region.values() and set(range(300, 320)) in region.values()


def test_recall_of_candidates(spark):
    """Pairs at the least similarity or above meet in one region: measured on pairs of 0.85 to 0.9."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        base = [f"v{rng.randrange(5000)}" for _ in range(260)]
        other = base[: 260 - rng.randint(14, 20)] + [f"u{rng.randrange(5000)}" for _ in range(rng.randint(0, 4))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    want = [(2 * i, 2 * i + 1) for i in range(400) if dict((r[1], r[3]) for r in brute(rows[2 * i : 2 * i + 2]))[2 * i + 1] == 2 * i]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r.doc_id: r.component_id for r in forest.near_duplicates(df, shingle=3, percent=85).collect()}
    assert len(want) > 300
    assert sum(found[b] == a for a, b in want) >= 0.99 * len(want)


def test_filter_keeps_one_of_each_group(spark):
    rows = corpus(9)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, class long")
    out = forest.keep_first(df, shingle=3, percent=85)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for _, d, _, c in brute(rows) if d == c)


def test_bounds_spare_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - k], rng.integers(0, 1 << 62, k, dtype=np.uint64)])) for k in range(0, 60, 3)]
    roots = forest.confirm(sets, 85)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert all(roots[i] == roots[j] for i, j in links)
    across = forest.confirm(sets[:2] + sets[:1], 85, [0, 1, 2], np.array([0, 0, 1]))
    assert across[2] == across[0] != across[1] or across[1] == across[0]


def test_neighbours_lie_over_partitions_of_few_rows(spark):
    """An order dealt over many partitions, most of fewer rows than a row meets, has the edges of one whole order."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, (60, forest.MINIMA)).astype(np.uint8)
    sigs = np.concatenate([base, base[rng.integers(0, 60, 240)]])
    flip = rng.random(sigs.shape) < 0.2
    sigs[flip] = rng.integers(0, 3, int(flip.sum()))
    rows = [(i.to_bytes(16, "big"), s.tobytes()) for i, s in enumerate(sigs)]
    df = spark.createDataFrame(rows, "set_key binary, sig binary")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = {}
    try:
        for parts in (1, 7, 400):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            edges = [(bytes(r.a), bytes(r.b)) for r in forest.candidate_edges(df, 85).collect()]
            up = {}
            for a, b in edges:
                up.setdefault(a, set()).add(b)
                up.setdefault(b, set()).add(a)
            reached, groups = set(), []
            for k in sorted(up):
                if k not in reached:
                    group, todo = set(), [k]
                    while todo:
                        x = todo.pop()
                        if x not in group:
                            group.add(x)
                            todo += up[x]
                    reached |= group
                    groups.append(frozenset(group))
            found[parts] = set(groups)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found[1] == found[7] == found[400] and found[1]
