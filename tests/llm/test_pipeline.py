"""The pipeline against a plain version of every stage, each held on its own input, and the SQL of the corpus queries."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quarrion.llm import factorization as fm
from quarrion.llm import queries
from tests.test_queries import TABLES, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def grams(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def plain_near_dedup(docs):
    sets = {d["doc_id"]: grams(w := WORD.findall(lowered(d["text"] or "")), 5) or ({tuple(w)} if w else set()) for d in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def plain_substring(docs):
    seen, out = set(), []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        w = WORD.findall(d["text"] or "")
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else d["text"]
        if WORD.search(text or ""):
            out.append({**d, "text": text, "n_chars": len(text) if gone else d["n_chars"]})
    return out


def plain_decontamination(docs, items):
    windows = defaultdict(set)
    for text in items:
        w = TOKEN.findall(lowered(text or ""))
        for g in grams(w, 10) or ({tuple(w)} if w else ()):
            windows[len(g)].add(g)
    return [d for d in docs if not any(grams(TOKEN.findall(lowered(d["text"] or "")), n) & known for n, known in windows.items())]


def plain_quality(spark, docs, sf_dir):
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]
    m, out = fm.train(*tables), []
    for d in docs:
        x = m.scale(fm.features([(d["text"] or "").encode()], np.array([len(d["text"] or "")], dtype=float)))[0].astype(np.float64)
        at = np.flatnonzero(x)
        z = m.w0 + x @ m.w + sum((m.v[at[i + 1 :]].astype(np.float64) @ m.v[a]) @ x[at[i + 1 :]] * x[a] for i, a in enumerate(at))
        out.append((d, 1 / (1 + np.exp(-z))))
    return out


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda d: (d["doc_id"], d["text"] or ""))


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixture"]
    for name, stage in corpus_pipeline.STAGES:
        given = rows(docs)
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        got = rows(docs)
        if name == "quality_classifier":
            kept = {d["doc_id"] for d in got}
            judged = plain_quality(spark, given, sf_dir)
            assert all((d["doc_id"] in kept) == (p >= fm.THRESHOLD) for d, p in judged if abs(p - fm.THRESHOLD) > 1e-4)
        elif name == "minhash_near_dedup":
            assert got == plain_near_dedup(given)
        elif name == "substring_dedup":
            assert got == plain_substring(given)
        elif name == "benchmark_decontamination":
            assert got == plain_decontamination(given, items)
        if name != "source_mixture":
            assert docs.columns == columns
            continue
        assert docs.columns == [*columns, "copies"]
        sizes, taken = defaultdict(int), defaultdict(int)
        for d in given:
            sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
        for d in got:
            assert 1 <= d["copies"] <= 2
            taken[d["source"]] += d["copies"] * len(WORD.findall(d["text"]))
        goal = plain_targets(sizes)
        for s, target in goal.items():
            largest = max((len(WORD.findall(d["text"] or "")) for d in given if d["source"] == s), default=0)
            assert abs(taken[s] - target) <= max(1, 0.5 * largest)


def plain_targets(sizes):
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, goal, left = 1.5 * sum(sizes.values()), {}, set(names)
    while left:
        level = (total - sum(goal.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > 2 * sizes[s]}
        if not full:
            return goal | {s: weight[s] * level for s in left}
        goal |= {s: 2.0 * sizes[s] for s in full}
        left -= full
    return goal


def test_run_gives_the_rows_of_the_last_stage(spark, sf_dir):
    a, b = (rows(corpus_pipeline.run(spark, sf_dir)) for _ in range(2))
    assert a and a == b


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket int, size string, copies string"
    long_text = " ".join(f"w{i}" for i in range(30_000))
    odd = [(1, None, None, None, None, 1, "a", "b"), (2, "", "en", "s", 0, None, None, None), (3, long_text, "en", None, len(long_text), 1, "a", "b"), (3, long_text, "en", None, len(long_text), 1, "a", "b"), (None, "no id at all", None, "s", 12, 1, "x", "y")]
    docs = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert set(out.columns) == set(docs.columns), name
        got = rows(out.where("doc_id is not null"))
        if name == "minhash_near_dedup":
            assert [d["doc_id"] for d in got] == [1, 2, 3, 3]
        if name == "benchmark_decontamination":
            assert [d["doc_id"] for d in got] == [1, 2, 3, 3]
        if name == "source_mixture":
            assert all(d["text"] for d in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cur.fetchall())


def test_rows_without_an_id_or_with_a_shared_one_keep_what_is_unique(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (None, a), (None, b), (2, a), (2, c)], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted((r.doc_id or 9, r.text) for r in stages["substring_dedup"](spark, docs, sf_dir).collect()) == [(1, a), (2, c), (9, b)]
    assert sorted((r.doc_id or 9, r.text) for r in stages["benchmark_decontamination"](spark, docs, sf_dir).collect()) == [(1, a), (2, a), (2, c), (9, a), (9, b)]
