import hashlib
import random
import re

import pytest

from quarrion.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=10):
    known = {}
    for i, t in items:
        w = lowered(t)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, met = lowered(t), set(), set()
        for n in {len(x) for x in known}:
            for s in range(len(w) - n + 1):
                if ids := known.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    met |= ids
        out[d] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit))
    return out


def tables(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "ß", "x9"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(10, 60))) for i in range(20)] + [(20, "alpha beta"), (21, "Gamma delta epsilon zeta"), (22, None), (23, "..."), (24, ""), (25, "solo"), (3, text(12))]
    items += [(30, items[0][1]), (31, "Ab cd " * 10)]
    docs = [(i, text(rng.randint(0, 200))) for i in range(30)]
    for i in range(30, 60):
        a = items[rng.randrange(20)][1]
        cut = a.split()[rng.randint(0, 3) :][: rng.randint(8, 30)]
        docs.append((i, text(rng.randint(0, 30)) + " " + " ".join(cut).upper() + "! " + text(rng.randint(0, 30))))
    docs += [(70, None), (71, ""), (72, "ALPHA-beta"), (73, "gamma delta; epsilon\tzeta solo"), (74, "ab cd " * 7), (75, text(9))]
    return docs, items


@pytest.mark.parametrize("limit", [winnowing.MAX_WINDOWS, 5])
def test_matches_brute_force(spark, limit):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in winnowing.contamination(d, b, max_windows=limit).collect()}
    assert got == brute(docs, items)


@pytest.mark.parametrize("limit", [winnowing.MAX_WINDOWS, 5])
def test_filter_keeps_columns_and_clean_rows(spark, limit):
    docs, items = tables(4)
    d = spark.createDataFrame([(i, t, None if i % 2 else "en", i) for i, t in docs], "doc_id long, text string, lang string, item_id long")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = winnowing.decontaminate(d, b, max_windows=limit)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == {i for i, x in brute(docs, items).items() if not x[4]}


@pytest.mark.parametrize("limit", [winnowing.MAX_WINDOWS, 5])
def test_rows_are_judged_by_their_own_text(spark, limit):
    passage = " ".join(f"word{i}" for i in range(12))
    rows = [(1, f"so {passage}"), (1, "clean one"), (None, passage), (None, "clean two"), (4, "clean four"), (4, "clean four"), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, passage), (2, "solo")], "item_id long, text string")
    out = winnowing.decontaminate(d, b, max_windows=limit if limit > 5 else 0).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[5], rows[6]]))
    got = winnowing.contamination(d, b, max_windows=limit if limit > 5 else 0).collect()
    assert sorted((str(r.doc_id), r.contaminated) for r in got) == [("1", False), ("1", True), ("4", False), ("4", False), ("5", False), ("None", False), ("None", True)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in winnowing.contamination(docs, none).collect()] == [False, False]
    assert winnowing.contamination(docs.limit(0), none).count() == 0
