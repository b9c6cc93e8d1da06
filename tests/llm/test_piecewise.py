import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrion.llm import piecewise as P


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=90), st.text("abcd", max_size=90))
def test_distance(a, b):
    assert P.distance(a, b) == brute_distance(a, b)


def test_fingerprint_is_local():
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "cde", "fg", "hijk"]) + str(rng.randint(0, 99)) for _ in range(2000)).encode()
    x = P.fingerprint(text)
    assert P.fingerprint(bytes(text)) == x
    assert P.likeness(x, P.fingerprint(b"a new start " + text)) > 0.9
    assert P.likeness(x, P.fingerprint(text[::-1])) < 0.4
    assert 16 <= len(x.split(":")[1]) <= 130
    assert P.fingerprint(b"") == "1::" and P.likeness("1::", "1::") == 1.0
    assert P.likeness("1::", x) == 0.0
    assert P.likeness(P.fingerprint(b"short text"), P.fingerprint(b"short test")) > 0.7
    for period in (b"x", b"Word ", b"another one ", bytes(range(33, 90))):
        again = period * (100_000 // len(period))
        x, y = P.fingerprint(again), P.fingerprint(again[: len(again) * 2 // 3] + text[: len(again) // 3])
        assert 10 <= len(x.split(":")[1]) <= 400 and P.likeness(x, y) > 0.3


def test_matches_brute_force(spark):
    rng = random.Random(2)
    vocab = ["été", "ß", "wort", "word", "palabra", "\n"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 300)))) for i in rng.sample(range(10_000), 90)]
    rows += [(20_000, None), (20_001, ""), (5, "x"), (None, "without an id"), (rows[0][0], "the same id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, range int").repartition(4)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (P.fingerprint(x.encode()) for x in (t, edited, after))
        want.append((i is None, i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, P.likeness(a, b), P.likeness(a, c)))
    for ranges in (None, 1, 7):
        got = [(r.doc_id is None, *r) for r in P.fingerprints(df, ranges=ranges).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_one_document_and_empty_table(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    (row,) = P.fingerprints(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert P.fingerprints(one.limit(0)).collect() == []
