import hashlib
import random
import re

from quarrion.llm import substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k=20):
    """Per row: words, removed words, digest of the kept words."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][s : s + k]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] != (i, s):
                gone.update(range(s, s + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ß x", " ", "a\x1cb"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, other = text(35), text(21)
    rows = [(i, rng.choice(["", "\t\n", " "]) + text(rng.randint(0, 150))) for i in range(40)]
    rows += [(100 + i, text(rng.randint(0, 30)) + "\n" + passage + "\x0b" + text(rng.randint(0, 30))) for i in range(25)]
    rows += [(200 + i, rows[i][1]) for i in range(8)]
    rows += [(300, None), (301, ""), (302, "  "), (303, "one"), (304, " ".join(["again"] * 90)), (305, f"{other} x {other}"), (306, text(20)), (307, text(30_000))]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeat_digests(df).collect()}
    assert got == brute(rows)


def test_passes_over_a_large_bucket(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(substring, "PASS_WINDOWS", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(90)
    packed = df.selectExpr("doc_id", "0L as t1", "0L as t2", "text").mapInArrow(lambda b: substring._to_buckets(b, 20, 5, 1), "bucket int, local boolean, windows int, block binary")
    table = packed.toArrow()
    assert sum(table.column("windows").to_pylist()) > 5000
    spans = substring._bucket_spans(table, 20).to_pylist()
    gone = {}
    for s in spans:
        gone.setdefault(s["doc"], set()).update(range(s["lo"], s["hi"]))
    want = {i: n for i, (_, n, _) in brute(rows).items() if n}
    assert {i: len(x) for i, x in gone.items()} == want


def test_documents_keep_their_columns(spark):
    text = " ".join(f"v{i}" for i in range(25))
    rows = [(1, text, "en", None, 0, 5), (2, text, None, "s", 0, None), (3, "short  text", "en", "s", 11, 1), (4, None, "en", "s", None, 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", spans int")
    out = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert out[1].text == text and out[2].text == "" and out[2].n_chars == 0 and out[3].text == "short  text" and out[4].text is None
    assert out[1].spans == 5 and out[4].spans == 2
    assert substring.remove_repeats(df).columns == df.columns


def test_empty_table_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring.repeat_digests(empty).collect() == []
    text = " ".join(f"v{i}" for i in range(22))
    df = spark.createDataFrame([(None, text), (7, text), (7, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring.repeat_digests(df).collect())
    assert got == [(-1, 22), (7, 0), (7, 0)]


def judged_by_row(rows, k=20):
    """Per row, in order: removed words. Rows of one id go by the hash of their text; equal rows are one document."""
    key = lambda r: (substring.NO_ID if r[0] is None else r[0], *r[2:])
    docs = {key(r): r[1].split() for r in rows}
    first, gone = {}, {}
    for d in sorted(docs):
        for s in range(len(docs[d]) - k + 1):
            if first.setdefault(tuple(docs[d][s : s + k]), (d, s)) != (d, s):
                gone.setdefault(d, set()).update(range(s, s + k))
    return [(r[0], r[1], len(gone.get(key(r), ()))) for r in rows]


def hashed(spark, rows):
    """rows with the two halves of the hash that orders rows of one id."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in df.selectExpr("doc_id", "text", "xxhash64(text)", f"xxhash64({0x5DEECE66D}L, text)").collect()]


def test_rows_without_an_id_or_with_a_repeated_one_are_judged_each_by_itself(spark, monkeypatch):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (None, a), (None, b), (2, a), (2, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (1_000_000, 0):
        monkeypatch.setattr(substring, "FEW_REPEATED", few)
        got = sorted((r.doc_id or 9, r.n_words, r.n_removed) for r in substring.repeat_digests(df).collect())
        assert got == [(1, 30, 0), (2, 30, 0), (2, 30, 30), (9, 30, 0), (9, 30, 30)]
        assert sorted(r.text for r in substring.remove_repeats(df).collect()) == ["", "", a, b, c]


def test_shared_ids_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    passages = [" ".join(rng.choice("pqrstuvw") + str(rng.randint(0, 50)) for _ in range(rng.randint(20, 60))) for _ in range(12)]
    rows = [(rng.choice([None, 1, 2, 3, i]), " ".join(rng.sample(passages, rng.randint(1, 3)))) for i in range(90)] + [(5, passages[0])] * 3 + [(None, passages[1])] * 4
    want = sorted((str(i), n, t) for i, t, n in judged_by_row(hashed(spark, rows)))
    for few in (1_000_000, 0):
        monkeypatch.setattr(substring, "FEW_REPEATED", few)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        out = substring.repeat_digests(df)
        assert sorted((str(r.doc_id), r.n_removed) for r in out.collect()) == [w[:2] for w in want]
        kept = sorted((str(r.doc_id), len(r.text.split())) for r in substring.remove_repeats(df).collect())
        assert kept == sorted((i, len(t.split()) - n) for i, n, t in want)
