"""Known answers and brute-force versions of operators that SQL does not express."""

import math
import random
import re
import zipfile
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion import catalog
from quarrion.functions import net as N
from quarrion.functions import text as X
from quarrion.operators import extract as E
from quarrion.operators import graph as G
from quarrion.operators import relational as R
from quarrion.operators import rules as L
from quarrion.operators import similarity as S


def brute_components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200)]
    df = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
    assert {r.node: r.component for r in G.components(df).collect()} == brute_components(edges)
    assert G.components(df.limit(0)).collect() == []


def test_two_core(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(tuple(r) for r in G.k_core(df, 2).collect()) == [(1, 2), (1, 3), (2, 3)]
    assert G.k_core(df, 3).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(G, "EDGES_A_TASK", 25)
    monkeypatch.setattr(G, "HUB", 3)
    rng = random.Random(5)
    edges = [(7, i) for i in range(20, 60)] + [(i, rng.randint(0, 80)) for i in range(30)] + [(i, 90) for i in range(70, 80)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in G.components(df).collect()} == brute_components(edges)


def test_components_of_near_neighbours_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "EDGES_A_TASK", 500)
    edges = [(i, i + 1 + i * d % 9) for i in range(1000) for d in range(1, 8) if i % 400 < 380]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in G.components(df, max_rounds=0).collect()} == brute_components(edges)


def test_components_of_a_path_that_does_not_settle_fail(spark, monkeypatch):
    monkeypatch.setattr(G, "EDGES_A_TASK", 10)
    df = spark.createDataFrame([(i * 37 % 200, i * 37 % 200 + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        G.components(df, max_rounds=0)


def test_two_core_of_long_chains(spark):
    tail = [(i, i + 1) for i in range(1000, 1400)] + [(1400, 1), (1200, 3000), (3000, 3001)] + [(i, i + 1) for i in range(5000, 5300)]
    ring = [(1, 2), (2, 3), (3, 1)] + [(i, i + 1) for i in range(2000, 2100)] + [(2100, 2000)]
    df = spark.createDataFrame(tail + ring, "a long, b long")
    assert sorted(tuple(r) for r in G.k_core(df, 2).collect()) == sorted(tuple(sorted(e)) for e in ring)


def test_two_core_of_all_orders(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    edges = {(r.o_custkey, r.o_custkey + r.o_orderkey % 11) for r in rows if r.o_orderkey % 11}
    while True:
        degree = Counter(x for e in edges for x in e)
        left = {e for e in edges if min(degree[x] for x in e) >= 2}
        if left == edges:
            break
        edges = left
    assert edges and {tuple(r) for r in catalog.QUERIES["g09_two_core"](spark, sf_dir).select("a", "b").collect()} == edges


def sets(seed=1):
    rng = random.Random(seed)
    rows = {i: {str(rng.randint(0, 30)) for _ in range(rng.randint(1, 12))} for i in range(40)}
    rows |= {100 + i: {*map(str, range(50, 60)), *(str(rng.randint(60, 62)) for _ in range(2))} for i in range(6)}
    return rows


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_prefix_filtering_loses_no_pair(spark, threshold):
    rows = sets()
    df = spark.createDataFrame([(i, x) for i, s in rows.items() for x in s], "node long, feature string")
    got = {(r.l, r.r): round(r.jaccard, 9) for r in S.pairs_above(df, threshold).collect()}
    want = {(a, b): round(len(rows[a] & rows[b]) / len(rows[a] | rows[b]), 9) for a in rows for b in rows if a < b}
    assert got == {k: v for k, v in want.items() if v >= threshold - 1e-12}


def test_complete_linkage_and_medoid(spark):
    rows = {i: {*map(str, range(10))} for i in range(4)} | {4: set(map(str, range(9))), 5: set(map(str, range(8)))}
    df = spark.createDataFrame([(i, x) for i, s in rows.items() for x in s], "node long, feature string")
    links = S.pairs_above(df, 0.8)
    clusters = S.linkage_clusters(links, S.families(links), cut=0.2 + 1e-12)
    assert [(r.size, r.medoid) for r in S.medoids(clusters, 5).collect()] == [(6, 0)]
    with pytest.raises(Exception, match="complete linkage takes 3"):
        S.linkage_clusters(links, S.families(links), 0.2, largest=3).collect()


def test_common_features_are_shared_by_all(spark):
    rows = [("f", 1, "a"), ("f", 1, "b"), ("f", 2, "a"), ("g", 3, "c"), ("g", 3, "c")]
    df = spark.createDataFrame(rows, "family string, node long, feature string")
    assert sorted(tuple(r) for r in R.common_features(df, "family", "node", "feature").collect()) == [("f", "a"), ("g", "c")]


def test_rules(spark):
    schema = "app_name string, components string, permissions array<string>, api2 string, empty string"
    row = spark.createDataFrame([("Hello", "a.B, c.D e.F", [" x ", "", "y.z"], "v", None)], schema)
    c = L.Compiler(row.schema)
    cases = {
        "content_include(components,'a.B,e.%')": True, "content_include(components,'a.B,E.%')": False, "content_include(permissions,'x,%z')": True, "content_include(permissions,'')": False,
        "content_include(permissions,'x)": True, "keywords_contains(appName,\"l\",2)": True, "keywords_contains(appName,\"l\",3)": False, "keywords_contains(app_name,\"[\",1)": False, "appName=~/^He/": True,
        "app_name=~/^he/": False, "jaccard_sim(components,'a.B c.D') >= 0.6": True, "jaccard_sim(components,'a.B') > 0.5": False, "jaccard_sim(empty,'') == 1": True, "jaccard_sim(empty,'a') < 0.1": True,
        "app_name=='Hello'": True, "empty==''": True, "unknown==''": True, "api2=='v'": True, "app_name=='Hello' && empty==''": True, "app_name=='x' || empty==''": True,
        "app_name=='Hello' && empty=='' || empty==''": False, "nonsense": False, "": False, "content_include(permissions,'y_z')": False, "content_include(permissions,'y.%')": True,
    }
    got = row.select(*(c.rule(x).alias(str(i)) for i, x in enumerate(cases))).first()
    assert {x: got[i] for i, x in enumerate(cases)} == cases
    assert L.rule_from_fingerprint("f", ["H:a.b", "S:c", "P:p", "x'y\\"]) == "content_include(f,'a.b.%,%.c,%p%,x''y\\\\')"
    first = L.first_match(row, [L.Rule("1", "n", "k", "app_name=='x'"), L.Rule("2", "n", "k", "app_name=='Hello'"), L.Rule("3", "n", "k", "app_name=='Hello'")]).first()
    assert first.rule_id == "2" and L.first_match(row, []).first().rule_id is None


def test_addresses(spark):
    rows = [("10.1.2.3", True), ("8.8.8.8", False), ("172.31.0.1", True), ("172.32.0.1", False), ("::1", True), ("2001:4860::1", False), ("fe80::1", True), ("x", False), ("", False), (None, False), ("300.1.1.1", False), ("224.0.0.1", True)]
    df = spark.createDataFrame(rows, "a string, want boolean")
    assert df.where(N.is_local("a", ipv6=True) != F.col("want")).count() == 0


def test_times_and_lists(spark):
    rows = [("1700000000",), ("1700000000123",), ("1700000000.5",), ("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",), ("2024/01/02 03:04:05",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.any_time("t")).collect()]
    assert got[0] == datetime(2023, 11, 14, 22, 13, 20) and got[1] == datetime(2023, 11, 14, 22, 13, 20, 123000) and got[2].microsecond == 500000
    assert got[3] == got[4] == got[5] == datetime(2024, 1, 2, 3, 4, 5) and got[6:] == [None, None]
    lists = spark.createDataFrame([('["a"," ",1]',), ("a;b,c\nd",), (None,), ("[broken",)], "l string").select(X.decoded_list("l")).collect()
    assert [r[0] for r in lists] == [["a", "1"], ["a", "b", "c", "d"], [], ["[broken"]]
    assert spark.createDataFrame([(10, "x")], "k int, v string").transform(lambda d: R.align(d, T.StructType([T.StructField("v", T.StringType()), T.StructField("n", T.LongType())]))).first().asDict() == {"v": "x", "n": None}


def test_top_share_puts_the_rest_last(spark):
    df = spark.createDataFrame([(x,) for x in ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + [" "] * 2 + [None] * 2 + ["d"]], "l string")
    got = [(r.rank, r.label, r.n) for r in R.top_share(df, "l", head=2).orderBy("rank").collect()]
    assert got == [(1, "a", 5), (2, "unknown", 4), (3, "other", 7)]


def test_daily_fills_gaps(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),)], "d date")
    assert [r.n for r in R.daily([(df, "d", "n", None)], "2024-01-01", "2024-01-04").orderBy("day").collect()] == [1, 0, 1, 0]


def test_strings_in_archives(spark, tmp_path):
    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.bin", b"\x00deep text\x01" + "wide".encode("utf-16-le"))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(inner, "lib/inner.zip")
        z.writestr("pic.png", b"hidden words")
        z.writestr("plain.dat", b"plain words\x00xy")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 broken archive")
    from quarrion.sources import readers

    files = readers.binaries(spark, str(tmp_path), "*.zip").where("path not like '%inner.zip'")
    got = {(r.path.rpartition("/")[2], r.entry.partition("!")[2], r.value) for r in E.binary_strings(files).collect()}
    assert ("a.zip", "plain.dat", "plain words") in got and ("a.zip", "lib/inner.zip!deep.bin", "deep text") in got and ("a.zip", "lib/inner.zip!deep.bin", "wide") in got
    assert ("broken.zip", "", " broken archive") in got or any("broken archive" in v for _, _, v in got)
    assert not any("hidden" in v for _, _, v in got)


def test_allow_list_variants(spark):
    df = spark.createDataFrame([("a.example.org",), ("example.org",), ("org",), ("x.net",), ("badexample.org",)], "host string")
    allowed = spark.createDataFrame([("Example.org",)], "domain string")
    assert {r.host for r in E.without_allowed(df, "host", allowed).collect()} == {"org", "x.net", "badexample.org"}
    last = spark.createDataFrame([("net",)], "domain string")
    assert "x.net" in {r.host for r in E.without_allowed(df, "host", last).collect()}
    assert "x.net" not in {r.host for r in E.without_allowed(df, "host", last, with_last=True).collect()}


def test_fingerprints_need_named_groups(spark):
    with pytest.raises(ValueError):
        E.Fingerprint("p", credentials=("x",)).groups()
    df = spark.createDataFrame([("app_id=12 com.sdk.A",), ("com.sdkother",)], "t string")
    known = [E.Fingerprint("sdk", ("com.sdk",), None, (r"app_id=(?P<app_id>\d+)",))]
    assert [r.t for r in E.products(df, ["t"], "t", known).collect()] == ["app_id=12 com.sdk.A"]
    assert [(r.name, r.value) for r in E.credentials(df, ["t"], "t", known).collect()] == [("app_id", "12")]


def test_emails(spark):
    texts = ["write to a.b@mail.example.org, or x@y", "a@b.com.", "(me+x@sub.host.co) %bad@x.org", "a@b@c.org", "x" * 33 + "@a.org", "ok@" + "d" * 30 + ".org", "_u@xn--a.xn--p1ai;", "a..b@c.org", "q@-a.org r@a-.org s@a-b.org"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(E.emails("t").alias("v")).collect()] == [["a.b@mail.example.org"], [], ["me+x@sub.host.co"], ["b@c.org"], [], [], ["_u@xn--a.xn--p1ai"], [], ["s@a-b.org"]]


def test_phones_stand_alone(spark):
    df = spark.createDataFrame([("13812345678 _13912345678 13712345678_ a13612345678 (13512345678) 138123456789",)], "t string")
    assert [r.value for r in E.found(df, [], "t", E.PHONE).collect()] == ["13812345678", "13512345678"]


def word_sets(spark, sf_dir, bare=False):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: set(re.findall(r"[^ \t\n\x0b\f\r]+", r.text)) for r in rows}
    return {i: s for i, x in sets.items() if (s := {y for w in x if (y := re.sub("[.,;:!?*#%&$]+$", "", w.lower()))} if bare else x)}


def brute_pairs(sets, least, strict=False):
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    return {p: j for p, j in pairs.items() if (j > least if strict else j >= least)}


def test_staged_families_of_all_documents(spark, sf_dir):
    want, placed = set(), set()
    for name in ("words", "bare"):
        sets = {n: s for n, s in word_sets(spark, sf_dir, name == "bare").items() if n not in placed}
        found = {}
        for n, top in brute_components(list(brute_pairs(sets, 0.8))).items():
            found.setdefault(top, set()).add(n)
        for top, nodes in found.items():
            if len(nodes) >= 3:
                want |= {(n, name, top, len(nodes)) for n in nodes}
                placed |= nodes
    got = catalog.QUERIES["g17_staged_families"](spark, sf_dir).collect()
    assert {(r.node, r.stage, r.family, r["size"]) for r in got} == want


@pytest.mark.parametrize("threshold", [0.1, 0.34, 0.5, 0.8, 0.9, 1.0])
def test_pairs_above_match_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    base = [set(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", weights=[30, 20, 10, *[1] * 33], k=rng.randint(1, 25))) for _ in range(60)]
    sets = dict(enumerate(base + [set(x) for x in base[:10]] + [x | {"new"} for x in base[10:30]] + [set(list(x)[1:]) or {"z"} for x in base[30:50]] + [{"a"}] * 5))
    members = spark.createDataFrame([(n, f) for n, s in sets.items() for f in s], "node long, feature string")
    for strict in (False, True):
        got = {(r.l, r.r): (r.shared, r.l_size, r.r_size, r.jaccard) for r in S.pairs_above(members, threshold, strict=strict).collect()}
        assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), j) for (a, b), j in brute_pairs(sets, threshold, strict).items()}


def test_filters_leave_few_candidates_of_frequent_features(spark, sf_dir):
    """Whole texts, whose commonest words stand in a quarter of all documents: hardly more candidates than pairs."""
    members = S.features(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0)))
    pairs = brute_pairs(word_sets(spark, sf_dir), 0.8)
    found = {(r.l, r.r) for r in S.candidates_above(members, 0.8).collect()}
    assert set(pairs) <= found and len(found) <= 2 * len(pairs) + 50
    assert {(r.l, r.r) for r in S.pairs_above(members, 0.8).collect()} == set(pairs)


def test_sets_that_meet_by_chance_are_dropped_in_the_join(spark, monkeypatch):
    """Sets of a small vocabulary meet at many items; bitmaps leave hardly more candidates than pairs, and lose none."""
    rng = random.Random(8)
    base = [set(rng.sample(range(40), 15) + rng.sample(range(1000, 1400), 25)) for _ in range(300)]
    sets = dict(enumerate(base + [set(sorted(x)[1:]) | {9999} for x in base[:40]] + [set()]))
    members = spark.createDataFrame([(n, str(f)) for n, s in sets.items() for f in s], "node long, feature string")
    candidates, real = [], S.checkpointed

    def counted(df, *args):
        out = real(df, *args)
        if "l_size" in df.columns:
            candidates.append(out.count())
        return out

    monkeypatch.setattr(S, "checkpointed", counted)
    want = brute_pairs(sets, 0.8)
    assert {(r.l, r.r) for r in S.pairs_above(members, 0.8).collect()} == set(want) and len(want) >= 40
    assert len(candidates) == 1 and candidates[0] <= 2 * len(want)


@pytest.mark.parametrize("least", [0.2, 0.55, 0.82, 1.0])
def test_cosines_match_brute_force(spark, least):
    rng = random.Random(int(least * 100))
    base = [set(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=[30, 20, *[1] * 24], k=rng.randint(1, 15))) for _ in range(60)]
    sets = dict(enumerate(base + [set(x) for x in base[:10]] + [x | {"new"} for x in base[10:30]]))
    members = spark.createDataFrame([(n, f) for n, s in sets.items() for f in s], "node long, feature string")
    df = {f: sum(f in s for s in sets.values()) for s in sets.values() for f in s}
    w2 = {f: (math.log((len(sets) + 1) / (d + 1)) + 1) ** 2 for f, d in df.items()}
    norm = {n: math.sqrt(sum(w2[f] for f in s)) for n, s in sets.items()}
    want = {(a, b): c for a in sets for b in sets if a < b and (c := sum(w2[f] for f in sets[a] & sets[b]) / (norm[a] * norm[b])) >= least - 1e-9}
    got = {(r.l, r.r): r.cosine for r in S.cosines_above(members, S.idf(members), least - 1e-9).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_cosines_rate_few_candidates(spark, monkeypatch):
    """Vectors that meet by chance are dropped in the join, copies are one class, and no pair is lost."""
    rng = random.Random(5)
    base = [set(rng.sample(range(40), 15) + rng.sample(range(1000, 1400), 25)) for _ in range(200)]
    sets = dict(enumerate(base + [set(sorted(x)[1:]) | {9999} for x in base[:30]] + base[:30]))
    members = spark.createDataFrame([(n, str(f)) for n, s in sets.items() for f in s], "node long, feature string")
    candidates, real = [], S.checkpointed

    def counted(df, *args):
        out = real(df, *args)
        if "l_norm2" in df.columns:
            candidates.append(out.count())
        return out

    monkeypatch.setattr(S, "checkpointed", counted)
    df = {f: sum(f in s for s in sets.values()) for s in sets.values() for f in s}
    w2 = {f: (math.log((len(sets) + 1) / (d + 1)) + 1) ** 2 for f, d in df.items()}
    norm = {n: math.sqrt(sum(w2[f] for f in s)) for n, s in sets.items()}
    want = {(a, b): c for a in sets for b in sets if a < b and (c := sum(w2[f] for f in sets[a] & sets[b]) / (norm[a] * norm[b])) >= 0.75}
    got = {(r.l, r.r): (r.shared, r.cosine) for r in S.cosines_above(members, S.idf(members), 0.75).collect()}
    assert got.keys() == want.keys() and all(got[p][0] == len(sets[p[0]] & sets[p[1]]) and abs(got[p][1] - want[p]) < 1e-9 for p in want)
    assert len(candidates) == 1 and 30 <= candidates[0] <= 90


def dense_linkage(n, edges, cut):
    """Complete linkage on all pairs of clusters."""
    d = {(i, j): 1.0 for i in range(n) for j in range(i + 1, n)} | {(i, j): x for x, i, j in edges}
    clusters = {i: {i} for i in range(n)}
    while True:
        far = {(a, b): max(d[min(i, j), max(i, j)] for i in clusters[a] for j in clusters[b]) for a in clusters for b in clusters if a < b}
        best = min(((x, p) for p, x in far.items()), default=(2, None))
        if best[0] > cut:
            return [min(c for c in clusters if i in clusters[c]) for i in range(n)]
        a, b = best[1]
        clusters[a] |= clusters.pop(b)


def test_linkage_by_edges_is_that_of_all_pairs():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 12)
        edges = [(rng.choice([0.0, 0.1, 0.1, 0.15, 0.2, 0.3]), i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        assert S._linkage(n, edges, 0.2) == dense_linkage(n, edges, 0.2)


def test_gram_hashes(spark):
    import hashlib

    lists = [["add", " Sub", "", "mul", "ret", "add", "sub", "mul", "ret"], ["a", "b", "c"], None, []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, t array<string>")
    got = {r.i: r.h for r in df.select("i", E.gram_hashes(F.col("t")).alias("h")).collect()}
    one = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
    tokens = ["ADD", "SUB", "MUL", "RET", "ADD", "SUB", "MUL", "RET"]
    want = set()
    for i in range(len(tokens) - 3):
        v = 0xCBF29CE484222325
        for t in tokens[i : i + 4]:
            v = (v * 0x9E3779B185EBCA87 ^ one(t)) % 2**64
        want.add(v - 2**64 if v >= 2**63 else v)
    assert got == {0: sorted(want), 1: [], 2: None, 3: []}
    assert len(want) == 4


def test_copies_are_compared_as_one_class(spark):
    """Many copies and their near copies: pairs are made of classes, and all nodes' pairs, families and clusters follow from them."""
    from pyspark.sql import functions as F

    from quarrion.operators import similarity as S

    words = [f"w{i}" for i in range(60)]
    texts = {k: words for k in range(1, 41)} | {k: words[1:] for k in (41, 42)} | {50: ["other"], 51: [], 52: [], 53: ["lone", "pair"]}
    rows = spark.createDataFrame([(k, w) for k, w in texts.items()] + [(53, ["pair", "lone", "third"]), (54, ["third", "lone", "pair"])], "k long, w array<string>")
    sets = S.feature_sets(rows, "k", F.col("w"))
    assert [(r.shared, r.l_size + r.r_size) for r in S.class_pairs_above(sets, 0.8, strict=True).collect()] == [(59, 119)]
    every = {k: frozenset(w) for k, w in texts.items() if w} | {53: frozenset(("pair", "lone", "third")), 54: frozenset(("pair", "lone", "third"))}
    want = {(a, b, len(x & y), len(x), len(y)) for a, x in every.items() for b, y in every.items() if a < b and len(x & y) > 0.8 * len(x | y)}
    got = S.set_pairs_above(sets, 0.8, strict=True).collect()
    assert len(got) == len(want) and {(r.l, r.r, r.shared, r.l_size, r.r_size) for r in got} == want
    found = {(r.node, r.family, r.size) for r in S.set_families(sets, 0.8, strict=True).collect()}
    assert found == {(k, 1, 42) for k in range(1, 43)} | {(53, 53, 2), (54, 53, 2)}


def test_copies_cluster_like_nodes_of_their_own(spark):
    """Complete linkage over classes with their numbers of copies gives the medoids of all nodes."""
    from quarrion.operators import similarity as S

    near = {(1, 2): 0.95, (1, 3): 0.9, (2, 3): 0.85, (3, 4): 0.81}
    copies = {1: 1, 2: 3, 3: 2, 4: 1, 5: 2}
    classes = spark.createDataFrame([(*p, s) for p, s in near.items()] + [(5, 5, 1.0)], "l long, r long, jaccard double")
    own = spark.createDataFrame([(k, 5 if k == 5 else 1, n) for k, n in copies.items()], "node long, family long, copies long")
    name = {k: [k, *(100 * k + i for i in range(1, n))] for k, n in copies.items()}
    links = [(*sorted((a, b)), s) for (x, y), s in near.items() for a in name[x] for b in name[y]] + [(a, b, 1.0) for x in copies for a in name[x] for b in name[x] if a < b]
    nodes = [(a, 5 if k == 5 else 1) for k in copies for a in name[k]]
    plain = S.linkage_clusters(spark.createDataFrame(links, "l long, r long, jaccard double"), spark.createDataFrame(nodes, "node long, family long"), 0.2)
    rows = lambda c: sorted((r.cluster, r["size"], r.medoid) for r in S.medoids(c, 2).collect())
    assert rows(S.linkage_clusters(classes, own, 0.2)) == rows(plain) != []


def test_short_sets_meet_without_a_shuffle_of_pairs(spark):
    members = spark.createDataFrame([(n, f"f{(n * k) % 17}") for n in range(1, 40) for k in range(1, 5)], "node long, feature string").distinct()
    key = lambda df: {(r.l, r.r, r.shared): round(r.cosine, 9) for r in df.collect()}
    assert key(S.short_cosines_above(members, S.idf(members), 0.35)) == key(S.cosines_above(members, S.idf(members), 0.35))
    for out in (S.short_cosines_above(members, S.idf(members), 0.35), S.pair_overlaps(members, 24)):
        assert out.count() > 50
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l#" not in plan and "HashAggregate(keys=[l#" not in plan


@pytest.mark.parametrize("threshold", [0.1, 0.34, 0.5, 0.8, 1.0])
def test_pairs_of_short_sets_match_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    base = [set(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=[20, 10, *[1] * 24], k=rng.randint(1, 7))) for _ in range(60)]
    sets = dict(enumerate(base + base[:10] + [x | {"new"} for x in base[10:30]] + [{"a"}] * 5))
    members = spark.createDataFrame([(n, f) for n, s in sets.items() for f in s] + [(None, "a"), (99, None)], "node long, feature string")
    for strict in (False, True):
        rows = S.short_pairs_above(members, threshold, strict).collect()
        want = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), j) for (a, b), j in brute_pairs(sets, threshold, strict).items()}
        assert len(rows) == len(want) and {(r.l, r.r): (r.shared, r.l_size, r.r_size, r.jaccard) for r in rows} == want


@pytest.mark.parametrize("name", ["j14_size_pruned_pairs", "f34_thresholded_pairs"])
def test_pairs_of_orders_are_counted_where_they_meet(spark, sf_dir, name):
    out = catalog.QUERIES[name](spark, sf_dir)
    assert out.count() > 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "hashpartitioning(l#" not in plan and "HashAggregate(keys=[l#" not in plan


def test_words_of_whole_texts_are_split_once_and_as_by_sql(spark, tmp_path):
    """Signs within words, white space of all kinds, empty texts and none; the split stands once in the plan."""
    import duckdb

    texts = [None, "", " \t\n", "the de of", "the\x0bx of", "the\x01de the,de", " the\f\t\n\rof ", "the\u00a0x", "a,b a\x01b the the", "of de the of a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = catalog.QUERIES["f32_jaccard"](spark, str(tmp_path))
    assert dict(map(tuple, out.collect())) == dict(duck.execute(catalog.ORACLES["f32_jaccard"]).fetchall())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_python_holds_few_rows_at_a_time(monkeypatch):
    """Archives are taken out of an Arrow batch piece by piece."""
    import pyarrow as pa

    from quarrion.operators import archives as A

    monkeypatch.setattr(E, "ROWS_AT_ONCE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(35)]), pa.array([b"x"] * 35, pa.binary())], names=["path", "content"])
    assert len(list(A._listed(iter([batch]), A._Held))) == 4
    assert [len(x) for x in E.pieces_of(batch)] == [10, 10, 10, 5]


def test_gram_hashes_over_pieces_are_those_of_one(spark, monkeypatch):
    df = spark.createDataFrame([(i, [f" w{(i * k) % 7} " if k % 3 else None for k in range(i % 9)] if i % 5 else None) for i in range(230)], "i int, t array<string>").coalesce(1)
    found = lambda: [(r.i, r.h) for r in df.select("i", E.gram_hashes(F.col("t")).alias("h")).collect()]
    pieces = found()
    monkeypatch.setattr(E, "ROWS_AT_ONCE", 1000)
    assert pieces == found() and len(pieces) == 230 and sum(bool(h) for _, h in pieces) > 50


def test_versions_are_compared_once(spark):
    """Rows of one version meet the known ones as one."""
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", [i % 3]) for i in range(60)] + [(99, "c", [1]), (98, "a", None)], "k int, g string, v array<int>")
    known = spark.createDataFrame([("a", [0]), ("a", [2]), ("b", [5]), ("a", [2])], "g string, v array<int>")
    out = R.nearest_version(rows, known, ["g"], "v")
    got = {r.k: r.found_version[0] for r in out.collect()}
    assert got == {i: ({0: 0, 1: 2, 2: 2}[i % 3] if i % 2 else 5) for i in range(60)} | {98: got[98]}
    assert "HashAggregate(keys=[g" in out._jdf.queryExecution().executedPlan().toString() or "SortAggregate(key=[g" in out._jdf.queryExecution().executedPlan().toString()
