"""Families of applications: known answers and brute-force versions of the link rules, groups and merges."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrion.operators import families as P
from quarrion.operators import libraries as B

APPS = "node long, package string, components string"


def names_frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def test_component_tests(spark):
    df = names_frame(spark, "a.b.Main", "a.b.main", "a.permission.Main", "Main", "a.b.Main$Inner", "a.b.inner$Main", "a.FULL", "a.b.MyPermissionAct", "1a.B", "android.hardware.camera", "a.b.c", "a.é.C")
    got = {r.c: (r.x, r.y) for r in df.select("c", P.is_code_component(F.col("c")).alias("x"), P.is_component_candidate(F.col("c")).alias("y")).collect()}
    assert got == {
        "a.b.Main": (True, True), "a.b.main": (False, True), "a.permission.Main": (False, False), "Main": (False, False), "a.b.Main$Inner": (True, True), "a.b.inner$Main": (False, True),
        "a.FULL": (True, False), "a.b.MyPermissionAct": (True, False), "1a.B": (True, False), "android.hardware.camera": (False, False), "a.b.c": (False, True), "a.é.C": (True, False),
    }


def test_features_of_both_rules(spark):
    apps = spark.createDataFrame([(1, "com.own.app", "'.ui.Login$1' androidx.core.View com.own.app.ui.Login,com.x9ab3z7.mod.Sub.Deep;\"com.own\" a.PERM")], APPS)
    assert sorted(r.feature for r in P.second_features(apps).collect()) == sorted([
        "F:com.own.app.ui.Login$1", "F:androidx.core.View", "F:com.own.app.ui.Login", "F:com.x9ab3z7.mod.Sub.Deep", "F:com.own", "H:com.own.app", "H:com.*.mod", "H:com",
        "S:ui.Login$1", "S:ui.Login", "S:Sub.Deep", "S:com.own", "L:Login$1", "L:Login", "L:Deep", "L:own",
    ])
    assert sorted(r.feature for r in P.first_features(apps).collect()) == ["H:com.*.mod", "H:com.own.app", "S:Sub.Deep", "S:ui.Login"]


def corpus(seed, n=60):
    """Applications of a few families, with names in common and names of their own."""
    rng = random.Random(seed)
    pools = [[f"org.fam{k}.{rng.choice(['core', 'ui', 'net'])}.{rng.choice(['Log', 'Pay', 'Map', 'Chat'])}{rng.randrange(6)}" for _ in range(14)] for k in range(5)]
    bare = [f"org.{a}.pack.{x}" for a in ("left", "right") for x in ("Alpha", "Beta", "Gamma", "Delta", "Omega", "Kappa")]
    rows = []
    for i in range(n):
        own = [f"net.solo{i}.a.One{i}", "androidx.core.View", "com.tencent.Thing"]
        pool = pools[i % 7] if i % 7 < 5 else bare[:6] if i % 7 == 5 else bare[6:]
        rows.append((i, f"app.n{i}", " ".join(rng.sample(pool, rng.randint(2, len(pool))) + own)))
    return rows


def feature_sets(spark, rows):
    apps = spark.createDataFrame(rows, APPS).repartition(3)
    features = P.second_features(apps)
    members = P.bounded(features, len(rows))
    sets, every = {i: set() for i, *_ in rows}, {i: set() for i, *_ in rows}
    for r in members.collect():
        sets[r.node].add(r.feature)
    for r in features.collect():
        every[r.node].add(r.feature)
    df = Counter(f for s in every.values() for f in s)
    return apps, members, sets, every, df


def linked(a, b, df, n):
    w = lambda s: sum(math.log(n / df[f]) ** 2 for f in s)
    common = a & b
    if not common:
        return False
    cosine = w(common) / math.sqrt(w(a) * w(b)) if w(a) * w(b) else 0
    anchors = sum(f[0] == "H" and df[f] <= 0.06 * n for f in common)
    spaces = Counter(f[2:].split(".")[0] for f in common if f[0] == "S")
    fork = sum(spaces.values()) >= 10 and max(spaces.values()) >= 10 and max(spaces.values()) >= 0.6 * sum(spaces.values())
    return (anchors >= 2 and cosine >= 0.35) or (anchors >= 1 and cosine >= 0.55) or (len(common) >= 3 and cosine >= 0.75) or fork


@pytest.mark.parametrize("seed", [1, 2])
def test_second_links_match_all_pairs(spark, seed):
    rows = corpus(seed)
    _, members, sets, _, df = feature_sets(spark, rows)
    bounded = {f for s in sets.values() for f in s}
    assert bounded == {f for f, c in df.items() if f[0] != "F" and c >= 5 and c <= (0.2 if f[0] == "H" else 0.8) * len(rows)}
    got = sorted((r.l, r.r) for r in P.second_links(members, len(rows)).collect())
    assert got == sorted((i, j) for i in sets for j in sets if i < j and linked(sets[i], sets[j], df, len(rows)))
    assert got


def test_first_links_match_all_pairs(spark):
    rows = corpus(4)
    apps = spark.createDataFrame(rows, APPS)
    members = P.bounded(P.first_features(apps), len(rows), second=False)
    sets = {i: set() for i, *_ in rows}
    df = {}
    for r in members.collect():
        sets[r.node].add(r.feature)
        df[r.feature] = r.df
    n = len(rows)
    extra = {i: ("chat" if i % 3 else None, {f"lib{i % 4}.so", "libx.so"} if i % 5 else set()) for i in sets}
    nodes = spark.createDataFrame([(i, s, sorted(x)) for i, (s, x) in extra.items()], "node long, stem string, libraries array<string>")
    w = lambda s: sum((math.log((n + 1) / (df[f] + 1)) + 1) ** 2 for f in s)
    want = []
    for i in sets:
        for j in sets:
            common = sets[i] & sets[j]
            if i < j and any(df[f] <= max(2, int(0.12 * n)) for f in common):
                cosine = w(common) / math.sqrt(w(sets[i]) * w(sets[j]))
                head = any(f[0] == "H" and df[f] <= max(2, int(0.06 * n)) for f in common)
                (s, x), (t, y) = extra[i], extra[j]
                like = len(x & y) / len(x | y) if x and y else 0
                if (head and (like >= 0.5 or (s and s == t) or (not x and not y and cosine >= 0.8))) or (cosine >= 0.5 and like >= 0.3):
                    want.append((i, j))
    assert sorted((r.l, r.r) for r in P.first_links(members, n, nodes).collect()) == sorted(want)
    assert want


def test_staged_links_match_all_pairs(spark):
    rng = random.Random(3)
    pages = [f"pages/p{i}" for i in range(40)]
    sets = {i: set(rng.sample(pages[8 * (i % 4) : 8 * (i % 4) + 12], rng.randint(3, 12))) for i in range(50)}
    frame = spark.createDataFrame([(i, f) for i, s in sets.items() for f in s], "node long, feature string")
    fit = {i: s for i, s in sets.items() if len(s) >= 5}
    df = Counter(f for s in fit.values() for f in s)
    w = lambda s: sum((math.log((len(fit) + 1) / (df[f] + 1)) + 1) ** 2 for f in s)
    want = []
    for i, a in fit.items():
        for j, b in fit.items():
            if i < j and len(a & b) >= 5:
                if a == b or w(a & b) / math.sqrt(w(a) * w(b)) >= 0.82 or (len(a & b) / len(a | b) >= 0.55 and len(a & b) / min(len(a), len(b)) >= 0.7):
                    want.append((i, j))
    assert sorted((r.l, r.r) for r in P.staged_links(frame).collect()) == want
    assert want


def test_strict_groups(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (8, 9)], "l long, r long")
    features = {1: "ab", 2: "abz", 3: "bc", 4: "cd", 5: "cd", 7: "kq", 8: "kr", 9: "ks"}
    members = spark.createDataFrame([(n, f) for n, s in features.items() for f in s], "node long, feature string")
    got = sorted(map(tuple, P.strict_groups(links, members).collect()), key=str)
    assert got == sorted([(1, 1, "b"), (1, 2, "b"), (1, 3, "b"), (4, 4, "c"), (4, 5, "c"), (7, 7, None), (7, 8, None), (7, 9, None)], key=str)
    coherent = sorted((r.family, r.node) for r in P.strict_groups(links, members, coherent=True).collect())
    assert coherent == [(1, 1), (1, 2), (4, 4), (4, 5), (7, 7), (7, 8), (7, 9)]


def test_families_merge_while_their_cores_share(spark):
    core = {1: "H:a H:x", 2: "H:a L:q", 3: "L:1 L:2 L:3 L:4 L:5 S:z", 4: "L:1 L:2 L:3 L:4 L:5 H:w", 5: "H:b.*", 6: "H:b.*", 7: "L:1 L:2 L:3 L:4"}
    members = spark.createDataFrame([(10 * f + k, x) for f, s in core.items() for k in range(2) for x in s.split()], "node long, feature string")
    groups = spark.createDataFrame([(f, 10 * f + k) for f in core for k in range(2)], "family long, node long")
    got = {r.family: r.into for r in P.merged_groups(groups, members).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    assert sorted({r.family for r in P.after_merge(groups, P.merged_groups(groups, members)).collect()}) == [1, 3, 5, 6, 7]


def test_fingerprints(spark):
    features = {1: "H:a.*.c F:a.b.c.Main S:c.Main L:Main H:z.y", 2: "H:a.*.c F:a.b.c.Main S:c.Main L:Main H:z.y F:only"}
    rows = spark.createDataFrame([(n, x) for n, s in features.items() for x in s.split()], "node long, feature string")
    groups = spark.createDataFrame([(1, 1), (1, 2)], "family long, node long")
    assert P.ordered_fingerprints(groups, rows).first().fingerprint == ["H:z.y", "F:a.b.c.Main"]
    cases = {"H:a": True, "F:com.tencent.X": False, "F:own.X": True, "S:a.MainActivity L:Other": False, "S:a.B L:Other": True, "L:MainActivity S:x.MainActivity": False}
    got = spark.createDataFrame([(k, k.split()) for k in cases], "k string, f array<string>").select("k", P.is_sufficient(F.col("f")).alias("ok")).collect()
    assert {r.k: r.ok for r in got} == cases


def test_one_family_among_strangers(spark):
    common = "org.family.core.worker org.family.core.receiver org.family.core.service"
    rows = [(i, "", f"{common} org.family.unique{i}.entry" if i < 5 else f"org.unrelated{i}.only.worker") for i in range(100)]
    found = P.component_families(spark.createDataFrame(rows, APPS))
    assert sorted((r.family, r.node, r.stage) for r in found.members.collect()) == [(0, i, "components") for i in range(5)]
    marks = found.fingerprints.first()
    assert marks.family == 0 and "F:org.family.core.worker" in marks.fingerprint
    assert found.counts["families"] == 1 and found.counts["apps"] == 100 and found.counts["assigned_apps"] == 5 and found.counts["isolated_apps"] == 95


def test_weak_families_are_divided_again(spark):
    bridge = " ".join(f"com.tencent.n{k}.X{k}" for k in range(2))
    rows = [(i, "", f"{bridge} " + " ".join(f"org.{'left' if i < 6 else 'right'}.p{k}.{'A' if i < 6 else 'B'}{k}" for k in range(6))) for i in range(12)] + [(i, "", f"net.solo{i}.x.Y{i}") for i in range(12, 60)]
    found = P.component_families(spark.createDataFrame(rows, APPS))
    families = {}
    for r in found.members.collect():
        families.setdefault(r.family, set()).add(r.node)
    assert sorted(map(sorted, families.values())) == [list(range(6)), list(range(6, 12))]
    every = {r.node: set() for r in found.members.collect()}
    for r in P.second_features(spark.createDataFrame(rows, APPS)).collect():
        if r.node in every:
            every[r.node].add(r.feature)
    for r in found.fingerprints.collect():
        assert all(set(r.fingerprint) <= every[n] for n in families[r.family])


def merged_by_rating_all_pairs(cores, sizes):
    """Families merged by rating all pairs again after every merge."""
    held = [[{i}, n, set(c)] for i, (c, n) in enumerate(zip(cores, sizes, strict=True))]
    kind = lambda s, k: {f for f in s if f[:2] in k}

    def rate(x, y):
        both = x[2] & y[2]
        roots = [f for f in kind(both, ("H:",)) if "*" not in f]
        if roots:
            return 2, 1.0, len(roots), x[1] + y[1]
        code = kind(both, ("S:", "L:"))
        part = len(code) / (min(len(kind(z[2], ("S:", "L:"))) for z in (x, y)) or 1)
        return (1, part, len(code), x[1] + y[1]) if len(kind(both, ("L:",))) >= 5 and (part >= 0.5 or len(code) >= 10) else None

    while True:
        rated = [(r, -i, -j) for i, x in enumerate(held) for j, y in enumerate(held) if i < j and (r := rate(x, y))]
        if not rated:
            return {m: min(x[0]) for x in held for m in x[0]}
        _, i, j = max(rated)
        y = held.pop(-j)
        x = held[-i]
        held[-i] = [x[0] | y[0], x[1] + y[1], x[2] & y[2]]


def test_merging_by_a_heap_is_that_of_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        pool = [f"{k}:{'*' if rng.random() < 0.2 else ''}{i}" for k, n in (("H", 4), ("S", 8), ("L", 12), ("F", 3)) for i in range(n)]
        cores = [set(rng.sample(pool, rng.randint(0, 20))) for _ in range(rng.randint(1, 12))]
        sizes = [rng.randint(2, 6) for _ in cores]
        into = P._Merging([set(c) for c in cores], list(sizes)).run()
        assert dict(enumerate(into)) == merged_by_rating_all_pairs(cores, sizes)


def test_library_features_and_classes(spark):
    rows = [
        (1, "me", "package:me/a.dart"), (1, "me", " package:me/a.dart "), (1, "me", "package:dio/x.dart"), (2, "dio", "package:dio/x.dart"), (1, "me", "dart:io"), (1, "me", "package:flutter/a"), (1, "me", "package:map_web/a"),
        (1, "me", "file:///x/.pub-cache/a"), (1, "me", "file:///x/lib/a"), (1, None, "package:rare/a"), (3, "x", ""), (3, "x", None),
    ]
    rows += [(i, "p", "package:often/a") for i in range(10, 19)] + [(30, "often", "package:often/a")]
    got = sorted((r.node, r.feature) for r in B.library_features(spark.createDataFrame(rows, "node long, package string, uri string")).collect())
    assert got == [(1, "file:///x/lib/a"), (1, "package:me/a.dart"), (1, "package:rare/a"), (2, "package:dio/x.dart"), (30, "package:often/a")]
    names = {"OrderPage": True, "MyApp": False, "_Order": False, "$Order": False, "Abc": False, "Abcd<T>": True, "Ab<Long>": False, "": False}
    assert {r.c: r.t for r in names_frame(spark, *names).select("c", B.is_telling_class(F.col("c")).alias("t")).collect()} == names


def test_weighted_links_match_all_pairs(spark):
    rng = random.Random(12)
    base = [set(rng.choices([f"f{i}" for i in range(40)], weights=[8, 8, *[1] * 38], k=rng.randint(6, 30))) for _ in range(40)]
    sets = dict(enumerate(base + [s | {"new"} for s in base] + [set(list(s)[2:]) for s in base]))
    members = spark.createDataFrame([(n, f) for n, s in sets.items() for f in s], "node long, feature string")
    fit = {n: s for n, s in sets.items() if len(s) >= 8}
    df = Counter(f for s in fit.values() for f in s)
    w = {f: math.log((len(fit) + 1) / (d + 1)) + 1 for f, d in df.items()}
    weigh = lambda s: sum(w[f] for f in s)
    want = {(a, b) for a in fit for b in fit if a < b and len(fit[a] & fit[b]) >= 8 and weigh(fit[a] & fit[b]) >= 0.58 * weigh(fit[a] | fit[b]) - 1e-12 and weigh(fit[a] & fit[b]) >= 0.68 * min(weigh(fit[a]), weigh(fit[b])) - 1e-12}
    assert {(r.l, r.r) for r in B.weighted_links(members).collect()} == want and len(want) > 20


def test_families_by_libraries_then_by_classes(spark):
    uris = [(n, "p", f"package:a{n // 3}/x{i}.dart") for n in range(6) for i in range(9)] + [(n, "p", "package:dio/x.dart") for n in range(6, 9)]
    classes = [(n, f"Order{i}") for n in (0, 6, 7) for i in range(8)] + [(8, "Order1")]
    found, marks = B.library_families(spark.createDataFrame(uris, "node long, package string, uri string"), spark.createDataFrame(classes, "node long, class string"))
    assert {(r.family, r.node, r.stage) for r in found.collect()} == {(n // 3 * 3, n, "libraries") for n in range(6)} | {(6, 6, "classes"), (6, 7, "classes")}
    assert {(r.family, tuple(r.fingerprint)) for r in marks.collect()} == {(g * 3, tuple(f"package:a{g}/x{i}.dart" for i in range(9))) for g in (0, 1)} | {(6, tuple(f"Order{i}" for i in range(8)))}


def test_nodes_of_equal_features_are_linked_as_one(spark):
    """Candidates are made of classes: forty equal nodes bring one, and their links to each other and to others are whole."""
    from quarrion.operators import families as P

    sets = {k: "abcdefgh" for k in range(40)} | {k: "abcdefgx" for k in range(40, 43)} | {50: "mnopq", 51: "rstuv", 52: "ab", 53: "ab"}
    members = spark.createDataFrame([(k, f) for k, s in sets.items() for f in s], "node long, feature string")
    reduced, owner, alike = P.by_classes(members)
    assert {r.node for r in reduced.collect()} == {0, 40, 50, 51, 52} and owner.count() == len(sets)
    assert {tuple(r) for r in alike.collect()} == {(0, 0), (40, 40), (52, 52)}
    got = [(r.l, r.r, r.shared) for r in P.staged_links(members).collect()]
    want = {(a, b, len(set(x) & set(y))) for a, x in sets.items() for b, y in sets.items() if a < b < 43}
    assert len(got) == len(want) and set(got) == want


def test_few_links_hold_the_two_core_together(spark):
    """The nodes and components of the whole two-core, by classes whose nodes are linked with each other and by others."""
    from quarrion.operators import families as P
    from quarrion.operators import graph as G

    copies = {1: 4, 2: 2, 3: 2, 4: 1, 5: 3, 6: 2, 7: 1, 8: 1}
    owner = spark.createDataFrame([(10 * c + i, 10 * c) for c, m in copies.items() for i in range(m)], "node long, cls long")
    links = spark.createDataFrame([(10 * a, 10 * b) for a, b in ((1, 1), (2, 3), (3, 4), (5, 5), (6, 6), (7, 8), (4, 7))], "l long, r long")
    whole = G.k_core(P.of_classes(links, owner), 2, "l", "r")
    few = P.core_links(links, owner)
    parts = lambda df, a, b: sorted(tuple(r) for r in G.components(df, a, b).collect())
    assert parts(few, "l", "r") == parts(whole, "a", "b") != []
    assert few.count() < whole.count()


def plans_of(monkeypatch, *modules):
    """The plans of all checkpoints that these modules make from now on, as they ran."""
    from quarrion.storage import checkpointed

    plans = []

    def noted(df, eager=True):
        out = checkpointed(df, eager)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    for m in modules:
        monkeypatch.setattr(m, "checkpointed", noted)
    return plans


def test_dividing_again_keeps_tables_out_of_the_driver(spark, monkeypatch):
    """No side of a join that grows with the applications is broadcast."""
    from quarrion.operators import graph as G

    plans = plans_of(monkeypatch, P, G)
    features = spark.createDataFrame([(i, f) for i in range(24) for f in [f"L:B{k}" for k in range(6)] + [f"S:p{i % 2}.N{k}" for k in range(12)]], "node long, feature string")
    members = P.bounded(features, 40)
    weak = spark.range(24).select(F.lit(0).cast("long").alias("family"), F.col("id").alias("node"))
    out = P.divided_again(weak, members, 40)
    assert {(r.weak, r.family, r.node) for r in out.collect()} == {(0, i % 2, i) for i in range(24)}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)


def test_libraries_keep_tables_out_of_the_driver(spark, monkeypatch):
    plans = plans_of(monkeypatch, B)
    uris = spark.createDataFrame([(i, "p", f"package:a{i // 4}/x{k}.dart") for i in range(24) for k in range(9)], "node long, package string, uri string")
    features = B.library_features(uris)
    links = B.weighted_links(features)
    assert features.count() == 24 * 9 and links.count() == 6 * 6
    links.collect(), features.collect()
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (links, features)]
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)


def test_dividing_again_makes_no_pairs_of_copies(spark, monkeypatch):
    """What is held grows with the nodes, not with their pairs; nodes of two weak families with the same features stay apart."""
    from quarrion.operators import graph as G
    from quarrion.storage import checkpointed

    rows = []

    def noted(df, eager=True):
        out = checkpointed(df, eager)
        rows.append(out.count())
        return out

    for m in (P, G):
        monkeypatch.setattr(m, "checkpointed", noted)
    members = spark.createDataFrame([(i, f, 50, 1.0) for i in range(120) for f in [f"L:Weak{i // 60}"] + [f"S:p{i % 2}.N{k}" for k in range(10)]], "node long, feature string, df long, weight double")
    weak = spark.range(120).select((F.col("id") >= 60).cast("long").alias("family"), F.col("id").alias("node"))
    got = {(r.weak, r.family, r.node) for r in P.divided_again(weak, members, 2000).collect()}
    assert got == {(i // 60, i // 60 * 60 + i % 2, i) for i in range(120)}
    assert max(rows) <= members.count()
