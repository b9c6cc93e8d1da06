import random
from datetime import datetime, timedelta

from quarrion.llm import urllists


def brute(captures, entries):
    best = {}
    for d, listed, ts in entries:
        if None not in (d, listed, ts):
            key = (d.lower(), ts)
            best[key] = best.get(key, False) or listed
    dated = {}
    for (d, ts), listed in sorted(best.items()):
        dated.setdefault(d, []).append((ts, listed))
    out = []
    for i, host, t in captures:
        hit = None
        labels = host.split(".") if host else []
        for k in range(len(labels)):
            seen = [e for e in dated.get(".".join(labels[k:]), []) if t is not None and e[0] <= t]
            if seen and seen[-1][1]:
                hit = ".".join(labels[k:])
                break
        out.append((i, hit))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    domains = ["a.example.org", "b.example.org", "example.org", "org", "x.net"]
    entries = [(rng.choice(domains).upper() if rng.random() < 0.1 else rng.choice(domains), rng.random() < 0.4, start + timedelta(minutes=30 * rng.randint(0, 60))) for _ in range(60)]
    entries += [(None, True, start), ("x.net", None, start), ("x.net", True, None), entries[0]]
    captures = [(i, rng.choice(["a.example.org", "b.example.org", "c.b.example.org", "x.net", "y.com"]), start + timedelta(minutes=15 * rng.randint(-4, 140))) for i in range(200)]
    captures += [(300, "x.net", None), captures[0]]
    rows = [(i, f"http://u:p@{h.upper()}:80/p?q", t, 1) for i, h, t in captures] + [(400, None, start, 1), (401, "no url", start, 1)]
    df = spark.createDataFrame(rows, "capture long, url string, fetched_at timestamp, host int").repartition(3)
    lists = spark.createDataFrame(entries, "domain string, listed boolean, ts timestamp")
    for bucket in (600, 3600, 10**7):
        out = urllists.evaluate(df, lists, bucket=bucket).collect()
        got = sorted(((r.capture, r.matched) for r in out), key=str)
        assert got == sorted(brute(captures, entries) + [(400, None), (401, None)], key=str)
        assert all(r.blocked == (r.matched is not None) for r in out)
        assert all(r.since <= r.fetched_at and (r.until is None or r.fetched_at < r.until) for r in out if r.blocked)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://h/", datetime(2024, 1, 1))], "capture long, url string, fetched_at timestamp")
    none = spark.createDataFrame([], "domain string, listed boolean, ts timestamp")
    assert [r.blocked for r in urllists.evaluate(captures, none).collect()] == [False]
    assert urllists.evaluate(captures.limit(0), none).collect() == []


def test_columns_of_any_name_stay(spark):
    start = datetime(2024, 1, 1)
    captures = spark.createDataFrame([("http://a.org/x", start, 1, 2, 3, 4)], "url string, fetched_at timestamp, _host int, _t int, domain int, bucket int")
    lists = spark.createDataFrame([("a.org", True, start)], "domain string, listed boolean, ts timestamp")
    (row,) = urllists.evaluate(captures, lists).collect()
    assert (row._host, row._t, row.domain, row.bucket, row.host, row.blocked, row.matched) == (1, 2, 3, 4, "a.org", True, "a.org")
