import os
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrion.llm import maintext as M


def text(page, template=None):
    return M.main_text(M.lines(page), template)


def test_article_without_what_surrounds_it():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="ad"><header>site</header><nav><ul><li>menu</ul></nav>
    <div class="cookie-notice">notice</div><aside>side</aside><main><article><header><h1>Head &amp;amp; line</h1></header><!-- <p>no</p> --><p>One <b>two</b>\n three&nbsp;four<p>five<br>six
    <div class="ad-slot"><p>buy</p></div><script>if (a < b) document.write("<p>no</p>")</script><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p>a &lt; b &#233;
    <section id="comments"><article class="comment"><p>reader</p></article></section></article></main><form>form</form><footer>foot</footer>"""
    assert text(page) == "Head &amp; line\nOne two three four\nfive six\na\nb\nc\nd\na < b é"
    assert text("") == "" and text("<p>") == "" and text("plain words") == "plain words"
    assert text("<p>cut off <b") == "cut off <b"
    assert text("<p hidden>x</p><p style='display:none'>y</p><p>z</p>") == "z"
    assert text("<div role=main><p>x</div><p>y") == "x"
    assert text("<script>var a = '<p>never closed'") == ""


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_longest_common_subsequence(a, b):
    x, y = M.shared(a, b)
    assert [a[i] for i in x] == [b[j] for j in y] and len(x) == brute_lcs(a, b)
    assert x == sorted(set(x)) and y == sorted(set(y))


def test_unmarked_pages_lose_the_lines_of_their_neighbour(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(40):
        host, body = f"h{i % 3}.example.org", [f"line {rng.random()}" for _ in range(rng.randint(1, 5))]
        html = "<p>top</p><p>menu one</p>" + "".join(f"<div>{x}</div>" for x in body) + "<p>bottom</p>"
        rows.append((i, f"http://{host}/a/{i:03d}", html, "r"))
        want[i] = "\n".join(body)
    rows += [(100, "http://alone.example.org/", "<p>top</p><p>x</p>", "r"), (101, None, "<p>y</p>", "r"), (102, "http://h0.example.org/a/003?copy", rows[3][2], "r"), (103, "no url", None, None)]
    rows.append(rows[5])
    want |= {100: "top\nx", 101: "y", 103: ""}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row string").repartition(3)
    got = {r.page_id: r for r in M.extract(df).collect()}
    assert M.extract(df).count() == len(rows)
    assert {i: got[i].text for i in want if i != 3} == {i: t for i, t in want.items() if i != 3}
    assert got[102].text in (want[3], f"top\nmenu one\n{want[3]}\nbottom")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert M.extract(df.limit(0)).collect() == []


def test_marked_articles_stay_whole(spark):
    page = "<nav>a</nav><article><p>same</p><p>{}</p></article><footer>{}</footer>"
    df = spark.createDataFrame([(i, f"http://h/{i}", page.format(i % 2, i)) for i in range(10)], "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in M.extract(df).collect()} == {(i, f"same\n{i % 2}") for i in range(10)}


def test_template_lines_go_from_marked_pages_too(spark):
    page = "<nav>a</nav><p>{1}</p><article><h1>{0}</h1><p>{0} text of page {1}, longer than what its site adds</p><p>read more on our site</p></article><footer>{1}</footer>"
    rows = [(i, f"http://h/{i}", page.format(f"head {i}", i)) for i in range(6)]
    copy = "<article><p>published twice on this host</p></article><p>unmarked template</p><footer>{}</footer>"
    rows += [(i, f"http://copies/{i}", copy.format(i)) for i in (10, 11)]
    got = {r.page_id: r.text for r in M.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{i}\nhead {i}\nhead {i} text of page {i}, longer than what its site adds" for i in range(6)} | {i: "published twice on this host" for i in (10, 11)}


def test_class_names_of_wrappers_do_not_lose_the_article():
    for name in ("post comments-open", "has-sidebar", "no-search", "content-sidebar-wrap", "with-menu"):
        assert text(f'<nav>n</nav><div class="{name}"><article class="post tag-social"><p>x</p><div class="share">s</div></article></div>') == "x"
        assert text(f'<main><div class="{name}"><article><p>x</p></article></div></main>') == "x"
    for name in ("post comments-open", "has-sidebar", "no-search"):
        assert text(f'<div class="{name}"><p>x</p></div>') == "x"
    assert text('<div class="sidebar"><article>teaser</article></div><article>x</article><div id="comments"><article>reader</article></div>') == "x"
    assert text('<p>x</p><div class="comments"><article>reader</article></div><div class="sidebar">y</div>') == "x"


def test_lines_repeated_thousands_of_times():
    import time

    began = time.perf_counter()
    a = [7] + [1] * 20_000 + [2] + [1] * 50 + [3, 5]
    b = [8] + [1] * 20_000 + [2] + [1] * 40 + [4, 6]
    x, y = M.shared(a, b)
    assert time.perf_counter() - began < 30
    assert all(a[i] == b[j] for i, j in zip(x, y, strict=True)) and x == sorted(x) and y == sorted(y)
    assert len(x) == 20_000 + 1 + 40


def test_alignment_of_lines_that_repeat_in_other_numbers():
    d = list(range(1000, 1200))
    a, b = [3] + [1] * 100 + d + [1] * 100 + [4], [8] + d + [1] * 100 + [9]
    x, y = M.shared(a, b)
    assert len(x) == 300 == brute_lcs(a, b) and [a[i] for i in x] == [b[j] for j in y]
    rng = random.Random(1)
    for _ in range(20):
        a, b = ([rng.choice([1, 1, 1, 2, 3, rng.randint(4, 40)]) for _ in range(rng.randint(0, 300))] for _ in range(2))
        x, y = M.shared(a, b)
        assert len(x) == brute_lcs(a, b) and [a[i] for i in x] == [b[j] for j in y] and x == sorted(set(x)) and y == sorted(set(y))


def brute_texts(rows):
    """The text of each distinct (page_id, url, html): all pages of a host in order, each against those up to NEAR places away."""
    hosts = {}
    for r in set(rows):
        host, path = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*))?(.*)", r[1] or "", re.S).groups()
        hosts.setdefault((host or "").lower(), []).append((path, r))
    out = {}
    for pages in hosts.values():
        pages.sort(key=lambda p: (p[0], ROW[p[1]]))
        lines = [M.lines(r[2] or "") for _, r in pages]
        for i, (path, r) in enumerate(pages):
            met = []
            for j in range(max(0, i - M.NEAR), min(len(pages), i + M.NEAR + 1)):
                if i != j:
                    lo, hi = min(i, j), max(i, j)
                    both = M.shared([t for t, _ in lines[lo]], [t for t, _ in lines[hi]])
                    prefix = len(os.path.commonprefix([path, pages[j][0]]))
                    met.append((-prefix, hi - lo, j > i, -len(both[0]), both[i > j]))
            out[r] = M.main_text(lines[i], [m[-1] for m in sorted(met) if m[-1]], len(met))
    return out


ROW = {}


def known_rows(spark, df):
    """The rows of df, with the hash by which equal paths are ordered."""
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    hashed = df.selectExpr("page_id", "url", "html", "coalesce(html, '') as h").selectExpr("page_id", "url", "html", f"concat(lpad(hex(xxhash64(page_id, url, h)), 16, '0'), lpad(hex(xxhash64({0x5DEECE66D}L, h, url, page_id)), 16, '0')) as row")
    ROW.update({(r.page_id, r.url, r.html): r.row for r in hashed.collect()})
    return rows


def test_whole_table_matches_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = known_rows(spark, df)
    want = brute_texts(rows)
    assert sorted((r.page_id, r.text) for r in M.extract(df).collect()) == sorted((r[0], want[r]) for r in rows)


def test_pages_over_many_partitions_match_brute_force(spark):
    rng = random.Random(7)
    pieces = ["<p>menu</p>", "<nav>n</nav>", "<article>", "</article>", "<p>shared sentence</p>", "<div>ad</div>", "<p>chance</p>", "<main>", "</main>", "<footer>f</footer>"]
    made = lambda: "".join(rng.choice(pieces) if rng.random() < 0.6 else f"<p>line {rng.randint(0, 30)} of some length</p>" for _ in range(rng.randint(0, 14)))
    rows = [(i, rng.choice([f"http://h{rng.randint(0, 2)}/{rng.choice('ab')}/{rng.randint(0, 40)}", f"HTTP://H{rng.randint(0, 2)}/x", None, "no url"]), made()) for i in range(220)]
    rows += [rows[4]] * 30 + [(500 + i, "http://h1/a/1", rows[9][2]) for i in range(6)] + [(900, "http://h2/a/2", None)]
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
        known = known_rows(spark, df)
        want = brute_texts(known)
        assert sorted((r.page_id, r.text) for r in M.extract(df).collect()) == sorted((r[0], want[r]) for r in known)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_article_line_is_lost_by_chance(spark, sf_dir):
    """On the tables every page has a marked article and no template inside it: texts are those of the marks."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in rows.collect()}
    for r in M.extract(rows).collect():
        article = [t for t, lv in M.lines(html[r.page_id]) if lv == M.ARTICLE]
        assert [t for t in r.text.split("\n") if t in article] == article


def test_one_sentence_of_two_neighbours_stays_in_the_article(spark):
    page = "<article><h1>head {0}</h1><p>text of page {0}, long enough to be one</p>{1}</article><p>site</p>"
    rows = [(i, f"http://h/{i}", page.format(i, "<p>by chance</p>" if i in (3, 4) else "")) for i in range(9)]
    got = {r.page_id: r.text for r in M.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"head {i}\ntext of page {i}, long enough to be one" + ("\nby chance" if i in (3, 4) else "") for i in range(9)}
