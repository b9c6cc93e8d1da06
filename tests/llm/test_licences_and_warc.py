import gzip
import hashlib
import textwrap
from pathlib import Path

from pyspark.sql import functions as F

from quarrion.llm import licences, warc


def test_whole_texts_and_notices(spark):
    mit = licences.KNOWN[0][1]
    other = "Copyright (c) 2020 A. Person\n\n" + mit.replace("copyright notice", "Copyright  NOTICE").replace("permit", "permit\n *") + "\n"
    rows = [
        (1, mit), (2, other), (3, mit + " and more"), (4, "Some text.\n# released UNDER the MIT licence\nAll rights reserved.\nLicensed under CC BY-NC 4.0"),
        (5, None), (6, ""), (7, "© 2020"), (1, mit), (None, "Released under the MIT License."), (8, "x " * 50_000),
    ]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, notices string").repartition(3)
    out = licences.scan(df, licences.known_licences(spark)).collect()
    got = sorted((str(r.doc_id), r.licence_id, r.n_notices, r.notices) for r in out)
    want = [("1", "MIT", 0, ""), ("1", "MIT", 0, ""), ("2", "MIT", 0, ""), ("3", None, 0, ""), ("4", None, 2, "CC-BY-NC-4.0,MIT"), ("5", None, 0, ""), ("6", None, 0, ""), ("7", None, 0, ""), ("8", None, 0, ""), ("None", "MIT", 1, "MIT")]
    assert [(a, b) for a, b, *_ in got] == [(a, b) for a, b, *_ in want]
    assert [g for g in got if g[0] not in "12"] == [w for w in want if w[0] not in "12"]
    assert {r.text_digest for r in out if r.doc_id in (5, 6, 7)} == {hashlib.sha256(b"").hexdigest()}
    assert licences.scan(df.limit(0), licences.known_licences(spark)).collect() == []
    none = spark.createDataFrame([], "licence_id string, text string")
    assert {r.licence_id for r in licences.scan(df, none).collect()} == {None}


def test_usual_licences_in_other_layouts_and_notices_in_other_words(spark):
    def filled(name):
        """Every paragraph on lines of another width, below a holder's line."""
        text = (licences.TEXTS / f"{name}.txt").read_text()
        return "Copyright (c) 2021 A. Person\n\n" + "\n\n".join(textwrap.fill(" ".join(p.split()), 61) for p in text.split("\n\n"))

    whole = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0"]
    rows = [(i, filled(i)) for i in whole]
    rows += [(i, (licences.TEXTS / f"{i}.txt").read_text()) for i in ("GPL-2.0", "LGPL-2.1", "GPL-3.0", "LGPL-3.0", "MPL-1.1", "CC0-1.0")]
    terms = (licences.TEXTS / "Apache-2.0.txt").read_text()
    rows += [("Apache-2.0", terms[: terms.index("   APPENDIX")].replace("http:", "https:")), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + filled("BSD-3-Clause").replace("1. ", "- ").replace("2. ", "- ").replace("3. ", "- "))]
    gpl = (licences.TEXTS / "GPL-2.0.txt").read_text()
    rows += [("GPL-2.0", gpl.replace("\n 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA\n", "\n", 1)), ("GPL-2.0", textwrap.indent(gpl[: gpl.index("            How to Apply")], " * "))]
    lines = [
        ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'), ("MIT", "This project is licensed under the MIT License"),
        ("GPL-3.0-or-later", "This program is distributed under the terms of the GNU General Public License, version 3 or later."), ("BSD-3-Clause", "License: BSD-3-Clause"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ]
    rows += [(None, f"Words before.\n{t}\nAnd words after.") for _, t in lines] + [(None, terms + "\nand more"), (None, "An apache has no licence.")]
    known = licences.known_licences(spark)
    out = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"), known).collect()}
    assert [out[k].licence_id for k in range(len(rows))] == [i for i, _ in rows]
    first = len(rows) - len(lines) - 2
    assert [out[first + k].notices for k in range(len(lines))] == [i for i, _ in lines]
    assert out[len(rows) - 1].n_notices == 0


def test_records_refer_to_their_response_and_survive_a_round_trip(spark, tmp_path):
    rows = [(1, "http://h/1", "<title>T &amp; t</title><script>x</script><p>One  <b>two</b><p>a &lt; b&amp;lt;<!-- c -->"), (2, None, None), (None, "http://h/3", ""), (1, "http://h/1", "<p>é")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, block string")
    responses = warc.responses_from_pages(df)
    records = warc.derivatives(responses)
    out = records.collect()
    assert len(out) == 8 and {r.warc_type for r in out} == {"metadata", "conversion"}
    ids = {r.record_id for r in responses.collect()}
    assert {r.refers_to for r in out} == ids
    text = {r.block for r in out if r.warc_type == "conversion"}
    assert text == {"One two\na < b&lt;", "", "é"}
    for r in out:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
    warc.write_warc(records, str(tmp_path / "out"))
    found = []
    for p in Path(tmp_path / "out").glob("part-*.gz"):
        data = gzip.decompress(p.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            found.append((fields["WARC-Record-ID"], fields["WARC-Refers-To"], fields.get("WARC-Target-URI"), rest[:n].decode()))
            data = rest[n + 4 :]
    assert sorted(map(str, found)) == sorted(str((r.record_id, r.refers_to, r.target_uri, r.block)) for r in out)
    assert warc.derivatives(responses.limit(0)).collect() == []


def test_all_references_are_decoded_once(spark):
    pages = [
        ("<p>caf&eacute; &#8217;x&#x2019; &hellip; a&nbsp;b &amp;lt; &lt;b&gt;</p>", "caf\u00e9 \u2019x\u2019 \u2026 a b &lt; <b>"), ("<p>&amp;lt; &quot;q&quot; &copy;</p>", '&lt; "q" \u00a9'),
        ("a<script>var x = 1;", "a"), ("b<!-- no end <p>x", "b"), ("c<title>t", "c"), (None, ""), ("x &unknown; y", "x &unknown; y"), ("<p>" + "lang &mdash; " * 20_000, ("lang \u2014 " * 20_000).strip()),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", warc.plain_text(F.col("html")).alias("t")).collect()}
    assert [got[i] for i in range(len(pages))] == [t for _, t in pages]


def test_other_contents_under_one_page_and_url_are_other_records(spark):
    rows = [(1, "http://a/", "<p>one"), (1, "http://a/", "<p>two"), (1, "http://a/", "<p>two"), (1, None, None), (None, "http://a/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.derivatives(warc.responses_from_pages(pages)).collect()
    assert len(found) == 10 and len({r.record_id for r in found}) == 8 and len({r.refers_to for r in found}) == 4
    assert {r.block for r in found if r.warc_type == "conversion"} == {"one", "two", ""}


def test_elements_without_text_give_none(spark):
    html = "<p>a<noscript>N<b>S</b></noscript><TEXTAREA rows=2>TA</textarea><template><p>TP</template><iframe src=x>F</iframe><p>b<textareas>c<template>rest"
    (row,) = spark.createDataFrame([(html,)], "h string").select(warc.plain_text(F.col("h")).alias("t")).collect()
    assert row.t == "a\nbc"
