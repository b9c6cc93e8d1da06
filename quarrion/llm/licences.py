"""Licence scans by canonical digest lookup, in DataFrame expressions only.

A text is brought to a canonical form: copyright lines are dropped, letters lowered, spellings that
count as equivalent unified, punctuation and white space reduced to single spaces. The SHA-256 of the
whole canonical text is hash-joined to the digests of known licences, which take the same way.
Notices of one line are looked up likewise, every line of a text being a text of its own.
Known are the whole texts in ``licence_texts`` (named by their ids) with the usual variants, and the
notices that the phrases and names below make.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that name a copyright holder; they differ from copy to copy and are no part of a licence.
COPYRIGHT_LINE = r"(?im)^[ \t*/#;>-]*(copyright[ \t]*(\(c\)|©|:|\[|<|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved[ \t.]*$)[^\n]*$"
#: Spellings that count as equivalent (fixed values): each is replaced by the second.
SPELLINGS = (
    ("licence", "license"), ("sublicence", "sublicense"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"), ("recognised", "recognized"),
    ("merchantibility", "merchantability"), ("whilst", "while"), ("wilful", "willful"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: The texts and notices that the SQL knows too (fixed values); known_licences() has more.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Up to so many known texts their digests are broadcast.
MOST_BROADCAST = 100_000
TEXTS = Path(__file__).parent / "licence_texts"
#: Titles that are put above a text that has none of its own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"),
}
#: Where the part behind the terms begins, which copies often lack.
APPENDIX = re.compile(r"^[ \t]*(?:APPENDIX: How to apply|How to Apply These Terms|Appendix: How to Apply|Exhibit A - |EXHIBIT A -)", re.M)
#: Spellings of single places that differ between copies of a text: each text is also known with the second.
VARIANTS = (
    (r"https://", "http://"), (r"http://", "https://"), (r"and/or distribute", "and distribute"), (r"(?m)^(\s*)[0-9]\. (?=Redistributions|Neither)", r"\1* "), (r"COPYRIGHT HOLDER OR", "COPYRIGHT OWNERS OR"),
    (r"Neither the name of the copyright holder", "Neither the name of the University"), (r"(?i)copyright holders? (and|or) contributors", r"REGENTS \1 CONTRIBUTORS"),
    (r"51 Franklin Street, Fifth Floor, Boston, MA\s+02110-1301,?\s+USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"),
    (r"(Free Software Foundation, Inc\.,)\n +(?:51 Franklin|59 Temple)[^\n]*(?=\n Everyone)", r"\1"),
)
#: Names of licences as one-line notices give them.
NAMES = {
    "MIT": ("MIT License", "MIT", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("0BSD License", "0BSD", "BSD Zero Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "BSD-2-Clause License", "Simplified BSD License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "BSD-3-Clause License", "New BSD License", "3-Clause BSD License", "Modified BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache License, Version 2.0 (the \"License\")", "Apache License v2.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License, v. 2.0"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL-1.1", "MPL 1.1"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons CC0 1.0 Universal License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 License"),
} | {
    f"{short}-{v}{'-or-later' if all(later) else ''}": tuple(
        x + tail for tail in later for name in (f"GNU {long} General Public License".replace("  ", " "), f"GNU {short}", short)
        for x in (f"{name}, version {v}", f"{name}, version {v.removesuffix('.0')}", f"{name} version {v.removesuffix('.0')}.0", f"{name} v{v.removesuffix('.0')}", f"{name}v{v.removesuffix('.0')}", f"{name} {v}")
    ) + ((f"{short}-{v}-or-later", f"{short}-{v}+") if all(later) else (f"{short}-{v}", f"{short}-{v}-only"))
    for long, short, versions in (("", "GPL", ("2.0", "3.0")), ("Lesser", "LGPL", ("2.1", "3.0")), ("Affero", "AGPL", ("3.0",))) for v in versions for later in (("",), (" or later", ", or (at your option) any later version"))
}
#: Notices are a phrase and a name; the first three words before "under" may follow a subject.
SUBJECTS = ("this project", "this software", "this program", "this library", "this file", "this code", "this work")
DEEDS = ("licensed", "released", "distributed", "available", "published")


def notices() -> list[tuple[str, str]]:
    """(licence_id, text) of the one-line notices."""
    deeds = [*DEEDS, *(f"{x} is {d}" for x in SUBJECTS for d in DEEDS[:3])]
    phrases = [*(f"{d} under {a}" for d in deeds for a in ("", "the ", "the terms of the ")), "SPDX-License-Identifier: ", "License: ", "License under the ", "This Source Code Form is subject to the terms of the "]
    return sorted({(i, p + n) for i, names in NAMES.items() for n in names for p in phrases})


def whole_texts() -> list[tuple[str, str]]:
    """(licence_id, text) of the whole licence texts with their variants."""
    found = [(i, t) for i, t in KNOWN if "\n" in t and not t.startswith("MIT License")]
    found += [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    found += [(i, t[: m.start()]) for i, t in found if (m := APPENDIX.search(t))]
    for pattern, by in VARIANTS:
        found += [(i, re.sub(pattern, by, t)) for i, t in found if re.search(pattern, t)]
    found += [(i, f"{title}\n\n{t}") for i, t in found for title in TITLES.get(i, ())]
    return sorted(set(found))


def canonical_lines(text):
    """The canonical lines of a text that are not empty; of a null text none."""
    c = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, ""))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(lines):
    """SHA-256 of the canonical text that the lines make, as lower-case hex."""
    return F.sha2(F.array_join(lines, " "), 256)


def key(lines):
    """The digest by which a text is looked up: spellings of two words are unified across line ends too."""
    joined = unified = F.array_join(lines, " ")
    for old, new in SPELLINGS:
        if " " in old:
            unified = F.replace(unified, F.lit(old), F.lit(new))
    return F.when(unified == joined, digest(lines)).otherwise(F.sha2(unified, 256))


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence_id, text) of the whole texts and the notices."""
    return spark.createDataFrame(sorted({*KNOWN, *whole_texts(), *notices()}), "licence_id string, text string")


def _digests(known: DataFrame) -> DataFrame:
    """(digest, licence_id), one row a digest: of several ids the least. Empty texts are no licences."""
    rows = known.select("licence_id", canonical_lines(F.col("text")).alias("lines")).where("licence_id is not null and size(lines) > 0")
    return rows.groupBy(key(F.col("lines")).alias("digest")).agg(F.min("licence_id").alias("licence_id"))


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_lines, text_digest, licence_id, n_notices and notices.

    licence_id is that of the licence which the whole text is, else null. notices are the distinct
    ids of lines that are known notices, sorted and joined by commas (empty if there are none); they
    count in n_notices. A null or empty text has the digest of the empty string and no licence.
    """
    digests = _digests(known)
    if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        digests = F.broadcast(digests)
    row = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(0x5DEECE66D), "text", "doc_id").alias("b"))  # equal rows have equal results
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), canonical_lines(F.col("text").cast("string")).alias("lines"))
    whole = rows.select("doc_id", "row", F.size("lines").cast("long").alias("n_lines"), digest(F.col("lines")).alias("text_digest"), key(F.col("lines")).alias("digest"))
    whole = whole.join(digests, "digest", "left")
    each = rows.select("row", F.posexplode("lines").alias("at", "line")).select("row", "at", F.sha2("line", 256).alias("digest"))
    met = each.join(digests, "digest").select("row", "at", "licence_id").distinct()
    notices = met.groupBy("row").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("licence_id")), ",").alias("ids"))
    out = whole.join(notices, "row", "left")
    return out.select("doc_id", "n_lines", "text_digest", "licence_id", F.coalesce("n", F.lit(0)).alias("n_notices"), F.coalesce("ids", F.lit("")).alias("notices"))
