"""Main text of web pages by nearest-URL page differencing.

Pages of one host are ordered by URL path; every page is paired with the NEAR pages on either side of
it. The text lines (blocks) of both pages are aligned by a longest common subsequence. Lines that a page
shares with the nearest of them, the one with the longest path prefix, are deleted: the template. A line
inside an article asks for more evidence, as pages may use one sentence by chance or quote one passage:
it goes if at least two of the compared pages, and three quarters of them, share it, where copies of the
article (pages that have at least half of its characters) say nothing. Marks confirm: lines in elements marked as
menus, footers, notices and the like go even if the neighbours have other ones. Marks decide alone only
where there is no neighbour or nothing is shared with one.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm import words as W
from quarrion.storage import checkpointed

#: Element names: those that end a line, those without content, those whose content is no text, and those that are never main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript template svg math object audio video canvas xmp".split())
ASIDE = frozenset("nav footer aside form dialog menu search button select datalist fieldset head".split())
#: Words in a class, an id or a role that mark what is not main text; those of the second list only outside an article.
MARKED = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus gdpr login menu menubar modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
OUTSIDE = frozenset("header footer masthead topbar alert".split())
#: Words that make a class name the state of an element (comments-open, has-sidebar) and no mark of what it holds.
STATES = frozenset("has no not with without is open opened closed enabled disabled allowed on off active free".split())
#: Marks of elements whose articles are other ones than the page's; an article in an element with other marks may be the page's.
OTHERS = frozenset("ad ads advert adverts advertisement advertising adsense comment comments disqus promo promoted promotion related replies sponsor sponsored".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("article section main body html table ul ol dl div nav aside footer header form td th".split())

#: Levels of a line. WRAPPED: of an article inside an element with a mark; WRAPPER: of the rest of that element, boilerplate as a line.
WRAPPED, WRAPPER, BOILERPLATE, NEUTRAL, MAIN, ARTICLE = -3, -2, -1, 0, 1, 2


def _level(name: str, attributes: str, above: int) -> int:
    """Level of what an element holds, given the level above it."""
    if above == BOILERPLATE or name in ASIDE or (name == "header" and WRAPPED < above < MAIN):
        return BOILERPLATE
    marks: set[str] = set()
    whole: set[str] = set()
    role = {"article": ARTICLE, "main": MAIN}.get(name, NEUTRAL)
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return BOILERPLATE
            if key in ("class", "id", "role"):
                whole.update(value.split())
                for word in value.split():
                    pieces = set(re.split(r"[_-]+", word))
                    if key == "role" or not pieces & STATES:
                        marks |= pieces
            if (key, value) in (("role", "article"), ("itemprop", "articlebody")):
                role = ARTICLE
            elif (key, value) == ("role", "main"):
                role = max(role, MAIN)
        if name not in ("body", "html", "main"):
            if role == ARTICLE:  # of its own class names only whole ones count: others are topics (tag-social)
                marks = whole & OTHERS
            if marks & OTHERS or (above in (WRAPPED, ARTICLE) and marks & MARKED):
                return BOILERPLATE
            if role < MAIN and (marks & MARKED or (above in (WRAPPER, NEUTRAL) and marks & OUTSIDE)):
                return WRAPPER
    if above in (WRAPPED, WRAPPER):
        return WRAPPED if role >= MAIN else above
    return max(above, role)


def lines(page: str) -> list[tuple[str, int]]:
    """The text lines of a page in order, with their levels; markup, scripts and comments give none."""
    out: list[tuple[str, int]] = []
    parts: dict[int, list[str]] = {}
    stack: list[tuple[str, int]] = []
    level, at, size = NEUTRAL, 0, len(page)

    def flush() -> None:
        for lv, pieces in parts.items():
            if text := " ".join("".join(pieces).split()):
                out.append((text, BOILERPLATE if lv == WRAPPER else lv))
        parts.clear()

    def close(names: set[str], scopes: frozenset[str]) -> None:
        nonlocal level
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                level = stack[-1][1] if stack else NEUTRAL
                return
            if stack[i][0] in scopes:
                return

    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.setdefault(level, []).append(html.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCKS:
                flush()
            close({name}, frozenset() if name in _SCOPES else _SCOPES)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "br" or name in VOID:
            parts.setdefault(level, []).append(" " if name in ("br", "wbr") else "")
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            close({"p"}, _SCOPES)
            if name in _CLOSED_BY:
                close(_CLOSED_BY[name], frozenset(("ul", "ol", "dl", "table")))
        if not (m[3] or m[6] or "").rstrip().endswith("/"):
            level = _level(name, m[3] or m[6] or "", level)
            stack.append((name, level))
    flush()
    best = max((lv for _, lv in out), default=NEUTRAL)
    inner = BOILERPLATE if best == ARTICLE else max(best, NEUTRAL)  # an article elsewhere is the page's; if there is none, this one joins the best lines
    return [(text, inner if lv == WRAPPED else lv) for text, lv in out]


#: Pages on either side with which a page is compared, and the share of them (two at least) that makes a line of an article template.
NEAR, MOST_PAGES = 4, 0.75


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a with every prefix of b: one addition of len(b) bits for each line of a."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full
    for x in a:
        met = free & masks.get(x, 0)
        free = ((free + met) | (free - met)) & full
    bits = np.unpackbits(np.frombuffer(free.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list[int], b: list[int], i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Appends the pairs of a longest common subsequence of a and b, which begin at i and j, by halves of a."""
    while a and b and a[0] == b[0]:
        out.append((i, j))
        a, b, i, j = a[1:], b[1:], i + 1, j + 1
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[: len(a) - tail], b[: len(b) - tail]
    if x and y:
        if len(x) == 1:
            if x[0] in y:
                out.append((i, j + y.index(x[0])))
        else:
            half = len(x) // 2
            cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            _aligned(x[:half], y[:cut], i, j, out)
            _aligned(x[half:], y[cut:], i + half, j + cut, out)
    out += [(i + len(x) + n, j + len(y) + n) for n in range(tail)]


def shared(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Indices of a longest common subsequence in both lists.

    Lines that the other list lacks are passed over first. Time is that of len(a) additions of len(b) bits, twice, and
    memory that of the lists, however often lines repeat.
    """
    both = set(a) & set(b)
    if not both:
        return [], []
    x, y = [i for i, v in enumerate(a) if v in both], [j for j, v in enumerate(b) if v in both]
    lo = 0
    while lo < min(len(x), len(y)) and a[x[lo]] == b[y[lo]]:
        lo += 1
    pairs = [(i, i) for i in range(lo)]
    _aligned([a[i] for i in x[lo:]], [b[j] for j in y[lo:]], lo, lo, pairs)
    return [x[i] for i, _ in pairs], [y[j] for _, j in pairs]


def main_text(found: list[tuple[str, int]], neighbours: list[list[int]] | None = None, compared: int = 0) -> str:
    """The lines of a page that are neither template lines nor marked as boilerplate.

    ``neighbours`` has the lines shared with each compared page that shares any, the nearest first; ``compared`` counts
    all compared pages. Without shared lines those of the highest level are the text; they are as well if nothing else
    is left (an unmarked copy).
    """
    best = max((lv for _, lv in found), default=NEUTRAL)
    top = [i for i, (_, lv) in enumerate(found) if lv == best and lv != BOILERPLATE]
    if not neighbours:
        return "\n".join(found[i][0] for i in top)
    sets = [set(n) for n in neighbours]
    gone = sets[0]
    if best >= MAIN:
        whole = sum(len(found[i][0]) for i in top)
        others = [n for n in sets if 2 * sum(len(found[i][0]) for i in top if i in n) < whole]
        count = Counter(i for n in others for i in n)
        total = len(others) + compared - len(sets)
        gone = {i for i in sets[0] if found[i][1] < best} | {i for i in top if count[i] >= max(2, MOST_PAGES * total)}
    own = [i for i, (_, lv) in enumerate(found) if lv != BOILERPLATE and i not in gone]
    return "\n".join(found[i][0] for i in own or top)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [[_hash(t) for t, _ in lines(b.decode())] for b in W.as_bytes(batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "path", "row", "lines"])


_SHARED = pa.list_(pa.struct([("prefix", pa.int32()), ("distance", pa.int32()), ("ahead", pa.bool_()), ("lines", pa.list_(pa.int32()))]))
_MET = pa.schema([("row", pa.string()), ("compared", pa.int32()), ("shared", _SHARED), ("part", pa.int32()), ("at", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64()))])
_MET_DDL = "row string, compared int, shared array<struct<prefix:int,distance:int,ahead:boolean,lines:array<int>>>"


class _Page:
    """A page in the order of paths, and what it shares with those around it."""

    def __init__(self, host: str, path: str, row: str, found: list[int], at: int = 0) -> None:
        self.host, self.path, self.row, self.lines, self.at = host, path, row, found, at
        self.compared, self.shared = 0, []

    def meet(self, later: _Page, distance: int) -> None:
        prefix = next((i for i, (p, q) in enumerate(zip(self.path, later.path, strict=False)) if p != q), min(len(self.path), len(later.path)))
        for page, ahead, mine in zip((self, later), (True, False), shared(self.lines, later.lines), strict=True):
            page.compared += 1
            if mine:
                page.shared.append({"prefix": prefix, "distance": distance, "ahead": ahead, "lines": mine})

    def met(self) -> tuple:
        return self.row, self.compared, self.shared, None, None, None, None, None

    def edge(self, part: int) -> tuple:
        return self.row, None, None, part, self.at, self.host, self.path, self.lines


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _consecutive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages share inside an ordered partition, and its first and last NEAR pages (part not null); of equal rows one is looked at."""
    part, near, first, n = TaskContext.get().partitionId(), deque(maxlen=NEAR), [], 0
    for batch in batches:
        out = []
        for host, path, row, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if near and near[-1].row == row and near[-1].host == host:
                continue
            page = _Page(host, path, row, found, n)
            n += 1
            for distance, before in enumerate(reversed(near), start=1):
                if before.host == host:
                    before.meet(page, distance)
            if len(near) == NEAR:
                out.append(near[0].met())
            if len(first) < NEAR:
                first.append(page)
            near.append(page)
        yield _batch(out, _MET)
    edges = {p.at: p for p in (*first, *near)}
    if edges:
        yield _batch([*(p.met() for p in near), *(p.edge(part) for p in edges.values())], _MET)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages of different partitions share: of rows (host, path, row, lines, later), where later has those behind in order."""
    schema = pa.schema([_MET.field(i) for i in range(3)])
    for batch in batches:
        out = []
        for host, path, row, found, later in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            for x in later:
                if x["row"] != row:
                    one, other = _Page(host, path, row, found), _Page(host, x["path"], x["row"], x["lines"])
                    one.meet(other, x["distance"])
                    out += [one.met()[:3], other.met()[:3]]
        yield _batch(out, schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for b, compared, found in zip(W.as_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            order = sorted(found or (), key=lambda x: (-x["prefix"], x["distance"], x["ahead"], -len(x["lines"]), x["lines"]))
            text.append(main_text(lines(b.decode()), [x["lines"] for x in order], compared or 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame) -> DataFrame:
    """(row, compared, shared): with how many pages of its host the page with this row hash was compared, and what lines it shares with each.

    ``pages`` has (row, url, html). A null url is a host of its own; pages that share nothing have no row.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    rows = pages.select(host.alias("host"), path.alias("path"), "row", "html").mapInArrow(_line_hashes, "host string, path string, row string, lines array<long>")
    ordered = rows.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    found = checkpointed(ordered.mapInArrow(_consecutive, f"{_MET_DDL}, part int, at long, host string, path string, lines array<long>"))
    seam = Window.partitionBy("host").orderBy("part", "at")  # 2 * NEAR rows a partition
    later = F.array_compact(F.array(*(F.when(F.lead("part", d).over(seam) != F.col("part"), F.struct(F.lit(d).alias("distance"), *(F.lead(c, d).over(seam).alias(c) for c in ("path", "row", "lines")))) for d in range(1, NEAR + 1))))
    ends = found.where("part is not null").select("host", "path", "row", "lines", later.alias("later"))
    across = ends.where(F.size("later") > 0).mapInArrow(_across, _MET_DDL)
    both = found.where("part is null").select("row", "compared", "shared").unionByName(across)
    return both.groupBy("row").agg(F.sum("compared").cast("int").alias("compared"), F.flatten(F.collect_list("shared")).alias("shared")).where(F.size("shared") > 0)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars. A null html is an empty page; rows may repeat."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    halves = (F.xxhash64("page_id", "url", "html"), F.xxhash64(F.lit(0x5DEECE66D), "html", "url", "page_id"))
    rows = rows.withColumn("row", F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))
    full = rows.join(templates(rows), "row", "left").select("page_id", "url", "html", "compared", "shared")
    page_id, url = rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()
    return full.mapInArrow(_texts, f"page_id {page_id}, url {url}, text string, n_chars long")
