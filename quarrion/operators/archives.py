"""Archives and binaries: entries listed from the directory alone, archives carved out of other bytes, and runs of text.

A directory is read from the end of a file: the closing record, then the entries it points at. Nothing is inflated for a
listing. Carving needs no directory: it looks for the signature of a local entry anywhere in the bytes and inflates up to
a limit, so it also finds what follows foreign bytes or has lost its end. Files are rows; a task holds one at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.operators.extract import MEDIA, MOST_BLOB, MOST_TEXT, TEXTS, pieces_of

#: Signatures of a local entry, an entry of the directory, the closing record and the records of large archives.
LOCAL, CENTRAL, CLOSING, CLOSING_64, LOCATOR_64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
#: Bytes at the end of a file among which its closing record lies, and archives within archives that are opened.
TAIL, DEPTH = 22 + 65_535, 2

Read = Callable[[int, int], bytes]
ENTRY = "entry string, length long, packed long, method int, crc long, flags int, at long"
_ENTRY = pa.struct([("entry", pa.string()), ("length", pa.int64()), ("packed", pa.int64()), ("method", pa.int32()), ("crc", pa.int64()), ("flags", pa.int32()), ("at", pa.int64())])


def _large(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and place with those of the extra field for large files where they are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide, v) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + size
    return values


def directory(read: Read, length: int) -> list[dict]:
    """The entries of an archive in the order of its directory; an error (ValueError) if there is no whole directory.

    ``read(at, n)`` gives n bytes of the file; it is asked for the tail and for the directory, for nothing else.
    """
    start = max(0, length - TAIL)
    tail = read(start, length - start)
    at = tail.rfind(CLOSING)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(CLOSING, 0, at)
    if at < 0:
        raise ValueError("no closing record")
    count, size, first = struct.unpack_from("<HII", tail, at + 10)
    end = start + at
    if 0xFFFFFFFF in (size, first) or count == 0xFFFF:
        where = tail.rfind(LOCATOR_64, 0, at)
        if where >= 0:
            end = struct.unpack_from("<Q", tail, where + 8)[0]
            record = read(end, 56)
            if record[:4] == CLOSING_64 and len(record) == 56:
                count, size, first = struct.unpack_from("<QQQ", record, 32)
    moved = end - size - first  # foreign bytes before the archive
    if moved < 0:
        raise ValueError("the directory lies before the file")
    data = read(first + moved, size)
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != CENTRAL or at + 46 > len(data):
            raise ValueError("a broken directory")
        flags, method, crc, packed, full, n, extra, note, place = struct.unpack_from("<HH4xIIIHHH8xI", data, at + 8)
        name = data[at + 46 : at + 46 + n]
        full, packed, place = _large(data[at + 46 + n : at + 46 + n + extra], [full, packed, place])
        text = name.decode("utf-8" if flags & 0x800 else "cp437", "replace").partition("\0")[0]
        out.append({"entry": text, "length": full, "packed": packed, "method": method, "crc": crc, "flags": flags, "at": place + moved})
        at += 46 + n + extra + note
    if len(out) != count:
        raise ValueError("entries are missing")
    return out


def entry_bytes(read: Read, entry: dict, most: int) -> bytes | None:
    """An entry's content up to ``most`` bytes; None for encrypted entries and unknown methods. Reads this entry alone."""
    head = read(entry["at"], 30)
    if len(head) < 30 or head[:4] != LOCAL or entry["flags"] & 1 or entry["method"] not in (0, 8):
        return None
    n, extra = struct.unpack_from("<HH", head, 26)
    data = read(entry["at"] + 30 + n + extra, entry["packed"])
    try:
        return data[:most] if entry["method"] == 0 else zlib.decompressobj(-15).decompress(data, most)
    except zlib.error:
        return None


class _Counted:
    """Random reads of bytes or of an open file, and how many bytes they took."""

    def __init__(self, source) -> None:
        self.source, self.taken = source, 0

    def __call__(self, at: int, n: int) -> bytes:
        if isinstance(self.source, bytes):
            data = self.source[at : at + n]
        else:
            self.source.seek(at)
            data = self.source.read(n)
        self.taken += len(data)
        return data


def _listed(batches: Iterator[pa.RecordBatch], opened: Callable) -> Iterator[pa.RecordBatch]:
    for batch in (x for b in batches for x in pieces_of(b)):
        names, rows, taken = [], [], []
        for name, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with opened(name, given) as (source, length):
                read = _Counted(source)
                try:
                    found = directory(read, length)
                except (ValueError, struct.error):
                    continue
            names += [name] * len(found)
            rows += found
            taken += [read.taken] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *pa.array(rows, _ENTRY).flatten(), pa.array(taken, pa.int64())], names=["path", *(f.name for f in _ENTRY), "bytes_read"])


class _Held:
    """A file given by its content."""

    def __init__(self, name, content) -> None:
        self.content = content or b""

    def __enter__(self):
        return self.content, len(self.content)

    def __exit__(self, *_) -> None:
        pass


class _Opened:
    """A file opened by its path for random reads, in whatever store pyarrow knows."""

    def __init__(self, name, length) -> None:
        self.name, self.length = name, length

    def __enter__(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.name if "://" in self.name else re.sub("^file:/*", "file:///", self.name))
        self.file = store.open_input_file(path)
        return self.file, self.length

    def __exit__(self, *_) -> None:
        self.file.close()


def listed(files: DataFrame) -> DataFrame:
    """(path, entry, length, packed, method, crc, flags, at, bytes_read) of archives (path, content), by their directories.

    Files without a whole directory give nothing; names as in the directory, ``bytes_read`` is what was looked at.
    """
    return files.select("path", "content").mapInArrow(lambda b: _listed(b, _Held), f"path string, {ENTRY}, bytes_read long")


def listed_in_place(files: DataFrame) -> DataFrame:
    """The same of archives (path, length) that stay where they are: tasks read tails and directories alone."""
    return files.select(F.col("path").cast("string"), F.col("length").cast("long")).mapInArrow(lambda b: _listed(b, _Opened), f"path string, {ENTRY}, bytes_read long")


def _ending(name: str) -> str:
    return name.rpartition(".")[2].lower()


def carved(data: bytes, prefix: str = "", depth: int = 0, most_text: int = MOST_TEXT, most_blob: int = MOST_BLOB) -> Iterator[tuple[str, bytes]]:
    """(label, content) of the entries that begin anywhere in the bytes, archives inside them as well.

    An entry is inflated up to the limit of its kind, by its name: a text beyond it is left out, anything else cut there.
    Media are left out; what cannot be inflated is passed over. Bytes without an entry are one themselves.
    """
    starts = [m.start() for m in re.finditer(re.escape(LOCAL), data)]
    if not starts:
        yield (f"{prefix}!<unassigned>" if prefix else "<unassigned>"), data
    for start, after in zip(starts, [*starts[1:], len(data)], strict=False):
        if start + 30 > len(data):
            continue
        method, declared, n, extra = struct.unpack_from("<H12xIHH", data, start + 8)
        name = data[start + 30 : start + 30 + n].decode("utf-8", "replace") or f"<entry@{start}>"
        label = f"{prefix}!{name}" if prefix else name
        text = _ending(name) in TEXTS
        if _ending(name) in MEDIA or (text and declared > most_text):
            continue
        body, limit = start + 30 + n + extra, most_text + 1 if text else most_blob
        try:
            content = zlib.decompressobj(-15).decompress(data[body:after], limit) if method == 8 else data[body : min(after, body + limit)]
        except zlib.error:
            continue
        if text and len(content) > most_text:
            continue
        if depth < DEPTH and content[:4] == LOCAL:
            yield from carved(content, label, depth + 1, most_text, most_blob)
        else:
            yield label, content


def carved_entries(files: DataFrame, most_text: int = MOST_TEXT, most_blob: int = MOST_BLOB) -> DataFrame:
    """(path, entry, content): what is carved out of files (path, content), archives or not. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces_of(b)):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for label, content in carved(data or b"", "", 0, most_text, most_blob):
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([label], pa.string()), pa.array([content], pa.binary())], names=["path", "entry", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, entry string, content binary")


def _decoded(data: bytes) -> np.ndarray:
    """The code points of the valid UTF-8 sequences among the bytes, in order; all other bytes are passed over.

    A sequence is told by its own bytes alone, and no byte can be part of two, so all are found side by side.
    """
    b = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int32)
    x, y, z, w = b[:-3], b[1:-2], b[2:-1], b[3:]
    tail = lambda v: (v & 0xC0) == 0x80
    one = x < 0x80
    two = (x >= 0xC2) & (x < 0xE0) & tail(y)
    three = (x & 0xF0 == 0xE0) & tail(y) & tail(z) & ~((x == 0xE0) & (y < 0xA0)) & ~((x == 0xED) & (y >= 0xA0))
    four = (x >= 0xF0) & (x < 0xF5) & tail(y) & tail(z) & tail(w) & ~((x == 0xF0) & (y < 0x90)) & ~((x == 0xF4) & (y >= 0x90))
    points = np.select(
        [one, two, three, four],
        [x, (x & 0x1F) << 6 | y & 0x3F, (x & 0x0F) << 12 | (y & 0x3F) << 6 | z & 0x3F, (x & 0x07) << 18 | (y & 0x3F) << 12 | (z & 0x3F) << 6 | w & 0x3F],
    )
    return points[one | two | three | four]


def _stretches(inside: np.ndarray, longest: int) -> Iterator[tuple[int, int]]:
    """Runs of True as [lo, hi), those beyond ``longest`` in pieces of that length."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    for lo, hi in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        for at in range(lo, hi, longest):
            yield at, min(hi, at + longest)


def text_runs(data: bytes, least: int = 3, most: int = 8192, least_cjk: int = 2, most_cjk: int = 128) -> list[str]:
    """Printable ASCII runs of a binary (tabs included, trimmed), then runs of Chinese characters in what is UTF-8 of it.

    An ASCII run is taken in pieces of ``most`` + 1, of which those that trimming leaves at ``least`` to ``most`` stay; Chinese
    characters with nothing but broken bytes between them are neighbours.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    out = []
    for lo, hi in _stretches((b == 9) | ((b >= 0x20) & (b <= 0x7E)), most + 1):
        text = data[lo:hi].decode("ascii").strip() if hi - lo >= least else ""
        if least <= len(text) <= most:
            out.append(text)
    points = _decoded(data)
    cjk = ((points >= 0x3400) & (points <= 0x4DBF)) | ((points >= 0x4E00) & (points <= 0x9FFF))
    return out + [points[lo:hi].astype("<u4").tobytes().decode("utf-32-le") for lo, hi in _stretches(cjk, most_cjk) if hi - lo >= least_cjk]


def runs(content: Column, least: int = 3, most: int = 8192) -> Column:
    """The text runs of a binary column, in order, as an array; null for null."""

    def each(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = lambda x: pa.array([None if v is None else text_runs(v, least, most) for v in x.to_pylist()], pa.list_(pa.string()))
        for column in columns:
            yield pa.concat_arrays([of(x) for x in pieces_of(column)] or [pa.array([], pa.list_(pa.string()))])

    return F.arrow_udf(each, "array<string>")(content)
