"""Indicators, credentials and routes in text, with the sources they were found in."""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.functions.net import host, is_local_ipv4, parent_domains
from quarrion.operators.relational import capped_list
from quarrion.storage import checkpointed

#: Patterns of indicators, Java and RE2 alike but for the look-arounds of the phone number.
URL = r"https?://[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{1,5})?(?:/[^\s\"'<>\\]*)?"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._+-]{0,30}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,10}"
PHONE = r"(?<![0-9A-Za-z_])1[3-9][0-9]{9}(?![0-9A-Za-z_])"
# Endings of pictures, sound, film and fonts, which hold no text worth a scan.
MEDIA = (
    "png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "tif", "tiff", "heic", "heif", "mp3", "mp4", "m4a", "aac", "wav", "ogg", "flac", "avi", "mov", "mkv", "webm",
    "ttf", "otf", "woff", "woff2",
)
# Endings of texts, which are read up to a lower limit.
TEXTS = ("java", "kt", "xml", "json", "properties", "txt", "js", "html", "gradle", "smali")
# Sizes up to which texts and other files are read.
MOST_TEXT, MOST_BLOB = 1 << 20, 64 << 20


def found(df: DataFrame, keys: Sequence[str], text: str, pattern: str, group: int = 0) -> DataFrame:
    """(keys, value) with one row for each match of a pattern."""
    return df.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("value"))


# Characters beside an @ that are looked at, those that may not stand before them, and the form of an address.
EMAIL_PARTS = r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._+-]{1,32})@(?=([A-Za-z0-9.-]{1,32})(?![A-Za-z0-9.-]))"
EMAIL_FORM = r"^[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+(?:[A-Za-z]{2,63}|xn--[A-Za-z0-9-]{1,59})$"


def emails(text: Column | str) -> Column:
    """The addresses in a text: at most 32 characters on either side of an @, with nothing of an address beside them."""
    local, domain = (F.regexp_extract_all(text, F.lit(EMAIL_PARTS), F.lit(i)) for i in (1, 2))
    return F.filter(F.zip_with(local, domain, lambda x, y: F.concat(x, F.lit("@"), y)), lambda v: v.rlike(EMAIL_FORM))


def script_value(text: Column, name: str) -> Column:
    """The JSON value that a script assigns to a variable, as JSON text; null without one. What follows the value is not read."""
    assigned = re.compile(rf"\b(?:var\s+)?{re.escape(name)}\s*=\s*")

    def value(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str) -> str | None:
            if not (m := assigned.search(t)):
                return None
            try:
                return json.dumps(json.JSONDecoder().raw_decode(t, m.end())[0], ensure_ascii=False)
            except json.JSONDecodeError:
                return None

        for s in texts:
            yield s.map(one, na_action="ignore")

    return F.pandas_udf(value, "string")(F.when(F.contains(text, F.lit(name)), text))


# Start and multiplier of the fold of token hashes, modulo 2**64.
FOLD_START, FOLD_MULT = 0xCBF29CE484222325, 0x9E3779B185EBCA87

#: Rows of an Arrow batch that are taken into Python at a time.
ROWS_AT_ONCE = 100


def gram_hashes(tokens: Column, n: int = 4) -> Column:
    """The distinct hashes of every n consecutive tokens (trimmed, in capitals, blanks left out), as signed numbers in order.

    A token's hash is its BLAKE2b digest of 8 bytes; a run folds them as value * FOLD_MULT xor hash.
    """

    def of(token: str) -> int:
        return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "ignore"), digest_size=8).digest(), "big")

    def runs(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        words = [str(x or "").strip().upper() for x in coded.dictionary.to_pylist()]
        digest = np.array([of(w) for w in words], dtype=np.uint64)
        index = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        told = np.array([*(w != "" for w in words), False])[index]  # a null token, at -1, is left out
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        found = []
        for lo, hi in itertools.pairwise(ends.tolist()):
            h = digest[index[lo:hi][told[lo:hi]]]
            fold = np.full(max(0, len(h) - n + 1), FOLD_START, dtype=np.uint64)
            for i in range(n if len(fold) else 0):
                fold = fold * np.uint64(FOLD_MULT) ^ h[i : len(h) - n + 1 + i]
            found.append(np.sort(np.unique(fold).view(np.int64)))
        sizes = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(found)), mask=lists.is_null())

    def hashed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in columns:
            yield pa.concat_arrays([runs(x) for x in pieces_of(lists)] or [pa.array([], pa.list_(pa.int64()))])

    return F.arrow_udf(hashed, "array<bigint>")(tokens)


def pieces_of(batch):
    """An Arrow batch or array in pieces of few rows, so that a task has few values as Python's at a time."""
    return (batch.slice(at, ROWS_AT_ONCE) for at in range(0, len(batch), ROWS_AT_ONCE))


def worth_reading(name: Column | str, length: Column | str) -> Column:
    """False for media files, texts and blobs beyond their limits; evaluated before contents are read."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    is_text = ending.isin(*TEXTS)
    return ~ending.isin(*MEDIA) & (F.col(length) <= F.when(is_text, MOST_TEXT).otherwise(MOST_BLOB))


def without_allowed(values: DataFrame, host_col: str, allowed: DataFrame, with_last: bool = False) -> DataFrame:
    """Rows whose host neither is nor lies below an allowed domain; the allow list is (domain)."""
    lists = allowed.select(F.lower("domain").alias("_domain")).distinct()
    keyed = values.withColumn("_up", parent_domains(host_col, with_last))
    hosts = keyed.select(F.col(host_col).alias("_h"), F.explode("_up").alias("_domain")).distinct()
    known = hosts.join(lists, "_domain", "left_semi").select("_h").distinct()
    return keyed.join(known, keyed[host_col] == known["_h"], "left_anti").drop("_up")


def is_noise(value: Column | str, noise_hosts: Sequence[str] = (), noise_parts: Sequence[str] = ()) -> Column:
    """URLs that say nothing: pictures, local addresses, hosts without a known form, listed hosts and substrings."""
    v = F.col(value) if isinstance(value, str) else value
    h = host(v)
    out = F.lower(F.regexp_replace(v, "[?#].*$", "")).rlike(r"\.(png|jpg|jpeg|gif|webp|svg|ico)$") | is_local_ipv4(h) | ~h.rlike(r"\.") | h.isin(*noise_hosts, "")
    for part in noise_parts:
        out = out | F.contains(F.lower(v), F.lit(part))
    return F.coalesce(out, F.lit(True))


def not_only_from(values: DataFrame, keys: Sequence[str], source: str, patterns: Sequence[str]) -> DataFrame:
    """Rows of values that have a source beyond those that match one of the patterns."""
    dull = F.lit(False)
    for p in patterns:
        dull = dull | F.col(source).rlike(p)
    good = values.groupBy(*keys).agg(F.bool_and(dull).alias("_dull")).where("not _dull").select(*keys)
    return values.join(good, list(keys), "left_semi")


def with_sources(values: DataFrame, keys: Sequence[str], source: str, most_sources: int = 5) -> DataFrame:
    """(keys, sources): the first distinct sources of each value by name."""
    return capped_list(values.select(*keys, source).distinct(), keys, source, [F.col(source)], most_sources)


def merged_sources(first: DataFrame, second: DataFrame, keys: Sequence[str], most_sources: int = 5, most_values: int = 200) -> DataFrame:
    """Two results (keys, sources) as one: sources of the first come first; values by name up to a number a type."""
    each = lambda df, rank: df.select(*keys, F.posexplode("sources").alias("at", "source")).withColumn("rank", F.lit(rank))
    rows = each(first, 0).unionByName(each(second, 1)).groupBy(*keys, "source").agg(F.min(F.struct("rank", "at")).alias("order"))
    lists = capped_list(rows, keys, "source", [F.col("order")], most_sources).withColumnRenamed("source", "sources")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]))
    return lists.withColumn("_n", at).where(F.col("_n") <= most_values).drop("_n")


#: Items of few words that may be broadcast (some hundred bytes each).
FEW_ITEMS = 100_000
#: Keys of items up to which these are broadcast.
FEW_KEYS = 1_000_000


#: Words whose items a task remembers.
REMEMBERED = 200_000


def _inside_words(own: DataFrame, items: DataFrame) -> DataFrame:
    """(_key, _id) of texts (_key, _text) with items (_id, _item), FEW_ITEMS at most, that hold no space: each lies inside a word."""
    shared = own.sparkSession.sparkContext.broadcast({r["_item"]: r["_id"] for r in items.collect()})
    kind = own.schema["_key"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, {}
        lengths = sorted({len(x) for x in known})

        def of(word: str) -> set[int]:
            parts = (word[i : i + n] for n in lengths if n <= len(word) for i in range(len(word) - n + 1))
            return {known[x] for x in parts if x in known}

        for batch in batches:
            rows, ids = [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                found: set[int] = set()
                for word in set(text.replace("\n", " ").split(" ")) if text else ():
                    if (hits := seen.get(word)) is None:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        hits = seen[word] = of(word)
                    found |= hits
                rows += [row] * len(found)
                ids += found
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64())], names=["_key", "_id"])

    return own.select("_key", "_text").mapInArrow(look, f"_key {kind}, _id long")


def located(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str) -> DataFrame:
    """Distinct (key, item_key) of the texts that contain an item, letter by letter.

    Equal items are looked for once. An item of five words or more stands whole in a text only where its inner words do, so
    the two meet by the second to fourth; those inside one word are looked for in the different words of a task's texts, and
    those of two to four words, or with spaces at the ends, in every text. Up to FEW_ITEMS different
    items of a kind, counted first, are broadcast. The keys of equal items are made out last, and rows are only compared
    again where a key has several texts or items. Empty items are in no text.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[^ \n]+"), F.lit(0))
    known = items.select(F.col(item_key).alias("_item_key"), F.col(item).cast("string").alias("_item")).where("_item <> ''").distinct()
    each = checkpointed(known.select("_item").distinct().withColumn("_id", F.monotonically_increasing_id())).withColumn("_words", words("_item"))
    keys = checkpointed(known.join(each.select("_item", "_id"), "_item").select("_id", "_item_key"))
    own = texts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    w = words("_text")
    onward = lambda n: F.slice(w, F.lit(n), F.greatest(F.size(w), F.lit(1)))
    runs = F.array_distinct(F.array_compact(F.zip_with(F.zip_with(w, onward(2), lambda x, y: F.concat(x, F.lit(" "), y)), onward(3), lambda x, y: F.concat(x, F.lit(" "), y))))
    long = each.where(F.size("_words") >= 5).select("_id", "_item", F.array_join(F.slice("_words", 2, 3), " ").alias("_run"))
    one = (F.size("_words") == 1) & ~F.col("_item").rlike("[ \n]")
    few_words = each.where(F.size("_words") < 5)
    inside = few_words.where(one).select("_id", "_item")
    by_word = inside.count() <= FEW_ITEMS
    short = (few_words.where(~one) if by_word else few_words).select("_id", "_item")
    holds = F.contains("_text", F.col("_item"))
    if long.count() <= FEW_ITEMS:
        found = own.withColumn("_run", F.explode(runs)).join(F.broadcast(long), "_run").where(holds).select("_key", "_id")
    else:  # runs are shuffled without their texts, which those that meet get back
        run = F.xxhash64("_run")
        met = own.select("_key", F.explode(runs).alias("_run")).select("_key", run.alias("_h")).join(long.withColumn("_h", run).select("_h", "_id", "_item"), "_h").drop("_h").distinct()
        found = met.withColumnRenamed("_key", "_of").join(own, F.col("_of").eqNullSafe(F.col("_key"))).where(holds).select("_key", "_id")
    near = own.join(F.broadcast(short) if short.count() <= FEW_ITEMS else short.hint("shuffle_replicate_nl"), holds).select("_key", "_id")
    found = found.unionByName(near)
    if by_word:
        found = found.unionByName(_inside_words(own, inside))
    if not own.groupBy("_key").count().where("count > 1").isEmpty():
        found = found.distinct()
    several = checkpointed(keys.groupBy("_item_key").count().where("count > 1").select("_item_key"))
    told = lambda k: found.join(F.broadcast(k) if few else k.hint("merge"), "_id").select("_key", "_item_key")
    few = keys.count() <= FEW_KEYS
    if several.isEmpty():
        out = told(keys)
    else:
        of = lambda how: keys.join(several.withColumnRenamed("_item_key", "_k"), F.col("_k").eqNullSafe(F.col("_item_key")), how).select("_id", "_item_key")
        out = told(of("left_anti")).unionByName(told(of("left_semi")).distinct())
    return out.select(F.col("_key").alias(key), F.col("_item_key").alias(item_key))


@dataclass(frozen=True)
class Fingerprint:
    """A product that text may use: prefixes of names, a pattern that recognises it and patterns with credentials.

    Credential patterns have named groups; each group gives credentials of that name.
    """

    product: str
    prefixes: tuple[str, ...] = ()
    recognised_by: str | None = None
    credentials: tuple[str, ...] = ()

    def groups(self) -> list[tuple[str, str, int]]:
        """(pattern without names, credential name, group number)."""
        out = []
        for p in self.credentials:
            names = re.compile(p).groupindex
            if not names:
                raise ValueError(f"{self.product}: a credential pattern needs named groups")
            out += [(re.sub(r"\(\?P<\w+>", "(", p), name, n) for name, n in names.items()]
        return out


def products(df: DataFrame, keys: Sequence[str], text: str, known: Sequence[Fingerprint]) -> DataFrame:
    """(keys, product, by) of the products that a text names or is recognised by.

    A prefix counts where no further name character follows it.
    """
    if len({k.product for k in known}) != len(known):
        raise ValueError("product names must be unique")
    hits = []
    for k in known:
        prefix = "|".join(re.escape(p) for p in k.prefixes)
        by_prefix = F.col(text).rlike(f"(?:{prefix})(?:[^A-Za-z0-9_]|$)") if k.prefixes else F.lit(False)
        by_pattern = F.col(text).rlike(k.recognised_by) if k.recognised_by else F.lit(False)
        hits.append(F.struct(F.lit(k.product).alias("product"), F.when(by_prefix, "prefix").when(by_pattern, "pattern").alias("by")))
    return df.select(*keys, F.explode(F.filter(F.array(*hits), lambda h: h["by"].isNotNull())).alias("h")).select(*keys, "h.product", "h.by")


def _named(product: str, name: str):
    return lambda v: F.struct(F.lit(product).alias("product"), F.lit(name).alias("name"), v.alias("value"))


def credentials(df: DataFrame, keys: Sequence[str], text: str, known: Sequence[Fingerprint]) -> DataFrame:
    """(keys, product, name, value): every match of every named group."""
    parts = []
    for k in known:
        for pattern, name, n in k.groups():
            parts.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(n)), _named(k.product, name)))
    return df.select(*keys, F.explode(F.flatten(F.array(*parts))).alias("c")).select(*keys, "c.*").where("value <> ''")


def ascii_runs(data: bytes, least: int = 4) -> list[str]:
    """Printable runs of a binary, in Latin-1 and in UTF-16LE."""
    one = [m.decode("latin-1") for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, data)]
    two = [m.decode("utf-16-le") for m in re.findall(rb"(?:[\x20-\x7e]\x00){%d,}" % least, data)]
    return one + two


def _members(name: str, data: bytes, depth: int, most: int) -> Iterator[tuple[str, bytes]]:
    """Entries of an archive, archives inside it as well; anything else is itself. Encrypted or broken entries are left out."""
    if depth < 2 and data[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for entry in z.infolist():
                    if entry.is_dir() or entry.file_size > most or entry.filename.rpartition(".")[2].lower() in MEDIA:
                        continue
                    try:
                        yield from _members(f"{name}!{entry.filename}", z.read(entry), depth + 1, most)
                    except (RuntimeError, zipfile.BadZipFile, NotImplementedError, OSError):
                        continue
            return
        except zipfile.BadZipFile:
            pass
    yield name, data


def _strings(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for entry, content in _members(name, data or b"", 0, MOST_BLOB):
                runs = ascii_runs(content, least)
                for lo in range(0, len(runs), 10_000):
                    part = runs[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array([entry] * len(part), pa.string()), pa.array(part, pa.string())], names=["path", "entry", "value"])


def binary_strings(files: DataFrame, least: int = 4) -> DataFrame:
    """(path, entry, value): printable runs in files (path, content) and in the entries of archives."""
    return files.select("path", "content").mapInArrow(lambda b: _strings(b, least), "path string, entry string, value string")


_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_COMMENTS = re.compile(rf"({_STRINGS})|//[^\n]*|/\*.*?\*/", re.S)
_SIGNS = re.compile(rf"{_STRINGS}|[^\"'()\[\]{{}},]+|.", re.S)


def call_arguments(text: str, name: str) -> list[list[str]]:
    """Arguments of the calls of a function: split at top-level commas, comments left out, strings kept whole."""
    out = []
    clean = _COMMENTS.sub(lambda m: m[1] or " ", text)
    for m in re.finditer(rf"(?<![\w$]){re.escape(name)}\s*\(", clean):
        depth, args = 0, [""]
        for sign in _SIGNS.finditer(clean, m.end()):
            c = sign[0]
            if c in ("(", "[", "{"):
                depth += 1
            elif c in (")", "]", "}"):
                depth -= 1
                if depth < 0:
                    out.append([a.strip() for a in args] if "".join(args).strip() else [])
                    break
            if c == "," and depth == 0:
                args.append("")
            else:
                args[-1] += c
    return out


def calls(df: DataFrame, keys: Sequence[str], text: str, name: str) -> DataFrame:
    """(keys, call, arguments) of every call of a function in source texts; Arrow batches, no shuffle."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, args = [], [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                for n, a in enumerate(call_arguments(t or "", name)):
                    at.append(i)
                    numbers.append(n)
                    args.append(a)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(index) for i in range(len(keys))] + [pa.array(numbers, pa.int32()), pa.array(args, pa.list_(pa.string()))], names=[*keys, "call", "arguments"])

    return df.select(*keys, text).mapInArrow(run, f"{schema}, call int, arguments array<string>")
