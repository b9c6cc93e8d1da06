"""Text expressions: normalising, list codecs, digests, formats and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_SPLIT = {"comma": r"[,]", "rule": r"[,\s]+", "cluster": r"[\s,;]+", "decode": r"[,;\n\r]+"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """A column trimmed, with blank values as null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)) == "", F.lit(True))


def normal_md5(c: Column | str) -> Column:
    """A digest lowered and trimmed; null if it is not 32 hex digits."""
    x = F.lower(F.trim(col(c)))
    return F.when(x.rlike("^[0-9a-f]{32}$"), x)


def pieces(c: Column | str, kind: str = "comma") -> Column:
    """The non-blank trimmed pieces of a list in text form; ``kind`` names the delimiters (LIST_SPLIT)."""
    parts = F.transform(F.split(F.coalesce(col(c).cast("string"), F.lit("")), LIST_SPLIT[kind]), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def decoded_list(c: Column | str) -> Column:
    """A JSON array of scalars, or else a text split at commas, semicolons and line ends."""
    parsed = F.filter(F.transform(F.from_json(col(c), "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(col(c).rlike(r"^\s*\["), F.coalesce(parsed, pieces(c, "decode"))).otherwise(pieces(c, "decode"))


def joined(c: Column | str, by: str = ",") -> Column:
    """A list as text, blanks dropped."""
    return F.array_join(F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: x != ""), by)


def default_label(name: Column | str, key: Column | str, prefix: str) -> Column:
    """The name, or else the prefix with the first eight characters of the key."""
    return F.coalesce(col(name), F.concat(F.lit(prefix), F.left(col(key), F.lit(8))))


def stem(c: Column | str, trivial: tuple[str, ...] = ()) -> Column:
    """A name without the digits, punctuation and underscores at its end; null if nothing telling is left."""
    x = F.regexp_replace(col(c), r"(?U)[\d\W_]+$", "")
    return F.when((x != "") & ~F.lower(x).isin(*trivial, ""), x)


def looks_random(c: Column | str) -> Column:
    """Names that a generator made: six characters or more with a digit, few vowels, or five consonants in a row."""
    x = F.lower(col(c))
    letters = F.length(F.regexp_replace(x, "[^a-z]", ""))
    vowels = F.length(F.regexp_replace(x, "[^aeiou]", ""))
    few = (letters > 0) & (vowels < F.lit(0.28) * letters)
    return x.rlike("^[a-z0-9]{6,}$") & (x.rlike("[0-9]") | few | x.rlike("[bcdfghjklmnpqrstvwxyz]{5}"))


def package_root(c: Column | str) -> Column:
    """The first three segments of a dotted name (all but the last of a short one), random ones as a star."""
    parts = F.split(col(c), r"\.")
    kept = F.slice(parts, F.lit(1), F.when(F.size(parts) <= 3, F.greatest(F.size(parts) - 1, F.lit(0))).otherwise(3))
    return F.array_join(F.transform(kept, lambda s: F.when(looks_random(s), F.lit("*")).otherwise(s)), ".")


def suffix_skeleton(c: Column | str, inner: bool = True) -> Column:
    """The last two segments of a dotted name; ``inner`` cuts what follows a dollar sign first."""
    x = F.substring_index(col(c), "$", 1) if inner else col(c)
    parts = F.split(x, r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "."))


def full_component(package: Column | str, c: Column | str) -> Column:
    """A component name with the package in front of a leading dot."""
    return F.when(F.startswith(col(c), F.lit(".")), F.concat(col(package), col(c))).otherwise(col(c))


def native_library(c: Column | str, framework: tuple[str, ...] = ()) -> Column:
    """The file name of a native library, null for framework libraries and hashed names."""
    x = F.regexp_extract(col(c), r"([^/]+\.so)$", 1)
    return F.when((x != "") & ~x.isin(*framework, "") & ~x.rlike("^lib[0-9a-f]{6,}\\.so$"), x)


def route(c: Column | str) -> Column:
    """A page route without quotes, escaped slashes, query, fragment, doubled slashes and a .vue ending."""
    x = F.regexp_replace(F.trim(col(c)), "[\"'`]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\\/", "/"), r"[?#].*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(x, "/{2,}", "/"), r"\.vue$", ""), F.lit(""))


def set_key(parts: Column, *context: Column) -> Column:
    """SHA-256 of the context and the sorted parts, joined by NUL."""
    return F.sha2(F.concat_ws("\0", *context, F.array_sort(parts)), 256)


def short_id(parts: Column) -> Column:
    """The first twelve hex digits of the SHA-256 of the sorted parts joined by semicolons."""
    return F.left(F.sha2(F.array_join(F.array_sort(parts), ";"), 256), F.lit(12))


def component_fingerprint(package: Column | str, names: Column | str) -> Column:
    """MD5 of the sorted distinct component names with the package taken out."""
    bare = F.transform(col(names), lambda x: F.replace(x, col(package), F.lit("")))
    return F.md5(F.array_join(F.array_sort(F.array_distinct(bare)), "\n"))


def size_label(c: Column | str) -> Column:
    """Bytes in steps of 1024 with two decimals."""
    n = col(c).cast("double")
    out = F.concat(F.format_number(n / 1024**4, 2), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), F.concat(F.regexp_replace(F.format_number(n / 1024**power, 2), ",", ""), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n >= 0, out)


def truthy(c: Column | str, words: tuple[str, ...] = ("1", "true", "yes", "y", "是")) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*words), F.lit(False))


def printable(c: Column | str) -> Column:
    """Control and zero-width characters out, white space as single blanks, trimmed."""
    x = F.regexp_replace(col(c), r"[\x00-\x08\x0E-\x1F\x7F​-‏﻿]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clipped(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def any_time(c: Column | str) -> Column:
    """Seconds or milliseconds since 1970 (from 1e11 on), ISO or two date formats; null for anything else."""
    x = F.trim(col(c).cast("string"))
    number = F.try_to_number(x, F.lit("9999999999999999.999999")).cast("double")
    number = F.coalesce(number, x.try_cast("double"))
    seconds = F.when(F.abs(number) >= 1e11, number / 1000).otherwise(number)
    formats = [F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")]
    return F.coalesce(F.timestamp_micros((seconds * 1000000).cast("long")), *formats, F.try_to_timestamp(x))


def snippet(c: Column | str, pattern: str, before: int = 80, after: int = 220) -> Column:
    """The text around the first match of a pattern, null without a match."""
    at = F.regexp_instr(col(c), F.lit(pattern))
    return F.when(at > 0, F.substring(col(c), F.greatest(at - before, F.lit(1)), F.lit(before + after)))


def line_of(c: Column | str, pattern: str) -> Column:
    """The line number of the first match of a pattern, null without a match."""
    at = F.regexp_instr(col(c), F.lit(pattern))
    head = F.substring(col(c), F.lit(1), at - 1)
    return F.when(at > 0, F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1)


def first_pattern(c: Column | str, named: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first pattern, in the given order, that is found."""
    return F.coalesce(*(F.when(col(c).rlike(p), F.lit(n)) for n, p in named), F.lit(other))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Shared over all distinct elements; two empty sets give ``both_empty``, one empty set 0, no set null.

    ``a`` stands here three times: if it is dear to make, make it a column first.
    """
    union = F.array_size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.array_size(F.array_intersect(a, b)) / union)


def normal_instruction(c: Column | str) -> Column:
    """A machine instruction with registers, stack slots and constants as placeholders."""
    x = F.regexp_replace(F.lower(F.trim(col(c))), r"\[(?:sp|x29|fp|rbp|rsp)[^\]]*\]", "[stack]")
    x = F.regexp_replace(x, r"#?-?\b0x[0-9a-f]+\b|#-?\d+\b", "imm")
    return F.regexp_replace(x, r"\b[xwrsdqv]\d{1,2}\b", "reg")
