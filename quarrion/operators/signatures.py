"""Error messages told by signatures: one automaton finds all of them in one pass, rules over its hits decide.

The automaton (Aho-Corasick) reads a text once, however many signatures there are, and gives every occurrence with its
place. What a hit means depends on what stands elsewhere in the message, so the rules are expressions over the hits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signatures of a device's failures.
DEVICE = (
    "device offline", "device unauthorized", "failed to run abb_exec", "abb_exec. error: closed", "connect error for write: closed", "error: closed", "transport error",
    "transport is closing", "transport endpoint is not connected", "no devices/emulators found", "device not found", "failed to get feature set", "fork failed",
    "cannot fork", "unable to fork", "resource temporarily unavailable", "not enough space", "no space left on device", "install_failed_insufficient_storage",
    "install_failed_user_restricted", "install_failed_blocked_by_admin", "package manager check failed", "can't find service: package",
    "could not access the package manager", "adb install timeout", "adb uninstall timeout", "adb shell timeout", "connection reset by peer", "protocol fault",
)
# Signatures of a package that cannot be installed.
PACKAGE = (
    "install_parse_failed", "install_failed_invalid_apk", "install_failed_version_downgrade", "install_failed_update_incompatible", "install_failed_no_certificates",
    "install_failed_older_sdk", "install_failed_test_only", "install_failed_duplicate_package", "failed to parse apk", "apk file not found",
)
# Signatures that tell of a device at run time, and those that do so beside a mention of the bridge or its shell.
RUNTIME = ("device offline", "device unauthorized", "failed to run abb_exec", "failed to get feature set", "no devices/emulators found", "device not found")
RUNTIME_BESIDE = (
    "transport is closing", "transport endpoint is not connected", "transport error", "connection reset by peer", "protocol fault", "fork failed", "cannot fork",
    "unable to fork", "resource temporarily unavailable",
)
# Words that give a hit its context.
BRIDGE, SHELL, NAMED_DEVICE, NOT_FOUND = ("adb", "abb_exec"), "shell:", "device '", " not found"
PLAN_ERROR, AGENT_ERROR, NO_WINDOW, SHELL_TIMEOUT, CLOSED = "plan model error:", "phone agent error:", "no output from dumpsys window", "adb shell timeout", "closed"

SIGNATURES = tuple(dict.fromkeys((*DEVICE, *PACKAGE, *RUNTIME, *RUNTIME_BESIDE, *BRIDGE, SHELL, NAMED_DEVICE, NOT_FOUND, PLAN_ERROR, AGENT_ERROR, NO_WINDOW, SHELL_TIMEOUT, CLOSED)))

HITS = "array<struct<signature: string, at: int>>"


def with_hits(rows: DataFrame, text: str, signatures: Sequence[str] = SIGNATURES) -> DataFrame:
    """rows with ``hits``, all occurrences (signature, at) in the trimmed text in small letters, by place, then signature.

    Occurrences may overlap. A null text has none. No shuffle; a text is read once.
    """
    if not signatures or "" in signatures:
        raise ValueError("signatures must not be empty")
    own = rows.drop("hits").withColumn("_text", F.lower(F.expr(rf"regexp_replace(regexp_replace(cast(`{text}` as string), '^\\s+', ''), '\\s+$', '')")))
    kind = pa.list_(pa.struct([("signature", pa.string()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for s in signatures:
            machine.add_word(s, s)
        machine.make_automaton()
        for batch in batches:
            found = []
            for t in batch.column("_text").to_pylist():
                hits = sorted((end - len(s) + 1, s) for end, s in machine.iter(t or ""))
                found.append([{"signature": s, "at": at} for at, s in hits])
            at = batch.schema.names.index("_text")
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[at], names[at] = pa.array(found, kind), "hits"
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "_text")
    return own.select(*(f"`{c}`" for c in own.columns if c != "_text"), "_text").mapInArrow(run, f"{schema}, hits {HITS}")


def _any(hits: Column | str, *signatures: str) -> Column:
    return F.exists(hits, lambda h: h["signature"].isin(*signatures))


def _starts(hits: Column | str, signature: str) -> Column:
    return F.exists(hits, lambda h: (h["signature"] == signature) & (h["at"] == 0))


def is_device_error(hits: Column | str = "hits") -> Column:
    """A device's failure: a signature, or a device named in quotes that is not found."""
    return (_any(hits, NAMED_DEVICE) & _any(hits, NOT_FOUND)) | _any(hits, *DEVICE)


def is_package_error(hits: Column | str = "hits") -> Column:
    return _any(hits, *PACKAGE)


def is_runtime_error(hits: Column | str = "hits") -> Column:
    """A device's failure at run time. What a planning model reports is none, whatever it says."""
    bridge = _any(hits, *BRIDGE)
    strong = _any(hits, *RUNTIME) | (_any(hits, NAMED_DEVICE) & _any(hits, NOT_FOUND)) | (_starts(hits, AGENT_ERROR) & _any(hits, NO_WINDOW))
    return ~_starts(hits, PLAN_ERROR) & (strong | ((bridge | _any(hits, SHELL)) & _any(hits, *RUNTIME_BESIDE)) | _any(hits, SHELL_TIMEOUT) | (_any(hits, CLOSED) & bridge))


def classified(rows: DataFrame, text: str) -> DataFrame:
    """rows with hits, device_error, package_error, runtime_error and kind: device before package before runtime, else other."""
    device, package, runtime = is_device_error(), is_package_error(), is_runtime_error()
    marks = {"device_error": device, "package_error": package, "runtime_error": runtime}
    return with_hits(rows, text).withColumns({**marks, "kind": F.when(device, "device").when(package, "package").when(runtime, "runtime").otherwise("other")})
