"""Repair of the structure of conversations by a dynamic program over secondary-sorted turns.

Rows are dealt by conversation and sorted by turn inside a task, and one pass over the Arrow batches carries the state of
the program from row to row and batch to batch. The roles that a conversation may have are an automaton of four states
(nothing yet, after system, user or assistant); the program keeps for each state the least cost of ending there and, of
the edits of equal cost, the least in ASCII order. Costs count from the least state and stop where no continuation can
win, so all states of the program are a small finite set and a row is one look-up in a table that fills as it is used.

A conversation whose rows go beyond GIANT_ROWS or GIANT_CHARS is not held by the task. It is repaired in sorted passes of
its own, each with bounded memory: forward, where packed backpointers (4 bytes a row) are spilled as rows of blocks, which
Spark writes to the shared folder; backward over the blocks, which gives one edit a row; and forward again over rows and
edits, which gives the repaired text's digest. Repeats in it are found by a window over equal rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.storage import checkpointed

#: Costs of edits: to set a role, to delete a row, to insert one, to leave a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and characters of a conversation that a task holds, and rows of a block of backpointers.
GIANT_ROWS, GIANT_CHARS, BLOCK = 100_000, 64_000_000, 65_536
#: Of states of one row, one that costs more than the least by this never wins: from any state two inserts, a deletion or one more insert lead to any other's continuation.
HOPELESS = 2 * INSERT + max(DELETE, INSERT)
#: Giant conversations whose ids may be broadcast (some 20 bytes each).
FEW_GIANTS = 100_000

#: Number of the block that has the figures of a giant conversation and what follows its last row.
_END = 1 << 40

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
START, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The user or assistant that may follow a state, and all pairs of roles that may stand side by side.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LEGAL = {"su", "ua", "au"}
#: Edits of one row: up to two inserts before it, then what is done with it. Their order is that of ASCII.
_EDITS = sorted("I" * n + x for n in range(3) for x in "DKR")

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_BLANK, _DUPLICATE, _CUT = 1, 2, 3


@lru_cache(maxsize=None)
def _step(states: tuple, kind: int, truncated: bool, must_go: bool) -> tuple[tuple, int, bytes]:
    """One row: the states after it, the least cost added, and for each state a byte (state before, edit).

    ``states`` has (cost above the least, rank) for each state or None; ``kind`` is the row's own state or START for
    another role. Edits have as many parts as rows whatever the state, so the ranks of the states before and then the
    last edits decide ASCII order.
    """
    best: list = [None] * 4
    for before, known in enumerate(states):
        if known is None:
            continue
        cost, rank = known
        at = before
        for n in range(3):
            if n:
                at, cost = _NEXT[at], cost + INSERT
            ways = [("D", at, DELETE)]
            if not must_go:
                extra = TRUNCATED if truncated else 0
                if kind == _NEXT[at] or (kind == SYSTEM and at == START):
                    ways.append(("K", kind, extra))
                ways.append(("R", _NEXT[at], REROLE + extra))
            for what, to, price in ways:
                edit = _EDITS.index("I" * n + what)
                new = (cost + price, rank, edit, before)
                if best[to] is None or new < best[to]:
                    best[to] = new
    least = min(b[0] for b in best if b)
    order = {b[1:3]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
    after = tuple((b[0] - least, order[b[1:3]]) if b and b[0] - least <= HOPELESS else None for b in best)
    return after, least, bytes(b[2] << 2 | b[3] if b else 255 for b in best)


_FIRST = ((0, 0), None, None, None)


def _last(states: tuple) -> tuple[int, int, str]:
    """(cost above the least, state, inserts) of the best end: nothing, or after an assistant."""
    inserts = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    cost, _, state = min((known[0] + INSERT * len(inserts[s]), known[1], s) for s, known in enumerate(states) if known)
    return cost, state, inserts[state]


def _edits(back: list[bytes], state: int) -> list[str]:
    """The edits of rows from their backpointers and the state after the last; the state before the first is START."""
    out = []
    for pointers in reversed(back):
        pointer = pointers[state]
        state = pointer & 3
        out.append(_EDITS[pointer >> 2])
    out.reverse()
    return out


class _Repaired:
    """Digest of the repaired rows, joined by line ends."""

    def __init__(self) -> None:
        self.sha, self.state, self.any = hashlib.sha256(), START, False

    def _row(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def apply(self, edit: str, role: str = "", text: str = "") -> None:
        """One row's edit; trailing inserts are an edit without a row."""
        for what in edit:
            if what == "D":
                continue
            self.state = _INITIALS[role[:1]] if what == "K" else _NEXT[self.state]
            self._row(role if what == "K" else _ROLES[self.state], "" if what == "I" else text)


class _Counts:
    """What is counted of a conversation's rows in their order, and the program's state."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.distinct = 0
        self.first = self.last = self.initial = None
        self.states = _FIRST

    def row(self, turn, role: str, fault: int) -> bytes:
        """Counts a row and returns its backpointers."""
        if turn is not None and (self.last is None or turn != self.last):
            self.distinct += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.blank += fault == _BLANK
        self.duplicate += fault == _DUPLICATE
        self.truncated += fault == _CUT
        self.illegal += self.initial is not None and self.initial + role[:1] not in _LEGAL
        self.initial = role[:1]
        self.states, cost, back = _step(self.states, _INITIALS.get(role[:1], START), fault == _CUT, fault in (_BLANK, _DUPLICATE))
        self.cost += cost
        return back

    def figures(self) -> tuple:
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _fault(text: str, duplicate: bool) -> int:
    body = text.rstrip(BLANKS)
    return _BLANK if not body else _DUPLICATE if duplicate else 0 if body[-1] in ".!?" else _CUT


class _Conversation:
    """A conversation that is held until its last row."""

    def __init__(self) -> None:
        self.counts, self.rows, self.back, self.seen, self.chars = _Counts(), [], [], set(), 0

    def row(self, turn, role: str, text: str) -> None:
        self.back.append(self.counts.row(turn, role, _fault(text, (role, text) in self.seen)))
        self.seen.add((role, text))
        self.rows.append((role, text))
        self.chars += len(text)

    def result(self) -> tuple:
        cost, state, inserts = _last(self.counts.states)
        edits, done = _edits(self.back, state), _Repaired()
        for edit, (role, text) in zip(edits, self.rows, strict=True):
            done.apply(edit, role, text)
        done.apply(inserts)
        return *self.counts.figures(), self.counts.cost + cost, "".join(edits) + inserts, done.sha.hexdigest()


_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def _rows(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    """The rows of the frames one by one; ids and turns come as strings, since pandas has no null among integers."""
    return chain.from_iterable(zip(*(f[n].tolist() for n in names), strict=True) for f in frames)


def _frame(rows: list[tuple], names: list[str], others: tuple[str, ...]) -> pd.DataFrame:
    """Rows under their names: whole numbers or null but for the columns named last."""
    columns = zip(*rows, strict=True)
    return pd.DataFrame({n: list(c) if n in others else pd.array(list(c), dtype="Int64") for n, c in zip(names, columns, strict=True)})


def _stream(frames: Iterator[pd.DataFrame], giant_rows: int, giant_chars: int) -> Iterator[pd.DataFrame]:
    """Results of conversations whose rows come together and in order; a giant one gives a row that only names it."""
    out: list[tuple] = []
    nothing = object()
    conv, held = nothing, None
    for conv_id, turn, role, text, present in chain(_rows(frames, ["conv_id", "turn", "role", "text", "present"]), [(nothing,) * 5]):
        conv_id, turn = (conv_id, None) if conv_id is nothing else (_number(conv_id), _number(turn))
        if conv_id is nothing or conv is nothing or conv_id != conv:
            if conv is not nothing:
                out.append((conv, *(held.result() if held else (0, 0, 0, 0, 0, 0, "", "")), held is None))
            if len(out) >= 2000 or (out and conv_id is nothing):
                yield _frame(out, [*_NAMES, "giant"], ("audit", "repaired_sha256", "giant"))
                out = []
            conv, held = conv_id, _Conversation()
        if conv_id is not nothing and held is not None and present:
            held.row(turn, role, text)
            if len(held.rows) > giant_rows or held.chars > giant_chars:
                held = None


def _forward(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Of giant conversations in order of position: blocks of backpointers, and a last row with figures and the state to end in."""

    def ended(conv, counts, number, back):
        cost, state, inserts = _last(counts.states)
        rest = [(conv, number, b"".join(back), None, None, *(None,) * 6)] if back else []
        return [*rest, (conv, _END, b"", state, inserts, *counts.figures(), counts.cost + cost)]

    columns = ["conv_id", "block", "back", "state", "inserts", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    frame = lambda rows: _frame(rows, columns, ("back", "inserts"))
    conv = counts = None
    number, back = 0, []
    for conv_id, turn, role, text, repeated in _rows(frames, ["conv_id", "turn", "role", "text", "repeated"]):
        conv_id, turn = _number(conv_id), _number(turn)
        if counts is None or conv_id != conv:
            if counts is not None:
                yield frame(ended(conv, counts, number, back))
            conv, counts, number, back = conv_id, _Counts(), 0, []
        back.append(counts.row(turn, role, _fault(text, repeated)))
        if len(back) == size:
            yield frame([(conv, number, b"".join(back), None, None, *(None,) * 6)])
            number, back = number + 1, []
    if counts is not None:
        yield frame(ended(conv, counts, number, back))


def _backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of giant conversations, a block a row, from blocks in falling order; the first names the state to end in."""
    state = START
    for conv_id, block, back, end, inserts in _rows(frames, ["conv_id", "block", "back", "state", "inserts"]):
        if inserts is not None:
            state, edits = int(end), inserts
        else:
            each = [back[i : i + 4] for i in range(0, len(back), 4)]
            found = _edits(each, state)
            state, edits = _before(each, state), ",".join(found)
        yield pd.DataFrame({"conv_id": pd.array([_number(conv_id)], dtype="Int64"), "block": [int(block)], "edits": [edits]})


def _before(back: list[bytes], state: int) -> int:
    for pointers in reversed(back):
        state = pointers[state] & 3
    return state


def _digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(conv_id, audit, repaired_sha256) of giant conversations, from rows that follow the edits of their block."""
    nothing = object()
    conv, done, audit, edits = nothing, _Repaired(), [], iter(())
    for conv_id, role, text, found in chain(_rows(frames, ["conv_id", "role", "text", "edits"]), [(nothing,) * 4]):
        conv_id = conv_id if conv_id is nothing else _number(conv_id)
        if conv_id is nothing or conv is nothing or conv_id != conv:
            if conv is not nothing:
                yield pd.DataFrame({"conv_id": pd.array([conv], dtype="Int64"), "audit": ["".join(audit)], "repaired_sha256": [done.sha.hexdigest()]})
            conv, done, audit, edits = conv_id, _Repaired(), [], iter(())
        if conv_id is nothing:
            break
        if found is None:
            done.apply(next(edits), role, text)
        else:
            if role is not None:  # what follows the last row
                done.apply(found)
            audit.append(found.replace(",", ""))
            edits = iter(found.split(","))


def _named(*columns: str) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]


def _giants(rows: DataFrame, block: int) -> DataFrame:
    """Results of giant conversations, by passes over sorted rows with bounded memory."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    again = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy("turn")
    flagged = rows.where("present").select("conv_id", "turn", "role", "text", (F.row_number().over(again) > 1).alias("repeated"))
    placed = checkpointed(flagged.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order, "repeated")).cast("long") - 1))
    forward = placed.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    figures = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    blocks = checkpointed(forward.select(*_named("conv_id", "turn"), "role", "text", "repeated").mapInPandas(lambda frames: _forward(frames, block), f"conv_id long, block long, back binary, state long, inserts string, {figures}"))
    turned = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    edits = checkpointed(turned.select(*_named("conv_id"), "block", "back", "state", "inserts").mapInPandas(_backward, "conv_id long, block long, edits string"))
    last = F.when(F.col("block") == _END, F.lit(""))
    heads = edits.select("conv_id", (F.col("block") * block).alias("position"), F.lit(0).alias("kind"), last.alias("role"), F.lit(None).cast("string").alias("text"), "edits")
    bodies = placed.select("conv_id", "position", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("edits"))
    both = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "position", "kind")
    digests = both.select(*_named("conv_id"), "role", "text", "edits").mapInPandas(_digested, "conv_id long, audit string, repaired_sha256 string")
    counted = blocks.where("state is not null").select(F.col("conv_id").alias("_conv"), *(c.split()[0] for c in figures.split(", ")))
    return counted.join(digests, F.col("_conv").eqNullSafe(F.col("conv_id"))).select(*_NAMES)


def repair(turns: DataFrame, present: Column | None = None, *, giant_rows: int = GIANT_ROWS, giant_chars: int = GIANT_CHARS, block: int = BLOCK) -> DataFrame:
    """Per conversation: gaps, counts of faults, and the cheapest edits that give it the roles ``(s?(ua)+)?``.

    ``turns`` has conv_id, turn, role and text; other columns are not read. A null role or text is one space, a null
    conv_id is a conversation, null turns come first; rows of one turn go by role and text. Where ``present`` is false
    a row only names its conversation, which has a result of zeros if it has no other. An empty table gives an empty
    one. ``audit`` has the initials of the edits (Keep, Rerole, Delete, Insert) in order, of those of least cost the
    first in ASCII order; ``repaired_sha256`` is of the repaired rows ``role:text``, joined by line ends. A conversation of
    more rows or characters than the limits is repaired in passes of its own, with the same result.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), (F.lit(True) if present is None else present).alias("present"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    found = checkpointed(dealt.select(*_named("conv_id", "turn"), "role", "text", "present").mapInPandas(lambda frames: _stream(frames, giant_rows, giant_chars), RESULT + ", giant boolean"))
    done = found.where("not giant").drop("giant")
    giants = found.where("giant").select(F.col("conv_id").alias("_giant"))
    number = giants.limit(FEW_GIANTS + 1).count()
    if not number:
        return done
    theirs = rows.join(F.broadcast(giants) if number <= FEW_GIANTS else giants, F.col("conv_id").eqNullSafe(F.col("_giant")), "left_semi")
    return done.unionByName(_giants(theirs, block))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, present) of conversations with a fault in some, chosen by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (present is false), 1 empties the text, 2 takes its ``.!?``, 3 repeats it, 4 sets the role user.
    A null in any column is one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    text = F.when(fault <= 1, "").when(fault == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(fault == 4, "user").otherwise(space("role"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (fault != 0).alias("present"), F.explode(copies).alias("_copy")).drop("_copy")
