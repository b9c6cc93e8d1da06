import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quarrion.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def repaired(rows):
    """The nine figures of the rows (turn, role, text) of one conversation, by a search backward over whole audit strings."""
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANK)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        """(cost, edits, roles and texts) from row i on, after the given role."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            c, e, r = best(i, after[state], inserts + 1)
            ways.append((c + 3, "I" + e, ((after[state], ""), *r)))
        if i < len(rows):
            c, e, r = best(i + 1, state, 0)
            ways.append((c + 4, "D" + e, r))
            if kinds[i] not in ("blank", "duplicate"):
                extra, (_, role, text) = 3 * (kinds[i] == "truncated"), rows[i]
                if role[:1] == after[state] or (role[:1] == "s" and state == ""):
                    c, e, r = best(i + 1, role[:1], 0)
                    ways.append((c + extra, "K" + e, ((role, text), *r)))
                c, e, r = best(i + 1, after[state], 0)
                ways.append((c + extra + 3, "R" + e, ((after[state], text), *r)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "~", ())

    cost, edits, kept = best(0, "", 0)
    full = {"u": "user", "a": "assistant"}
    text = "\n".join(f"{full.get(r, r)}:{t}" for r, t in kept)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()


def broken(rows):
    """Rows (conv_id, turn, role, text) after damage, by the definition."""
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if n:
            row = (conv, turn, "user" if n == 4 else role, "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text)
            out += [row] * (2 if n == 3 else 1)
    return out


def brute(rows, damage=True):
    convs = {}
    for conv, *rest in broken(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        convs.setdefault(conv, []).append(tuple(rest))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {c: repaired(sorted(convs.get(c, []), key=order)) for c in {r[0] for r in rows}}


def shown(df):
    return {r.conv_id: tuple(r[1:]) for r in df.collect()}


def talks(n, rows, seed=4):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", "", None, "Assistant", "unknown"]
    texts = ["Yes.", "No?", "cut off", "Yes.", " \t", "", None, "é.\n ", "漢", "a.b", "x! ", "Fine! "]
    out = []
    for c in range(n):
        for t in range(rng.randint(1, rows)):
            turn = rng.choice([t, t, t, t + 1, None])
            out.append((c, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}."))
    return out


def test_step_table_matches_a_search_on_all_short_conversations():
    rng = random.Random(1)
    for _ in range(4000):
        rows = [(i, rng.choice(["system", "user", "assistant", "x"]), rng.choice(["A.", "B", "", "C!"]) if rng.random() < 0.5 else f"{rng.random()}.") for i in range(rng.randint(0, 9))]
        held = turns._Conversation()
        for row in rows:
            held.row(*row)
        assert held.result() == repaired(rows)


def test_matches_brute_force(spark):
    rows = talks(300, 12)
    rows += [(None, 1, "user", "Who?"), (None, 2, "assistant", "Nobody."), (-3, None, "user", "q."), (-3, None, "user", "q.")]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "All of it goes.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as present", "2 as cost").repartition(7)
    got = shown(turns.repair(turns.damaged(df), present=F.col("present")))
    assert got == brute(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_without_damage(spark):
    rows = talks(60, 8, seed=9)
    assert shown(turns.repair(spark.createDataFrame(rows, SCHEMA))) == brute(rows, damage=False)


@pytest.mark.parametrize("limits", [{"giant_rows": 3, "block": 4}, {"giant_rows": 0, "block": 1}, {"giant_chars": 10, "block": 2}, {"giant_rows": 5, "block": 65_536}])
def test_giants_give_the_same(spark, limits, monkeypatch):
    rows = talks(40, 30, seed=6) + [(None, 1, "user", "Who?")] * 5
    if limits["block"] == 4:
        monkeypatch.setattr(turns, "FEW_GIANTS", 2)
    assert shown(turns.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), **limits)) == brute(rows, damage=False)


def test_a_long_conversation_over_many_batches(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.random()}" + rng.choice([".", ""])) for t in range(3000)] + [(2, 0, "user", "long " * 200_000 + ".")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = shown(turns.repair(spark.createDataFrame(rows, SCHEMA)))
        again = shown(turns.repair(spark.createDataFrame(rows, SCHEMA), giant_rows=1000, block=250))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = turns._Conversation()
    for _, *row in rows[:-1]:
        held.row(*row)
    assert got[1] == again[1] == held.result() and got[2][6] == "KI"


def test_ids_beyond_doubles_and_the_empty_table(spark):
    big = (1 << 53) + 1
    rows = [(big, big, "user", "a."), (big, big + 1, "assistant", "b."), (None, None, "user", "c."), (big + 1, 0, "user", "d.")]
    got = shown(turns.repair(spark.createDataFrame(rows, SCHEMA)))
    assert set(got) == {big, big + 1, None} and got[big][0] == 0 and got[big][6] == "KK"
    assert turns.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(queries.op13_conversation_repair(spark, sf_dir)) == brute(rows)
