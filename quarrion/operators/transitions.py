"""State transitions of keyed rows: compare-and-set, expiry, allocation, review, cascades.

Each returns the new table or the rows that change. A job that writes them runs as the single writer
of its table (a batch job, or one micro-batch at a time), which takes the place of row locks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_where(rows: DataFrame, condition: Column, values: Mapping[str, object]) -> DataFrame:
    """Compare-and-set: rows that meet the condition get the values; ``changed`` tells which did."""
    hit = F.coalesce(condition, F.lit(False))
    new = {c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, v in values.items()}
    return rows.withColumn("changed", hit).withColumns(new)


def patched(rows: DataFrame, patch: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Partial update by key: only allowed columns of the patch count, nulls in it leave the old value."""
    use = [c for c in allowed if c in patch.columns and c in rows.columns and c != key]
    p = patch.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in use))
    met = rows.join(p, rows[key] == p["_k"], "left")
    return met.select(*(F.coalesce(f"_{c}", c).alias(c) if c in use else F.col(c) for c in rows.columns))


def is_fresh(at: str, now, seconds: int) -> Column:
    """A heartbeat not older than so many seconds; a missing one is not fresh."""
    return F.coalesce(F.col(at) >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))


def expired(rows: DataFrame, at: str, now, seconds: int, state: str, running: Sequence[str]) -> DataFrame:
    """The rows in a running state whose last sign of life is older than so many seconds."""
    return rows.where(F.col(state).isin(*running) & (F.col(at) < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))))


def allocate(jobs: DataFrame, workers: DataFrame, job_order: Sequence[Column], worker_order: Sequence[Column], lanes: Sequence[str] = ()) -> DataFrame:
    """One job for one worker: the n-th job in order meets the n-th worker, inside each lane if there are lanes.

    Without lanes only the first jobs and workers in order, as many as there are of the fewer, are ranked.
    """
    if not lanes:
        pairs = min(jobs.count(), workers.count())
        jobs, workers = jobs.orderBy(*job_order).limit(pairs), workers.orderBy(*worker_order).limit(pairs)
    j = jobs.withColumn("_n", F.row_number().over(Window.partitionBy(*lanes).orderBy(*job_order)))
    w = workers.withColumn("_n", F.row_number().over(Window.partitionBy(*lanes).orderBy(*worker_order)))
    return j.join(w, [*lanes, "_n"]).withColumnRenamed("_n", "turn")


def claimed(rows: DataFrame, condition: Column, key: str, order: Sequence[Column], token: str, most: int, state: str = "status", to: str = "running") -> DataFrame:
    """At most so many rows that meet the condition, first in order, move to a state under an attempt token; keys are unique."""
    first = rows.where(condition).orderBy(*order).limit(most).select(F.col(key).alias("_taken"))
    met = rows.join(F.broadcast(first), rows[key] == first["_taken"], "left")  # ``most`` keys
    taken = F.col("_taken").isNotNull()
    return met.withColumns({state: F.when(taken, F.lit(to)).otherwise(F.col(state)), "token": F.when(taken, F.lit(token))}).drop("_taken")


def finished(rows: DataFrame, results: DataFrame, key: str, state: str = "status") -> DataFrame:
    """Results (key, token, outcome) end a row only if it still carries the same token."""
    r = results.select(F.col(key).alias("_k"), F.col("token").alias("_t"), "outcome")
    met = rows.join(r, (rows[key] == r["_k"]) & (rows["token"] == r["_t"]), "left")
    return met.select(*(F.coalesce("outcome", c).alias(c) if c == state else F.when(F.col("outcome").isNull(), F.col(c)).alias(c) if c == "token" else F.col(c) for c in rows.columns))


def reviewed_upsert(old: DataFrame, new: DataFrame, key: str, state: str, kept: Sequence[str], fresh: str) -> DataFrame:
    """Upsert that leaves rows in a kept state alone; others take the new values and become fresh."""
    rest = [c for c in old.columns if c not in (key, state)]
    a, b = old.alias("a"), new.alias("b")
    frozen = F.coalesce(F.col(f"a.{state}").isin(*kept), F.lit(False))
    untouched = frozen | F.col(f"b.{key}").isNull()
    pick = lambda c: F.when(untouched, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.when(untouched, F.col(f"a.{state}")).otherwise(F.lit(fresh)).alias(state), *(pick(c) for c in rest))


def cascaded(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is gone go with it; those without a parent stay."""
    alive = parents.select(F.col(key).alias("_k")).distinct()
    return children.join(alive, children[foreign] == alive["_k"], "left").where(F.col("_k").isNotNull() | F.col(foreign).isNull()).drop("_k")


def nulled(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is gone lose the reference."""
    alive = parents.select(F.col(key).alias("_k")).distinct()
    return children.join(alive, children[foreign] == alive["_k"], "left").withColumn(foreign, F.col("_k")).drop("_k")


def health(rows: DataFrame, probe: DataFrame, key: str, state: str = "status", busy: Sequence[str] = ("busy",)) -> DataFrame:
    """States by a probe (key, reachable, healthy): offline, quarantined or online; busy rows stay as they are."""
    p = probe.select(F.col(key).alias("_k"), "reachable", "healthy")
    new = F.when(F.col(state).isin(*busy), F.col(state)).when(~F.coalesce("reachable", F.lit(False)), "offline").when(~F.coalesce("healthy", F.lit(False)), "quarantined").otherwise("online")
    return rows.join(p, rows[key] == p["_k"], "left").withColumn(state, new).drop("_k", "reachable", "healthy")
