"""Events in time: step intervals, deduplication, bursts, transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_steps(events: DataFrame, steps: DataFrame, key: str, event_at: str, step_at: str, step_id: str) -> DataFrame:
    """events with the step of their key during which they happened: the last one that began by then.

    Both tables are ordered together by key and time and the step is carried forward: one shuffle and
    no range join. An event at a step's start belongs to that step; of steps with one start the larger
    id counts; events before the first step are dropped.
    """
    names = [c for c in events.columns if c != key]
    e = events.select(key, F.col(event_at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(steps.schema[step_id].dataType).alias("_step"), F.lit(None).cast("timestamp").alias("_start"), F.struct(*names).alias("_row"))
    s = steps.where(F.col(step_at).isNotNull()).select(key, F.col(step_at).alias("_at"), F.lit(0).alias("_kind"), F.col(step_id).alias("_step"), F.col(step_at).cast("timestamp").alias("_start"), F.lit(None).cast(e.schema["_row"].dataType).alias("_row"))
    so_far = Window.partitionBy(key).orderBy("_at", "_kind", "_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = e.unionByName(s).withColumns({"step": F.last("_step", ignorenulls=True).over(so_far), "step_start": F.last("_start", ignorenulls=True).over(so_far)})
    return carried.where("_kind = 1 and step is not null").select(key, "_row.*", "step", "step_start")


def step_bounds(steps: DataFrame, key: str, at: str, order: Sequence[Column]) -> DataFrame:
    """steps with ``until``, the start of the next one in list order; null for the last."""
    return steps.withColumn("until", F.lead(at).over(Window.partitionBy(key).orderBy(*order)))


def assign_by_range(events: DataFrame, steps: DataFrame, key: str, event_at: str, step_at: str, step_id: str) -> DataFrame:
    """The same by a range join with [start, next start); for steps in list order that few events meet."""
    bounds = step_bounds(steps, key, step_at, [F.col(step_at), F.col(step_id)]).select(F.col(key).alias("_k"), F.col(step_id).alias("step"), F.col(step_at).alias("step_start"), "until")
    on = (events[key] == F.col("_k")) & (events[event_at] >= F.col("step_start")) & (F.col("until").isNull() | (events[event_at] < F.col("until")))
    return events.join(bounds, on).drop("_k", "until")


def first_of_each(events: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first event of each composite key; null keys are keys."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def without_bursts(events: DataFrame, keys: Sequence[str], at: str, gap_seconds: float, order: Sequence[str] = ()) -> DataFrame:
    """Events at least a gap after the previous copy, whether that copy was kept or not."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at, *order))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > int(gap_seconds * 1_000_000))).drop("_gap")


def request_pairs(messages: DataFrame, key: str, order: str, kind: str, request: str, response: str, carry: Sequence[str]) -> DataFrame:
    """Each request with the first response before the next request of its key; null without one.

    The fold over a stream is one sort: requests number the transactions, and the first response of a
    transaction answers its request.
    """
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = messages.where(F.col(kind).isin(request, response)).withColumn("transaction", F.sum((F.col(kind) == request).cast("int")).over(so_far)).where("transaction > 0")
    asked = F.col(kind) == request
    answer = F.min(F.when(~asked, F.struct(order, *carry)))
    out = numbered.groupBy(key, "transaction").agg(F.min(F.when(asked, F.struct(order, *carry))).alias("q"), answer.alias("r"), F.count_if(~asked).alias("n_responses"))
    return out.select(key, "transaction", *(F.col(f"q.{c}").alias(f"request_{c}") for c in (order, *carry)), *(F.col(f"r.{c}").alias(f"response_{c}") for c in (order, *carry)), "n_responses", F.col("r").isNotNull().alias("complete"))


def answers_by_frame(messages: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(request, response, carry) of rows (kind, frame, request_frame): a response names the frame of its request; unanswered requests stay.

    Of several responses to one frame the first counts.
    """
    asked = messages.where("kind = 'request'").select(F.col("frame").alias("request"), *carry)
    said = messages.where("kind = 'response'").groupBy(F.col("request_frame").alias("request")).agg(F.min("frame").alias("response"))
    return asked.join(said, "request", "left")


def data_by_stream(messages: DataFrame) -> DataFrame:
    """(request, n_data, n_bytes) of rows (kind, frame, stream, stream_id, size): data frames belong to the request of their stream and id.

    A stream and id have one request; without data its counts are 0, data without a request are left out.
    """
    asked = messages.where("kind = 'request'").groupBy("stream", "stream_id").agg(F.min("frame").alias("request"))
    data = messages.where("kind = 'data'").groupBy("stream", "stream_id").agg(F.count("*").alias("n_data"), F.sum("size").alias("n_bytes"))
    return asked.join(data, ["stream", "stream_id"], "left").select("request", F.coalesce("n_data", F.lit(0)).alias("n_data"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


def sliding(rows: DataFrame, key: str, order: str, value: str, n: int = 4) -> DataFrame:
    """Every run of n consecutive values of a key, joined by blanks; short ends give none."""
    at = Window.partitionBy(key).orderBy(order)
    parts = [F.col(value), *(F.lead(value, i).over(at) for i in range(1, n))]
    runs = rows.select(key, order, *(p.alias(f"_{i}") for i, p in enumerate(parts)))
    return runs.where(F.col(f"_{n - 1}").isNotNull()).select(key, order, F.concat_ws(" ", *(f"_{i}" for i in range(n))).alias("gram"))
