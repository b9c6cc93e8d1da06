"""Streaming forms of the event operators. Each takes a streaming DataFrame and returns one; the caller starts the query."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark, path: str, schema, files_a_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def assign_steps(events: DataFrame, bounds: DataFrame, key: str, at: str) -> DataFrame:
    """Streaming events to static step bounds (key, step, start, until): a stream-static range join."""
    b = bounds.select(F.col(key).alias("_k"), "step", "start", "until")
    on = (events[key] == F.col("_k")) & (events[at] >= F.col("start")) & (F.col("until").isNull() | (events[at] < F.col("until")))
    return events.join(b, on).drop("_k", "until")


def first_of_each(events: DataFrame, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """The first event of each key to arrive; a key is forgotten when the watermark has passed it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def counts(events: DataFrame, at: str, keys: Sequence[str], window: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows of event time; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window, slide) if slide else F.window(at, window), *keys).agg(F.count("*").alias("n"))


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def without_bursts(events: DataFrame, keys: Sequence[str], at: str, gap_seconds: float, late: str = "1 hour") -> DataFrame:
    """Events at least a gap after the previous copy, whether that was kept or not. State: the last time of a key.

    Time is event time: rows later than the watermark are dropped, and a key is forgotten once the watermark
    is a gap beyond its last time, when no row that is still to come could be suppressed.
    """
    gap = round(gap_seconds * 1_000_000)

    def suppress(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        times = _micros(rows[at])
        before = state.get[0] if state.exists else None
        keep = np.diff(times, prepend=times[0] - gap - 1 if before is None else before) > gap
        last = int(times[-1]) if before is None else max(before, int(times[-1]))
        state.update((last,))
        state.setTimeoutTimestamp(max(-(-(last + gap) // 1000), state.getCurrentWatermarkMs()) + 1)
        yield rows[keep]

    return events.withWatermark(at, late).groupBy(*keys).applyInPandasWithState(suppress, events.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def request_pairs(messages: DataFrame, key: str, order: str, kind: str, request: str, response: str, at: str, late: str = "10 minutes", wait_seconds: float = 600) -> DataFrame:
    """(key, request, response, complete) as soon as an answer or the next request is there, or the wait is over.

    State: the open request of a key and its event time ``at``. An unanswered request comes out incomplete when
    the watermark (``late`` behind the newest message) is the wait beyond its time.
    """
    k, o = messages.schema[key].dataType.simpleString(), messages.schema[order].dataType.simpleString()
    names = [key, "request", "response", "complete"]

    def pair(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            open_request = state.get[0]
            state.remove()
            yield pd.DataFrame([(group[0], open_request, None, False)], columns=names).astype({"request": "Int64", "response": "Int64"})
            return
        rows = pd.concat(list(batches))
        rows = rows[rows[kind].isin((request, response))].sort_values(order, kind="stable")
        number, asks, times = rows[order].to_numpy(), (rows[kind] == request).to_numpy(), _micros(rows[at])
        if state.exists:
            number, asks, times = np.insert(number, 0, state.get[0]), np.insert(asks, 0, True), np.insert(times, 0, state.get[1])
        closed = np.flatnonzero(asks[:-1])  # what follows a request closes it, by an answer or by the next request
        complete = ~asks[closed + 1]
        out = pd.DataFrame({key: group[0], "request": number[closed], "response": pd.array(np.where(complete, number[closed + 1], 0), "Int64"), "complete": complete})
        out.loc[~complete, "response"] = pd.NA
        if len(asks) and asks[-1]:
            state.update((int(number[-1]), int(times[-1])))
            state.setTimeoutTimestamp(max(int(times[-1]) // 1000 + round(wait_seconds * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield out[names].astype({"request": "Int64"})

    shape = f"{key} {k}, request {o}, response {o}, complete boolean"
    return messages.withWatermark(at, late).groupBy(key).applyInPandasWithState(pair, shape, f"request {o}, at long", "append", GroupStateTimeout.EventTimeTimeout)


def into_table(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Starts a query that hands every micro-batch to a merge step, the single writer of its table.

    Without an interval it works off what is there and ends, also behind the operators with state: their
    timeouts are of event time.
    """
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
