"""The rate limiter as a stateful stream: the times of allowed calls are a caller's state.

Callers are dealt to buckets, and a bucket's callers share an entry of the state
store: a call of Python serves many callers, however few calls each has made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 1024
COLUMNS = "endpoint string, ip long, no_ip boolean, id long, no_id boolean, t double, allowed boolean"
_READ = ["endpoint", "ip", "no_ip", "id", "no_id", "t"]


def _taken(calls: DataFrame, event_time: str | None) -> DataFrame:
    """The columns read; numbers that are missing are told apart, since a missing one would turn a column of pandas into floats."""
    missing = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("ip", "id")]
    return calls.select("endpoint", *missing, F.col("ip").isNull().alias("no_ip"), F.col("id").isNull().alias("no_id"), "t", *([event_time] if event_time else []))


def _given(judged: DataFrame) -> DataFrame:
    return judged.select("endpoint", F.when(~F.col("no_ip"), F.col("ip")).alias("ip"), F.when(~F.col("no_id"), F.col("id")).alias("id"), "t", "allowed")


def _in_buckets(taken: DataFrame, buckets: int) -> DataFrame:
    return taken.withColumn("bucket", F.pmod(F.xxhash64("endpoint", "ip", "no_ip"), F.lit(buckets)).cast("int"))


def _judged(frame: pd.DataFrame, held: dict[tuple, list[float]], limit: int, seconds: int) -> pd.DataFrame:
    """The calls in order of time with `allowed`; held: the times that count for each caller, brought up to date."""
    frame, allowed = frame[_READ].sort_values(["t", "no_id", "id"], ascending=[True, False, True]), []
    for *caller, t in zip(*(frame[c].tolist() for c in ("endpoint", "ip", "no_ip", "t")), strict=True):
        key = tuple(caller)
        kept = [x for x in held.get(key, ()) if t - x < seconds]
        allowed.append(len(kept) < limit)
        if allowed[-1]:
            kept.append(t)
        held[key] = kept
    return frame.assign(allowed=pd.Series(allowed, frame.index, bool))


def _ends(kept: list[float], seconds: int) -> int:
    """When, in milliseconds, a caller's window is over."""
    return int((kept[-1] + seconds) * 1000)


def _live(held: dict[tuple, list[float]], seconds: int, watermark: int | None) -> dict[tuple, list[float]]:
    """The callers whose window the watermark has not passed."""
    return {caller: kept for caller, kept in held.items() if kept and (watermark is None or _ends(kept, seconds) > watermark)}


def limit_stream(calls: DataFrame, limit: int, seconds: int, event_time: str | None = None, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """calls (endpoint, ip, id, t) with `allowed`: as in the batch form, call by call.

    State is at most `limit` times for each caller; with a timestamp column
    `event_time` it goes once the watermark (`late` behind) has passed a caller's
    window, and later calls than that are dropped. Calls are taken in order of
    time within a micro-batch, which the source should bound (maxFilesPerTrigger);
    those that come in later batches than their time are judged on arrival. This
    order is ours: a single process sees calls as they come.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {tuple(caller): list(kept) for *caller, kept in zip(*state.get, strict=True)} if state.exists else {}
        if not state.hasTimedOut:
            yield _judged(pd.concat(list(frames)), held, limit, seconds)
        watermark = state.getCurrentWatermarkMs() if event_time else None
        if not (held := _live(held, seconds, watermark)):
            if state.exists:
                state.remove()
            return
        state.update((*map(list, zip(*held, strict=True)), list(held.values())))
        if event_time:
            state.setTimeoutTimestamp(max(min(_ends(kept, seconds) for kept in held.values()), watermark + 1))

    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    taken = _taken(calls, event_time)
    marked = taken.withWatermark(event_time, late) if event_time else taken
    schema = "endpoint array<string>, ip array<long>, no_ip array<boolean>, kept array<array<double>>"
    return _given(_in_buckets(marked, buckets).groupBy("bucket").applyInPandasWithState(run, COLUMNS, schema, "append", timeout))


class _Calls(StatefulProcessor):
    """The times of allowed calls, of one caller or of a bucket of them, as a list in the state store, and a timer that clears it."""

    def __init__(self, limit: int, seconds: int, gathered: bool):
        self.limit, self.seconds, self.gathered = limit, seconds, gathered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "endpoint string, ip long, no_ip boolean, t double")

    def _held(self) -> dict[tuple, list[float]]:
        held = {}
        for *caller, t in self.kept.get():
            held.setdefault(tuple(caller), []).append(t)
        return held

    def _keep(self, held: dict[tuple, list[float]], watermark: int) -> None:
        held = _live(held, self.seconds, watermark)
        if held:
            self.kept.put([(*caller, t) for caller, kept in held.items() for t in kept])
            self.handle.registerTimer(max(min(_ends(kept, self.seconds) for kept in held.values()), watermark + 1))
        else:
            self.kept.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for frame in [pd.concat(list(rows))] if self.gathered else rows:  # a caller's own calls: one Arrow batch at a time, however many there are
            yield _judged(frame, held, self.limit, self.seconds)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._keep(held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._held(), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def limit_calls(calls: DataFrame, limit: int, seconds: int, event_time: str, late: str = "1 day", buckets: int | None = None) -> DataFrame:
    """As limit_stream, with list state and timers.

    Without `buckets` each caller has an entry of the state store: its calls pass in
    Arrow batches, never gathered, and are judged in the order of their batches, and by
    time within one; a source in order of time gives the result of the batch form. With
    `buckets` a bucket's callers share an entry, and its calls of a micro-batch are
    gathered and judged in order of time. Needs the RocksDB state store.
    """
    marked = _taken(calls, event_time).withWatermark(event_time, late)
    grouped = _in_buckets(marked, buckets).groupBy("bucket") if buckets else marked.groupBy("endpoint", "ip", "no_ip")
    return _given(grouped.transformWithStateInPandas(_Calls(limit, seconds, bool(buckets)), COLUMNS, "Append", "EventTime"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each type in windows of event time; rows later than `late` are dropped (our own rule)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
