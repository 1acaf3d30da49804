"""Keyed state with timers (transformWithState): rolling distinct counts with retention (R15, A4), heartbeats without input (R12, R14, X36), the second look.

These need the RocksDB state store: set spark.sql.streaming.stateStore.providerClass before a query starts (``use_rocksdb``).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Hours that a station's buckets are kept, hours of the rolling counts, seconds between heartbeats.
RETAIN_HOURS, ROLLING_HOURS, BEAT_SEC = 216, (24, 168), 60
#: Seconds after a transmission in which an aircraft may act on it, and between polls.
WINDOW_AFTER_SEC, POLL_SEC = 60, 15


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Hours(StatefulProcessor):
    """The hours in which a vessel was heard, as far back as they are kept."""

    def __init__(self, windows: tuple[int, ...], retain: int):
        self.windows, self.retain = windows, retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getValueState("hours", "hours array<long>", self.retain * 3_600_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.hours.get()[0]) if self.hours.exists() else []
        steps, heard = [], sorted({int(h) for batch in rows for h in batch["hour"].dropna()})
        oldest = max(held[-1:] + heard[-1:], default=0) - self.retain
        for hour in heard:
            place = bisect_left(held, hour)
            if place < len(held) and held[place] == hour or hour < oldest:
                continue
            for width in self.windows:
                # A sighting counts for `width` hours; what its neighbours already count for is left out.
                first = max(hour, held[place - 1] + width) if place else hour
                last = min(hour + width, held[place]) if place < len(held) else hour + width
                if first < last:
                    steps += [(width, first, 1), (width, last, -1)]
            held.insert(place, hour)
        self.hours.update(([h for h in held if h >= oldest],))
        if steps:
            yield pd.DataFrame(steps, columns=["width", "hour", "step"])

    def close(self) -> None:
        pass


def rolling_steps(messages: DataFrame, windows: tuple[int, ...] = ROLLING_HOURS, retain: int = RETAIN_HOURS) -> DataFrame:
    """Steps (width, hour, step) of the number of different vessels in the last `width` clock hours. messages: mmsi, hour (hours since 1970).

    A vessel is a key of its own and holds its hours alone, so nothing holds a set of vessels. Steps only ever add up: rows that come late change hours that were counted before.
    A vessel's hours go after `retain` hours without one, and a sighting older than that is left out.
    """
    rows = messages.select("mmsi", F.col("hour").cast("long").alias("hour"))
    return rows.groupBy("mmsi").transformWithStateInPandas(_Hours(windows, retain), "width int, hour long, step int", "append", "ProcessingTime")


def rolling_counts(steps: DataFrame) -> DataFrame:
    """width, hour, vessels, for each hour at which a count changes: from the steps of any number of batches. One row per hour and width."""
    hours = steps.groupBy("width", "hour").agg(F.sum("step").alias("step")).filter("step <> 0")
    return hours.select("width", "hour", F.sum("step").over(Window.partitionBy("width").orderBy("hour")).alias("vessels"))


class _Beats(StatefulProcessor):
    """A timer per station that starts itself anew."""

    def __init__(self, every_ms: int, quiet_beats: int):
        self.every, self.quiet = every_ms, quiet_beats

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "messages long, since long, silent long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heard = sum(len(batch) for batch in rows)
        if self.state.exists():
            messages, since, silent, at = self.state.get()
        else:
            messages, since, silent, at = 0, 0, 0, timerValues.getCurrentProcessingTimeInMs() + self.every
            self.handle.registerTimer(at)
        self.state.update((messages + heard, since + heard, silent, at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        messages, since, silent, at = self.state.get()
        beats = []
        # A trigger that comes late owes all beats up to now: a gap in the log would look like a dead station.
        while at <= timerValues.getCurrentProcessingTimeInMs():
            silent = 0 if since else silent + 1
            beats.append((key[0], pd.Timestamp(at, unit="ms"), messages, since, silent > 0 and silent % self.quiet == 0))
            since, at = 0, at + self.every
        self.state.update((messages, since, silent, at))
        self.handle.registerTimer(at)
        if beats:
            yield pd.DataFrame(beats, columns=["station", "at", "messages", "since_last", "silence"])

    def close(self) -> None:
        pass


def heartbeats(messages: DataFrame, every_sec: float = BEAT_SEC, quiet_beats: int = 10) -> DataFrame:
    """Station, at, messages (all so far), since_last (since the last beat), silence (nothing was heard for so many beats, and again after each further so many).

    A station beats from its first message on, whether or not any more come, for as long as the query is triggered: one row each period, on the processing clock.
    """
    out = "station string, at timestamp, messages long, since_last long, silence boolean"
    return messages.select("station").groupBy("station").transformWithStateInPandas(_Beats(int(every_sec * 1000), quiet_beats), out, "append", "ProcessingTime")


class _Due(StatefulProcessor):
    """A transmission and the timer of its second look."""

    def __init__(self, after_ms: int, kind: str):
        self.after, self.kind = after_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        if not self.row.exists():  # once recorded, a transmission isn't recorded again
            first = batch.iloc[0]
            self.row.update((first["t"].to_pydatetime(), first["body"]))
            self.handle.registerTimer(int(first["t"].timestamp() * 1000) + self.after)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t, body = self.row.get()
        yield pd.DataFrame({"id": [key[0]], "t": [t], "body": [body]})

    def close(self) -> None:
        pass


def due_transmissions(transmissions: DataFrame, after: int = WINDOW_AFTER_SEC + POLL_SEC, late: str = "0 seconds") -> DataFrame:
    """Each transmission (id long, t, and any more columns) once, when `after` seconds and a poll have gone by on the stream's clock. A repeated id is the same transmission."""
    rows = transmissions.withColumn("t", F.col("t").cast("timestamp"))
    rest = [c for c in rows.columns if c not in ("id", "t")]
    kind = rows.select(F.struct(*rest).alias("body")).schema["body"].dataType.simpleString()
    slim = rows.select("id", "t", F.to_json(F.struct(*rest)).alias("body")).withWatermark("t", late)
    due = slim.groupBy("id").transformWithStateInPandas(_Due(after * 1000, "t timestamp, body string"), "id long, t timestamp, body string", "append", "EventTime")
    return due.select("id", "t", F.from_json("body", kind).alias("b")).select("id", "t", "b.*")
