"""Order-dependent state per key, as a batch fold and as a stateful stream of the same function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillframe.functions.text import quarantine_seconds

#: Fixed, as in quarantine_seconds: answers that refuse a key and that limit its rate.
REFUSED, LIMITED = (401, 402, 403), 429


def lockout(events: DataFrame, key: str, order: list[str], *, threshold: int = 5) -> DataFrame:
    """Failures since the last success at each event; a failure that reaches the threshold locks. Only a success clears
    the counter, so it outlives the end of a lock. events: failed, succeeded.

    The fold is a count restarted at each success, so it runs as two window counts and needs no Python.
    """
    by_time = Window.partitionBy(key).orderBy(*order)
    runs = events.withColumn("_run", F.count_if(F.col("succeeded")).over(by_time))
    failures = F.count_if(F.col("failed")).over(Window.partitionBy(key, "_run").orderBy(*order))
    counted = runs.withColumn("failures", failures.cast("int"))
    return counted.withColumn("locks", F.col("failed") & (F.col("failures") >= threshold)).drop("_run")


def lockout_stream(events: DataFrame, key: str, *, threshold: int = 5, minutes: int = 15) -> DataFrame:
    """The same rule on a stream: one row per failure that locks, with the end of the lock."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        count = held.get[0] if held.exists else 0
        out = []
        for row in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():  # a key's rows of one batch
            if row.succeeded:
                count = 0
            elif row.failed:
                count += 1
                if count >= threshold:
                    out.append((group[0], row.ts, row.ts + pd.Timedelta(minutes=minutes), count))
        held.update((count,))
        yield pd.DataFrame(out, columns=[key, "ts", "locked_until", "failures"])

    schema = f"{key} {events.schema[key].dataType.simpleString()}, ts timestamp, locked_until timestamp, failures int"
    return events.groupBy(key).applyInPandasWithState(step, schema, "n int", "append", "NoTimeout")


def last_status_stream(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest status of each key as a stream: only a later event on the order moves it, ``error`` always does."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else None
        for status in pd.concat(list(frames)).sort_values("ts", kind="stable").status:
            if status == "error" or now in (None, "error") or status in order and now in order and order.index(status) >= order.index(now):
                now = status
        held.update((now,))
        yield pd.DataFrame({key: [group[0]], "status": [now]})

    schema = f"{key} {events.schema[key].dataType.simpleString()}, status string"
    return events.groupBy(key).applyInPandasWithState(step, schema, "status string", "update", "NoTimeout")


class _Quarantine(StatefulProcessor):
    """A slot's failures in a row and the end of its rest. A timer drops the state of a slot that stays idle."""

    def __init__(self, key: str, idle: str):
        self.key, self.idle = key, pd.Timedelta(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("slot", "failures int, until timestamp, last timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures, until, last = self.slot.get() if self.slot.exists() else (0, None, None)
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():  # a slot's rows of one batch
            if last is not None and row.ts - pd.Timestamp(last) > self.idle:
                failures, until = 0, None
            last = row.ts
            if row.ok:
                failures, until = 0, None
            else:
                failures += 1
                base = 300 if row.status in REFUSED else 30 if row.status == LIMITED else 60 if failures >= 3 else 0
                until = row.ts + pd.Timedelta(seconds=base * min(failures, 10)) if base else until
            out.append((key[0], row.event_id, failures, until))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + self.idle).timestamp() * 1000) + 1)
        self.slot.update((failures, until if until is None else pd.Timestamp(until).to_pydatetime(), pd.Timestamp(last).to_pydatetime()))
        found = pd.DataFrame(out, columns=[self.key, "event_id", "failures", "blocked_until"])
        yield found.astype({"blocked_until": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.slot.clear()
        yield pd.DataFrame({self.key: pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "failures": pd.Series(dtype="int32"), "blocked_until": pd.Series(dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def quarantine_stream(events: DataFrame, key: str, *, idle: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(key, event_id, failures, blocked_until) after each event of a slot: failures in a row, and the end of the rest that
    the last failure with a rest gave. A success clears both, and so does an idle time, whose end a timer waits for to drop
    the state; an event after it finds none. events: key, event_id, ts, ok, status.

    A slot's events of one batch are put in order together; those of a batch must not be older than the slot's last one.
    """
    kind = events.schema[key].dataType.simpleString()
    timed = events.select(key, "event_id", "ts", "ok", "status").withWatermark("ts", late)
    schema = f"{key} {kind}, event_id long, failures int, blocked_until timestamp"
    return timed.groupBy(key).transformWithStateInPandas(_Quarantine(key, idle), schema, "Append", "EventTime")


def quarantine(events: DataFrame, key: str, *, idle: str = "6 hours") -> DataFrame:
    """The same rule over a table, by windows: a run of events starts anew after a success or an idle time."""
    by_time = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.col("ts") > F.lag("ts").over(by_time) + F.expr(f"INTERVAL '{idle.split()[0]}' HOUR")
    marked = events.withColumn("_new", F.coalesce(gap, F.lit(False)) | F.col("ok"))
    runs = marked.withColumn("_run", F.count_if("_new").over(by_time))
    within = Window.partitionBy(key, "_run").orderBy("ts", "event_id")
    counted = runs.withColumn("failures", F.count_if(~F.col("ok")).over(within).cast("int"))
    seconds = quarantine_seconds(F.col("status"), F.col("failures"))
    end = F.when(~F.col("ok") & (seconds > 0), F.timestamp_add("SECOND", seconds, F.col("ts")))
    rested = counted.withColumn("blocked_until", F.last(end, ignorenulls=True).over(within))
    return rested.select(key, "event_id", "failures", "blocked_until")
