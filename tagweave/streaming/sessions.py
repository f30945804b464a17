"""Sessions of events and their decayed scores: as state of a stream, and the same over a table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagweave.plans.scratch import ship

#: Seconds between events that end a session; share of a score that an hour takes is 1 - e^-DECAY.
GAP, DECAY = 1800, 0.1
OUT = "key string, start timestamp, end timestamp, n long, total double, score double"
_OPEN = "start long, end long, n long, total double, score double"  # microseconds
#: What a stateful query needs of its session: state of several columns.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _faded(micros: int, decay: float) -> float:
    return math.exp(-decay * micros / 3.6e9)


def merged(a: tuple, b: tuple, decay: float) -> tuple:
    """Two sessions as one; scores are those of the later end."""
    end = max(a[1], b[1])
    score = a[4] * _faded(end - a[1], decay) + b[4] * _faded(end - b[1], decay)
    return min(a[0], b[0]), end, a[2] + b[2], a[3] + b[3], score


class _Sessions(StatefulProcessor):
    """Open sessions of a key, apart by more than the gap; an event joins those that it is near to, in whatever order it comes.

    A timer at each session's end and gap, in event time, gives the session once the watermark has passed it.
    """

    def __init__(self, gap: int, decay: float) -> None:
        self.gap, self.decay = gap * 1_000_000, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        before = {r[1] for r in held}
        for frame in rows:
            for t, v in zip(frame["micros"].tolist(), frame["value"].tolist(), strict=True):
                v = 0.0 if v is None or math.isnan(v) else v
                one, rest = (t, t, 1, v, v), []
                for r in held:
                    if r[0] - self.gap <= one[1] and one[0] <= r[1] + self.gap:
                        one = merged(r, one, self.decay)
                    else:
                        rest.append(r)
                held = [*rest, one]
        self.open.put(held)
        now = {r[1] for r in held}
        for end in before - now:
            self.handle.deleteTimer(self._due(end))
        for end in now - before:
            self.handle.registerTimer(self._due(end))
        yield pd.DataFrame()

    def _due(self, end: int) -> int:
        return (end + self.gap) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(r) for r in self.open.get()]
        done = [r for r in held if self._due(r[1]) <= due]
        left = [r for r in held if self._due(r[1]) > due]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        when = lambda k: pd.to_datetime([r[k] for r in done], unit="us")
        if done:
            yield pd.DataFrame({"key": key[0], "start": when(0), "end": when(1), "n": [r[2] for r in done], "total": [r[3] for r in done], "score": [r[4] for r in done]})

    def close(self) -> None:
        pass


def _rows(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.withColumn("micros", F.unix_micros("ts"))


def stream_sessions(events: DataFrame, key: str, ts: str = "ts", value: str = "value", gap: int = GAP, decay: float = DECAY, late: str = "1 hour") -> DataFrame:
    """OUT rows of a stream of events, each session once, when the watermark, `late` behind the newest event, has passed its gap.

    score is the sum of the values, each faded by e^-decay for every hour to the session's end. Events later than the
    watermark are left out. State is one row for each open session. The session needs PROVIDER among its settings.
    """
    ship(events.sparkSession)
    rows = _rows(events, key, ts, value).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Sessions(gap, decay), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def sessions(events: DataFrame, key: str, ts: str = "ts", value: str = "value", gap: int = GAP, decay: float = DECAY) -> DataFrame:
    """The same over a table: OUT rows of all sessions; events without a time are left out, values without one count as 0."""
    rows = _rows(events, key, ts, value).filter("ts IS NOT NULL").withColumn("value", F.coalesce("value", F.lit(0.0)))
    order = Window.partitionBy("key").orderBy("micros")
    new = F.coalesce(F.col("micros") - F.lag("micros").over(order) > gap * 1_000_000, F.lit(True)).cast("long")
    told = rows.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ended = told.withColumn("last", F.max("micros").over(Window.partitionBy("key", "session")))
    faded = F.col("value") * F.exp(-decay * (F.col("last") - F.col("micros")) / 3.6e9)
    out = ended.groupBy("key", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(faded).alias("score"))
    return out.drop("session")
