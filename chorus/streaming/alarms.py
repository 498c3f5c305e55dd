"""Alarm for silent sources: keyed state with event-time timers.

A source is silent after an entry if none follows within a span. The state of a source
holds the times of entries whose span the watermark has not passed, and one timer, at the
end of the first such span. When it fires, every span that has passed is decided: no row
behind the watermark can come any more, so the result does not depend on the order or the
batches in which entries arrived. Equal times of a source collapse in the task that reads
them, before they are shuffled, which is all that a source with very many entries sends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = T.StructType([T.StructField("source", T.StringType()), T.StructField("silent_since", T.TimestampType())])
_STATE = T.StructType([T.StructField("pending", T.ArrayType(T.LongType()))])


def decided(pending: list[int], span: int, watermark: int) -> tuple[list[int], list[int]]:
    """(times after which the source was silent, times still open), from sorted times in ms.

    A time is decided once its whole span lies before the watermark.
    """
    silent, open_ = [], []
    for at, following in zip(pending, [*pending[1:], None]):
        if at + span >= watermark:
            open_.append(at)
        elif following is None or following > at + span:
            silent.append(at)
    return silent, open_


def _rows(source: str, times: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"source": pd.Series([source] * len(times), dtype=object),
                         "silent_since": pd.to_datetime(pd.Series(times, dtype="int64"), unit="ms")})


class SilenceProcessor(StatefulProcessor):
    """Emits the time of every entry that no other one followed within ``span`` milliseconds."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", _STATE)

    def _keep(self, pending: list[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if pending:
            self.state.update((pending,))
            self.handle.registerTimer(pending[0] + self.span)
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get()[0] if self.state.exists() else []
        times = set(known)
        for frame in rows:
            times.update(int(t) for t in frame["at"])
        self._keep(sorted(times))
        yield _rows(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending = list(self.state.get()[0]) if self.state.exists() else []
        watermark = timerValues.getCurrentWatermarkInMs()
        silent, open_ = decided(sorted(pending), self.span, watermark)
        self._keep(open_)
        yield _rows(key[0], silent)

    def close(self) -> None:
        pass


def _collapsed(batches: Iterator[pa.RecordBatch]):
    """Each pair of source and time once per batch of rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["source", "ts", "at"]).aggregate([])
        yield from table.select(["source", "ts", "at"]).to_batches()


def silences(stream: DataFrame, source: str, ts: str, span_minutes: int, delay: str) -> DataFrame:
    """(source, silent_since): entries that no entry of the source followed within the span.

    Decided once the watermark, the newest time less ``delay``, has passed the span. A missing
    source or time takes no part.
    """
    rows = stream.select(F.col(source).cast("string").alias("source"),
                         F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.filter(F.col("source").isNotNull() & F.col("ts").isNotNull())
    timed = (rows.withColumn("at", F.unix_millis("ts"))
             .mapInArrow(_collapsed, "source string, ts timestamp, at long").withWatermark("ts", delay))
    return timed.groupBy("source").transformWithStateInPandas(
        statefulProcessor=SilenceProcessor(span_minutes * 60_000), outputStructType=_OUT,
        outputMode="Append", timeMode="EventTime")
