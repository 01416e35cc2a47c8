"""Stateful gates on streams of signals. State is one small row a key in the query's state store; a timer drops it once it can no longer
hold anything back, so that keys which fall silent cost nothing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(ts: dt.datetime) -> int:
    return round(ts.timestamp() * 1_000_000)


class _Gate(StatefulProcessor):
    """Sends what `passes`; remembers what was sent last and when, for `hold` after it."""

    def __init__(self, fields: list[str], hold: dt.timedelta):
        self.fields, self.hold = fields, hold // dt.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = ", ".join(f"{f} string" for f in self.fields)
        self.last = handle.getValueState("last", f"at bigint{', ' + kinds if kinds else ''}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        before = last
        for row in sorted(rows, key=lambda r: r["ts"]):  # those of one key and batch
            at, said = _micros(row["ts"]), tuple(row[f] for f in self.fields)
            if last is None or said != tuple(last[1:]) or at - last[0] >= self.hold:
                last = (at, *said)
                yield row
        if last is not before:
            if before is not None:
                self.handle.deleteTimer((before[0] + self.hold) // 1000)
            self.last.update(tuple(last))
            self.handle.registerTimer((last[0] + self.hold) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _gated(rows: DataFrame, keys: list[str], fields: list[str], hold: dt.timedelta, late: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = rows.withWatermark("ts", late)
    return timed.groupBy(*keys).transformWithState(_Gate(fields, hold), outputStructType=rows.schema, outputMode="Append", timeMode="EventTime")


def cooldown(signals: DataFrame, *, hours: int = 4, late: str = "1 hour") -> DataFrame:
    """signals (symbol, side, ts, ...): those at least `hours` after the last one that was sent on the symbol and side. Rows of a batch
    count in the order of their time; rows earlier than what was sent are held back too, and so are rows later than `late`."""
    return _gated(signals, ["symbol", "side"], [], dt.timedelta(hours=hours), late)


def throttle(alerts: DataFrame, *, heartbeat_hours: int = 6, late: str = "1 hour") -> DataFrame:
    """alerts (symbol, ts, severity, payload): the first, each change of severity or payload, and a repeat once the heartbeat is due. Once it
    is due anything passes, so that nothing need be remembered any longer."""
    return _gated(alerts, ["symbol"], ["severity", "payload"], dt.timedelta(hours=heartbeat_hours), late)
