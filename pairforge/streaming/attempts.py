"""Attempts over time: the first kept attempt of each row, whatever the order of arrival.

Attempts of a row come as a stream, numbered from 1, and may come late, twice or in any
order. A row's state holds which of its attempts up to the last allowed number have come,
and the kept one with the smallest number. It is given out as soon as every
attempt before it has come and failed, or else when the row's time is over; then a
mark alone stays, so that what comes later changes nothing, until the timer drops it.
Over all rows that come in time this is the batch operator ``first_kept``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the stateful operator needs of the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Attempts(StatefulProcessor):
    """State: ``seen``, a bit for each attempt that has come; ``best`` and its row ``held``; ``done``."""

    def __init__(self, key: str, most: int, wait_ms: int):
        self.key, self.most, self.wait_ms = key, most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "seen long, best int, held string, done boolean, until long")

    def _out(self, key: tuple, best: int, held: str) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "attempt": [best], "row": [held]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, best, held, done, until = self.state.get() if self.state.exists() else (0, 0, "", False, -1)
        latest = until
        for frame in rows:
            for attempt, keep, row, at in zip(frame["attempt"], frame["keep"], frame["row"], frame["at"], strict=True):
                latest = max(latest, int(at) + self.wait_ms)
                if 1 <= attempt <= self.most:
                    seen |= 1 << int(attempt)
                    if keep and (not best or attempt < best):
                        best, held = int(attempt), row
        if latest != until:
            if until >= 0:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        if not done and best and all(seen >> k & 1 for k in range(1, best)):
            yield self._out(key, best, held)
            done, held = True, ""
        self.state.update((seen, best, held, done, latest))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            _, best, held, done, _ = self.state.get()
            self.state.clear()
            if best and not done:
                yield self._out(key, best, held)

    def close(self) -> None:
        pass


def first_kept(stream: DataFrame, key: str, attempt: str, keep: F.Column, time: str, most: int = 3, wait: str = "10 minutes") -> DataFrame:
    """The first attempt that passes, of those up to ``most``; rows without one are dropped.

    ``stream`` has a watermark on ``time``; a row waits for earlier attempts until the watermark is ``wait``
    behind the last of its attempts. Rows without a key or time are left out.
    """
    columns = stream.columns
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    # pandas renames columns that begin with an underscore
    rows = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{attempt}`").cast("int").alias("attempt"), F.coalesce(keep, F.lit(False)).alias("keep"), F.to_json(F.struct(*[f"`{c}`" for c in columns])).alias("row"), F.col(time).alias("time"), F.unix_millis(F.col(time).cast("timestamp")).alias("at")
    )
    kind = stream.schema[key].dataType.simpleString()
    found = rows.groupBy("key").transformWithStateInPandas(_Attempts(key, most, wait_ms), f"key {kind}, attempt int, row string", "append", "eventTime")
    return found.select(F.from_json("row", stream.schema).alias("r")).select(*[F.col(f"r.`{c}`").alias(c) for c in columns])
