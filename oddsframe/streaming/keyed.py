"""Open, latest and move of every price in keyed state, for readers that want each change as it happens.

Each (match, bookmaker) holds one value in Spark's state store: its first and its latest tick and how many it had.  A
batch emits the new value of every key it touched.  An event-time timer follows the latest tick; when the watermark has
passed it by `keep`, the key's price is final, its value is emitted once more as closed, and its state is dropped, so
the store holds only matches that still move.  A tick within the watermark's delay counts in whatever order it comes;
an older one has no state to change and is dropped, as any stateful job of Spark does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oddsframe.streaming.streams import TICK_KEYS, use_rocksdb

VALUE = "open_us long, open_event long, open_price double, latest_us long, latest_event long, latest_price double, ticks long"
_FIELDS = [f.split()[0] for f in VALUE.split(", ")]
MOVES = "match_id string, bookmaker_key string, " + VALUE + ", closed boolean"


def merged(value: tuple | None, ticks: pd.DataFrame) -> tuple:
    """A key's value with more ticks; earlier time opens, later time is latest, the event id decides equal times."""
    at, event, price = (ticks[c].to_numpy() for c in ("at_us", "event_id", "price"))
    order = np.lexsort((event, at))
    ends = [(int(at[k]), int(event[k]), float(price[k])) for k in (order[0], order[-1])]
    count = len(order)
    if value is not None:
        ends = [min(ends[0], tuple(value[:3]), key=lambda e: e[:2]), max(ends[1], tuple(value[3:6]), key=lambda e: e[:2])]
        count += value[6]
    return (*ends[0], *ends[1], count)


class PriceProcessor(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("price", VALUE)

    def _row(self, key: tuple[Any, ...], value: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, *value, closed)], columns=[*TICK_KEYS, *_FIELDS, "closed"])

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.value.get()
        batches = list(rows)
        value = merged(tuple(known) if known is not None else None, batches[0] if len(batches) == 1 else pd.concat(batches))
        self.value.update(value)
        timer = value[3] // 1000 + self.keep_ms
        if known is None or known[3] != value[3]:
            if known is not None:
                self.handle.deleteTimer(known[3] // 1000 + self.keep_ms)
            self.handle.registerTimer(timer)
        yield self._row(key, value, False)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            value = tuple(self.value.get())
            self.value.clear()
            yield self._row(key, value, True)

    def close(self) -> None:
        pass


def price_changes(ticks: DataFrame, delay: str = "2 days", keep_hours: float = 48) -> DataFrame:
    """Stream of `MOVES`: every key's value whenever a batch changed it, and once more when it is closed.

    ticks: match_id, bookmaker_key, ts, event_id, price.  Run in update mode.
    """
    use_rocksdb(ticks.sparkSession)
    timed = ticks.withColumn("at", F.col("ts").cast("timestamp")).withColumn("at_us", F.unix_micros("at")).withWatermark("at", delay)
    rows = timed.select(*TICK_KEYS, "at", "at_us", "event_id", "price").where(F.col("at").isNotNull())
    processor = PriceProcessor(int(keep_hours * 3_600_000))
    return rows.groupBy(*TICK_KEYS).transformWithStateInPandas(processor, MOVES, "Update", "EventTime")


def latest_values(changes: DataFrame) -> DataFrame:
    """The last value of every key among emitted ones; a value never loses ticks, so the one with most is the last."""
    best = F.struct("ticks", "closed")
    return changes.groupBy(*TICK_KEYS).agg(*[F.max_by(c, best).alias(c) for c in [*_FIELDS, "closed"]])
