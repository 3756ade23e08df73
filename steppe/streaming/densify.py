"""A monthly panel from a stream: months without observations are filled by timers.

The batch panel has every cell in every month. As a stream, a month of a cell is
final when the watermark has passed its end: a timer of the cell then emits the
month, with the sum of what came or null, and waits for the next. Cells that
fall silent go on with nulls as long as others move the watermark. Later rows
are dropped by the watermark, and counted. The state of a cell is its open months.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PANEL = "cell_id long, date date, value double, n_obs long"


def month_number(day: date) -> int:
    return day.year * 12 + day.month - 1


def first_day(month: int) -> date:
    return date(month // 12, month % 12 + 1, 1)


def end_ms(month: int) -> int:
    """The moment at which a month is over, in milliseconds of UTC."""
    day = first_day(month + 1)
    return int(datetime(day.year, day.month, 1, tzinfo=timezone.utc).timestamp() * 1000)


class Densifier(StatefulProcessor):
    """The open months of one cell."""

    def __init__(self, start: int):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "month int", "total double, seen boolean, n long")
        self.next = handle.getValueState("next", "month int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.next.exists():
            self.next.update((self.start,))
            self.handle.registerTimer(end_ms(self.start))
        (begin,) = self.next.get()
        for frame in rows:
            for month, group in frame.groupby("month"):
                if month < begin:
                    continue  # before the panel starts
                known = group["value"].dropna()
                total, seen, n = self.open.getValue((int(month),)) if self.open.containsKey((int(month),)) else (0.0, False, 0)
                self.open.updateValue((int(month),), (float(total + known.sum()), bool(seen or len(known)), int(n + len(group))))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (month,) = self.next.get()
        out, now = [], timerValues.getCurrentWatermarkInMs()
        while end_ms(month) <= now:
            total, seen, n = 0.0, False, 0
            if self.open.containsKey((month,)):
                total, seen, n = self.open.getValue((month,))
                self.open.removeKey((month,))
            out.append((key[0], first_day(month), float(total) if seen else None, n))
            month += 1
        self.next.update((month,))
        self.handle.registerTimer(end_ms(month))
        if out:
            yield pd.DataFrame(out, columns=["cell_id", "date", "value", "n_obs"]).astype({"value": "float64"})

    def close(self) -> None:
        pass


def densified(stream: DataFrame, start: date, key: str = "cell_id", time: str = "ts", value: str = "value", lateness: str = "10 days") -> DataFrame:
    """``PANEL``: every cell in every month from ``start`` on, each once, when it is final.

    Rows without a key or time are left out, rows before ``start`` too. The state
    store must be RocksDB's, which keeps state on disk.
    """
    rows = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    day = F.to_date(time)
    rows = rows.select(F.col(key).cast("long").alias("cell_id"), time, (F.year(day) * 12 + F.month(day) - 1).alias("month"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("cell_id").transformWithStateInPandas(Densifier(month_number(start)), PANEL, "Append", "EventTime")


def late_rows(query) -> int:
    """Rows that the watermark dropped, over all batches whose progress is kept."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
