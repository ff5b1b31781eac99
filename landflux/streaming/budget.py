"""Running budgets of a stream: a row for every tower and day, as in batch.

Days are summed by Spark's own windows, which merge a busy tower's readings in
every task and give a day out once, when the watermark has passed its end. What
is left for keyed state is one row a tower and day: a running total for each
tower, and a timer that forgets towers gone silent.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from landflux.streaming.towers import DIGITS, fixed_flux

DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)


def budget_schema(digits: int = DIGITS) -> str:
    money = f"decimal(38,{digits})"
    return f"tower_id bigint, day date, day_flux {money}, n bigint, budget {money}, n_so_far bigint"


class TowerTotal(StatefulProcessor):
    """The running total of each tower, over its closed days in order.

    A tower's closed days come in order from batch to batch, as the watermark
    only moves on; those of one batch are sorted here. With ``idle_days``, a gap
    of more days starts the total anew, and state is dropped once the watermark
    says that no day can follow within the gap.
    """

    def __init__(self, digits: int, idle_days: int | None) -> None:
        self.digits, self.idle_days = digits, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", f"budget decimal(38,{self.digits}), n bigint, day date")

    def _silent_from(self, day: dt.date) -> int:
        """Moment, in milliseconds, from which a new day of the tower starts anew."""
        return ((day - EPOCH).days + 1 + self.idle_days) * DAY_MS

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("day")
        budget, n, last = self.total.get() or (None, 0, None)
        if self.idle_days is not None and last is not None:
            self.handle.deleteTimer(self._silent_from(last))
        out = []
        for day in days.itertuples():
            if self.idle_days is not None and last is not None and (day.day - last).days > self.idle_days:
                budget, n = None, 0
            flux: Decimal | None = None if pd.isna(day.day_flux) else day.day_flux
            if flux is not None:
                budget = flux if budget is None else budget + flux
            n, last = n + int(day.n), day.day
            out.append((key[0], last, flux, int(day.n), budget, n))
        self.total.update((budget, n, last))
        if self.idle_days is not None:
            self.handle.registerTimer(self._silent_from(last))
        yield pd.DataFrame(out, columns=["tower_id", "day", "day_flux", "n", "budget", "n_so_far"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.total.clear()
        return iter(())

    def close(self) -> None:
        pass


def budget_days(readings: DataFrame, digits: int = DIGITS, idle_days: int | None = None) -> DataFrame:
    """``towers.running_budget`` of a stream with a watermark: closed days, each given out once.

    Readings that come after their day has closed are dropped, as by any window.
    """
    days = readings.groupBy("tower_id", F.window("ts", "1 day").alias("w")).agg(
        F.sum(fixed_flux(digits)).alias("day_flux"), F.count("flux").alias("n")
    )
    closed = days.select("tower_id", F.window_time("w").alias("closed"), F.to_date("w.start").alias("day"), "day_flux", "n")
    return closed.groupBy("tower_id").transformWithStateInPandas(
        TowerTotal(digits, idle_days), budget_schema(digits), "Append", "EventTime"
    )
