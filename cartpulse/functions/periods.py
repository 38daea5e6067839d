"""Calendar bounds of the feature windows.

All bounds depend only on the reference date, so they are computed once on
the driver and enter the plans as date literals: Catalyst folds them and the
scan gets plain range predicates.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass



def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


def shift_months(day: dt.date, months: int) -> dt.date:
    """Calendar month offset that clamps to the month end (2024-05-31 -3 -> 02-29)."""
    index = day.year * 12 + (day.month - 1) + months
    year, month = divmod(index, 12)
    month += 1
    last = calendar.monthrange(year, month)[1]
    return dt.date(year, month, min(day.day, last))


def shift_days(day: dt.date, days: int) -> dt.date:
    return day + dt.timedelta(days=days)


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


@dataclass(frozen=True)
class Windows:
    """Every window bound used by the pair features, for one reference date."""

    ref: dt.date
    cycle_months: int = 12
    block_days: int = 7
    freq_days: int = 180
    sow_recent_months: int = 12
    sow_total_months: int = 24
    series_months: int = 12
    season_months: int = 3

    @property
    def cycle_start(self) -> dt.date:
        return shift_months(self.ref, -self.cycle_months)

    @property
    def n_blocks(self) -> int:
        span = (self.ref - self.cycle_start).days
        return (span - 1) // self.block_days + 1

    @property
    def freq_start(self) -> dt.date:
        return shift_days(self.ref, -self.freq_days)

    @property
    def sow_recent_start(self) -> dt.date:
        return shift_months(self.ref, -self.sow_recent_months)

    @property
    def sow_start(self) -> dt.date:
        return shift_months(self.ref, -self.sow_total_months)

    @property
    def series_start(self) -> dt.date:
        return shift_months(month_start(self.ref), -self.series_months)

    @property
    def n_months(self) -> int:
        return self.series_months + 1

    # season need: current window (ref - m, ref], same window a year earlier,
    # whose start is offset from the current start (chained offsets)
    @property
    def season_start(self) -> dt.date:
        return shift_months(self.ref, -self.season_months)

    @property
    def season_prior_start(self) -> dt.date:
        return shift_months(self.season_start, -12)

    @property
    def season_prior_end(self) -> dt.date:
        return shift_months(self.ref, -12)

    @property
    def activity_start(self) -> dt.date:
        return self.cycle_start


def sql_date(day: dt.date) -> str:
    return f"DATE '{day.isoformat()}'"


def mmdd(day) -> str:
    """Suffix used to name per-cutoff artefacts (2025-11-09 -> '1109')."""
    return as_date(day).strftime("%m%d")
