"""Explicit point in time for every time-window answer.

The reference evaluates ``CURRENT_DATE`` / ``NOW()`` implicitly; here the
instant is a parameter.  All boundaries are computed once on the driver and
enter plans as timestamp literals, so Catalyst folds them and parquet
filters on stored timestamps push down to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parse(as_of) -> datetime:
    if isinstance(as_of, datetime):
        return as_of.replace(tzinfo=None)
    if isinstance(as_of, date):
        return datetime(as_of.year, as_of.month, as_of.day)
    return datetime.fromisoformat(str(as_of).replace("Z", "").replace("T", " "))


def _add_months(d: date, n: int) -> date:
    m = d.month - 1 + n
    return date(d.year + m // 12, m % 12 + 1, 1)


@dataclass(frozen=True)
class Clock:
    """Window boundaries for one ``as_of`` instant (UTC wall clock)."""

    as_of: datetime

    @classmethod
    def at(cls, as_of) -> "Clock":
        return cls(_parse(as_of))

    @property
    def today(self) -> date:
        return self.as_of.date()

    @property
    def week_start(self) -> date:          # date_trunc('week', now): Monday
        return self.today - timedelta(days=self.today.weekday())

    @property
    def month_start(self) -> date:
        return self.today.replace(day=1)

    @property
    def prev_month_start(self) -> date:
        return _add_months(self.month_start, -1)

    def days_ago(self, n: int) -> date:
        return self.today - timedelta(days=n)

    def months_ago(self, n: int) -> date:
        return _add_months(self.month_start, -n)

    @property
    def tomorrow(self) -> date:
        return self.today + timedelta(days=1)

    @property
    def next_month_start(self) -> date:
        return _add_months(self.month_start, 1)


def ts_lit(value) -> Column:
    """Timestamp literal read in the session time zone (UTC)."""
    if isinstance(value, datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.lit(text).cast("timestamp")


def date_lit(value: date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def sql_ts(value) -> str:
    """The same boundary as an ANSI SQL literal (used by the oracles)."""
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.strftime('%Y-%m-%d %H:%M:%S')}'"
    return f"TIMESTAMP '{value.isoformat()} 00:00:00'"


def sql_date(value: date) -> str:
    return f"DATE '{value.isoformat()}'"
