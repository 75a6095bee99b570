"""Time expressions of the market calendar: built-in, over UTC timestamps, independent of the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
NEW_YORK = "America/New_York"


def local_timestamp(ts: Column, zone: str = NEW_YORK) -> Column:
    """The wall clock of ``zone`` at an instant."""
    return F.from_utc_timestamp(ts, zone)


def local_date_text(ts: Column, zone: str = NEW_YORK) -> Column:
    """Local date as yyyy-MM-dd."""
    return F.date_format(local_timestamp(ts, zone), "yyyy-MM-dd")


def hour_ending(ts: Column, zone: str = NEW_YORK) -> Column:
    """Wall-clock hour plus 1, in 1..24."""
    return F.hour(local_timestamp(ts, zone)) + 1


def decision_cutoff(target_date: Column, zone: str = NEW_YORK, hour: int = 10) -> Column:
    """The instant ``hour`` o'clock local time on the day before a target date."""
    return F.to_utc_timestamp(F.date_sub(target_date, 1).cast("timestamp") + F.make_dt_interval(hours=F.lit(hour)), zone)


def hour_text(utc_micros: Column) -> Column:
    """An instant's hour as YYYY-MM-DDTHH:00:00Z."""
    return F.date_format(F.timestamp_micros(utc_micros), "yyyy-MM-dd'T'HH':00:00Z'")
