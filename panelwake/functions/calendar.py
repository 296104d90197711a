"""Season calendar: a season starts on 1 October and ends on 31 May; June to September is off-season."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def season_of(date: Column | str) -> Column:
    """Start year of the season a date falls in, NULL in the off-season."""
    d = _col(date)
    return F.when(F.month(d) >= 10, F.year(d)).when(F.month(d) <= 5, F.year(d) - 1)


def season_label(season: Column | str) -> Column:
    """2019 -> '2019-20'."""
    s = _col(season)
    return F.format_string("%d-%02d", s, F.pmod(s + 1, F.lit(100)))


def day_number(ts: Column | str) -> Column:
    """Days since 1970-01-01 of the calendar day."""
    return F.unix_date(F.to_date(_col(ts)))


def cutoff(season: Column | str) -> Column:
    """First day of a season; features of that season may only use earlier events."""
    return F.make_date(_col(season), F.lit(10), F.lit(1))


def season_end(season: Column | str) -> Column:
    """First day after a season."""
    return F.make_date(_col(season) + 1, F.lit(6), F.lit(1))


def next_cutoff_season(date: Column | str) -> Column:
    """The first season whose cutoff lies strictly after the date."""
    d = _col(date)
    return F.year(d) + F.when(F.month(d) >= 10, 1).otherwise(0)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp; the session zone plays no part."""
    t = _col(ts).cast("timestamp_ntz")
    minutes = F.unix_date(F.to_date(t)).cast("long") * 1440 + F.hour(t) * 60 + F.minute(t)
    return minutes * 60000000 + (F.extract(F.lit("SECOND"), t) * 1000000).cast("long")


def elapsed_days(start_micros: Column, end_micros: Column) -> Column:
    """Fractional days between two microsecond counts."""
    return (end_micros - start_micros) / 86400000000.0


def in_months(date: Column | str, months: list[int]) -> Column:
    return F.month(_col(date)).isin(*months)
