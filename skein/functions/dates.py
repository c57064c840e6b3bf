"""Local days, calendar grids, periods and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = (7, 30, 90)  # fixed values: lengths of the periods in days


def local_day(at: Column, zone: str) -> Column:
    """Calendar day of an instant in a zone, as text (yyyy-MM-dd)."""
    return F.date_format(F.from_utc_timestamp(at.cast("timestamp"), zone), "yyyy-MM-dd")


def local_midnight(day: Column, zone: str) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def day_seconds(day: Column, zone: str) -> Column:
    """Length of a local day: 82,800 to 90,000 seconds where clocks change."""
    return F.unix_timestamp(local_midnight(F.date_add(day, 1), zone)) - F.unix_timestamp(local_midnight(day, zone))


def weekday(day: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(day) - 1


def civil_day_number(day: Column) -> Column:
    return F.unix_date(day.cast("date"))


def month_grid(months: DataFrame, *, month: str = "month") -> DataFrame:
    """(month, week, weekday, day): whole weeks from Sunday on; places outside the month have no day."""
    first = F.trunc(F.col(month).cast("date"), "month")
    lead = weekday(first)
    cells = F.ceil((lead + F.dayofmonth(F.last_day(first))) / 7) * 7
    grid = months.select(month, first.alias("first"), lead.alias("lead"), F.explode(F.sequence(F.lit(0), (cells - 1).cast("int"))).alias("cell"))
    day = F.date_add(F.col("first"), F.col("cell") - F.col("lead"))
    inside = F.trunc(day, "month") == F.col("first")
    return grid.select(month, F.floor(F.col("cell") / 7).cast("int").alias("week"), (F.col("cell") % 7).alias("weekday"), F.when(inside, day).alias("day"))


def covering_period(day: Column, today: Column) -> Column:
    """The shortest period that reaches back to the day; null for older days."""
    age = F.datediff(today, day)
    out = F.lit(None).cast("int")
    for length in sorted(PERIODS, reverse=True):
        out = F.when(age < length, F.lit(length)).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds (HH:MM:SS), held at a hundred hours; a dash for no value."""
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(seconds / 3600), two(F.floor(seconds / 60) % 60), two(seconds % 60))
    return F.when(seconds.isNull(), "—").when(seconds >= 360_000, "≥100h").otherwise(clock)


def stale(generated: Column, now: Column, zone: str, *, after: int = 1800, ahead: int = 300) -> Column:
    """True for a snapshot that is too old, from the future or of another local day; seconds since the epoch."""
    other_day = local_day(F.timestamp_seconds(generated), zone) != local_day(F.timestamp_seconds(now), zone)
    return generated.isNull() | (now - generated > after) | (generated - now > ahead) | other_day
