"""Calendar and fixed-length epochs, in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH_COLUMNS = ["epoch", "epoch_start", "epoch_end", "epoch_mins"]
_UNSET = object()


def resolve_epoch(epoch: object = _UNSET, epoch_mins: float | None = None, default: str = "day") -> tuple[str, float | None]:
    """The epoch level; ``epoch_mins`` selects fixed-length epochs and excludes any other level."""
    if epoch_mins is not None:
        if epoch is not _UNSET and epoch is not None and epoch != "interval":
            raise ValueError("epoch_mins goes with epoch='interval' or without epoch")
        if not epoch_mins > 0:
            raise ValueError("epoch_mins must be positive")
        return "interval", float(epoch_mins)
    level = default if epoch is _UNSET or epoch is None else epoch
    if level == "interval":
        raise ValueError("epoch='interval' needs epoch_mins")
    if level not in ("day", "hour", "week", "month"):
        raise ValueError(f"unknown epoch {level!r}")
    return level, None


_DAY, _HOUR = 86_400_000_000, 3_600_000_000


def instant(x: Column) -> Column:
    """The instant of a time without a zone, read as UTC whatever the session's zone."""
    gap = x - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), gap).cast("decimal(20,6)")
    seconds = part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def utc_date(us: Column) -> Column:
    """The UTC day of microseconds since the Unix epoch."""
    return F.date_from_unix_date(F.floor(us / _DAY).cast("int"))


def utc_text(us: Column) -> Column:
    """Microseconds since the Unix epoch as ``yyyy-MM-dd HH:mm:ss`` in UTC."""
    second = F.floor(F.pmod(us, F.lit(_DAY)) / 1_000_000)
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(utc_date(us).cast("string"), F.lit(" "), two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60))


def epoch_columns(datetime: Column, epoch: str, epoch_mins: float | None = None) -> list[Column]:
    """``epoch`` (a label), ``epoch_start``, ``epoch_end``, ``epoch_mins`` of a timestamp.

    All in UTC by arithmetic on microseconds and dates, which no session zone touches.
    """
    us = F.unix_micros(datetime)
    at = lambda date: F.unix_date(date).cast("long") * _DAY
    if epoch in ("interval", "hour"):
        width = _HOUR if epoch == "hour" else int(round(epoch_mins * 60e6))
        start = F.floor(us / width).cast("long") * width
        end, label = start + width, utc_text(start)
    elif epoch == "month":
        first = F.trunc(utc_date(us), "month")
        start, end, label = at(first), at(F.add_months(first, 1)), F.substring(first.cast("string"), 1, 7)
    else:
        day = utc_date(us)
        first = F.trunc(day, "week") if epoch == "week" else day
        start = at(first)
        end = start + (7 * _DAY if epoch == "week" else _DAY)
        label = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")) if epoch == "week" else day.cast("string")
    mins = F.when(us.isNotNull(), F.lit(float(epoch_mins))) if epoch == "interval" else (end - start) / 60e6
    return [label.alias("epoch"), F.timestamp_micros(start).alias("epoch_start"), F.timestamp_micros(end).alias("epoch_end"), mins.alias("epoch_mins")]


def with_epochs(df: DataFrame, epoch: str, epoch_mins: float | None = None) -> DataFrame:
    kept = [c for c in df.columns if c not in EPOCH_COLUMNS]
    return df.select(*kept, *epoch_columns(F.col("datetime"), epoch, epoch_mins))
