"""Fix tables: typed columns, row checks, default groups.

A fix table has ``sensor_id, datetime, lon, lat`` and any other columns. Rows have no order in Spark, so where an
operator speaks of input order it uses ``order_col``, a column whose values are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions.epochs import instant
from fieldtrace.functions.geo import is_finite

REQUIRED = ("sensor_id", "datetime", "lon", "lat")
ORDER = "order_col"

#: Text forms of a time, tried in this order; the month comes before the day.
DATETIME_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss[.SSSSSS]",
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd",
]


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError("missing columns: " + ", ".join(missing))


def parse_datetime(x: Column) -> Column:
    """A timestamp from text, by the first form that fits; null if none does. Text without an offset is UTC."""
    zoned = lambda f: (F.trim(x), f) if f.endswith("X") else (F.concat(F.trim(x), F.lit("Z")), f + "X")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for text, f in map(zoned, DATETIME_FORMATS)])


def as_instant(x: Column, kind: T.DataType | str) -> Column:
    """A timestamp from text, a time without a zone or a date, all read as UTC, or from a timestamp."""
    if isinstance(kind, (T.StringType, str)):
        return parse_datetime(x)
    return instant(x.cast("timestamp_ntz")) if isinstance(kind, (T.TimestampNTZType, T.DateType)) else x.cast("timestamp")


def prepare(df: DataFrame) -> DataFrame:
    """Typed copy: text ids, UTC timestamps, double coordinates (text that is no number gives null)."""
    require(df, *REQUIRED)
    typed = {"sensor_id": F.col("sensor_id").cast("string"), "datetime": as_instant(F.col("datetime"), df.schema["datetime"].dataType)}
    typed |= {c: F.col(c).try_cast("double") for c in ("lon", "lat")}
    return df.select(*[typed[c].alias(c) if c in typed else F.col(c) for c in df.columns])


def with_order(df: DataFrame, order_col: str = ORDER) -> DataFrame:
    require(df, order_col)
    return df


def numbered(df: DataFrame, groups: list[str], within: list[str | Column], name: str) -> DataFrame:
    """Add one sequence from 1 over all rows: group after group, nulls first, then by ``within``.

    Rows are ordered inside their groups only; what is ordered as a whole has one row a group.
    """
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = df.withColumn("_own", F.row_number().over(Window.partitionBy(*groups).orderBy(*within)))
    return join_by(own, counts.select(*groups, before.alias("_before")), groups).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before")


def join_by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the keys stay once."""
    own, same = [f"_k{i}" for i in range(len(keys))], F.lit(True)
    for c, k in zip(keys, own, strict=True):
        right, same = right.withColumnRenamed(c, k), same & F.col(c).eqNullSafe(F.col(k))
    return left.join(right, same, how).drop(*own)


def blank(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")) == "", F.lit(True))


def row_flags(df: DataFrame, check_zero_zero: bool = False) -> DataFrame:
    """Add boolean columns about ids, times and coordinates; ``bad_row`` doesn't look at animal ids."""
    lon, lat = F.col("lon"), F.col("lat")
    missing_lon, missing_lat = ~is_finite(lon), ~is_finite(lat)
    invalid_lon = ~missing_lon & ~F.coalesce(lon.between(-180, 180), F.lit(True))
    invalid_lat = ~missing_lat & ~F.coalesce(lat.between(-90, 90), F.lit(True))
    zero = F.coalesce((lon == 0) & (lat == 0), F.lit(False)) if check_zero_zero else F.lit(False)
    out = df.withColumns({
        "bad_sensor": blank(F.col("sensor_id")),
        "bad_animal_id": blank(F.col("animal_id")) if "animal_id" in df.columns else F.lit(False),
        "bad_datetime": F.col("datetime").isNull(),
        "missing_lon": missing_lon, "missing_lat": missing_lat, "invalid_lon": invalid_lon, "invalid_lat": invalid_lat, "zero_zero": zero,
    })
    return out.withColumns({
        "bad_lon": F.col("missing_lon") | F.col("invalid_lon") | F.col("zero_zero"),
        "bad_lat": F.col("missing_lat") | F.col("invalid_lat") | F.col("zero_zero"),
    }).withColumn("bad_row", F.col("bad_sensor") | F.col("bad_datetime") | F.col("bad_lon") | F.col("bad_lat"))


FLAGS = ["bad_sensor", "bad_animal_id", "bad_datetime", "missing_lon", "missing_lat", "invalid_lon", "invalid_lat", "zero_zero", "bad_lon", "bad_lat", "bad_row"]


def invalid_reason() -> Column:
    """The reasons of a flagged row, ``;`` between."""
    named = [("missing_sensor_id", "bad_sensor"), ("invalid_datetime", "bad_datetime"), ("missing_lon", "missing_lon"), ("missing_lat", "missing_lat"), ("invalid_lon", "invalid_lon"), ("invalid_lat", "invalid_lat"), ("zero_zero", "zero_zero")]
    return F.concat_ws(";", *[F.when(F.col(flag), F.lit(name)) for name, flag in named])


def track_groups(df: DataFrame, groups: list[str] | None = None) -> list[str]:
    """The columns that part tracks: those given, or deployment and sensor, or the sensor."""
    if groups is not None:
        require(df, *groups)
        return list(groups)
    return ["deployment_id", "sensor_id"] if "deployment_id" in df.columns else ["sensor_id"]


def time_groups(df: DataFrame, groups: list[str] | None = None) -> list[str]:
    """Groups of the operators on time grids: all of these that exist."""
    if groups is not None:
        require(df, *groups)
        return list(groups)
    return [c for c in ("deployment_id", "animal_id", "sensor_id", "segment_id") if c in df.columns]


def summary_groups(df: DataFrame, groups: list[str] | None = None) -> list[str]:
    if groups is not None:
        require(df, *groups)
        return list(groups)
    return [c for c in ("deployment_id", "animal_id", "sensor_id") if c in df.columns]


def herd_groups(df: DataFrame, groups: list[str] | None = None) -> list[str]:
    if groups is not None:
        require(df, *groups)
        return list(groups)
    return [c for c in ("deployment_id", "paddock") if c in df.columns]
