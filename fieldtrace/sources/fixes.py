"""Sources of fixes: files, and the track view over the driver's event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions.epochs import epoch_columns, instant

#: Columns of the track view as SQL that Spark and DuckDB read alike, to the last bit.
FIX_COLUMNS = {
    "sensor_id": "concat('S', lpad(cast(user_id as varchar(20)), 5, '0'))",
    "animal_id": "concat('A', lpad(cast(user_id as varchar(20)), 5, '0'))",
    "deployment_id": "concat('D', cast(user_id % 4 as varchar(20)))",
    "datetime": "cast(ts as timestamp)",
    "lon": "150.0e0 + (user_id % 10) * 0.002e0 + ((event_id * 7919) % 2003) * 0.000001e0 + value * 0.00001e0",
    "lat": "-30.0e0 - (user_id % 7) * 0.002e0 - ((event_id * 104729) % 1999) * 0.000001e0 - value * 0.00001e0",
    "treatment": "case when user_id % 2 = 0 then 'control' else 'trial' end",
    "state": "event_type",
    "order_col": "event_id",
}
#: The same with planted errors: a bad longitude, (0, 0), missing times, missing sensors.
DIRTY_COLUMNS = FIX_COLUMNS | {
    "sensor_id": f"case when event_id % 103 = 0 then ' ' else {FIX_COLUMNS['sensor_id']} end",
    "datetime": "case when event_id % 89 = 0 then null else cast(ts as timestamp) end",
    "lon": f"case when event_id % 97 = 0 then 0.0e0 when event_id % 101 = 0 then 181.0e0 else {FIX_COLUMNS['lon']} end",
    "lat": f"case when event_id % 97 = 0 then 0.0e0 when event_id % 107 = 0 then null else {FIX_COLUMNS['lat']} end",
}
#: The same with one track that holds a third of all rows.
HOT_COLUMNS = FIX_COLUMNS | {c: f"case when event_id % 3 = 0 then '{k}' else {FIX_COLUMNS[c]} end" for c, k in (("sensor_id", "S"), ("animal_id", "A"), ("deployment_id", "D"))}
SHARED_TIME = FIX_COLUMNS | {"datetime": "date_trunc('hour', cast(ts as timestamp))"}


def select_sql(columns: dict[str, str], where: str = "") -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM events" + (f" WHERE {where}" if where else "")


def dirty_sql() -> str:
    """Planted errors, and every fiftieth row again under another order."""
    again = DIRTY_COLUMNS | {"order_col": "event_id + 1000000000"}
    return f"{select_sql(DIRTY_COLUMNS)} UNION ALL {select_sql(again, 'event_id % 50 = 0')}"


def _view(spark: SparkSession, sf_dir: str, columns: dict[str, str], where: str | None = None) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    if isinstance(events.schema["ts"].dataType, T.TimestampNTZType):
        events = events.withColumn("ts", instant(F.col("ts")))
    return (events.filter(where) if where else events).selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fixes: one track per user."""
    return _view(spark, sf_dir, FIX_COLUMNS)


def hot_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fixes, a third of them one track."""
    return _view(spark, sf_dir, HOT_COLUMNS)


def hourly_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with times cut to hours, so that animals share them."""
    return fixes(spark, sf_dir).withColumn("datetime", epoch_columns(F.col("datetime"), "hour")[1])


def dirty_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = DIRTY_COLUMNS | {"order_col": "event_id + 1000000000"}
    return _view(spark, sf_dir, DIRTY_COLUMNS).unionByName(_view(spark, sf_dir, again, "event_id % 50 = 0"))


def read_fixes(spark: SparkSession, path: str, schema: str, fmt: str = "csv", **options) -> DataFrame:
    """A fix table from files, with an explicit schema: nothing is inferred by reading the data twice."""
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        options = {"header": True} | options
    return reader.options(**options).load(path)
