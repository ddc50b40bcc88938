"""Small fix tables; all times count from 2024-01-01 00:00:00 UTC."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

T0 = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def table(spark: SparkSession, rows: list[tuple], extra: str = "") -> DataFrame:
    """Rows of (deployment_id, sensor_id, seconds, lon, lat, *extra), numbered in order."""
    schema = "deployment_id string, sensor_id string, datetime timestamp, lon double, lat double" + (", " + extra if extra else "") + ", order_col long"
    num = lambda v: None if v is None else float(v)
    made = [(d, s, None if t is None else at(t), num(x), num(y), *more, k) for k, (d, s, t, x, y, *more) in enumerate(rows)]
    return spark.createDataFrame(made, schema)


def track_6(spark: SparkSession) -> DataFrame:
    lon, lat = (0, 1, 2, 3, 3, 4), (0, 0, 1, 1, 2, 2)
    return table(spark, [("D1", "A", 60 * i, 150 + lon[i] * 1e-4, -30 + lat[i] * 1e-4) for i in range(6)])


def rows_of(df: DataFrame, by: str = "order_col") -> list:
    return df.orderBy(by).collect()
