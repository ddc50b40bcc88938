"""Validation, quality control, gaps and segments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import stats
from fieldtrace.functions.geo import is_finite
from fieldtrace.operators.tracks import FLAGS, ORDER, REQUIRED, blank, invalid_reason, numbered, prepare, row_flags, track_groups, with_order


@dataclass
class Validation:
    """A verdict on the schema, and lazy tables about the rows (None where the schema isn't valid)."""

    is_valid: bool
    message: str
    data: DataFrame | None = None
    qc: DataFrame | None = None
    invalid_rows: DataFrame | None = None
    intervals: DataFrame | None = None
    hints: dict[str, list[str]] = field(default_factory=dict)

    def __str__(self) -> str:
        return self.message


@dataclass
class Quality:
    """Issue tables of a valid fix table."""

    qc: DataFrame
    invalid_rows: DataFrame
    duplicate_rows: DataFrame
    gap_rows: DataFrame
    non_positive_intervals: DataFrame

    def __str__(self) -> str:
        rows = {r["metric"]: r["count"] for r in self.qc.collect()}
        return ", ".join(f"{k} {int(v)}" for k, v in rows.items() if v is not None)


def intervals(df: DataFrame, groups: list[str], large_gap_mins: float = 60, order_col: str = ORDER) -> DataFrame:
    """Times between consecutive rows of a group, in input order, rows without a time aside."""
    if not large_gap_mins > 0:
        raise ValueError("large_gap_mins must be positive")
    w = Window.partitionBy(*groups).orderBy(order_col)
    out = df.filter("datetime is not null").select(*groups, F.lag(order_col).over(w).alias("previous_row_id"), F.col(order_col).alias("row_id"), F.lag("datetime").over(w).alias("previous_datetime"), "datetime")
    out = out.filter("previous_datetime is not null").withColumn("interval_s", (F.unix_micros("datetime") - F.unix_micros("previous_datetime")) / 1e6)
    out = out.withColumn("interval_mins", F.col("interval_s") / 60)
    kind = F.when(F.col("interval_s") < 0, "negative").when(F.col("interval_s") == 0, "zero").when(F.col("interval_mins") > large_gap_mins, "large_gap").otherwise("positive")
    return out.withColumns({"interval_type": kind, "is_non_positive_interval": F.col("interval_s") <= 0, "is_large_gap": F.col("interval_mins") > large_gap_mins})


def gps_check_gaps(df: DataFrame, large_gap_mins: float = 60, groups: list[str] | None = None, order_col: str = ORDER) -> DataFrame:
    """Intervals that are large, zero or negative."""
    df = with_order(prepare(df), order_col)
    return intervals(df, track_groups(df, groups), large_gap_mins, order_col).filter("is_large_gap or is_non_positive_interval")


def gps_append_segments(df: DataFrame, large_gap_mins: float = 60, groups: list[str] | None = None, segment_col: str = "segment_id", order_col: str = ORDER) -> DataFrame:
    """Number the continuous pieces of a track, in input order: a large or negative gap, or a missing time, begins one."""
    df = with_order(prepare(df), order_col)
    grp = track_groups(df, groups)
    w = Window.partitionBy(*grp).orderBy(order_col)
    gap = (F.unix_micros("datetime") - F.unix_micros(F.lag("datetime").over(w))) / 60e6
    starts = (F.row_number().over(w) == 1) | F.coalesce((gap < 0) | (gap > large_gap_mins), F.lit(True))
    out = df.withColumn("_starts", starts.cast("int")).withColumn("_n", F.sum("_starts").over(w))
    return out.withColumn(segment_col, F.format_string("%s_seg%03d", F.coalesce("sensor_id", F.lit("NA")), F.col("_n"))).drop("_starts", "_n")


def _duplicate_keys(df: DataFrame, groups: list[str], order_col: str = ORDER) -> tuple[list[Column], list[str], Column]:
    """What tells records apart, what tells fixes apart, and whether the latter is complete.

    Records are told apart by two hashes, each with the places of nulls: two numbers are compared, not all columns.
    """
    whole = [x for c in df.columns if c != order_col for x in (F.col(c), F.col(c).isNull())]
    key = list(dict.fromkeys([*groups, "sensor_id", "datetime", "lon", "lat"]))
    complete = F.lit(True)
    for c in key:
        complete = complete & (~blank(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).isNotNull())
    return [F.xxhash64(*whole), F.xxhash64(F.lit(1), *whole)], key, complete


def duplicate_flags(df: DataFrame, groups: list[str], order_col: str = ORDER) -> DataFrame:
    """Add ``duplicate_record`` (all columns as in an earlier row) and ``duplicate_fix`` (complete key as in one)."""
    hashes, key, complete = _duplicate_keys(df, groups, order_col)
    record = F.row_number().over(Window.partitionBy(*hashes).orderBy(order_col)) > 1
    fix = complete & (F.row_number().over(Window.partitionBy(*key).orderBy(order_col)) > 1)
    return df.withColumns({"duplicate_record": record, "duplicate_fix": fix})


def qc_table(df: DataFrame, groups: list[str], large_gap_mins: float = 60, check_zero_zero: bool = False, order_col: str = ORDER) -> DataFrame:
    """``metric, count, proportion, value, datetime_value, threshold_mins``: 29 rows about a fix table."""
    flagged = row_flags(df, check_zero_zero)
    animals = "animal_id" in df.columns
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    trimmed = lambda c: F.when(~blank(F.col(c)), F.trim(F.col(c).cast("string")))
    tests = {c: F.col(c) for c in FLAGS} | {"missing_coordinates": F.col("missing_lon") | F.col("missing_lat"), "invalid_coordinates": F.col("bad_lon") | F.col("bad_lat")}
    late = F.col("datetime") < F.lag("datetime").over(Window.partitionBy(*groups).orderBy(order_col))
    tests["late"], flagged = F.col("_late"), flagged.withColumn("_late", F.coalesce(late, F.lit(False)))
    # Counts are made by sensor and animal first, so that distinct ones are told apart among few rows.
    by_id = flagged.groupBy(trimmed("sensor_id").alias("_s"), (trimmed("animal_id") if animals else F.lit(None).cast("string")).alias("_a")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("datetime").alias("datetime_min"), F.max("datetime").alias("datetime_max"), *[F.sum(t.cast("long")).alias(c) for c, t in tests.items()]
    )
    main = by_id.agg(
        count("n_rows").alias("n_rows"), F.countDistinct("_s").alias("n_sensors"), (F.countDistinct("_a") if animals else F.lit(None).cast("long")).alias("n_animals"),
        F.min("datetime_min").alias("datetime_min"), F.max("datetime_max").alias("datetime_max"), *[count(c).alias(c) for c in tests],
    )
    hashes, key, complete = _duplicate_keys(df, groups, order_col)
    again = lambda keyed: keyed.agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    twins = again(df.groupBy(*hashes)).select(F.col("n").alias("dup_record")).join(F.broadcast(again(df.filter(complete).groupBy(*key)).select(F.col("n").alias("dup_fix"))))
    # Intervals are counted by their length once; all that is said about them follows from the counts.
    lengths = stats.counted(intervals(df, groups, large_gap_mins, order_col), F.col("interval_s"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    gaps = lengths.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_intervals"), F.min("v").alias("i_min"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("i_mean"), F.max("v").alias("i_max"),
        some(F.col("v") <= 0).alias("non_positive"), some(F.col("v") / 60 > large_gap_mins).alias("large"),
    ).join(F.broadcast(stats.quantiles(lengths, {"i_q25": 0.25, "i_med": 0.5, "i_q75": 0.75})))
    one = main.join(F.broadcast(twins)).join(F.broadcast(gaps))  # one row each
    n, none = F.col("n_rows"), F.lit(None)

    def row(metric, c=none, p=none, v=none, t=none, threshold=none):
        return F.struct(F.lit(metric).alias("metric"), c.cast("double").alias("count"), p.cast("double").alias("proportion"), v.cast("double").alias("value"), t.cast("timestamp").alias("datetime_value"), threshold.cast("double").alias("threshold_mins"))

    part = lambda metric, c: row(metric, F.col(c), stats.proportion(F.col(c), n))
    animal = F.when(F.lit(animals), F.col("bad_animal_id"))
    rows = [
        row("n_rows", n, F.lit(1)), row("n_fixes", n, F.lit(1)), row("n_sensors", F.col("n_sensors")), row("n_animals", F.col("n_animals")), row("datetime_min", t=F.col("datetime_min")), row("datetime_max", t=F.col("datetime_max")),
        part("n_invalid_rows", "bad_row"), part("n_missing_sensor_id", "bad_sensor"), row("n_missing_animal_id", animal, stats.proportion(animal, n)), part("n_invalid_datetime", "bad_datetime"),
        part("n_missing_lon", "missing_lon"), part("n_missing_lat", "missing_lat"), part("n_missing_coordinates", "missing_coordinates"), part("n_invalid_lon", "bad_lon"), part("n_invalid_lat", "bad_lat"),
        part("n_invalid_coordinates", "invalid_coordinates"), part("n_zero_zero", "zero_zero"), part("n_duplicate_fixes", "dup_fix"), part("n_duplicate_records", "dup_record"), part("n_out_of_order", "late"),
        row("n_intervals", F.col("n_intervals"), F.when(n > 1, stats.proportion(F.col("n_intervals"), n - 1))), row("interval_min_s", v=F.col("i_min")), row("interval_q25_s", v=F.col("i_q25")), row("interval_median_s", v=F.col("i_med")),
        row("interval_mean_s", v=F.col("i_mean")), row("interval_q75_s", v=F.col("i_q75")), row("interval_max_s", v=F.col("i_max")),
        row("n_non_positive_intervals", F.col("non_positive"), stats.proportion(F.col("non_positive"), F.col("n_intervals"))), row("n_large_gaps", F.col("large"), stats.proportion(F.col("large"), F.col("n_intervals")), threshold=F.lit(float(large_gap_mins))),
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def invalid_rows(df: DataFrame, check_zero_zero: bool = False) -> DataFrame:
    """Rows with a bad id, time or coordinate, with ``invalid_reason``."""
    return row_flags(df, check_zero_zero).filter("bad_row").withColumn("invalid_reason", invalid_reason()).drop(*FLAGS)


def _hints(df: DataFrame) -> dict[str, list[str]]:
    low = {c: c.lower() for c in df.columns}
    looks = {"sensor_id": ("sensor", "device", "collar", "tag"), "datetime": ("time", "date", "stamp"), "lon": ("lon", "lng", "x"), "lat": ("lat", "y")}
    return {need: [c for c, x in low.items() if any(p == x or (len(p) > 1 and p in x) for p in parts)] for need, parts in looks.items() if need not in df.columns}


def _unusable(df: DataFrame, typed: DataFrame) -> dict[str, str]:
    """Required columns without a single usable value, and why. Reads the table once; an empty table has none."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    given = df.agg(some(~blank(F.col("datetime"))).alias("given"))
    good = typed.agg(
        some(~blank(F.col("sensor_id"))).alias("sensor_id"), some(F.col("datetime").isNotNull()).alias("datetime"),
        some(is_finite(F.col("lon")) & F.col("lon").between(-180, 180)).alias("lon"), some(is_finite(F.col("lat")) & F.col("lat").between(-90, 90)).alias("lat"),
    )
    one = good.first()
    why = {"sensor_id": "no value that isn't blank", "lon": "no value from -180 to 180", "lat": "no value from -90 to 90"}
    if not one["datetime"]:
        why["datetime"] = "no value is a time" if given.first()["given"] else "no value"
    return {c: why[c] for c in REQUIRED if not one[c]}


def gps_validate(df: DataFrame, drop_invalid: bool = False, large_gap_mins: float = 60, groups: list[str] | None = None, check_zero_zero: bool = False, order_col: str = ORDER) -> Validation:
    """Check the schema and describe the rows. A bad schema gives a verdict with hints, not an error.

    A required column that is there but holds no usable value is as bad as one that isn't.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        hints = _hints(df)
        said = "; ".join(f"{c}: perhaps {', '.join(h)}" for c, h in hints.items() if h)
        return Validation(False, "missing columns: " + ", ".join(missing) + (f" ({said})" if said else ""), hints=hints)
    typed = with_order(prepare(df), order_col)
    if unusable := _unusable(df, typed):
        return Validation(False, "; ".join(f"{c}: {why}" for c, why in unusable.items()))
    grp = track_groups(typed, groups)
    bad = invalid_rows(typed, check_zero_zero)
    data = row_flags(typed, check_zero_zero).filter("not bad_row").drop(*FLAGS) if drop_invalid else typed
    return Validation(True, "valid", data, qc_table(typed, grp, large_gap_mins, check_zero_zero, order_col), bad, intervals(typed, grp, large_gap_mins, order_col))


def gps_qc_summary(df: DataFrame, large_gap_mins: float = 60, groups: list[str] | None = None, check_zero_zero: bool = False, order_col: str = ORDER) -> Quality:
    """Issue tables; raises where the schema isn't valid."""
    verdict = gps_validate(df, False, large_gap_mins, groups, check_zero_zero, order_col)
    if not verdict.is_valid:
        raise ValueError(verdict.message)
    typed = verdict.data
    grp = track_groups(typed, groups)
    twins = duplicate_flags(typed, grp, order_col).filter("duplicate_record or duplicate_fix")
    large = numbered(verdict.intervals.filter("is_large_gap"), grp, ["row_id"], "gap_id")
    sides = large.select("gap_id", "interval_mins", F.explode(F.array(F.struct(F.lit("before").alias("gap_side"), F.col("previous_row_id").alias("row_id")), F.struct(F.lit("after").alias("gap_side"), F.col("row_id").alias("row_id")))).alias("s"))
    at = typed.select(F.col(order_col).alias("row_id"), *grp, "datetime", "lon", "lat")
    gap_rows = sides.select("gap_id", "s.gap_side", "s.row_id", F.col("interval_mins").alias("gap_mins")).join(at, "row_id").select("gap_id", "gap_side", "row_id", *grp, "datetime", "lon", "lat", "gap_mins")
    not_positive = verdict.intervals.filter("is_non_positive_interval").drop("is_large_gap", "is_non_positive_interval")
    return Quality(verdict.qc, verdict.invalid_rows, twins, gap_rows, not_positive)
