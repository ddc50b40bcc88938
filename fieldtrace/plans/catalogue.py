"""Registered queries over the driver tables and their DuckDB oracles.

Results are projected alike in both engines: times as microseconds, metres to 3 places, rates and angles to 6,
coordinates to 9.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.operators import activity, alignment, cleaning, maps, movement, resources, social, spatial, summary, validation
from fieldtrace.plans import oracles as O
from fieldtrace.plans.layers import PADDOCKS, RESOURCES, boxes, corners
from fieldtrace.sources.fixes import dirty_fixes, fixes, hot_fixes, hourly_fixes

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    columns: dict[str, str]  # name: k as is, t time, n count, b flag, m metres, r rate, c coordinate, o coordinate whose means end in halves, d density
    sql: str | None = None


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    how = {
        "k": lambda c: F.col(c), "t": lambda c: F.unix_micros(F.col(c).cast("timestamp")), "n": lambda c: F.col(c).cast("long"), "b": lambda c: F.col(c).cast("boolean"),
        "m": lambda c: F.round(F.col(c).cast("double"), 3), "r": lambda c: F.round(F.col(c).cast("double"), 6),
        "c": lambda c: F.round(F.col(c).cast("double"), 9), "d": lambda c: F.round(F.col(c).cast("double") * 1e9), "o": lambda c: F.round(F.col(c).cast("double") + 3.3e-11, 9),
    }
    return df.select(*[how[k](c).alias(c) for c, k in columns.items()])


def _projected(sql: str, columns: dict[str, str]) -> str:
    how = {"k": "{0}", "t": "epoch_us({0})", "n": "CAST({0} AS BIGINT)", "b": "CAST({0} AS BOOLEAN)", "m": "round(CAST({0} AS DOUBLE), 3)", "r": "round(CAST({0} AS DOUBLE), 6)", "c": "round(CAST({0} AS DOUBLE), 9)", "d": "round(CAST({0} AS DOUBLE)*1e9)", "o": "round(CAST({0} AS DOUBLE)+3.3e-11, 9)"}
    return "SELECT " + ", ".join(f"{how[k].format(c)} AS {c}" for c, k in columns.items()) + f" FROM ({sql}) q"


TRACK = {"deployment_id": "k", "sensor_id": "k"}
EPOCH = {"epoch": "k", "epoch_start": "t", "epoch_end": "t", "epoch_mins": "r"}
STEP = TRACK | {"order_col": "n", "step_dt_s": "r", "step_m": "m", "speed_mps": "r", "bearing_deg": "r", "cum_distance_m": "m", "net_displacement_m": "m"}
MOVED = EPOCH | {
    "n_fixes": "n", "n_steps": "n", "start_datetime": "t", "end_datetime": "t", "span_s": "r", "total_distance_m": "m", "net_displacement_m": "m", "mean_step_m": "m", "median_step_m": "m", "p95_step_m": "m",
    "mean_speed_mps": "r", "max_speed_mps": "r", "p95_speed_mps": "r", "mean_abs_turn_rad": "r", "straightness_index": "r",
}
ANIMAL = {"deployment_id": "k", "animal_id": "k", "sensor_id": "k"}
SOCIAL = {
    "n_social_fixes": "n", "mean_social_group_size": "r", "mean_valid_fixes": "r", "mean_nearest_neighbour_m": "m", "median_nearest_neighbour_m": "m", "p95_nearest_neighbour_m": "m", "mean_distance_to_others_m": "m",
    "mean_n_neighbours_within_250m": "r", "prop_any_neighbour_within_250m": "r", "mean_n_neighbours_within_1000m": "r", "prop_any_neighbour_within_1000m": "r",
}
FIX = TRACK | {"order_col": "n", "datetime": "t", "lon": "c", "lat": "c"}
GRID = TRACK | {"animal_id": "k", "datetime": "t", "lon": "c", "lat": "c", "is_observed": "b"}
REACH = (250, 1000)
SAMPLED = {"n_expected_fixes": "n", "n_observed_fixes": "n", "n_interpolated": "n", "prop_interpolated": "r", "n_missing_datetime": "n", "n_observed_gaps": "n", "gap_min_s": "c", "gap_median_s": "c", "gap_max_s": "c", "sampling_interval_target_s": "r", "sampling_interval_achieved_s": "c", "interval_mins": "r"}


def _movement(level: str | None, mins: float | None = None) -> Query:
    options = {"epoch_mins": mins} if mins else {"epoch": level}
    return Query(lambda s, d: movement.gps_movement_summary(fixes(s, d), **options), TRACK | MOVED | {"treatment": "k"}, O.movement(level or "interval", mins, ["deployment_id", "sensor_id"], ["treatment"]))


def _segmented(s: SparkSession, d: str) -> DataFrame:
    return validation.gps_append_segments(fixes(s, d), large_gap_mins=1440)


def _all_blocks(s: SparkSession, d: str) -> DataFrame:
    df = hourly_fixes(s, d)
    use = resources.gps_resource_use(df, RESOURCES, 150, "day", metric_crs=3857)
    return summary.gps_epoch(df, "day", include=["movement", "social", "spatial", "resource_use"], resource_use=use, thresholds_m=REACH, metric_crs=3857)


def _map_polygons(s: SparkSession, d: str) -> DataFrame:
    ring = F.from_json("geometry", "type string, coordinates array<array<array<double>>>")["coordinates"][0]
    lon, lat = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return maps.map_polygons(boxes(fixes(s, d)), polygon_group="Paddocks").withColumns({"n_points": F.size(ring), "width": F.array_max(lon) - F.array_min(lon), "height": F.array_max(lat) - F.array_min(lat)})


QUERIES: dict[str, Query] = {
    "movement_day": _movement("day"),
    "movement_week": _movement("week"),
    "movement_month": _movement("month"),
    "movement_hour": _movement("hour"),
    "movement_interval": _movement(None, 720),
    "steps": Query(lambda s, d: movement.gps_steps(fixes(s, d)), STEP | {"turn_rad": "r"}, O.steps()),
    "steps_in_segments": Query(lambda s, d: movement.gps_steps(_segmented(s, d)), STEP | {"segment_id": "k", "turn_rad": "r"}, O.steps_in_segments()),
    "turning_degrees": Query(lambda s, d: movement.gps_turning(fixes(s, d), unit="degrees"), STEP | {"turn_deg": "r"}, O.steps()),
    "invalid_rows": Query(lambda s, d: validation.gps_validate(dirty_fixes(s, d), check_zero_zero=True).invalid_rows, {"order_col": "n", "sensor_id": "k", "invalid_reason": "k"}, O.invalid_rows()),
    "validated_rows": Query(lambda s, d: validation.gps_validate(dirty_fixes(s, d), drop_invalid=True).data, FIX, O.validated_rows()),
    "qc_metrics": Query(lambda s, d: validation.gps_qc_summary(dirty_fixes(s, d), large_gap_mins=1440).qc, {"metric": "k", "count": "r", "proportion": "r", "value": "r", "datetime_value": "t", "threshold_mins": "r"}, O.qc_metrics(1440)),
    "duplicate_rows": Query(lambda s, d: validation.gps_qc_summary(dirty_fixes(s, d)).duplicate_rows, {"order_col": "n", "duplicate_record": "b", "duplicate_fix": "b"}, O.duplicate_rows()),
    "qc_gap_rows": Query(lambda s, d: validation.gps_qc_summary(dirty_fixes(s, d), large_gap_mins=1440).gap_rows, TRACK | {"gap_id": "n", "gap_side": "k", "row_id": "n", "gap_mins": "c"}, O.qc_gap_rows(1440)),
    "check_gaps": Query(lambda s, d: validation.gps_check_gaps(dirty_fixes(s, d), 1440), TRACK | {"previous_row_id": "n", "row_id": "n", "interval_mins": "c", "interval_type": "k"}, O.check_gaps(1440)),
    "append_segments": Query(lambda s, d: validation.gps_append_segments(dirty_fixes(s, d), 1440), TRACK | {"order_col": "n", "segment_id": "k"}, O.segments(1440)),
    "clean_duplicates": Query(lambda s, d: cleaning.gps_clean_duplicates(dirty_fixes(s, d)).data, FIX, O.clean_duplicates()),
    "clean_errors_flag": Query(lambda s, d: cleaning.gps_clean_errors(dirty_fixes(s, d), action="flag", window_start="2024-01-03", window_end="2024-01-28").data, {"order_col": "n", "is_gps_error": "b", "gps_error_reason": "k"}, O.clean_errors("2024-01-03", "2024-01-28")),
    "clean_deployment_windows": Query(lambda s, d: cleaning.gps_clean_errors(fixes(s, d), deployment_windows=_windows(s), deployment_groups=["deployment_id"], action="flag").data, {"order_col": "n", "is_gps_error": "b", "gps_error_reason": "k"}, O.clean_windows()),
    "clean_speed_fixed": Query(lambda s, d: cleaning.gps_clean_speed_fixed(fixes(s, d), 0.05, action="flag").data, {"order_col": "n", "is_speed_outlier": "b"}, O.clean_speed("0.05")),
    "clean_speed_quantile": Query(lambda s, d: cleaning.gps_clean_speed_stat(fixes(s, d), "quantile", prob=0.99, min_threshold_mps=0.001, action="flag").data, {"order_col": "n", "is_speed_outlier": "b"}, O.clean_speed_quantile(0.99, 0.001)),
    "clean_speed_mad": Query(lambda s, d: cleaning.gps_clean_speed_stat(fixes(s, d), "mad", k=2, min_threshold_mps=0.001, action="flag").data, {"order_col": "n", "is_speed_outlier": "b"}, O.clean_speed_mad(2, 0.001)),
    "clean_pipeline": Query(lambda s, d: cleaning.gps_clean(dirty_fixes(s, d), ("duplicates", "errors", "speed_fixed"), max_speed_mps=0.05).data, FIX, O.clean_pipeline(0.05)),
    "clean_audit": Query(lambda s, d: cleaning.gps_clean(dirty_fixes(s, d), ("duplicates", "errors", "speed_fixed"), max_speed_mps=0.05).summary, {"step_no": "n", "step": "k", "action": "k", "before_n": "n", "after_n": "n", "n_removed": "n", "n_flagged": "n", "threshold_mps": "r"}, O.clean_audit(0.05)),
    "append_paddock": Query(lambda s, d: cleaning.gps_append_paddock_names(fixes(s, d), PADDOCKS, epoch="day", min_prop=0.5), {"order_col": "n", "assigned_paddock": "k"}, O.append_paddock(0.5)),
    "clean_spatial": Query(lambda s, d: cleaning.gps_clean_spatial(fixes(s, d), PADDOCKS, 50, action="flag").data, {"order_col": "n", "paddock": "k", "is_outside_boundary": "b"}, O.clean_spatial(50)),
    "layer_paddock": Query(lambda s, d: cleaning.gps_append_paddock_names(fixes(s, d), boxes(fixes(s, d)), epoch="day", min_prop=0.5), {"order_col": "n", "assigned_paddock": "k"}, O.layer_paddock(0.5)),
    "layer_nearest": Query(lambda s, d: resources.gps_resource_distance(fixes(s, d), corners(fixes(s, d)), 3857), {"order_col": "n", "nearest_resource_id": "k", "nearest_resource_type": "k", "resource_distance_m": "m"}, O.layer_nearest()),
    "clean_default": Query(lambda s, d: cleaning.gps_clean(dirty_fixes(s, d), max_speed_mps=0.05).data, FIX | {"lon_raw": "r", "lat_raw": "r"}),
    "denoise_spline": Query(lambda s, d: cleaning.gps_denoise(fixes(s, d)).data, FIX | {"lon_raw": "r", "lat_raw": "r"}),
    "denoise_states": Query(lambda s, d: cleaning.gps_denoise(fixes(s, d), "state_aware", "state", ("view", "click")).data, FIX | {"lon_raw": "r", "lat_raw": "r"}),
    "regularise": Query(lambda s, d: alignment.gps_regularise(fixes(s, d), 360), GRID | {"treatment": "k", "observed_datetime": "t", "time_offset_s": "r"}, O.regularise(360)),
    "interpolate": Query(lambda s, d: alignment.gps_interpolate(fixes(s, d), 360), GRID | {"treatment": "k", "is_interpolated": "b", "interpolation_gap_s": "r"}, O.interpolate(360)),
    "interpolate_hot_track": Query(lambda s, d: alignment.gps_interpolate(hot_fixes(s, d), 30, keep_extra=False), GRID | {"is_interpolated": "b", "interpolation_gap_s": "r"}, O.interpolate(30, O.HOT)),
    "downsample_rigid": Query(lambda s, d: alignment.gps_downsample(fixes(s, d), 720, "rigid", 60), FIX, O.downsample(720, 60, "rigid")),
    "downsample_representative": Query(lambda s, d: alignment.gps_downsample(fixes(s, d), 720), FIX, O.downsample(720, 0, "representative")),
    "grid_diagnostics": Query(lambda s, d: alignment.grid_diagnostics(fixes(s, d), alignment.gps_interpolate(fixes(s, d), 360), ["deployment_id", "animal_id", "sensor_id"]), ANIMAL | {"n_fixes": "n", "n_grid": "n", "n_observed": "n", "n_interpolated": "n", "median_gap_mins": "c", "max_gap_mins": "c"}, O.grid_diagnostics(360)),
    "regularise_diagnostics": Query(lambda s, d: alignment.temporal_diagnostics(fixes(s, d), alignment.gps_regularise(fixes(s, d), 360), "regularise", 360), ANIMAL | SAMPLED | {"n_observed_timestamps": "n", "n_observed_on_grid": "n", "n_unmatched_observed_fixes": "n", "n_duplicate_timestamps": "n", "median_abs_time_offset_s": "c", "max_abs_time_offset_s": "c", "tolerance_mins": "r"}, O.regularise_diagnostics(360)),
    "interpolate_diagnostics": Query(lambda s, d: alignment.temporal_diagnostics(fixes(s, d), alignment.gps_interpolate(fixes(s, d), 360), "interpolate", 360), ANIMAL | SAMPLED | {"n_observed_timestamps": "n", "n_valid_anchor_timestamps": "n", "n_observed_on_grid": "n", "n_unfilled_grid_fixes": "n", "n_duplicate_timestamps": "n", "n_invalid_coordinate_fixes": "n"}, O.interpolate_diagnostics(360)),
    "downsample_diagnostics": Query(lambda s, d: alignment.temporal_diagnostics(fixes(s, d), alignment.gps_downsample(fixes(s, d), 720, "rigid", 60), "downsample", 720, phase_mins=60), ANIMAL | SAMPLED | {"n_retained_fixes": "n", "phase_mins": "r"}, O.downsample_diagnostics(720, 60, "rigid")),
    "proximity": Query(lambda s, d: social.gps_proximity(hourly_fixes(s, d)), {"deployment_id": "k", "datetime": "t", "pair_id": "k", "distance_m": "m"}, O.proximity()),
    "nearest_neighbour": Query(lambda s, d: social.gps_nearest_neighbour(hourly_fixes(s, d)), {"order_col": "n", "social_group_size": "n", "nearest_animal_id": "k", "nearest_neighbour_m": "m"}, O.social_rows()),
    "neighbours_within": Query(lambda s, d: social.gps_neighbours_within_range(hourly_fixes(s, d), REACH), {"order_col": "n", "n_valid_fixes": "n", "n_neighbours_within_250m": "n", "n_neighbours_within_1000m": "n", "any_neighbour_within_250m": "b"}, O.social_rows()),
    "social_rows": Query(lambda s, d: social.gps_social(hourly_fixes(s, d), REACH), {"order_col": "n", "social_group_size": "n", "nearest_animal_id": "k", "nearest_neighbour_m": "m", "mean_distance_to_others_m": "m", "n_neighbours_within_250m": "n", "n_neighbours_within_1000m": "n"}, O.social_rows()),
    "contacts": Query(lambda s, d: social.gps_contacts(hourly_fixes(s, d), 1000, max_gap_mins=2880), {"deployment_id": "k", "pair_id": "k", "contact_event_id": "n", "contact_start": "t", "contact_end": "t", "duration_s": "r", "n_contact_fixes": "n", "min_distance_m": "m", "mean_distance_m": "m", "max_distance_m": "m"}, O.contacts(1000, 2880)),
    "contacts_median_gap": Query(lambda s, d: social.gps_contacts(hourly_fixes(s, d), 1000), {"deployment_id": "k", "pair_id": "k", "contact_event_id": "n", "contact_start": "t", "duration_s": "r", "n_contact_fixes": "n"}, O.contacts(1000, "(SELECT quantile_cont(gap, 0.5) FROM near WHERE gap > 0)")),
    "social_day": Query(lambda s, d: social.gps_social_summary(hourly_fixes(s, d), "day", thresholds_m=REACH), ANIMAL | EPOCH | {"n_fixes": "n"} | SOCIAL, O.social_day()),
    "resource_distance": Query(lambda s, d: resources.gps_resource_distance(fixes(s, d), RESOURCES, 3857), {"order_col": "n", "nearest_resource_id": "k", "nearest_resource_type": "k", "resource_distance_m": "m", "metric_crs": "k"}, O.resource_distance()),
    "resource_use": Query(lambda s, d: resources.gps_resource_use(fixes(s, d), RESOURCES, 150, "day", metric_crs=3857), ANIMAL | EPOCH | {"resource_id": "k", "n_total_fixes": "n", "n_fixes_near": "n", "prop_fixes_near": "r", "mean_distance_m": "m", "median_distance_m": "m", "min_distance_m": "m"}, O.resource_use(150)),
    "resource_visits": Query(lambda s, d: resources.gps_resource_visits(fixes(s, d), RESOURCES, 400, 2880, metric_crs=3857), ANIMAL | {"visit_id": "n", "resource_id": "k", "visit_start": "t", "visit_end": "t", "duration_mins": "r", "n_fixes": "n", "min_distance_m": "m", "mean_distance_m": "m"}, O.resource_visits(400, 2880)),
    "hotspots": Query(lambda s, d: spatial.gps_hotspots(fixes(s, d), 200, 0.9, epoch="week", metric_crs=3857), ANIMAL | EPOCH | {"cell_x": "n", "cell_y": "n", "n_fixes": "n", "total_fixes": "n", "prop_fixes": "r", "hotspot_count_threshold": "r", "cell_centre_lon": "r", "cell_centre_lat": "r"}, O.hotspots(200, 0.9)),
    "spatial_week": Query(lambda s, d: spatial.gps_spatial(fixes(s, d), "week"), ANIMAL | EPOCH | {"n_fixes": "n", "span_hours": "r", "lon_min": "c", "lat_max": "c", "centroid_lon": "o", "centroid_lat": "o", "mcp100_area_ha": "r", "mcp95_area_ha": "r", "metric_crs": "k"}, O.spatial_week()),
    "mcp_area": Query(lambda s, d: spatial.gps_mcp(fixes(s, d), epoch="month", metric_crs=3857), ANIMAL | EPOCH | {"percent": "r", "n_fixes": "n", "n_fixes_used": "n", "area_ha": "r"}, O.mcp_area()),
    "kde_cells": Query(lambda s, d: spatial.gps_kde(fixes(s, d), epoch="month", metric_crs=3857), ANIMAL | EPOCH | {"density_rank": "n", "kde_density": "d", "cell_probability": "r", "cumulative_probability": "r", "in_kde50": "b"}, O.kde_cells()),
    "epoch_merge": Query(lambda s, d: summary.gps_epoch(hourly_fixes(s, d), "day", include=["movement", "social"], thresholds_m=REACH), ANIMAL | MOVED | {"social_n_fixes": "n"} | SOCIAL, O.epoch_merge()),
    "epoch_all": Query(_all_blocks, ANIMAL | MOVED | {"social_n_fixes": "n"} | SOCIAL | {"spatial_n_fixes": "n", "lon_min": "c", "lat_max": "c", "mcp100_area_ha": "r", "n_resources": "n", "n_fixes_near_resource": "n", "mean_resource_distance_m": "m"}, O.epoch_all(150)),
    "animal_summary": Query(lambda s, d: summary.gps_animal_summary(fixes(s, d), "week"), ANIMAL | MOVED, O.movement("week", None, ["deployment_id", "animal_id", "sensor_id"])),
    "group_summary": Query(lambda s, d: summary.gps_group_summary(fixes(s, d), "week", group_cols=["deployment_id", "treatment"]), {"deployment_id": "k", "treatment": "k"} | EPOCH | {"n_animal_epochs": "n", "n_animals": "n", "n_sensors": "n", "n_fixes": "n", "total_distance_m": "m", "mean_total_distance_m": "m", "mean_speed_mps": "r"}, O.group_summary()),
    "diurnal": Query(lambda s, d: summary.gps_diurnal(fixes(s, d)).withColumn("date", F.col("date").cast("string")), ANIMAL | MOVED | {"date": "k", "hour": "n"}, O.diurnal()),
    "resource_epoch": Query(lambda s, d: summary.resource_roll_up(resources.gps_resource_use(fixes(s, d), RESOURCES, 150, "day", metric_crs=3857)), ANIMAL | EPOCH | {"n_resources": "n", "n_resource_fix_rows": "n", "n_fixes_near_resource": "n", "prop_fixes_near_resource": "r", "mean_resource_distance_m": "m", "min_resource_distance_m": "m"}, O.resource_epoch(150)),
    "activity_features": Query(lambda s, d: activity.add_features(fixes(s, d), "step_turn")[0], {"order_col": "n", "_f_step": "r", "_f_turn": "r"}, O.activity_features()),
    "adaptive_features": Query(lambda s, d: activity.add_features(fixes(s, d))[0], {"order_col": "n", "_f_step": "r", "_f_turn": "r", "_f_net": "r", "_f_straight": "r"}, O.adaptive_features()),
    "activity_gmm": Query(lambda s, d: activity.gps_activity_state(fixes(s, d), "gmm", feature_set="step_turn").data, {"order_col": "n", "activity_state": "k", "inactive_prob": "r", "activity_state_component": "n"}, O.activity_gmm()),
    "activity_gmm_hmm": Query(lambda s, d: activity.gps_activity_state(fixes(s, d)).data, {"order_col": "n", "activity_state": "k", "inactive_prob": "r", "activity_state_component": "n"}, O.activity_gmm_hmm()),
    "activity_hmm": Query(lambda s, d: activity.gps_activity_state(fixes(s, d), "hmm", feature_set="step_turn").data, {"order_col": "n", "activity_state": "k", "inactive_prob": "r", "activity_state_id": "n"}),
    "map_points": Query(lambda s, d: maps.gps_map(fixes(s, d), state_col="state", state_colors={"view": "#1a9641"}), {"map_group": "k", "seq": "n", "order_col": "n", "color": "k", "popup": "k"}, O.map_points()),
    "playback_points": Query(lambda s, d: maps.gps_playback(fixes(s, d), align=False)[0], {"map_group": "k", "seq": "n", "start_time": "t", "end_time": "t"}, O.playback("points")),
    "map_polygons": Query(_map_polygons, {"map_group": "k", "layer_no": "n", "label": "k", "n_points": "n", "width": "c", "height": "c"}, O.map_polygons()),
    "playback_tails": Query(lambda s, d: maps.gps_playback(fixes(s, d), align=False, smooth_movement=False)[1], {"map_group": "k", "seq": "n", "start_time": "t", "end_time": "t"}, O.playback("tails")),
}


def _windows(spark: SparkSession) -> DataFrame:
    """Deployment windows: a parameter table; one deployment has none."""
    rows = [(f"D{k}", f"2024-01-{5 + k:02d} 00:00:00", f"2024-01-{25 - k:02d} 12:00:00") for k in range(3)]
    return spark.createDataFrame(rows, "deployment_id string, start_datetime string, end_datetime string")


def queries() -> dict[str, Builder]:
    """Every registered query by name."""
    return {name: (lambda s, d, q=q: _project(q.build(s, d), q.columns)) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name, for the queries that SQL can express."""
    return {name: _projected(q.sql, q.columns) for name, q in QUERIES.items() if q.sql}
