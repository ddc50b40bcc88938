import math
from datetime import datetime

import numpy as np
import pytest
from helpers import T0, at, table, track_6
from pyspark.sql import functions as F

from fieldtrace.functions import geo
from fieldtrace.operators import activity, alignment, cleaning, maps, movement, resources, social, spatial, summary, tracks, validation
from fieldtrace.operators.resources import Resource


def rows(df, *order):
    return df.orderBy(*(order or ["order_col"])).collect()


def test_steps_bearings_and_turns(spark):
    df = table(spark, [("D", "A", 0, 0.0, 0.0), ("D", "A", 60, 0.0, 0.001), ("D", "A", 120, 0.001, 0.001)])
    r = rows(movement.gps_steps(df))
    assert r[0].step_m is None
    assert r[1].step_m == pytest.approx(111.195, abs=0.2) and r[1].bearing_deg == pytest.approx(0, abs=1e-6)
    assert r[2].bearing_deg == pytest.approx(90, abs=1e-3) and r[2].turn_rad == pytest.approx(math.pi / 2, abs=1e-3)
    m = movement.gps_movement_summary(df, epoch_mins=10).collect()[0]
    assert (m.n_fixes, m.n_steps) == (3, 2)
    assert m.total_distance_m == pytest.approx(222.39, abs=0.4) and 0.6 < m.straightness_index < 0.8
    assert "turn_deg" in movement.gps_turning(df, unit="degrees").columns


def test_steps_stop_at_segments(spark):
    df = table(spark, [("D", "A", 0, 0.0, 0.0, "s1"), ("D", "A", 60, 0.001, 0.0, "s1"), ("D", "A", 3600, 1.0, 0.0, "s2"), ("D", "A", 3660, 1.001, 0.0, "s2")], "segment_id string")
    r = rows(movement.gps_steps(df))
    assert r[2].step_m is None and r[2].cum_distance_m == r[1].cum_distance_m
    assert r[0].net_displacement_m == 0 and r[2].net_displacement_m == 0


def test_simultaneous_fixes_have_a_step_but_no_speed(spark):
    r = rows(movement.gps_steps(table(spark, [("D", "A", 0, 0.0, 0.0), ("D", "A", 0, 0.001, 0.0)])))
    assert r[1].step_m > 100 and r[1].speed_mps is None


def test_epochs_of_two_minutes(spark):
    m = rows(movement.gps_movement_summary(track_6(spark), epoch_mins=2), "epoch")
    assert [x.n_fixes for x in m] == [2, 2, 2]
    with pytest.raises(ValueError):
        movement.gps_movement_summary(track_6(spark), "day", epoch_mins=2)
    with pytest.raises(ValueError):
        movement.gps_movement_summary(track_6(spark), "interval")


def test_segments_follow_input_order(spark):
    df = table(spark, [("D", "A", 60 * i + (10800 if i > 3 else 0), 150.0, -30.0) for i in range(6)])
    assert [r.segment_id for r in rows(validation.gps_append_segments(df, 30))] == ["A_seg001"] * 4 + ["A_seg002"] * 2
    odd = table(spark, [("D", "A", 0, 1.0, 1.0), ("D", "A", 0, 1.0, 1.0), ("D", "A", -60, 1.0, 1.0), ("D", "A", None, 1.0, 1.0), ("D", "A", 60, 1.0, 1.0)])
    assert [r.segment_id[-1] for r in rows(validation.gps_append_segments(odd, 30))] == ["1", "1", "2", "3", "4"]


def test_validation(spark):
    text = spark.createDataFrame(
        [("A", "2024-01-01 00:00:00", 150.0, -30.0, 0), ("", "2024-01-01 00:01:00", 150.1, -30.1, 1), ("B", "bad", 150.2, -30.2, 2), ("C", "2024-01-01 00:03:00", 181.0, -30.3, 3), (None, "2024-01-01 00:04:00", 150.4, -91.0, 4)],
        "sensor_id string, datetime string, lon double, lat double, order_col long",
    )
    v = validation.gps_validate(text, drop_invalid=True)
    assert v.is_valid and v.data.count() == 1 and v.qc.count() == 29
    reasons = {r.order_col: r.invalid_reason for r in v.invalid_rows.collect()}
    assert reasons == {1: "missing_sensor_id", 2: "invalid_datetime", 3: "invalid_lon", 4: "missing_sensor_id;invalid_lat"}
    bad = validation.gps_validate(text.withColumnRenamed("lon", "lng"))
    assert not bad.is_valid and "lng" in str(bad)
    with pytest.raises(ValueError):
        validation.gps_qc_summary(text.drop("lat"))
    q = validation.gps_qc_summary(text)
    assert "n_rows 5" in str(q)


def test_datetime_forms(spark):
    from fieldtrace.operators.tracks import parse_datetime

    forms = {"2024-03-04T05:06:07Z": datetime(2024, 3, 4, 5, 6, 7), "03/04/2024 05:06": datetime(2024, 3, 4, 5, 6), "2024-03-04": datetime(2024, 3, 4), "13/04/2024 05:06": datetime(2024, 4, 13, 5, 6), "x": None}
    df = spark.createDataFrame([(k,) for k in forms], "t string")
    assert {r.t: r.p for r in df.select("t", parse_datetime(F.col("t")).alias("p")).collect()} == forms


def test_duplicates_keep_the_first(spark):
    df = track_6(spark)
    twice = df.unionByName(df.withColumn("order_col", F.col("order_col") + 100))
    kept = cleaning.gps_clean_duplicates(twice)
    assert sorted(r.order_col for r in kept.data.collect()) == list(range(6))
    s = kept.summary.collect()[0]
    assert (s.before_n, s.after_n, s.n_removed, s.n_flagged) == (12, 6, 6, 0)
    flagged = cleaning.gps_clean_duplicates(twice, action="flag")
    assert flagged.data.count() == 12 and flagged.flagged.count() == 6


def test_deployment_window_flags_outside(spark):
    windows = spark.createDataFrame([("D1", "A", at(60), at(120))], "deployment_id string, sensor_id string, start_datetime timestamp, end_datetime timestamp")
    out = cleaning.gps_clean_errors(track_6(spark), deployment_windows=windows, action="flag").data
    assert [r.gps_error_reason for r in rows(out)] == ["outside_deployment_window", "", "", *["outside_deployment_window"] * 3]
    twice = cleaning.gps_clean_errors(track_6(spark), deployment_windows=windows.union(windows)).data
    with pytest.raises(Exception, match="repeat a key"):  # found when rows are read, not when the plan is made
        twice.collect()


def test_speed_jump_flags_both_steps(spark):
    df = table(spark, [("D", "A", 60 * i, 150.0 + (1.0 if i == 2 else 0.0), -30.0) for i in range(5)])
    r = rows(cleaning.gps_clean_speed_fixed(df, action="flag").data)
    assert [x.is_speed_outlier for x in r] == [False, False, True, True, False]


def test_speed_threshold_by_deviation(spark):
    steps = [1e-6] * 65 + [2e-5] * 14 + [0.01]
    lon = np.concatenate([[150.0], 150 + np.cumsum(steps)])
    out = cleaning.gps_clean_speed_stat(table(spark, [("D", "A", 60 * i, float(x), -30.0) for i, x in enumerate(lon)]), action="flag")
    assert sum(r.is_speed_outlier for r in out.data.collect()) == 1


def test_pipeline_has_an_audit_row_a_step(spark):
    out = cleaning.gps_clean(track_6(spark), ("duplicates", "errors", "speed_fixed", "denoise"), step_args={"speed_fixed": {"max_speed_mps": 1000}})
    assert [r.step for r in rows(out.summary, "step_no")] == ["duplicates", "errors", "speed_fixed", "denoise"]
    assert out.data.count() == 6 and {"lon_raw", "lat_raw"} <= set(out.data.columns)
    with pytest.raises(ValueError):
        cleaning.gps_clean(track_6(spark), ("nothing",))


def test_denoise_takes_the_median_of_rest(spark):
    df = table(spark, [("D", "A", 60 * i, 150 + (i % 3) * 1e-5, -30.0, "rest" if i < 6 else "walk") for i in range(12)], "activity_state string")
    r = rows(cleaning.gps_denoise(df, "state_aware").data)
    assert {x.lon for x in r[:6]} == {150 + 1e-5} and r[0].lon_raw == 150


def test_interpolation_meets_on_one_grid(spark):
    a = [("D", "A", 60 * m, lon, lat) for m, lon, lat in ((2, 0.0, 0.0), (17, 15.0, 30.0), (32, 30.0, 60.0))]
    b = [("D", "B", 60 * m, lon, lat) for m, lon, lat in ((7, 100.0, 20.0), (22, 115.0, 35.0), (37, 130.0, 50.0))]
    out = alignment.gps_interpolate(table(spark, a + b), 15)
    got = {(r.sensor_id, (r.datetime - T0).total_seconds() / 60): (r.lon, r.lat) for r in out.filter("is_interpolated").collect()}
    assert sorted({k[1] for k in got}) == [15, 30]
    assert [got["A", m][0] for m in (15, 30)] == pytest.approx([13, 28]) and [got["B", m][1] for m in (15, 30)] == pytest.approx([28, 43])
    with pytest.raises(ValueError):
        alignment.gps_interpolate(out, 15)


def test_snap_against_interpolation(spark):
    df = table(spark, [("D", "A", s, 150 + k * 1e-4, -30 - k * 1e-4) for s, k in ((0, 0), (90, 3), (240, 8))])
    snapped = rows(alignment.gps_regularise(df, 1), "datetime")
    assert sum(r.is_observed for r in snapped) == 3 and [r.time_offset_s for r in snapped if r.is_observed] == [0, -30, 0]
    line = rows(alignment.gps_interpolate(df, 1), "datetime")
    assert sum(r.is_observed for r in line) == 2 and sum(r.is_interpolated for r in line) == 3 and line[2].lon == pytest.approx(150.0004)


def test_downsample(spark):
    minute = lambda df: [int((r.datetime - T0).total_seconds() / 60) for r in rows(df, "datetime")]
    assert minute(alignment.gps_downsample(track_6(spark), 2, "rigid")) == [0, 2, 4]
    assert minute(alignment.gps_downsample(track_6(spark), 2, "rigid", phase_mins=1)) == [1, 3, 5]


def herd(spark):
    lat = {"A": [0, 0, 0], "B": [1e-4] * 3, "C": [1e-3, 1e-3, None]}
    return table(spark, [("D", s, 60 * m, 0.0, lat[s][m], f"cow_{s.lower()}") for m in range(3) for s in "ABC"], "animal_id string")


def test_pairs_and_nearest(spark):
    pairs = {(r.pair_id, r.datetime): r.distance_m for r in social.gps_proximity(herd(spark)).collect()}
    assert pairs["A:B", T0] == pytest.approx(11.119, abs=0.01) and pairs["A:C", T0] == pytest.approx(111.195, abs=0.01)
    r = rows(social.gps_social(herd(spark), (20, 105)))
    assert r[2].nearest_animal_id == "cow_b" and r[2].nearest_neighbour_m == pytest.approx(100.075, abs=0.01) and r[2].n_neighbours_within_105m == 1
    assert (r[8].social_group_size, r[8].n_valid_fixes, r[8].nearest_neighbour_m) == (3, 2, None)
    day = social.gps_social_summary(herd(spark), thresholds_m=(20,)).filter("sensor_id = 'C'").collect()[0]
    assert (day.n_fixes, day.n_social_fixes) == (3, 2)


def test_contact_event(spark):
    lat = {"A": [0, 0, 0], "B": [1e-4, 1e-4, 1e-2]}
    df = table(spark, [("D", s, 60 * m, 0.0, lat[s][m]) for m in range(3) for s in "AB"])
    (c,) = social.gps_contacts(df, 20, max_gap_mins=2).collect()
    assert (c.pair_id, c.contact_event_id, c.n_contact_fixes, c.duration_s) == ("A:B", 1, 2, 60) and c.min_distance_m == pytest.approx(11.119, abs=0.01)


RES = [Resource("water", ((150.0, -30.0),), "water"), Resource("shade", ((150.001, -30.0),), "shade")]


def test_resources(spark):
    use = {r.resource_id: r for r in resources.gps_resource_use(track_6(spark), RES, 20, metric_crs=3857).collect()}
    assert (use["water"].n_total_fixes, use["water"].n_fixes_near) == (6, 2) and use["water"].prop_fixes_near == pytest.approx(1 / 3)
    (v,) = resources.gps_resource_visits(track_6(spark), RES, 25, metric_crs=3857).collect()
    assert (v.resource_id, v.n_fixes, v.duration_mins) == ("water", 2, 1)
    zone = [Resource("zone", ((149.9999, -30.0001), (150.00025, -30.0001), (150.00025, -29.9999), (149.9999, -29.9999)), polygon=True)]
    assert rows(resources.gps_resource_distance(track_6(spark), zone))[0].resource_distance_m == 0
    assert rows(resources.gps_resource_distance(track_6(spark), []))[0].resource_distance_m is None


HOME = [("home", [(149.999, -30.001), (150.001, -30.001), (150.001, -29.999), (149.999, -29.999)])]


def test_paddocks_by_majority(spark):
    df = track_6(spark)
    move = lambda n: df.withColumn("lon", F.when(F.col("order_col") >= 6 - n, F.lit(151.0)).otherwise(F.col("lon")))
    assert {r.assigned_paddock for r in cleaning.gps_append_paddock_names(move(1), HOME).collect()} == {"home"}
    assert {r.assigned_paddock for r in cleaning.gps_append_paddock_names(move(3), HOME).collect()} == {None}
    out = cleaning.gps_clean_spatial(move(1), HOME)
    assert out.data.count() == 5 and {r.paddock for r in out.data.collect()} == {"home"}


def test_home_range(spark):
    df = table(spark, [("D", "A", 60 * i, 150 + x * 1e-3, -30 + y * 1e-3) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5), (0.2, 0.7)])])
    m = {r.percent: r for r in spatial.gps_mcp(df, metric_crs=3857, return_geometry=True).collect()}
    assert m[100].area_ha == pytest.approx(111.3195 * 128.54 / 1e4, rel=1e-2) and len(m[100].geometry) == 4 and m[100].n_fixes == 6
    s = spatial.gps_spatial(df).collect()[0]
    assert s.metric_crs == "EPSG:32756" and s.n_fixes == 6 and s.mcp100_area_ha > 0
    k = spatial.gps_kde(df, metric_crs=3857, keep_all=True).collect()
    assert sum(r.cell_probability for r in k) == pytest.approx(1) and max(r.density_rank for r in k) == len(k) <= 10000
    h = spatial.gps_hotspots(df, 30, metric_crs=3857, keep_all=True).collect()
    assert sum(r.n_fixes for r in h) == 6


def test_projections_go_back(spark):
    df = spark.createDataFrame([(150.5, -30.25), (-3.2, 51.4)], "lon double, lat double")
    for lon, lat, zone in ((150.5, -30.25, 56), (-3.2, 51.4, 30)):
        x, y = geo.utm(F.lit(lon), F.lit(lat), F.lit(zone), F.lit(lat > 0))
        got = df.limit(1).select(x.alias("x"), y.alias("y")).select("x", "y", *[c.alias(n) for c, n in zip(geo.utm_inverse(F.col("x"), F.col("y"), F.lit(zone), F.lit(lat > 0)), ("lon", "lat"), strict=True)]).first()
        assert got.lon == pytest.approx(lon, abs=1e-7) and got.lat == pytest.approx(lat, abs=1e-7)
        assert geo.utm_point(lon, lat, zone, lat > 0) == pytest.approx((got.x, got.y))


def test_summaries(spark):
    df = herd(spark).withColumn("treatment", F.lit("t"))
    e = summary.gps_epoch(df, "day", include=["movement", "social"], thresholds_m=(20,)).collect()
    assert len(e) == 3 and "social_n_fixes" in e[0].asDict()
    g = summary.gps_group_summary(df, "day", group_cols=["deployment_id", "treatment"]).collect()[0]
    assert (g.n_animal_epochs, g.n_animals, g.n_fixes) == (3, 3, 9)
    d = summary.gps_diurnal(df).collect()[0]
    assert d.hour == 0 and str(d.date) == "2024-01-01"
    with pytest.raises(ValueError):
        summary.merge_metric_tables({"a": df.select("lon"), "b": df.select("lat")})


@pytest.mark.parametrize("method", ["gmm", "gmm_hmm", "hmm"])
def test_activity_tells_rest_from_walking(spark, method):
    move = lambda i: 0.0 if i < 60 else (i - 59) * 3e-4
    df = table(spark, [("D", "A", 60 * i, 150 + move(i) + (i * 7919 % 13) * 1e-7, -30 + move(i)) for i in range(120)])
    out = activity.gps_activity_state(df, method, feature_set="step_turn")
    r = rows(out.data)
    assert len(r) == 120 and out.model["inactive_component"] in (1, 2)
    assert sum(x.activity_state == "inactive" for x in r[5:55]) > 40 and sum(x.activity_state == "active" for x in r[65:]) > 45
    assert all(0 <= x.inactive_prob <= 1 for x in r if x.inactive_prob is not None)
    with pytest.raises(ValueError):
        activity.gps_activity_state(df.limit(10), method)


def test_maps(spark, tmp_path):
    pts = maps.gps_map(track_6(spark), max_points=3)
    assert pts.count() == 3 and rows(pts, "seq")[0].popup.startswith("<b>sensor_id:</b> A<br/>")
    points, tails = maps.gps_playback(track_6(spark), align=False, tail_points=2, smooth_movement=False)
    t = rows(tails, "seq")
    assert points.count() == 6 and len(t) == 5 and (t[0].end_time - t[0].start_time).total_seconds() == 120
    maps.write_html(pts, str(tmp_path / "m.html"))
    maps.write_geojson(pts, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).count() == 3
    with pytest.raises(ValueError):
        maps.write_html(pts, str(tmp_path / "m.html"), limit=1)


def test_shuffled_input_gives_equal_results(spark):
    df = track_6(spark)
    a = sorted(map(str, movement.gps_steps(df).collect()))
    assert a == sorted(map(str, movement.gps_steps(df.repartition(3).orderBy(F.rand(1))).collect()))


def test_read_fixes(spark, tmp_path):
    from fieldtrace.sources.fixes import read_fixes

    (tmp_path / "f.csv").write_text("sensor_id,datetime,lon,lat\nA,2024-01-01 00:00:00,150,-30\n")
    assert read_fixes(spark, str(tmp_path / "f.csv"), "sensor_id string, datetime string, lon double, lat double").count() == 1


def test_registered_queries_use_all_cells(spark):
    from fieldtrace.plans import catalogue

    cells = catalogue.queries()["kde_cells"](spark, "/root/testdata/sf0.001")
    assert cells.agg(F.max("density_rank")).first()[0] > 400


def test_interpolation_over_many_blocks(spark, monkeypatch):
    g = np.random.default_rng(8)
    times = np.sort(g.choice(20_000, 500, replace=False))
    df = table(spark, [("D", s, int(t), float(t) / 1000 % 7, -30 if t % 11 else None) for s in "AB" for t in times])
    wide = {(r.sensor_id, r.datetime): r for r in alignment.gps_interpolate(df, 1).collect()}
    monkeypatch.setattr(alignment, "BLOCK_STEPS", 7)
    assert {(r.sensor_id, r.datetime): r for r in alignment.gps_interpolate(df, 1).collect()} == wide
    anchors = {int(t): float(t) / 1000 % 7 for t in times if t % 11}
    for (_, when), r in wide.items():
        t = (when - T0).total_seconds()
        before, after = [k for k in anchors if k <= t], [k for k in anchors if k >= t]
        if not before or not after:
            assert r.lon is None and not r.is_interpolated
        elif t in anchors:
            assert r.is_observed and r.lon == anchors[t]
        else:
            a, b = max(before), min(after)
            assert r.lon == pytest.approx(anchors[a] + (t - a) / (b - a) * (anchors[b] - anchors[a])) and r.interpolation_gap_s == b - a


def test_epochs_and_texts_are_utc_in_every_session_zone(spark):
    from fieldtrace.functions.epochs import with_epochs

    text = [("D", "A", f"2024-{m:02d}-{d:02d}{sep}{h:02d}:30:07", 150.0, -30.0, k) for k, (m, d, h, sep) in enumerate((m, d, h, sep) for m in (1, 3, 10, 12) for d in (1, 6, 31) for h in (0, 2, 23) for sep in " T" if d < 31 or m != 11)]
    df = spark.createDataFrame(text, "deployment_id string, sensor_id string, datetime string, lon double, lat double, order_col long")
    naive = df.withColumn("datetime", F.to_timestamp_ntz(F.replace("datetime", F.lit("T"), F.lit(" "))))
    seen = []
    for zone in ("UTC", "Australia/Brisbane", "America/New_York", "Asia/Kathmandu"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            levels = [("day", None), ("hour", None), ("week", None), ("month", None), ("interval", 45.0)]
            for source in (df, naive):
                seen.append([sorted(map(tuple, with_epochs(tracks.prepare(source), level, mins).select("order_col", "epoch", *[F.unix_micros(c) for c in ("datetime", "epoch_start", "epoch_end")], "epoch_mins").collect())) for level, mins in levels])
            out = movement.gps_movement_summary(df, "day").select("epoch", "n_fixes", F.unix_micros("epoch_start"))
            seen[-1].append(sorted(map(tuple, out.collect())))
            seen[-2].append(seen[-1][-1])
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert all(x == seen[0] for x in seen)
    day = {r[0]: r for r in seen[0][0]}
    assert day[0][1] == "2024-01-01" and day[0][2] - day[0][3] == 1807 * 10**6 and {r[1] for r in seen[0][2]} >= {"2024-W01", "2025-W01", "2024-W09"}


def test_contacts_and_counts_equal_all_pairs(spark):
    g = np.random.default_rng(2)
    rows_ = [("D", f"S{k:02d}", 0, 179.9995 + 0.001 * g.random() if k % 4 else -179.9999, 0.001 * g.random() + (89.999 if k % 5 == 0 else 0)) for k in range(60)]
    rows_ += [("D", f"P{k}", 0, lon, lat) for k, (lon, lat) in enumerate([(181.0, -30.0), (181.0, -30.0001), (-179.0, -30.0001), (10.0, 95.0), (-170.0, 85.0), (float("nan"), 1.0), (0.0, None)])]
    df = table(spark, rows_)
    every = {r.order_col: r for r in social.gps_social(df, (20.0, 60.0)).collect()}
    cells = {r.order_col: r for r in social.gps_neighbours_within_range(df, (20.0, 60.0)).collect()}
    names = ("n_neighbours_within_20m", "n_neighbours_within_60m")
    assert {k: tuple(r[n] for n in names) for k, r in cells.items()} == {k: tuple(r[n] for n in names) for k, r in every.items()}
    assert sum(r[names[1]] for r in cells.values()) > 40 and cells[60][names[1]] == 2
    pairs = {r.pair_id for r in social.gps_proximity(df).filter("distance_m <= 60").collect()}
    assert {r.pair_id for r in social.gps_contacts(df, 60, max_gap_mins=1).collect()} == pairs


def test_nearest_neighbours_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(social, "PAIRS_UP_TO", 0)
    g = np.random.default_rng(5)
    near = [("D", f"S{k:02d}", 60 * (k % 3), 150 + 10.0 ** -g.integers(1, 6) * g.random(), -30 + 10.0 ** -g.integers(1, 6) * g.random()) for k in range(80)]
    ties = [("E", f"T{k}", 0, 10.0, lat) for k, lat in enumerate((0.0, 0.001, -0.001, 0.001, 60.0))]
    odd = [("F", "alone", 0, 1.0, 1.0), ("G", "g1", 0, None, 1.0), ("G", "g2", 0, 1.0, 1.0), ("H", "h1", 0, 0.0, 89.9), ("H", "h2", 0, 180.0, -89.9), (None, "n", 0, 1.0, 1.0), ("D", "t", None, 1.0, 1.0)]
    df = table(spark, near + ties + odd)
    every = {r.order_col: r for r in social.gps_social(df, ()).drop("mean_distance_to_others_m").collect()}
    got = {r.order_col: r for r in social.gps_nearest_neighbour(df).collect()}
    assert got == every and sum(r.nearest_neighbour_m is not None for r in got.values()) == 87


def test_merge_keeps_rows_of_all_tables(spark):
    key = "deployment_id string, epoch string"
    a = spark.createDataFrame([("D", "1", 1.0), ("D", "1", 2.0), (None, "2", 3.0)], key + ", x double")
    b = spark.createDataFrame([("D", "1", 5.0), ("E", "1", 6.0)], key + ", x double")
    c = spark.createDataFrame([(None, "2", "t"), ("D", "1", "u")], key + ", y string")
    got = {(r.deployment_id, r.epoch, r.x, r.b_x, r.y) for r in summary.merge_metric_tables({"a": a, "b": b, "c": c}).collect()}
    assert got == {("D", "1", 1.0, 5.0, "u"), ("D", "1", 2.0, 5.0, "u"), (None, "2", 3.0, None, "t"), ("E", "1", None, 6.0, None)}


def test_map_polygons_and_collections(spark, tmp_path):
    import json

    from fieldtrace.functions.shapes import from_wkt, shape_fault
    from fieldtrace.sources.layers import paddock_table

    layer = lambda *texts: paddock_table(spark.createDataFrame([(k, f"p<{k}>", t) for k, t in enumerate(texts)], "no long, name string, geometry string"), "no", "name")
    square, hole = "(0 0, 4 0, 4 4, 0 4, 0 0)", "(1 1, 2 1, 2 2, 1 2, 1 1)"
    good = maps.map_polygons(layer(f"POLYGON ({square}, {hole})", f"MULTIPOLYGON (({square}), ((9 9, 10 9, 9 10)))"), polygon_group="Paddocks")
    got = [json.loads(r.value) for r in maps.polygon_features(good).orderBy("value").collect()]
    assert {f["geometry"]["type"] for f in got} == {"Polygon", "MultiPolygon"} and {f["properties"]["label"] for f in got} == {"p<0>", "p<1>"}
    faults = {"POINT (1 1)": "no polygon", "POLYGON EMPTY": "empty", "POLYGON ((0 0, 4 1, 4 0, 0 2, 0 0))": "crosses", "POLYGON ((0 0, 1 0, 0 0))": "three", f"POLYGON ({square}, (8 8, 9 8, 9 9, 8 8))": "hole", "POLYGON ((0 0, 4 0, 4 4, 2 0, 0 4, 0 0))": "crosses"}
    for text, word in faults.items():
        assert word in shape_fault(from_wkt(text)), text
        with pytest.raises(Exception, match=word):
            maps.map_polygons(layer(text)).collect()
    with pytest.raises(ValueError):
        maps.map_polygons(layer(), opacity=2)
    df = table(spark, [("D", s, 60 * i, 150 + i * 1e-4, -30.0) for s in ("A", "B/1") for i in range(5)])
    points, tails = maps.gps_playback(df, align=False)
    t = rows(tails, "map_group", "seq")
    assert t[0].start_time == t[0].movement_start and t[0].movement_end > t[0].movement_start
    maps.write_playback(points, tails, str(tmp_path / "p"))
    read = [json.loads("".join(f.read_text() for f in sorted(d.glob("part-*")))) for d in sorted((tmp_path / "p").glob("map_group=*"))]
    assert [len(c["features"]) for c in read] == [9, 9] and all(c["type"] == "FeatureCollection" for c in read)
    assert [f["geometry"]["type"] for f in read[0]["features"]] == ["LineString"] * 4 + ["Point"] * 5
    size = maps.map_size(maps.gps_map(df), point_warning_n=9, group_warning_n=2).first()
    assert (size.n_points, size.n_groups, size.many_points, size.many_groups) == (10, 2, True, False)
    timed = rows(maps.timeline_points(maps.gps_map(df)), "map_group", "seq")
    assert timed[1].time == "2024-01-01T00:01:00Z" and timed[1].time_ms - timed[0].time_ms == 60_000


def test_interpolation_keeps_two_anchors_a_grid_step_however_many_fixes(spark, monkeypatch):
    """Many fixes inside one step, two at its last time: blocks get the first and the last, and the first row of equal times."""
    rows = [("D", "A", 60 * k / 100, 150 + k * 1e-6, -30.0) for k in range(1000)] + [("D", "A", 599.4, 151.0, -31.0), ("D", "A", 1800, 150.5, -30.5)]
    df, held = table(spark, rows), []
    union = type(df).unionByName
    monkeypatch.setattr(type(df), "unionByName", lambda a, b, **k: (held.append(b), union(a, b, **k))[1])
    out = alignment.gps_interpolate(df, 10).orderBy("datetime").collect()
    assert [round(r.lon, 9) for r in out] == [150.0, round(150.000999 + (600 - 599.4) / (1800 - 599.4) * (150.5 - 150.000999), 9), round(150.000999 + (1200 - 599.4) / (1800 - 599.4) * (150.5 - 150.000999), 9), 150.5]
    assert held[0].count() == 3
