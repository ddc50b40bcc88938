"""Herds at one time: all pairs in tiles; ties; layers and contacts that share a step."""

import math
import random

import duckdb
import numpy as np
import pytest
from helpers import T0, rows_of, table

from fieldtrace.functions import meetings
from fieldtrace.operators import social
from fieldtrace.plans import catalogue


def _metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("part", [7, 4096])
@pytest.mark.parametrize("spread", [0.02, 60.0])
def test_social_rows_equal_plain_pairs_without_a_row_for_a_pair(spark, monkeypatch, part, spread):
    monkeypatch.setattr(social, "PART_FIXES", part)
    rng = random.Random(5)
    places = [(150 + spread * round(rng.random(), 2), -30 + spread * round(rng.random(), 2)) for _ in range(60)]
    rows = [("D1", f"S{k % 50}", 0 if k % 3 else 60, *p) for k, p in enumerate(places + places[:20])]
    rows += [("D1", "S7", 0, None, -30), ("D1", "S8", 0, float("inf"), -30), ("D2", "S9", 0, 150, -30), ("D3", "S1", None, 150, -30), ("D2", "S9", 60, None, None), ("D2", "S1", 60, 150, -30)]
    social_ = social.gps_social(table(spark, rows), (200, 1000))
    assert "SortAggregate" not in social_._jdf.queryExecution().toString()
    fine = lambda k: all(v is not None and math.isfinite(v) for v in rows[k][3:5])
    for k, got in enumerate(rows_of(social_)):
        herd = [j for j in range(len(rows)) if rows[j][0] == rows[k][0] and rows[j][2] == rows[k][2] and rows[k][2] is not None]
        d = [(_metres(rows[k][3:5], rows[j][3:5]), (rows[j][1], j) < (rows[k][1], k), rows[j][1], j) for j in herd if j != k and fine(k) and fine(j)]
        best = min(((round(v, 6), *more) for v, *more in d), default=(None, None, None, None))
        assert got["social_group_size"] == len(herd) and got["nearest_sensor_id"] == best[2] and got["nearest_animal_id"] == best[2]
        assert got["nearest_neighbour_m"] == (None if best[0] is None else pytest.approx(best[0], abs=1e-5))
        assert got["mean_distance_to_others_m"] == (pytest.approx(sum(v[0] for v in d) / len(d), rel=1e-12) if d else None)
        assert [got[f"n_neighbours_within_{t}m"] for t in (200, 1000)] == [sum(v[0] <= t for v in d) for t in (200, 1000)]


def _against_sql(spark, tmp_path, name, events):
    """Rows of a query over events (event_id, ts, user_id, event_type, value) and those of its SQL."""
    con = duckdb.connect()
    con.execute("set threads = 4")
    con.execute(f"create table events as {events}")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = catalogue.queries()[name](spark, str(tmp_path))
    rows = con.execute(f"select {', '.join(got.columns)} from ({catalogue.oracle_sql()[name]}) q").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(rows, key=repr)


def test_paddock_sql_counts_edges(spark, tmp_path):
    events = "select * from (values (138113::bigint, timestamp '2024-01-12 09:58:41', 2435::bigint, 'click', 10.9e0), (7, timestamp '2024-01-12 00:00:00', 3, 'view', 1.0e0)) v(event_id, ts, user_id, event_type, value)"
    got, want = _against_sql(spark, tmp_path, "append_paddock", events)
    assert got == want and (138113, "south") in got


@pytest.mark.parametrize("name", ["contacts", "contacts_median_gap"])
def test_contacts_sql_has_no_ties(spark, tmp_path, name):
    events = "select i::bigint as event_id, timestamp '2024-01-01' + to_hours(((i * 7919) % 997)::int) as ts, (i % 7 * 4)::bigint as user_id, 'view' as event_type, (i * 31 % 400)::double as value from range(30000) r(i)"
    got, want = _against_sql(spark, tmp_path, name, events)
    assert got == want and len(got) > 10


@pytest.mark.parametrize("part", [5, 16_384])
def test_counts_and_nearest_meet_cells_inside_tasks(spark, monkeypatch, part):
    monkeypatch.setattr(social, "PAIRS_UP_TO", 0)
    monkeypatch.setattr(social, "PART_ASKS", part)
    rng = random.Random(7)
    rows = [("D1", f"S{k % 90:02d}", 60 * (k % 2), 150 + 0.02 * round(rng.random(), 2 + k % 3), -30 + 0.02 * round(rng.random(), 2 + k % 3)) for k in range(400)]
    rows += [("D2", f"T{k}", 0, 179.99995 - 359.9999 * (k % 2), 0.0005 * k) for k in range(9)] + [("D3", "U1", 0, 0.0, 0.0), ("D3", "U2", 0, 180.0, 0.0), ("D3", "U3", 0, None, 0.0), ("D4", "V", 0, 1.0, 1.0)]
    df = table(spark, rows)
    every, counts, near = rows_of(social.gps_social(df, (40.0, 250.0))), social.gps_neighbours_within_range(df, (40.0, 250.0)), social.gps_nearest_neighbour(df)
    # A join of fixes with fixes made a row for each pair.
    assert "rank_b" not in counts._jdf.queryExecution().toString()
    for other in (counts, near):
        names = [c for c in other.columns if c not in df.columns]
        assert [tuple(r[n] for n in names) for r in rows_of(other)] == [tuple(r[n] for n in names) for r in every]
    assert sum(r["n_neighbours_within_40m"] for r in every) > 100


def test_pairs_are_dealt_by_herd_and_time_however_small_the_file(spark):
    n = 40
    df = table(spark, [("D1", f"S{k:03d}", 3600 * t, 0.0, k * 1e-4) for t in range(24) for k in range(n)])
    pairs = social.gps_proximity(df)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # a broadcast join would make all pairs in the tasks of the file
    assert pairs.count() == pairs.select("datetime", "pair_id").distinct().count() == 24 * n * (n - 1) // 2


def _plain_runs(fixes, metres, max_gap):
    """Runs (pair, number, first, last, fixes, distances) and gaps of (herd, track, time, lon, lat), by a loop over all pairs."""
    met, gaps, out = {}, [], []
    for k, (h, s, t, *p) in enumerate(fixes):
        for g, r, u, *q in fixes[:k]:
            if h == g and t == u and None not in (h, t, *p, *q) and all(map(math.isfinite, p + q)) and (d := _metres(p, q)) <= metres:
                met.setdefault((h, *sorted((s, r))), []).append((t, d))
    for pair, rows in met.items():
        number, run = 0, []
        for t, d in [*sorted(rows), (None, None)]:
            if run and t is not None and t > run[-1][0]:
                gaps.append(t - run[-1][0])
            if run and (t is None or t - run[-1][0] > max_gap):
                number, run = number + 1, out.append((*pair, number + 1, run[0][0], run[-1][0], len(run), [v for _, v in run])) or []
            run.append((t, d))
    return sorted(out), sorted(gaps)


def _met_often(rng):
    near = [("D1", f"S{k % 9}", 60 * rng.randrange(40), 150 + 0.02 * rng.random(), -30 + 0.02 * rng.random()) for k in range(600)]
    edge = [("D2", f"T{k % 3}", 60 * (k // 4), 179.9999 if k % 2 else -179.9999 - 360 * (k % 3), 0.001 * (k % 5)) for k in range(60)]
    pole = [("D3", f"U{k}", 0, 90.0 * k, 89.9999) for k in range(4)] + [("D3", "U9", 0, 0.0, 90.0001)]
    return near + edge + pole + [("D1", "S1", 0, None, -30.0), ("D1", "S2", 0, float("nan"), -30.0), (None, "S1", 0, 150.0, -30.0), ("D1", "S1", None, 150.0, -30.0), ("D4", "V", 0, 1.0, 1.0)]


@pytest.mark.parametrize("piece", [3, 40, 1_000_000])
def test_runs_go_on_from_piece_to_piece(monkeypatch, piece):
    monkeypatch.setattr(meetings, "PIECE_PAIRS", piece)
    rows = [r for r in _met_often(random.Random(3)) if r[0] == "D1" and None not in r and math.isfinite(r[3])]
    want, gaps = _plain_runs(rows, 900, 300)
    names = sorted({r[1] for r in rows})
    own = np.array([names.index(r[1]) for r in rows])
    for sides in (np.full(len(rows), 2), own % 2):
        fixes = meetings.Fixes(*(np.array([r[k] for r in rows], t) for k, t in ((2, np.int64),)), own, *(np.array([r[k] for r in rows]) for k in (3, 4)), sides)
        got = sorted((*("D1", *(names[v] for v in divmod(p, len(names)))), *map(int, v[:4])) for f in meetings.runs(fixes.near(900), lambda g: g > 300) for p, *v in zip(*f, strict=True))
        counted = {}
        for v, n in meetings.gaps(fixes.near(900)):
            for a, b in zip(v.tolist(), n.tolist(), strict=True):
                counted[a] = counted.get(a, 0) + b
        if sides[0] == 2:
            assert got == [w[:-1] for w in want] and counted == {g: gaps.count(g) for g in gaps}
        else:
            assert got == [w[:-1] for w in want if (names.index(w[1]) + names.index(w[2])) % 2]


@pytest.mark.parametrize("block", [30, 262_144])
@pytest.mark.parametrize("gap", [5, None])
def test_contacts_equal_plain_pairs_without_a_row_for_a_pair(spark, monkeypatch, block, gap):
    monkeypatch.setattr(social, "BLOCK_FIXES", block)
    rows = _met_often(random.Random(4))
    limit = 60 * gap if gap else np.median(_plain_runs(rows, 900, 1e9)[1])
    want, _ = _plain_runs(rows, 900, limit)
    found = social.gps_contacts(table(spark, rows), 900, max_gap_mins=gap)
    # A join of fixes with fixes made a row for each pair, which was shuffled by its tracks.
    assert "rank_b" not in found._jdf.queryExecution().toString()
    got = sorted(found.collect(), key=lambda r: (r.deployment_id, r.sensor_id_a, r.sensor_id_b, r.contact_event_id))
    second = lambda t: (t - T0).total_seconds()
    assert [(r.deployment_id, r.sensor_id_a, r.sensor_id_b, r.contact_event_id, second(r.contact_start), second(r.contact_end), r.n_contact_fixes) for r in got] == [w[:-1] for w in want]
    assert {w[0] for w in want} == {"D1", "D2", "D3"} and any(w[1] == w[2] for w in want)
    for r, w in zip(got, want, strict=True):
        assert r.pair_id == f"{w[1]}:{w[2]}" and (r.animal_id_a, r.animal_id_b) == (w[1], w[2])
        assert (r.min_distance_m, r.mean_distance_m, r.max_distance_m) == pytest.approx((min(w[-1]), sum(w[-1]) / len(w[-1]), max(w[-1])), abs=1e-6)
