"""Smoothing, mixtures and hidden states against plain versions."""

import itertools
import math
import statistics

import numpy as np
import pytest
from helpers import rows_of, table

from fieldtrace.functions import chains, splines
from fieldtrace.operators import activity, cleaning, spatial


def dense_spline(x, y):
    """The smoothing spline of least generalised cross-validation by dense matrices."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = [1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    best = None
    for lam in splines.PENALTIES:
        hat = np.eye(n) - lam * q @ np.linalg.solve(r + lam * q.T @ q, q.T)
        score = ((y - hat @ y) ** 2).mean() / max(1 - np.trace(hat) / n, 1e-9) ** 2
        if best is None or score < best[0]:
            best = (score, hat @ y, lam, np.trace(hat))
    return best


def test_spline_equals_a_dense_solve():
    g = np.random.default_rng(2)
    for n in (4, 5, 7, 60, 130):
        x = np.cumsum(g.integers(1, 4, n)).astype(float)
        y = np.cumsum(g.normal(size=n)) + g.normal(size=n) * 3
        _, want, lam, trace = dense_spline(x, y)
        assert np.allclose(splines.fit(x, y, lam), want, atol=1e-6 * np.ptp(y)), n
        rss, leverage = splines.scores(x, y, np.ones(n, bool), np.array([lam]))
        assert leverage[0] == pytest.approx(trace, rel=1e-6) and rss[0] == pytest.approx(((y - want) ** 2).sum(), rel=1e-6)


def smoothed(y):
    ok = np.isfinite(y)
    out = y.copy()
    if ok.sum() >= 4 and np.ptp(y[ok]) > 0:
        out[ok] = dense_spline(np.flatnonzero(ok) + 1.0, y[ok] - y[ok].mean())[1] + y[ok].mean()
    return out


def test_splines_of_blocks_equal_one_spline(spark, monkeypatch):
    g = np.random.default_rng(12)
    df = table(spark, [("D", "A", 60 * i, 150 + 1e-4 * math.sin(i / 9) + 1e-5 * g.normal(), None if i % 17 == 0 else -30 + 1e-5 * g.normal()) for i in range(220)])
    monkeypatch.setattr(cleaning, "BLOCK_POINTS", 80)
    monkeypatch.setattr(cleaning, "OVERLAP_POINTS", 78)
    got = rows_of(cleaning.gps_denoise(df).data)
    for c, tol in (("lon", 1e-9), ("lat", 2e-6)):
        raw = np.array([math.nan if r[f"{c}_raw"] is None else r[f"{c}_raw"] for r in got])
        now = np.array([math.nan if r[c] is None else r[c] for r in got])
        assert np.allclose(now, smoothed(raw), atol=tol, equal_nan=True)


def wander(spark, n=70, sensors="AB"):
    g = np.random.default_rng(6)
    return table(spark, [("D", s, 60 * i, 150 + 1e-5 * i * (i > 30) + 1e-6 * g.normal(), -30 + 1e-6 * g.normal(), "rest" if 10 <= i < 20 else "walk") for s in sensors for i in range(n)], "state string")


def test_denoise_by_track_and_state(spark):
    df = wander(spark)
    raw = {(r.sensor_id, r.order_col): r for r in df.collect()}
    got = {(r.sensor_id, r.order_col): r for r in cleaning.gps_denoise(df).data.collect()}
    for s in "AB":
        keys = sorted(k for k in raw if k[0] == s)
        for c in ("lon", "lat"):
            assert np.allclose([got[k][c] for k in keys], smoothed(np.array([raw[k][c] for k in keys])), atol=1e-9)
            assert all(got[k][f"{c}_raw"] == raw[k][c] for k in keys)
    got = {(r.sensor_id, r.order_col): r for r in cleaning.gps_denoise(df, "state_aware", "state", ("rest",)).data.collect()}
    keys = sorted(k for k in raw if k[0] == "A")
    for c in ("lon", "lat"):
        assert {got[k][c] for k in keys[10:20]} == {statistics.median(raw[k][c] for k in keys[10:20])}
        for part in (keys[:10], keys[20:]):
            assert np.allclose([got[k][c] for k in part], smoothed(np.array([raw[k][c] for k in part])), atol=1e-9)


def test_adaptive_features_against_a_loop(spark):
    df = wander(spark, 40)
    out, names = activity.add_features(df)
    got = {(r.sensor_id, r.order_col): r for r in out.collect()}
    for s in "AB":
        track = sorted((r for r in got.values() if r.sensor_id == s), key=lambda r: r.order_col)
        for i, r in enumerate(track):
            inside = [x for x in track[: i + 1] if (r.datetime - x.datetime).total_seconds() < 1800]
            a, b = inside[0], r
            p, q = math.radians(a.lat), math.radians(b.lat)
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
            net, path = 2 * 6371000 * math.asin(math.sqrt(h)), sum(x.step_m for x in inside[1:])
            assert r["_f_net"] == pytest.approx(math.log1p(net), abs=1e-6)
            assert r["_f_straight"] == pytest.approx(min(net / path, 1) if path > 0 else 0, abs=1e-6)


def forward_backward(log_e, log_t, log_s):
    n = len(log_e)
    e, t = np.exp(log_e), np.exp(log_t)
    alpha, beta, total, xi = np.empty((n, 2)), np.ones((n, 2)), 0.0, np.zeros((2, 2))
    for i in range(n):
        a = (np.exp(log_s) if not i else alpha[i - 1] @ t) * e[i]
        total += np.log(a.sum())
        alpha[i] = a / a.sum()
    for i in range(n - 2, -1, -1):
        both = alpha[i][:, None] * t * (e[i + 1] * beta[i + 1])[None]
        xi += both / both.sum()
        beta[i] = t @ (e[i + 1] * beta[i + 1])
        beta[i] /= beta[i].sum()
    return alpha * beta / (alpha * beta).sum(1, keepdims=True), xi, total


def viterbi(log_e, log_t, log_s):
    score, back = log_s + log_e[0], []
    for e in log_e[1:]:
        step = score[:, None] + log_t
        back.append(step.argmax(0))
        score = step.max(0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("width", [1, 2, 7, 1000])
def test_blocks_of_a_chain_equal_one_loop(width):
    g = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 300):
        log_e, log_t, log_s = g.normal(size=(n, 2)) * 3, np.log([[0.9, 0.1], [0.3, 0.7]]), np.log([0.4, 0.6])
        blocks = [log_e[k : k + width] for k in range(0, n, width)]
        made = [chains.block_products(b, log_t, log_s, k == 0) for k, b in enumerate(blocks)]
        before, behind, score, ends = chains.across_blocks(np.stack([p for p, _ in made]), np.stack([q for _, q in made]))
        parts = [chains.posteriors(b, log_t, log_s, k == 0, before[k], behind[k]) for k, b in enumerate(blocks)]
        post, xi, total = forward_backward(log_e, log_t, log_s)
        assert np.allclose(np.concatenate([p for p, _, _ in parts]), post)
        assert np.allclose(sum(x for _, x, _ in parts), xi) and sum(t for _, _, t in parts) == pytest.approx(total)
        path = np.concatenate([chains.best_path(b, log_t, log_s, k == 0, score[k], ends[k]) for k, b in enumerate(blocks)])
        assert path.tolist() == viterbi(log_e, log_t, log_s)


def test_path_is_the_best_of_all():
    g = np.random.default_rng(5)
    for n in (1, 2, 5, 9):
        e, t, s = g.normal(size=(n, 2)), np.log([[0.8, 0.2], [0.3, 0.7]]), np.log([0.6, 0.4])
        score = lambda p: s[p[0]] + e[0, p[0]] + sum(t[a, b] + e[i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(p)))  # noqa: B023, E731
        assert tuple(viterbi(e, t, s)) == max(itertools.product((0, 1), repeat=n), key=score)


def dense(x, model, k):
    return -0.5 * (np.log(2 * np.pi * model["var"][k]) + (x - model["mean"][k]) ** 2 / model["var"][k]).sum(1)


def halves(x):
    up = x[:, 0] > np.median(x[:, 0])
    return {"mean": np.stack([x[~up].mean(0), x[up].mean(0)]), "var": np.stack([x[~up].var(0), x[up].var(0)]) + 1e-6}


def test_mixture_equals_plain_expectation_maximisation(spark):
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(size=(60, 2)) * [0.2, 0.5], g.normal(size=(90, 2)) + [3, 1]])
    got = activity.fit_mixture(spark.createDataFrame(x.tolist(), "a double, b double").repartition(3), ["a", "b"])
    model, weight, last = halves(x), np.array([0.5, 0.5]), -math.inf
    for _ in range(200):
        p = np.stack([weight[k] * np.exp(dense(x, model, k)) for k in (0, 1)], 1)
        share, total = p / p.sum(1, keepdims=True), np.log(p.sum(1)).mean()
        weight = share.sum(0) / len(x)
        model["mean"] = (share.T @ x) / share.sum(0)[:, None]
        model["var"] = np.stack([(share[:, k, None] * (x - model["mean"][k]) ** 2).sum(0) / share[:, k].sum() for k in (0, 1)])
        if abs(total - last) < 1e-5:
            break
        last = total
    assert np.allclose(got["weight"], weight, atol=1e-6) and all(np.allclose(got[c], model[c], atol=1e-6) for c in ("mean", "var"))
    same = activity.fit_mixture(spark.createDataFrame([[1.0, 2.0]] * 60, "a double, b double"), ["a", "b"])
    assert np.allclose(same["mean"], [[1, 2], [1, 2]])


def plain_runs(path, least):
    runs = [(k, len(list(v))) for k, v in itertools.groupby(path)]
    out = []
    for i, (k, n) in enumerate(runs):
        out += [out[-1] if n < least and 0 < i < len(runs) - 1 else k] * n
    return out


@pytest.mark.parametrize(("method", "block"), [("gmm_hmm", 4096), ("hmm", 4096), ("gmm_hmm", 9), ("hmm", 9)])
def test_hidden_states_of_tracks_equal_plain_decoding(spark, monkeypatch, method, block):
    monkeypatch.setattr(activity, "BLOCK_ROWS", block)
    df = wander(spark)
    done = activity.gps_activity_state(df, method, feature_set="step_turn")
    idle = done.model["inactive_component"] - 1
    got = {r.order_col: r for r in done.data.collect()}
    rows = rows_of(activity.add_features(df, "step_turn")[0])
    assert len(got) == len(rows)
    tracks = [[r for r in rows if r.sensor_id == s and r["_f_turn"] is not None] for s in "AB"]
    xs = [np.array([[r["_f_step"], r["_f_turn"]] for r in track]) for track in tracks]
    if method == "hmm":
        model, trans, start, last = halves(np.concatenate(xs)), np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([0.5, 0.5]), -math.inf
        for _ in range(100):
            found = [forward_backward(np.stack([dense(x, model, k) for k in (0, 1)], 1), np.log(trans), np.log(start)) for x in xs]
            post, x, now = np.concatenate([f[0] for f in found]), np.concatenate(xs), sum(f[2] for f in found)
            trans = sum(f[1] for f in found) + np.array([[4.0, 0], [0, 4.0]])
            trans = trans / trans.sum(1, keepdims=True)
            start = np.clip(sum(f[0][0] for f in found) / 2, 1e-6, 1)
            start = start / start.sum()
            model["mean"] = (post.T @ x) / post.sum(0)[:, None]
            model["var"] = np.maximum(np.stack([(post[:, k, None] * (x - model["mean"][k]) ** 2).sum(0) / post[:, k].sum() for k in (0, 1)]), 1e-6)
            if abs(now - last) < 1e-4 * max(1.0, abs(last)):
                break
            last = now
        assert np.allclose(done.model["mean"], model["mean"], atol=1e-5) and np.allclose(done.model["trans"], trans, atol=1e-5)
    for track, x in zip(tracks, xs, strict=True):
        logs = np.stack([dense(x, done.model, k) for k in (0, 1)], 1)
        if method == "hmm":
            t, start = np.log(done.model["trans"]), np.log(done.model["start"])
            path = plain_runs(viterbi(logs, t, start), 2)
            want, prob = ["inactive" if p == idle else "active" for p in path], forward_backward(logs, t, start)[0][:, idle]
        else:
            logs = logs + np.log(done.model["weight"])
            p = np.clip(1 / (1 + np.exp(logs[:, 1 - idle] - logs[:, idle])), 1e-12, 1 - 1e-12)
            e, t, start = np.log(np.stack([p, 1 - p], 1)), np.log([[0.98, 0.02], [0.02, 0.98]]), np.log([0.5, 0.5])
            want, prob = ["inactive" if p == 0 else "active" for p in viterbi(e, t, start)], forward_backward(e, t, start)[0][:, 0]
        assert [got[r.order_col].activity_state for r in track] == want
        assert np.allclose([got[r.order_col].inactive_prob for r in track], prob, atol=1e-6)


def test_short_runs_take_over_the_state_before(spark):
    g = np.random.default_rng(1)
    path = [int(v) for v in (g.random(200) < 0.4)]
    df = spark.createDataFrame([("A", 1, i, p) for i, p in enumerate(path)] + [(None, 1, 0, 1)], "sensor_id string, _seq long, _no int, _path int").repartition(4)
    for least in (2, 3):
        got = {(r.sensor_id, r["_no"]): r["_path"] for r in activity.long_runs(df, ["sensor_id"], least).collect()}
        assert [got["A", i] for i in range(200)] == plain_runs(path, least) and got[None, 0] == 1


def test_rest_runs_with_missing_coordinates_keep_their_median(spark):
    lon = [1.0, 2.0, math.nan, math.nan, None]
    df = table(spark, [("D", "A", 60 * i, x, -30.0, "rest") for i, x in enumerate(lon)] + [("D", "B", 60 * i, math.nan, -30.0, "rest") for i in range(3)], "state string")
    got = rows_of(cleaning.gps_denoise(df, "state_aware", "state", ("rest",)).data)
    assert [r.lon for r in got[:5]] == [1.5] * 5 and all(math.isnan(r.lon) for r in got[5:])


def test_kernel_density_in_parts_equals_one_sum(spark, monkeypatch):
    g = np.random.default_rng(9)
    df = table(spark, [("D", s, 60 * i, 150 + 1e-3 * g.normal(), -30 + 1e-3 * g.normal()) for s in "AB" for i in range(60)] + [("D", "C", 60 * i, 150.0, -30.0) for i in range(6)] + [("D", "E", 0, 150.0, -30.0)])
    run = lambda: {(r.sensor_id, r.density_rank): r for r in spatial.gps_kde(df, epoch="month", metric_crs=3857, keep_all=True, max_cells=500).collect()}
    whole = run()
    monkeypatch.setattr(spatial, "PART_POINTS", 7)
    parts = run()
    assert whole.keys() == parts.keys() and {k[0] for k in whole} == {"A", "B", "C"}
    for k, r in whole.items():
        assert parts[k].kde_density == pytest.approx(r.kde_density, rel=1e-9)
    for s in "ABC":
        assert sum(r.cell_probability for k, r in whole.items() if k[0] == s) == pytest.approx(1)


def test_whole_sequences_side_by_side_equal_one_after_the_other():
    g = np.random.default_rng(4)
    lengths = np.array([1, 7, 3, 40, 7, 2])
    starts, log_e = np.cumsum(lengths) - lengths, 3 * g.normal(size=(lengths.sum(), 2))
    log_t, log_s = np.log([[0.9, 0.1], [0.3, 0.7]]), np.log([0.6, 0.4])
    post, path, moved, ll = np.empty_like(log_e), np.empty(len(log_e), int), np.zeros((2, 2)), 0.0
    for at, have in chains.packed(lengths, 50):
        there = np.arange(at.shape[1]) < have[:, None]
        p, m, one = chains.whole_posteriors(log_e[at], have, log_t, log_s)
        post[at[there]], path[at[there]] = p[there], chains.whole_paths(log_e[at], have, log_t, log_s)[there]
        moved, ll = moved + m, ll + one
    want = [forward_backward(log_e[s : s + n], log_t, log_s) for s, n in zip(starts, lengths, strict=True)]
    assert np.allclose(post, np.concatenate([x[0] for x in want])) and np.allclose(moved, sum(x[1] for x in want)) and np.isclose(ll, sum(x[2] for x in want))
    assert path.tolist() == [int(v) for s, n in zip(starts, lengths, strict=True) for v in viterbi(log_e[s : s + n], log_t, log_s)]


def test_splines_side_by_side_equal_one_after_the_other():
    g = np.random.default_rng(5)
    lengths = np.array([4, 30, 5, 300, 4])
    y = np.cumsum(g.normal(size=lengths.sum())) + 150
    got, starts = splines.smoothed(y, lengths), np.cumsum(lengths) - lengths
    for s, n in zip(starts, lengths, strict=True):
        x, own = np.arange(n, dtype=float), y[s : s + n] - y[s : s + n].mean()
        rss, leverage = splines.scores(x, own, np.ones(n, bool))
        k = (rss / n / np.maximum(1 - leverage / n, 1e-9) ** 2).argmin()
        assert np.allclose(got[s : s + n], y[s : s + n].mean() + splines.fit(x, own, splines.PENALTIES[k]), atol=1e-10)


def test_short_tracks_are_smoothed_together_as_long_ones_by_themselves(spark, monkeypatch):
    g = np.random.default_rng(6)
    lon = [math.nan if k % 29 == 3 else None if k % 31 == 7 else 150 + 1e-3 * g.normal() for k in range(240)]
    df = table(spark, [("D", None if k % 5 == 4 else "ABCD"[k % 5], 60 * k, lon[k], -30 + 1e-3 * g.normal(), ("rest", "walk")[g.random() < 0.8]) for k in range(240)], "state string").repartition(3)
    run = lambda *a: [(r.order_col, r.lon, r.lat, r.lon_raw) for r in rows_of(cleaning.gps_denoise(df, *a).data)]
    methods = [(), ("state_aware", "state", ("rest",))]
    with monkeypatch.context() as m:
        m.setattr(cleaning, "_splined", None)  # no group of its own for a track or run
        short = [run(*a) for a in methods]
    monkeypatch.setattr(cleaning, "WHOLE_POINTS", 0)
    for a, got in zip(methods, short, strict=True):
        for x, y in zip(got, run(*a), strict=True):
            assert all(u is v is None or u == pytest.approx(v, abs=1e-9, nan_ok=True) for u, v in zip(x, y, strict=True))


def test_density_of_a_group_becomes_its_result_in_one_task(spark, monkeypatch):
    g = np.random.default_rng(3)
    df = table(spark, [("D1", f"S{k % 3}", k, 150 + g.random() / 1e3, -30 + g.random() / 1e3) for k in range(90)])
    run = lambda: {(r.sensor_id, r.density_rank): r for r in spatial.gps_kde(df, epoch="month", metric_crs=3857, max_cells=300).collect()}
    plan = spatial.gps_kde(df, epoch="month", metric_crs=3857)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # a window over all cells shuffled every grid
    one = run()
    monkeypatch.setattr(spatial, "PART_POINTS", 7)
    parts = run()
    assert set(one) == set(parts) and {k[0] for k in one} == {"S0", "S1", "S2"}
    for k, r in one.items():
        assert (r.cell_centre_x, r.cell_centre_y) == (parts[k].cell_centre_x, parts[k].cell_centre_y)
        assert (r.kde_density, r.cumulative_probability) == pytest.approx((parts[k].kde_density, parts[k].cumulative_probability), rel=1e-12)
    last = {s: max(r.cumulative_probability - r.cell_probability for k, r in one.items() if k[0] == s) for s in ("S0", "S1", "S2")}
    assert all(0.9 < v < 0.95 for v in last.values())


def test_a_round_of_a_mixture_is_a_row_of_sums_for_each_task(spark, monkeypatch):
    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(0, 0.3, (300, 2)), g.normal(3, 0.8, (200, 2))])
    rows, rounds = spark.createDataFrame([*map(tuple, x.tolist()), (None, 1.0)], "a double, b double").repartition(3), []
    plain = activity._mixture_round

    def seen(*a):
        rounds.append(a)
        return plain(*a)

    monkeypatch.setattr(activity, "_mixture_round", seen)
    model = activity.fit_mixture(rows, ["a", "b"], tol=1e-9)
    assert len(rounds) > 2 and model["weight"] == pytest.approx([0.6, 0.4], abs=0.01) and model["mean"][1] == pytest.approx(x[300:].mean(0), abs=0.05)
    logs = np.stack([np.log(w) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(1) for w, m, v in zip(model["weight"], model["mean"], model["var"])])
    assert model["log_likelihood"] == pytest.approx(np.logaddexp(*logs).mean(), abs=1e-6)
