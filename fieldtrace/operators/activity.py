"""Active and inactive states from movement: mixture models and hidden Markov smoothing.

Fits are rounds of aggregates over all rows; what returns to the driver is the state of two components. Sequences
that fit into a block are worked on side by side, others in blocks of rows (``functions.chains``): no task holds a longer track.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import chains, stats
from fieldtrace.functions.geo import haversine_m, is_finite
from fieldtrace.operators.movement import gps_steps
from fieldtrace.operators.tracks import ORDER, join_by, prepare, track_groups

MIN_ROWS, MIN_VAR = 50, 1e-6
#: Rows of a block of a track.
BLOCK_ROWS = 4096


@dataclass
class ActivityStates:
    """Rows with state columns, and what was fitted."""

    data: DataFrame
    model: dict = field(default_factory=dict)


def add_features(df: DataFrame, feature_set: str = "adaptive", groups: list[str] | None = None, order_col: str = ORDER) -> tuple[DataFrame, list[str]]:
    """Log step and absolute turn; ``adaptive`` adds net displacement and straightness over a trailing window.

    The window of a track is the larger of 30 minutes and four of its median gaps. A row with a time and finite coordinates
    looks back to the first such row inside its window: the first one after the window's start, found by one scan over
    rows and window starts in order of time. Rows without a time or coordinates have no window.
    """
    df = prepare(df)
    grp = track_groups(df, groups)
    if not {"step_m", "speed_mps", "turn_rad"} <= set(df.columns):
        df = gps_steps(df, groups, order_col)
    out = df.withColumns({"_f_step": F.log1p("step_m"), "_f_turn": F.abs("turn_rad")})
    if feature_set == "step_turn":
        return out, ["_f_step", "_f_turn"]
    if feature_set != "adaptive":
        raise ValueError(f"unknown feature set {feature_set!r}")
    track = Window.partitionBy(*grp).orderBy("datetime", order_col)
    gap = F.unix_micros("datetime") - F.unix_micros(F.lag("datetime").over(track))
    rows = out.withColumns({
        "_t": F.unix_micros("datetime"), "_gap": F.when(gap > 0, gap),
        "_run": F.sum(F.when(is_finite(F.col("step_m")) & (F.col("step_m") > 0), F.col("step_m")).otherwise(0.0)).over(track.rowsBetween(Window.unboundedPreceding, 0)),
    })
    widths = rows.groupBy(*grp).agg(F.greatest(F.lit(1_800_000_000), F.coalesce((4 * F.median("_gap")).cast("long"), F.lit(0))).alias("_width"))
    ok = is_finite(F.col("lon")) & is_finite(F.col("lat")) & F.col("_t").isNotNull()
    asked = join_by(rows, widths, grp).withColumns({"_at": F.col("_t") - F.col("_width"), "_asks": F.lit(True)})
    points = rows.filter(ok).select(*grp, order_col, F.col("_t").alias("_at"), F.lit(False).alias("_asks"), F.struct("lon", "lat", "_run").alias("_point"))
    # Backwards in time the last point passed is the first one after a window's start; a start passes no point of its own time.
    behind = Window.partitionBy(*grp).orderBy(F.desc("_at"), F.desc("_asks"), F.desc(order_col)).rowsBetween(Window.unboundedPreceding, -1)
    found = asked.unionByName(points, allowMissingColumns=True).withColumn("_from", F.last("_point", True).over(behind)).filter("_asks")
    net = F.when(ok, haversine_m(F.col("_from.lon"), F.col("_from.lat"), F.col("lon"), F.col("lat")))
    path = F.greatest(F.col("_run") - F.col("_from._run"), F.lit(0.0))
    found = found.withColumns({"_net": net, "_path": path})
    straight = F.when(F.col("_net").isNotNull(), F.when(F.col("_path") > 0, F.least(F.col("_net") / F.col("_path"), F.lit(1.0))).otherwise(0.0))
    return found.select(*out.columns, F.log1p("_net").alias("_f_net"), straight.alias("_f_straight")), ["_f_step", "_f_turn", "_f_net", "_f_straight"]


def _start(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of the rows above the median of the first feature, and of the others."""
    middle = stats.quantiles(stats.counted(rows, F.col(names[0])), {"m": 0.5}).first()["m"]
    upper = F.col(names[0]) > F.lit(middle)
    aggregates = [f(F.when(side, F.col(c))).alias(f"{a}_{k}_{j}") for k, side in enumerate((~upper, upper)) for j, c in enumerate(names) for a, f in (("m", F.avg), ("v", F.var_pop))]
    one = rows.agg(*aggregates, *[F.avg(c).alias(f"m_{j}") for j, c in enumerate(names)], *[F.stddev_pop(c).alias(f"s_{j}") for j, c in enumerate(names)]).first()
    d = range(len(names))
    # Where one side is empty, the components start a deviation apart.
    mean = [[one[f"m_{k}_{j}"] if one[f"m_1_{j}"] is not None else one[f"m_{j}"] + (2 * k - 1) * one[f"s_{j}"] for j in d] for k in (0, 1)]
    var = [[one[f"v_{k}_{j}"] if one[f"m_1_{j}"] is not None else one[f"s_{j}"] ** 2 for j in d] for k in (0, 1)]
    return np.array(mean, float), np.array(var, float) + MIN_VAR


def _log_density(names: list[str], mean: np.ndarray, var: np.ndarray, k: int) -> Column:
    out = F.lit(float(-0.5 * np.log(2 * np.pi * var[k]).sum()))
    for j, c in enumerate(names):
        out = out - 0.5 * (F.col(c) - float(mean[k, j])) * (F.col(c) - float(mean[k, j])) / float(var[k, j])
    return out


def _mixture_round(sums: list[str], weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> Callable:
    """What a round of expectation maximisation adds up over the rows of a task: one row, however many rows there are."""
    base = np.log(weight) - 0.5 * np.log(2 * np.pi * var).sum(1)

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sums))
        for b in batches:
            off = np.stack([c.to_numpy() for c in b.columns])[None] - mean[:, :, None]
            square = off * off
            logs = base[:, None] - 0.5 * np.einsum("kjn,kj->kn", square, 1 / var)
            both = np.logaddexp(*logs)
            share = np.exp(logs - both)
            total += np.concatenate([[b.num_rows, both.sum()], share.sum(1), np.einsum("kn,kjn->kj", share, off).reshape(-1), np.einsum("kn,kjn->kj", share, square).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], sums)

    return expected


def fit_mixture(rows: DataFrame, names: list[str], max_iter: int = 200, tol: float = 1e-5) -> dict:
    """Two diagonal Gaussians by expectation maximisation: one aggregate over all rows a round, from a row of sums for each task.

    Starts from the halves at the median of the first feature; stops when the mean log likelihood moves by less than ``tol``.
    """
    mean, var = _start(rows, names)
    weight, last, d = np.array([0.5, 0.5]), -np.inf, len(names)
    sums = ["n", "ll", *[f"n{k}" for k in (0, 1)], *[f"{a}{k}_{j}" for a in "mv" for k in (0, 1) for j in range(d)]]
    columns = ", ".join(f"{c} double" for c in sums)
    known = rows.select(*[F.col(c).cast("double") for c in names]).dropna()
    for _ in range(max_iter):
        # The numbers of a round go with the function: as literals they had the aggregate compiled anew each time.
        got = known.mapInArrow(_mixture_round(sums, weight, mean, var), columns)
        one = np.array(got.agg(*[F.sum(c) for c in sums]).first(), float)
        now, n = one[1] / one[0], one[2:4] + 1e-12
        moved, square = (one[4 + i * 2 * d : 4 + (i + 1) * 2 * d].reshape(2, d) / n[:, None] for i in (0, 1))
        weight, mean, var = n / n.sum(), mean + moved, np.maximum(square - moved**2, MIN_VAR)
        if abs(now - last) < tol:
            break
        last = now
    return {"weight": weight, "mean": mean, "var": var, "log_likelihood": float(now)}


def _sequences(rows: DataFrame, groups: list[str], order_col: str) -> DataFrame:
    """Add ``_seq`` (a run of usable or of unusable rows of a track), ``_no`` (place in the track), ``_begins``, ``_ends``, ``_block``."""
    track = Window.partitionBy(*groups).orderBy("datetime", order_col)
    begins, ends = (F.coalesce(F.col("_ok") != f("_ok").over(track), F.lit(True)) for f in (F.lag, F.lead))
    out = rows.withColumns({"_begins": begins, "_ends": ends, "_no": F.row_number().over(track)})
    return out.withColumns({"_seq": F.sum(F.col("_begins").cast("long")).over(track.rowsBetween(Window.unboundedPreceding, 0)), "_block": F.floor(F.col("_no") / BLOCK_ROWS)})


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _same(table: pa.Table, columns: list[str], n: int) -> dict[str, pa.Array]:
    """The grouping values of a group, for ``n`` rows."""
    return {c: pa.chunked_array([pa.repeat(table.column(c)[0], n)]) for c in columns}


def _floats(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(rows, float).reshape(-1)), rows.shape[1]).cast(pa.list_(pa.float64()))


def _carried(products: DataFrame, keys: list[str]) -> DataFrame:
    """What every block gets from the other blocks of its sequence; a sequence has a row for each ``BLOCK_ROWS`` rows here."""

    def carry(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        product, plus = (np.array(table.column(c).to_pylist()).reshape(-1, 2, 2) for c in ("_product", "_plus"))
        before, behind, score, ends = chains.across_blocks(product, plus)
        return pa.table({**_same(table, keys, len(ends)), "_block": table.column("_block"), "_before": _floats(before), "_behind": _floats(behind), "_score": _floats(score), "_end": pa.array(ends.astype(np.int32))})

    return products.groupBy(*keys).applyInArrow(carry, f"{_kinds(products, [*keys, '_block'])}, _before array<double>, _behind array<double>, _score array<double>, _end int")


def _decoded(rows: DataFrame, groups: list[str], log_t: np.ndarray, log_s: np.ndarray) -> DataFrame:
    """Add ``_p0`` (posterior of state 0) and ``_path`` to usable rows with ``_seq, _block, _no, _begins`` and log emissions ``_e0, _e1``."""
    keys = [*groups, "_seq"]

    def emissions(table: pa.Table) -> np.ndarray:
        return np.stack([table.column("_e0").to_numpy(), table.column("_e1").to_numpy()], 1)

    def products(table: pa.Table) -> pa.Table:
        table = table.sort_by("_no")
        product, plus = chains.block_products(emissions(table), log_t, log_s, table.column("_begins")[0].as_py())
        return pa.table({**_same(table, [*keys, "_block"], 1), "_product": _floats(product.reshape(1, 4)), "_plus": _floats(plus.reshape(1, 4))})

    narrow = rows.select(*keys, "_block", "_no", "_begins", "_e0", "_e1")
    found = narrow.groupBy(*keys, "_block").applyInArrow(products, f"{_kinds(rows, [*keys, '_block'])}, _product array<double>, _plus array<double>")

    def decode(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.append_column("_p0", pa.array([], pa.float64())).append_column("_path", pa.array([], pa.int32()))
        left, (edge,) = left.sort_by("_no"), right.to_pylist()
        log_e, begins = emissions(left), left.column("_begins")[0].as_py()
        post, _, _ = chains.posteriors(log_e, log_t, log_s, begins, np.array(edge["_before"]), np.array(edge["_behind"]))
        path = chains.best_path(log_e, log_t, log_s, begins, np.array(edge["_score"]), edge["_end"])
        return left.append_column("_p0", pa.array(post[:, 0])).append_column("_path", pa.array(path.astype(np.int32)))

    both = rows.groupBy(*keys, "_block").cogroup(_carried(found, keys).groupBy(*keys, "_block"))
    return both.applyInArrow(decode, f"{_kinds(rows, rows.columns)}, _p0 double, _path int")


def _decoded_whole(rows: DataFrame, log_t: np.ndarray, log_s: np.ndarray) -> DataFrame:
    """The same as ``_decoded`` for rows of tracks that fit into a block, in the order of ``_sequences``: many side by side."""

    def answered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        log_e = np.stack([table.column(c).to_numpy() for c in ("_e0", "_e1")], 1)
        begins = np.flatnonzero(table.column("_begins").to_numpy())
        p0, path = np.empty(len(log_e)), np.empty(len(log_e), np.int32)
        for at, have in chains.packed(np.diff(begins, append=len(log_e))):
            there = np.arange(at.shape[1]) < have[:, None]
            p0[at[there]] = chains.whole_posteriors(log_e[at], have, log_t, log_s)[0][there][:, 0]
            path[at[there]] = chains.whole_paths(log_e[at], have, log_t, log_s)[there]
        yield from table.append_column("_p0", pa.array(p0)).append_column("_path", pa.array(path)).to_batches()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            ends = np.flatnonzero(b.column("_ends").to_numpy(zero_copy_only=False))
            if len(ends):  # the sequence that begins last may go on in the next batch
                yield from answered([*held, b.slice(0, ends[-1] + 1)])
                held, b = [], b.slice(ends[-1] + 1)
            if b.num_rows:
                held.append(b)

    return rows.mapInArrow(decode, f"{_kinds(rows, rows.columns)}, _p0 double, _path int")


def _rounds(own: list[str], sums: list[str], log_t: np.ndarray, log_s: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[Callable, Callable, Callable]:
    """What a round of Baum-Welch does with blocks of features: their matrices, and, once carried, their expectations; or both at once."""

    def emissions(x: np.ndarray) -> np.ndarray:
        return -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None, :] - mean[None]) ** 2 / var[None]).sum(2)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [chains.block_products(emissions(x.values.to_numpy().reshape(-1, mean.shape[1])), log_t, log_s, begins) for x, begins in zip(b.column("_x"), b.column("_begins").to_pylist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(_floats(np.stack([f[i].reshape(4) for f in found])) for i in (0, 1))], [*own, "_product", "_plus"])

    def expected(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r, edge in zip(left.to_pylist(), right.to_pylist(), strict=True):
            x = np.array(r["_x"]).reshape(-1, mean.shape[1])
            post, moved, ll = chains.posteriors(emissions(x), log_t, log_s, r["_begins"], np.array(edge["_before"]), np.array(edge["_behind"]))
            off = x[:, None, :] - mean[None]
            first = post[0] if r["_begins"] else np.zeros(2)
            out.append(np.concatenate([[ll], first, moved.reshape(-1), post.sum(0), (post[:, :, None] * off).sum(0).reshape(-1), (post[:, :, None] * off**2).sum(0).reshape(-1)]))
        return pa.table(dict(zip(sums, np.array(out).reshape(-1, len(sums)).T, strict=True)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same sums for blocks that are whole sequences, many side by side."""
        for b in batches:
            x, n = b.column("_x").flatten().to_numpy().reshape(-1, mean.shape[1]), pc.list_value_length(b.column("_x")).to_numpy() // mean.shape[1]
            log_e, out = emissions(x), []
            for at, have in chains.packed(n):
                post, moved, ll = chains.whole_posteriors(log_e[at], have, log_t, log_s)
                there = np.arange(at.shape[1]) < have[:, None]
                p, off = post[there], x[at[there]][:, None, :] - mean[None]
                out.append(np.concatenate([[ll], post[0].sum(0), moved.reshape(-1), p.sum(0), np.einsum("rk,rkj->kj", p, off).reshape(-1), np.einsum("rk,rkj->kj", p, off**2).reshape(-1)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in np.sum(out, 0)], sums)

    return products, expected, whole


def fit_hmm(rows: DataFrame, names: list[str], groups: list[str], max_iter: int = 100, tol: float = 1e-4, self_prob: float = 0.95) -> dict:
    """Two-state Gaussian HMM by Baum-Welch over all sequences, with Dirichlet priors of 1, and 5 for staying.

    ``rows`` are usable rows with ``_seq, _block, _no, _begins, _ends``. Sequences inside one block give their expectations
    at once. For the others a round sends matrices of blocks, carries them along each sequence, and sums expectations of
    blocks. Blocks of features are kept between rounds.
    """
    mean, var = _start(rows, names)
    trans, start, last, d = np.array([[self_prob, 1 - self_prob], [1 - self_prob, self_prob]]), np.array([0.5, 0.5]), -np.inf, len(names)
    keys = [*groups, "_seq"]
    own = [*keys, "_block"]
    listed = F.sort_array(F.collect_list(F.struct("_no", F.array(*names).alias("x"))))
    blocks = rows.groupBy(*own).agg(F.max("_begins").alias("_begins"), (F.max("_begins") & F.max("_ends")).alias("_whole"), listed.alias("_x")).select(*own, "_begins", "_whole", F.flatten("_x.x").alias("_x")).repartition(*own).persist()
    sums = ["ll", *[f"s{k}" for k in (0, 1)], *[f"t{i}{k}" for i in (0, 1) for k in (0, 1)], *[f"n{k}" for k in (0, 1)], *[f"{a}{k}_{j}" for a in "mv" for k in (0, 1) for j in range(d)]]
    kinds = _kinds(blocks, own)
    one_block, more = blocks.filter("_whole").select("_x"), blocks.filter("not _whole")
    try:
        parted = not more.isEmpty()
        for _ in range(max_iter):
            products, expected, whole = _rounds(own, sums, np.log(trans), np.log(start), mean, var)
            columns = ", ".join(f"{c} double" for c in sums)
            got = one_block.mapInArrow(whole, columns)
            if parted:
                carried = _carried(more.mapInArrow(products, f"{kinds}, _product array<double>, _plus array<double>"), keys)
                got = got.union(more.groupBy(*own).cogroup(carried.groupBy(*own)).applyInArrow(expected, columns))
            one = np.array(got.agg(*[F.sum(c) for c in sums]).first(), float)
            now, begun, moved, n = one[0], one[1:3], one[3:7].reshape(2, 2), one[7:9] + 1e-12
            trans = moved + np.array([[4.0, 0.0], [0.0, 4.0]]) + 1e-9
            trans /= trans.sum(1, keepdims=True)
            start = np.clip(begun / begun.sum(), 1e-6, 1)
            start /= start.sum()
            shift, square = (one[9 + i * 2 * d : 9 + (i + 1) * 2 * d].reshape(2, d) / n[:, None] for i in (0, 1))
            mean, var = mean + shift, np.maximum(square - shift**2, MIN_VAR)
            if np.isfinite(last) and abs(now - last) < tol * max(1.0, abs(last)):
                break
            last = now
    finally:
        blocks.unpersist()
    return {"trans": trans, "start": start, "mean": mean, "var": var, "log_likelihood": float(now)}


def long_runs(rows: DataFrame, groups: list[str], min_run: int) -> DataFrame:
    """``_path`` where runs shorter than ``min_run`` between two others take over the state of the run before."""
    sequence = Window.partitionBy(*groups, "_seq")
    order = sequence.orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_new", F.coalesce((F.col("_path") != F.lag("_path").over(sequence.orderBy("_no"))).cast("long"), F.lit(0)))
    out = out.withColumn("_run", F.sum("_new").over(order))
    runs = out.groupBy(*groups, "_seq", "_run").agg(F.count(F.lit(1)).alias("_size"), F.first("_path").alias("_own"))
    along = sequence.orderBy("_run")
    edge = F.lag("_run").over(along).isNull() | F.lead("_run").over(along).isNull()
    runs = runs.withColumn("_kept", F.when(edge | (F.col("_size") >= min_run), F.col("_own")))
    runs = runs.withColumn("_state", F.last("_kept", True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*groups, "_seq", "_run"]
    return join_by(out, runs.select(*keys, "_state"), keys).drop("_path", "_new", "_run").withColumnRenamed("_state", "_path")


def gps_activity_state(
    df: DataFrame, method: str = "gmm_hmm", groups: list[str] | None = None, state_col: str = "activity_state", inactive_prob_col: str = "inactive_prob", feature_set: str = "adaptive", fit_max_rows: int | None = None, seed: int = 1, min_run_n: int = 2, self_prob: float = 0.98, order_col: str = ORDER,
) -> ActivityStates:
    """Label fixes active or inactive.

    The model is fitted to all rows that have all features, by aggregates; ``fit_max_rows`` fits it to about so many instead
    (single rows by seeded hash for mixtures, whole tracks for ``hmm``). Rows are scored by column expressions (``gmm``) and
    tracks decoded in blocks (``gmm_hmm``, ``hmm``). The inactive component is the one with less movement. At least 50 rows
    must have all features.
    """
    if method not in ("gmm_hmm", "gmm", "hmm"):
        raise ValueError(f"unknown method {method!r}")
    rows, names = add_features(df, feature_set, groups, order_col)
    grp = track_groups(rows, groups)
    valid = F.lit(True)
    for c in names:
        valid = valid & is_finite(F.col(c))
    rows = rows.withColumn("_ok", valid)
    keep = [c for c in rows.columns if c not in {*names, "_ok"}]
    if method == "hmm":
        rows = _sequences(rows, grp, order_col)
    fit = rows.filter("_ok").select(*grp, *names, order_col, *(["_seq", "_block", "_no", "_begins", "_ends"] if method == "hmm" else [])).persist()
    try:
        n = fit.count()
        if n < MIN_ROWS:
            raise ValueError(f"only {n} rows have all features; {MIN_ROWS} are needed")
        if fit_max_rows is not None and n > fit_max_rows:
            by = F.xxhash64(F.lit(seed), *(grp if method == "hmm" else [order_col]))
            some = fit.filter(F.pmod(by, F.lit(2**32)) < int(2**32 * fit_max_rows / n))
        else:
            some = fit
        model = fit_hmm(some, names, grp) if method == "hmm" else fit_mixture(some, names)
    finally:
        fit.unpersist()
    moved = np.expm1(model["mean"][:, 0]) + (np.expm1(model["mean"][:, 2]) if len(names) > 2 else 0)
    idle = int(moved.argmin())
    extra = f"{state_col}_id" if method == "hmm" else f"{state_col}_component"
    found = {"method": method, "features": names, "inactive_component": idle + 1, **model}
    density = lambda k: _log_density(names, model["mean"], model["var"], k)
    if method != "hmm":
        gap = density(1 - idle) - density(idle) + float(np.log(model["weight"][1 - idle]) - np.log(model["weight"][idle]))
        rows = rows.withColumn(inactive_prob_col, F.when(F.col("_ok"), 1 / (1 + F.exp(F.least(gap, F.lit(700.0))))))
    if method == "gmm":
        is_idle = F.col(inactive_prob_col) >= 0.5
        out = rows.withColumns({state_col: F.when(is_idle, "inactive").when(~is_idle, "active"), extra: F.when(is_idle, idle + 1).when(~is_idle, 2 - idle)})
        return ActivityStates(out.select(*keep, state_col, inactive_prob_col, extra), found)
    if method == "hmm":
        states, log_t, log_s = (0, 1), np.log(model["trans"]), np.log(model["start"])
        emitted = rows.withColumns({f"_e{k}": density(k) for k in states})
    else:  # state 0 is the inactive one
        log_t, log_s = np.log(np.array([[self_prob, 1 - self_prob], [1 - self_prob, self_prob]])), np.log(np.array([0.5, 0.5]))
        p = F.least(F.greatest(F.col(inactive_prob_col), F.lit(1e-12)), F.lit(1 - 1e-12))
        emitted = _sequences(rows, grp, order_col).withColumns({"_e0": F.log(p), "_e1": F.log(1 - p)})
    usable = emitted.filter("_ok").drop(*names, "_ok", inactive_prob_col)
    # A table of the tracks that don't fit into a block: a row for each BLOCK_ROWS rows at most.
    long = df.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= BLOCK_ROWS).drop("_n")
    if long.isEmpty():
        done = _decoded_whole(usable, log_t, log_s)
    else:
        short, parted = (join_by(usable, F.broadcast(long), grp, how) for how in ("left_anti", "left_semi"))
        done = _decoded_whole(short, log_t, log_s).unionByName(_decoded(parted, grp, log_t, log_s))
    if method == "hmm" and min_run_n > 1:
        done = long_runs(done, grp, min_run_n)
    at = idle if method == "hmm" else 0
    is_idle, prob = F.col("_path") == at, F.col("_p0") if at == 0 else 1 - F.col("_p0")
    label = (F.col("_path") + 1) if method == "hmm" else F.when(is_idle, idle + 1).otherwise(2 - idle)
    done = done.select(*keep, F.when(is_idle, "inactive").otherwise("active").alias(state_col), prob.alias(inactive_prob_col), label.cast("int").alias(extra))
    rest = emitted.filter("not _ok").select(*keep, F.lit(None).cast("string").alias(state_col), F.lit(None).cast("double").alias(inactive_prob_col), F.lit(None).cast("int").alias(extra))
    return ActivityStates(done.unionByName(rest), found)
