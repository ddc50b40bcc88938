"""Layers as tables against the literal plans of small layers, and against brute force."""

import math
import random

import pytest
from helpers import table
from pyspark.sql import functions as F

from fieldtrace.functions import geo
from fieldtrace.operators import cleaning, layer_index, resources
from fieldtrace.plans.layers import PADDOCKS
from fieldtrace.sources import layers


def rings(r, k):
    """A random polygon around a random place: star-shaped, with a hole or a second part now and then."""
    x, y, size = 150 + r.random() * 0.02, -30 + r.random() * 0.02, 10 ** r.uniform(-4.5, -2.3)
    star = lambda f, n: [(x + f * size * r.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + f * size * r.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    outer = star(1, r.choice([3, 5, 40, 300]))
    parts = [[outer, [(x + 0.1 * size * dx, y + 0.1 * size * dy) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]] if k % 3 == 0 else [outer]]
    return [*parts, [[(x + 2 * size, y), (x + 3 * size, y), (x + 3 * size, y + size)]]] if k % 4 == 0 else parts


def text(parts):
    ring = lambda v: "(" + ", ".join(f"{a!r} {b!r}" for a, b in [*v, v[0]]) + ")"
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(ring, p)) + ")" for p in parts) + ")"


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(7)
    shapes = [rings(r, k) for k in range(25)]
    layer = spark.createDataFrame([(k, f"p{k}", text(p)) for k, p in enumerate(shapes)] + [(99, "none", None), (98, "empty", "POLYGON EMPTY")], "no long, name string, geometry string")
    corners = [v for p in shapes[:9] for part in p for ring in part for v in ring[:6]]
    points = [(150 + r.random() * 0.02, -30 + r.random() * 0.02) for _ in range(500)] + corners * 2
    return layer, table(spark, [("D", f"S{i % 7}", 60 * i, x, y) for i, (x, y) in enumerate(points)])


def segment(x, y, a, b):
    (x1, y1), (x2, y2) = a, b
    span = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / span, 0), 1) if span else 0
    return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def within(x, y, parts, buffer):
    """Whether a polygon holds a point, or has it within a distance, by a loop over all edges."""
    for part in parts:
        odd = False
        for ring in part:
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
                odd ^= (y1 > y) != (y2 > y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
                if abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) <= 1e-15 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) or buffer and segment(x, y, (x1, y1), (x2, y2)) <= buffer:
                    return True
        if odd:
            return True
    return False


@pytest.mark.parametrize("buffer_m", [0.0, 40.0])
def test_polygons_of_a_table_equal_a_loop(some, buffer_m):
    layer, df = some
    r = random.Random(7)
    move = (lambda p: geo.mercator_point(*p)) if buffer_m else tuple
    shapes = [[[list(map(move, ring)) for ring in part] for part in rings(r, k)] for k in range(25)]
    got = {r.order_col: r for r in cleaning.with_first_polygon(df, layers.paddock_table(layer, "no", "name"), buffer_m, 3857).collect()}
    want = {k: next((f"p{i}" for i, s in enumerate(shapes) if within(*move((g.lon, g.lat)), s, buffer_m)), None) for k, g in got.items()}
    assert {k: g._p for k, g in got.items()} == want and len(set(want.values())) > 8 and None in want.values()


def test_a_table_equals_a_plan_on_small_layers(spark):
    r = random.Random(3)
    df = table(spark, [("D", "S", 60 * i, 149.995 + r.random() * 0.03, -30.02 + r.random() * 0.025) for i in range(300)])
    layer = spark.createDataFrame([(k, n, text([[ring]])) for k, (n, ring) in enumerate(PADDOCKS)], "no long, name string, geometry string")
    for buffer_m in (0.0, 50.0):
        small = {x.order_col: x._p for x in cleaning.with_first_polygon(df, PADDOCKS, buffer_m, 3857).collect()}
        assert {x.order_col: x._p for x in cleaning.with_first_polygon(df, layers.paddock_table(layer, "no", "name"), buffer_m, 3857).collect()} == small


def test_nearest_of_a_table_equals_that_of_a_plan(spark, some):
    layer, df = some
    lines = [(200, "track", "LINESTRING (150.001 -29.999, 150.019 -29.981)"), (201, "pump", "POINT (150.03 -30.01)"), (202, "pumps", "MULTIPOINT (149.9 -30.2, 150.001 -30.0005)")]
    areas = [(k, n, text([[ring]]), "area") for k, (n, ring) in enumerate(PADDOCKS[2:])]
    both = spark.createDataFrame(areas + [(*x, None) for x in lines], "no long, name string, geometry string, kind string")
    far = table(spark, [("D", "far", 60 * i, 150 + 10.0**-i, -30 - 30 * 10.0**-i) for i in range(5)]).withColumn("order_col", F.col("order_col") + 10_000)
    fixes = df.unionByName(far)
    small = layers.resources(layers.layer_from_table(both.orderBy("no")), "name", "kind")
    want = {r.order_col: r for r in resources.gps_resource_distance(fixes, small, 3857).collect()}
    got = {r.order_col: r for r in resources.gps_resource_distance(fixes, layers.resource_table(both, "no", "name", "kind"), 3857).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].resource_distance_m == pytest.approx(r.resource_distance_m, abs=1e-6)
        assert (got[k].nearest_resource_id, got[k].nearest_resource_type) == (r.nearest_resource_id, r.nearest_resource_type), k


def test_an_empty_layer_holds_nothing(spark, some):
    layer, df = some
    none = layers.paddock_table(layer.limit(0), "no", "name")
    assert cleaning.gps_clean_spatial(df, none, action="flag").data.filter("is_outside_boundary").count() == df.count()
    assert resources.gps_resource_distance(df, none, 3857).filter("nearest_resource_id is not null").count() == 0


def test_cells_of_a_part_stay_few():
    import numpy as np

    for n in (4, 3000):
        t = np.linspace(0, 2 * np.pi, n, endpoint=False)
        ring = tuple(zip((150 + 0.3 * np.cos(t)).tolist(), (-30 + 0.01 * np.sin(t)).tolist(), strict=True))
        level, cells = layer_index._cover(layer_index._edges((ring,)), 0)
        assert len(cells) <= 110 and cells[:, 2].sum() >= 0


def test_cells_behind_an_earlier_polygon_go(spark):
    wide = [0.01 + 2e-4 * (k * 37 % 100) for k in range(100)]
    box = lambda w: f"POLYGON (({150 - w} {-30 - w}, {150 + w} {-30 - w}, {150 + w} {-30 + w}, {150 - w} {-30 + w}))"
    layer = layers.paddock_table(spark.createDataFrame([(k, f"p{k}", box(w)) for k, w in enumerate(wide)], "no long, name string, geometry string"), "no", "name")
    cells, _ = layer_index._polygon_tables(layer, 4326, 0)
    kept = layer_index._unhidden(cells, [r.level for r in cells.select("level").distinct().collect()])
    assert kept.filter("inside").groupBy("level", "cx", "cy").count().filter("count > 1").isEmpty()
    assert kept.count() < cells.count() / 2
    ways = (0, 0.00999, 0.01001, 0.01036, 0.0155, 0.0199, 0.0297, 0.0299)
    df = table(spark, [("D", "S", 60 * i, 150 + x, -30) for i, x in enumerate(ways)])
    got = {r.order_col: r._p for r in cleaning.with_first_polygon(df, layer, 0, 3857).collect()}
    assert got == {i: next((f"p{k}" for k, w in enumerate(wide) if x <= w), None) for i, x in enumerate(ways)}


def test_points_far_from_a_cluster_meet_it_in_parts(spark, monkeypatch):
    """No row for a pair of a point and a feature: a round's rows are those of points, in parts of a few."""
    r = random.Random(11)
    monkeypatch.setattr(layer_index, "CELL_POINTS", 40)
    monkeypatch.setattr(layer_index, "CELL_PIECES", 30)
    monkeypatch.setattr(layer_index, "_BLOCK", 8)
    at = [(r.random() * 5, r.random() * 5) for _ in range(200)]
    features = at + at[:40] + [(3000.0, -500.0)]
    points = [(100 + r.random() * 300, 100 + r.random() * 300) for _ in range(300)] + at[:20]
    layer = layer_index.LayerTable(spark.createDataFrame([(k, f"r{k}", None, f"POINT ({x!r} {y!r})") for k, (x, y) in enumerate(features)], "layer_no long, name string, kind string, geometry string"), 3857)
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "k long, x double, y double")
    found = layer_index.with_nearest(df, F.col("x"), F.col("y"), layer, 3857).collect()
    want = {k: min((math.hypot(x - a, y - b), no) for no, (a, b) in enumerate(features)) for k, (x, y) in enumerate(points)}
    assert len(found) == len(points)
    for row in found:
        assert row._d == pytest.approx(want[row.k][0], abs=1e-6) and row._name == f"r{want[row.k][1]}"


def test_many_polygons_with_edges_in_a_cell_meet_its_points_without_a_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(layer_index, "CELL_POINTS", 20)
    r = random.Random(5)
    wide = [[0.01 * (1 - 0.05 * r.random()) for _ in range(4)] for _ in range(150)]
    box = lambda w: f"POLYGON (({150 - w[0]!r} {-30 - w[1]!r}, {150 + w[2]!r} {-30 - w[1]!r}, {150 + w[2]!r} {-30 + w[3]!r}, {150 - w[0]!r} {-30 + w[3]!r}))"
    layer = layers.paddock_table(spark.createDataFrame([(k, f"p{k}", box(w)) for k, w in enumerate(wide)], "no long, name string, geometry string"), "no", "name")
    points = [(150 + 0.0101 * r.uniform(-1, 1), -30 + 0.0101 * r.choice([-1, 1]) * r.uniform(0.9, 1)) for _ in range(400)]
    found = cleaning.with_first_polygon(table(spark, [("D", "S", 60 * i, *p) for i, p in enumerate(points)]), layer, 0, 3857)
    # A join with bands of edges made a row for each point and polygon of a cell.
    assert "band" not in found._jdf.queryExecution().toString()
    want = {i: next((f"p{k}" for k, (a, b, c, d) in enumerate(wide) if 150 - a <= x <= 150 + c and -30 - b <= y <= -30 + d), None) for i, (x, y) in enumerate(points)}
    assert {g.order_col: g._p for g in found.collect()} == want and len(set(want.values())) > 8 and None in want.values()


@pytest.mark.parametrize("pairs, few", [(7, 3), (1000, 64), (1_048_576, 64)])
@pytest.mark.parametrize("buffer", [0.0, 3e-4])
def test_the_first_polygon_is_found_in_pieces(monkeypatch, pairs, few, buffer):
    import numpy as np

    monkeypatch.setattr(layer_index, "_PAIRS", pairs)
    monkeypatch.setattr(layer_index, "_FEW_EDGES", few)
    r = random.Random(8)
    shapes = [rings(r, 3 * k)[:1] for k in range(1, 24) if k % 4]
    edges = [layer_index._edges(tuple(map(tuple, s[0]))) for s in shapes]
    points = np.array([(150 + r.random() * 0.02, -30 + r.random() * 0.02) for _ in range(150)] + [v for s in shapes for v in s[0][0][:3]])
    first, last = (np.array(v) for v in zip(*[sorted((r.randrange(len(shapes) + 1), r.randrange(len(shapes) + 1))) for _ in points], strict=True))
    got = layer_index._first_of(*points.T, first, last, np.zeros(len(shapes), bool), np.concatenate(edges), np.append(0, np.cumsum([len(e) for e in edges])), buffer)
    want = [next((k for k in range(a, b) if within(x, y, shapes[k], buffer)), -1) for (x, y), a, b in zip(points.tolist(), first, last, strict=True)]
    assert got.tolist() == want and len(set(want)) > 8
