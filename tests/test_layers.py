import json
import math

import pytest
from helpers import table, track_6

from fieldtrace.functions import geo, shapes
from fieldtrace.operators import cleaning, resources
from fieldtrace.sources import layers

SQUARE = [(149.999, -30.001), (150.001, -30.001), (150.001, -29.999), (149.999, -29.999), (149.999, -30.001)]
HOLE = [(149.99995, -30.00005), (150.00005, -30.00005), (150.00005, -29.99995), (149.99995, -29.99995), (149.99995, -30.00005)]


def wkt(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"


def test_well_known_text():
    assert shapes.from_wkt("POINT (1 2)") == shapes.Shape("point", ((((1.0, 2.0),),),))
    assert shapes.from_wkt("SRID=4326;MULTIPOINT ((1 2), (3 4))") == shapes.from_wkt("multipoint(1 2, 3 4)")
    assert shapes.from_wkt("LINESTRING Z (1 2 9, -3e1 4 9)").parts == ((((1.0, 2.0), (-30.0, 4.0)),),)
    assert len(shapes.from_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.5 5.2, 5.6 5.2, 5.6 5.3, 5.5 5.2)))").parts[1]) == 2
    assert shapes.from_wkt("POLYGON EMPTY").parts == ()
    with pytest.raises(ValueError):
        shapes.from_wkt("CIRCLE (1 2)")


def test_layers_go_back_to_degrees():
    there = shapes.polygon(SQUARE)
    for crs, move in ((3857, geo.mercator_point), (32756, lambda x, y: geo.utm_point(x, y, 56, False))):
        back = shapes.to_degrees(there.moved(move), crs)
        assert all(a == pytest.approx(b, abs=1e-9) for a, b in zip(back.parts[0][0], there.parts[0][0], strict=True))
    with pytest.raises(ValueError):
        shapes.to_degrees(there, 2154)


def test_holes_and_parts(spark):
    df = track_6(spark)
    layer = layers.layer_from_table(spark.createDataFrame([("ring", wkt(SQUARE, HOLE)), (None, None)], "NAME string, geometry string"))
    out = {r.order_col: r.paddock for r in cleaning.gps_clean_spatial(df, layers.paddocks(layer), 0.5, action="flag").data.collect()}
    assert out[0] is None and out[1] == "ring"  # the first fix lies in the hole
    far = shapes.from_wkt("MULTIPOLYGON (((10 10, 11 10, 11 11, 10 10)), ((149.999 -30.001, 150.001 -30.001, 150.001 -29.999, 149.999 -29.999, 149.999 -30.001)))")
    near = resources.gps_resource_distance(df, [resources.Resource("r", (), shape=far)])
    assert {r.resource_distance_m for r in near.collect()} == {0.0}


def test_geojson(spark, tmp_path):
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"Name": "home", "kind": "k"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}, {"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(collection))
    layer = layers.read_geojson(spark, str(tmp_path / "a.geojson"))
    assert [n for n, _ in layers.paddocks(layer)] == ["home"] and layers.resources(layer, "Name", "kind")[0].resource_type == "k"
    with pytest.raises(ValueError):
        layers.paddocks(layer, "missing")
    with pytest.raises(ValueError):
        layers.paddocks([layers.Feature(layer[0].shape, {"Name": " "})])
    got = cleaning.gps_append_paddock_names(track_6(spark), layers.paddocks(layer)).collect()
    assert {r.assigned_paddock for r in got} == {"home"}


def test_buffers_are_metres_on_the_ground(spark):
    # 100 m north and 95 m east of the square at 30 degrees south; in EPSG:3857 metres both would be too far
    north, east = -29.999 + 100 / 110_850, 150.001 + 95 / (111_320 * math.cos(math.radians(30)))
    df = table(spark, [("D", "A", 0, 150.0, north), ("D", "A", 60, east, -30.0), ("D", "A", 120, 150.0, -29.99)])
    at = lambda **more: [r.assigned_paddock for r in cleaning.gps_append_paddock_names(df, [("home", SQUARE)], buffer_m=105, min_prop=0.5, **more).collect()]
    assert at() == ["home"] * 3 and at(metric_crs=3857) == [None] * 3


def test_repeated_deployment_windows(spark):
    twice = spark.createDataFrame([("D1", "2024-01-01", "2024-01-02")] * 2, "deployment_id string, start_datetime string, end_datetime string")
    with pytest.raises(Exception, match="repeat a key"):
        cleaning.gps_clean_errors(track_6(spark), deployment_windows=twice, deployment_groups=["deployment_id"]).data.collect()
