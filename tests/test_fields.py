"""Geometry, projection, grids, as-of joins, margins and link states on small cases."""

import datetime as dt
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from headwater.operators import integrity, network, spatial, temporal
from headwater.sources import geo, grid, shapes
from headwater.streaming import links

RING = "array<struct<x: double, y: double>>"


def meets(a, b, c, d):
    def turn(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    def on(p, q, r):
        return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    t = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    if t[0] * t[1] < 0 and t[2] * t[3] < 0:
        return True
    return any(v == 0 and on(p, q, r) for v, p, q, r in zip(t, (a, a, c, c), (b, b, d, d), (c, d, a, b)))


def brute(link, ring):
    a, b = link[:2], link[2:]
    sides = list(zip(ring, ring[1:] + ring[:1]))
    if any(meets(a, b, p, q) for p, q in sides):
        return True
    inside = False
    for p, q in sides:
        if (p[1] > a[1]) != (q[1] > a[1]) and a[0] < (q[0] - p[0]) * (a[1] - p[1]) / (q[1] - p[1]) + p[0]:
            inside = not inside
    return inside


@pytest.mark.parametrize("cell", [3.0, 11.0, 1000.0])
def test_overlay_equals_all_pairs(spark, cell):
    """Small whole numbers, so that ends, corners and sides often touch; whatever the cell, each pair comes once."""
    rnd = random.Random(5)
    at = lambda m: float(rnd.randint(-m, m))
    rows = [(i, at(15), at(15), 0.0, 0.0) for i in range(120)]
    rows = [(i, x, y, x + at(6), y + at(6)) for i, x, y, _, _ in rows]
    rings = []
    for i in range(25):
        cx, cy, n = at(15), at(15), rnd.randint(3, 7)
        turns = sorted(rnd.random() * 2 * math.pi for _ in range(n))
        rings.append((i, [(cx + round(rnd.randint(1, 7) * math.cos(t)), cy + round(rnd.randint(1, 7) * math.sin(t))) for t in turns]))
    rings += [(100, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)])]  # closed by hand
    a = spark.createDataFrame([*rows, (900, None, 1.0, 2.0, 3.0), (901, float("nan"), 1.0, 2.0, 3.0)], "link long, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame([*rings, (800, None), (801, []), (802, [(1.0, 1.0), (2.0, 2.0)]), (803, [(1.0, None), (2.0, 2.0), (3.0, 0.0)])], f"area long, ring {RING}")
    out = spatial.overlay_polygons(a, b, cell)
    want = sorted((r[0], p[0]) for r in rows for p in rings if brute(r[1:], [tuple(c) for c in p[1]]))
    assert sorted((r["link"], r["area"]) for r in out.collect()) == want and len(want) > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlay_feeds_the_scenarios(spark):
    """A link without a mask is unknown in a flood, one that two polygons meet has the greater depth."""
    a = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0), (2, 50.0, 50.0, 51.0, 50.0), (3, 1.0, 1.0, 1.0, 1.0)], "link long, x1 double, y1 double, x2 double, y2 double")
    square = lambda x, s: [(x, -s), (x + s, -s), (x + s, s), (x, s)]
    b = spark.createDataFrame([("S1", 0.2, square(0.0, 2.0)), ("S1", 0.7, square(3.0, 2.0)), ("S2", 0.1, square(0.0, 2.0))], f"scenario string, depth double, ring {RING}")
    sc = spark.createDataFrame([("S0", True, None), ("S1", False, 0.5), ("S2", False, 0.5)], "scenario string, baseline boolean, threshold double")
    over = network.overlay(a.select("link"), spatial.flood_depths(a, b, ["link"], 10.0), sc, ["link"])
    got = {(r["link"], r["scenario"]): r["depth"] for r in over.collect()}
    assert len(got) == 9 and got[1, "S1"] == 0.7 and got[1, "S2"] == 0.1 and got[3, "S1"] == 0.2 and got[2, "S1"] is None and got[1, "S0"] is None
    left = {(r["link"], r["scenario"]): r["depth_unknown"] for r in network.passable(over).collect()}
    assert (1, "S1") not in left and left[2, "S1"] and not left[2, "S0"] and not left[3, "S2"]


def test_errors_of_the_overlay(spark):
    a = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 2)], "x1 double, y1 double, x2 double, y2 double, id int")
    b = spark.createDataFrame([([(0.0, 0.0)], 1)], f"ring {RING}, id int")
    with pytest.raises(ValueError, match="both sides"):
        spatial.overlay_polygons(a, b, 1.0)
    with pytest.raises(ValueError, match="cell"):
        spatial.overlay_polygons(a, b.drop("id"), 0.0)


def test_known_points_and_round_trips(spark):
    """The zone's meridian at the equator, published places, and the whole zone back to a billionth of a degree, on both hemispheres."""
    rows = [(-123.0, 0.0), (-122.0, 37.5), (-123.0, 45.0), *[(-127 + x / 3, y * 0.9) for x in range(24) for y in range(-90, 91, 9)], (None, 1.0), (1.0, None), (-123.0, 91.0)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumns({"x": F.col("lon"), "y": F.col("lat")})
    for zone, north in (("EPSG:32610", 0.0), ("EPSG:32710", 10_000_000.0)):
        there = spatial.reproject(df, "x", "y", "EPSG:4326", zone)
        back = spatial.reproject(there.withColumns({"u": F.col("x"), "v": F.col("y")}), "u", "v", zone, "EPSG:4326").collect()
        assert (back[0]["x"], back[0]["y"]) == (500_000.0, north)
        assert all(abs(r["u"] - r["lon"]) < 1e-9 and abs(r["v"] - r["lat"]) < 1e-9 for r in back[:-3])
        assert all(r["x"] is None or r["y"] is None for r in back[-3:])
        # A degree of latitude on the meridian at 45 N: the scale on the meridian times its length of arc from the equator.
        assert abs(back[2]["y"] - north - 0.9996 * 4_984_944.378) < 0.01
    assert spatial.reproject(df, "x", "y", "EPSG:32610", "EPSG:32610") is df
    for crs in ("EPSG:3310", "EPSG:32661", "WGS84", "EPSG:32600"):
        with pytest.raises(spatial.UnknownReferenceSystem):
            spatial.reproject(df, "x", "y", "EPSG:4326", crs)


def test_grids_in_parts(spark, tmp_path):
    """A file that Spark reads in many parts has the same rows; tiles stand where they belong; cells without data are null."""
    cells = [(r, c, float(r * 100 + c)) for r in range(37) for c in range(9) if (r + c) % 5]
    df = spark.createDataFrame([*cells, (3, 3, None)], "row long, col long, value double")
    grid.write_grid(df, str(tmp_path / "g"), 9, 37, (10.0, -5.0), 0.5, tall=10)
    text = (tmp_path / "whole.asc")
    held = {(r, c): v for r, c, v in cells}
    lines = [" ".join(str(held.get((r, c), -9999.0)) for c in range(9)) for r in range(37)]
    text.write_text("NCOLS 9\nnrows 37\nxllcorner 10\nyllcorner -5\ncellsize 0.5\nNODATA_value -9999\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        whole = grid.read_grid(spark, str(text))
        assert whole.rdd.getNumPartitions() > 0
        got = {(r["row"], r["col"]): (r["x"], r["y"], r["value"]) for r in whole.collect()}
        tiles = {(r["x"], r["y"]): r["value"] for r in grid.read_grid(spark, str(tmp_path / "g" / "*")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(r, c): (10 + (c + 0.5) * 0.5, -5 + (37 - r - 0.5) * 0.5, held.get((r, c))) for r in range(37) for c in range(9)}
    assert tiles == {(x, y): v for x, y, v in got.values()}
    points = spark.createDataFrame([(1, 10.0, -5.0), (2, 10.26, 13.49), (3, 9.9, 0.0), (4, None, 1.0)], "id int, px double, py double")
    at = {r["id"]: r["value"] for r in grid.sample(points, grid.read_grid(spark, str(text)), "px", "py", (10.0, -5.0), 0.5).collect()}
    assert at == {1: held.get((36, 0)), 2: held.get((0, 0)), 3: None, 4: None}


def test_bad_grids(spark, tmp_path):
    (tmp_path / "short.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\n1 2 3\n4 5\n")
    (tmp_path / "tall.asc").write_text("ncols 1\nnrows 1\nxllcorner 0\nyllcorner 0\ncellsize 1\n1\n2\n")
    (tmp_path / "headless.asc").write_text("ncols 1\nnrows 1\nxllcorner 0\ncellsize 1\n1\n")
    for name in ("short", "tall", "headless"):
        with pytest.raises(Exception, match="does not fit the header"):
            grid.read_grid(spark, str(tmp_path / f"{name}.asc")).collect()
    with pytest.raises(grid.BadGrid):
        grid.write_grid(spark.createDataFrame([], "row long, col long, value double"), str(tmp_path / "x"), 0, 1, (0, 0), 1)


@pytest.mark.parametrize("blocks", [1, 7])
def test_as_of(spark, blocks):
    """A hot key, ties in time, events before any observation, nulls; with one range and several."""
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    when = lambda: rnd.choice([None, *[start + dt.timedelta(minutes=m) for m in range(40)]])
    key = lambda: rnd.choice([None, "a", "a", "a", "b", "c"])
    events = [(i, key(), when()) for i in range(150)]
    seen = [(key(), when(), rnd.choice([None, 1.0, 2.0, 3.0])) for _ in range(90)]
    out = temporal.as_of(spark.createDataFrame(events, "id long, k string, ts timestamp"), spark.createDataFrame(seen, "k string, ts timestamp, v double"), ["k"], "ts", ["v"], blocks)

    def want(k, t):
        own = [(u, v is not None, v or 0.0, v) for j, u, v in seen if j == k and k is not None and u is not None and t is not None and u <= t]
        return (max(own)[0], max(own)[3]) if own else (None, None)

    assert sorted((r["id"], r["ts_seen"], r["v"]) for r in out.collect()) == sorted((i, *want(k, t)) for i, k, t in events)
    with pytest.raises(ValueError, match="columns of the events"):
        temporal.as_of(spark.createDataFrame(events, "id long, k string, ts timestamp"), spark.createDataFrame(events, "id long, k string, ts timestamp"), ["k"], "ts", ["id"])


def test_margins_tell_sums_from_nulls(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", "p", 2), (None, "p", 4)], "a string, b string, n long")
    out = integrity.margins(df, ["a", "b"], [["a", "b"], ["a"], []], [F.sum("n").alias("n")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("x", None, 0, 1), ("x", "p", 0, 2), (None, "p", 0, 4), ("x", None, 1, 3), (None, None, 1, 4), (None, None, 3, 7)], key=str)


def test_link_states_over_batches(spark, tmp_path):
    """State goes from batch to batch; a late row is dropped; a link that is silent too long expires and starts anew."""
    links.state_store(spark)
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [(1, hour(0), 0.5), (1, hour(1), 0.2), (2, hour(1), None), (None, hour(1), 9.0), (3, None, 1.0)],
        [(1, hour(3), 0.9), (9, hour(30), 0.1)],
        [(2, hour(2), 7.0), (9, hour(31), 0.3)],  # link 2: behind the watermark
        [(1, hour(40), 0.4)],
    ]
    query = None
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = []
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, "link long, ts timestamp, depth double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("link long, ts timestamp, depth double").parquet(str(tmp_path / "in"))
            write = links.link_states(stream, "2 hours", 20 * 3600).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
            query = write.foreachBatch(lambda df, n: rows.extend(tuple(r) for r in df.collect())).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert (1, hour(1), 0.2, 2, False) in rows and (2, hour(1), None, 1, False) in rows
    assert (1, hour(3), 0.9, 3, False) in rows and (1, hour(3), 0.9, 3, True) in rows and (2, hour(1), None, 1, True) in rows
    assert not any(r[2] == 7.0 for r in rows) and not any(r[0] in (None, 3) for r in rows)
    assert (9, hour(31), 0.3, 2, False) in rows and (1, hour(40), 0.4, 1, False) in rows


SHAPES = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]], [], [[(1.0, 1.0), (2.0, 1.5)], [(5.0, 5.0), (6.0, 7.0), (8.0, 9.0)]]]


def test_shapefiles(spark, tmp_path):
    """Geometries of several parts, null shapes, attributes of each kind; heights are left out; two files keep apart."""
    rows = [(7, "Zürich", 1.5, True, "2024-02-29"), (None, "", None, None, None), (-3, "x", -2.0, False, None)]
    fields = [("id", "N", 8), ("name", "C", 12), ("depth", "F", 10), ("wet", "L", 1), ("day", "D", 8)]
    (tmp_path / "roads.shp").write_bytes(shapes.pack_shapes("PolyLine", SHAPES))
    (tmp_path / "roads.dbf").write_bytes(shapes.pack_attributes(fields, rows))
    (tmp_path / "points.SHP").write_bytes(shapes.pack_shapes("Point", [[[(1.0, 2.0)]], [[(3.0, 4.0)]]]))
    (tmp_path / "readme.txt").write_text("no shape")
    got = {(r["stem"].rsplit("/", 1)[-1], r["number"]): r for r in geo.read_source(spark, "shapefile", str(tmp_path)).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {("roads", 1): "PolyLine", ("roads", 2): "Null", ("roads", 3): "PolyLine", ("points", 1): "Point", ("points", 2): "Point"}
    assert [[(p["x"], p["y"]) for p in part] for part in got["roads", 3]["parts"]] == SHAPES[2] and got["roads", 2]["parts"] == []
    assert [r.toPython() for r in (got["roads", 1]["properties"], got["roads", 2]["properties"])] == [
        {"id": 7, "name": "Zürich", "depth": 1.5, "wet": True, "day": "2024-02-29"}, {"id": None, "name": None, "depth": None, "wet": None, "day": None}
    ]
    assert got["points", 2]["properties"] is None
    flat = shapes.pack_shapes("Polygon", SHAPES[:1])
    with_heights = flat[:108] + struct.pack("<i", 15) + flat[112:] + struct.pack("<5d", 0, 9, 1, 2, 3)
    with_heights = with_heights[:24] + struct.pack(">i", len(with_heights) // 2) + with_heights[28:104] + struct.pack(">i", (len(with_heights) - 108) // 2) + with_heights[108:]
    assert [(n, k, [p.tolist() for p in parts]) for n, k, parts in shapes.records(with_heights)] == [(1, "Polygon", [[[0.0, 0.0], [4.0, 0.0], [4.0, 3.0]]])]


@pytest.mark.parametrize("content", [b"", b"x" * 200, shapes.pack_shapes("Point", [[[(1.0, 2.0)]]])[:-4]])
def test_bad_shapefiles(content):
    with pytest.raises(shapes.BadShapefile):
        list(shapes.records(content))


def test_bad_attributes():
    good = shapes.pack_attributes([("a", "C", 3)], [("x",), ("y",)])
    assert [v for _, v in shapes.attributes(good)] == [{"a": "x"}, {"a": "y"}]
    deleted = good[:65] + b"*" + good[66:]
    assert [v for _, v in shapes.attributes(deleted)] == [{}, {"a": "y"}]
    for content in (b"", good[:-5]):
        with pytest.raises(shapes.BadShapefile):
            list(shapes.attributes(content))
    with pytest.raises(shapes.BadShapefile, match="wider"):
        shapes.pack_attributes([("a", "C", 1)], [("xy",)])


def test_polygons_are_not_broadcast(spark):
    """Their file is small, their copies by cell are not."""
    links = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0)], "k long, x1 double, y1 double, x2 double, y2 double")
    ring = spark.createDataFrame([([(1.0, 1.0), (5.0, 1.0), (5.0, 5.0)],)], "ring array<struct<x: double, y: double>>")
    got = spatial.overlay_polygons(links, ring, 2.0)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 1
