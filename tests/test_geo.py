"""Readers and sinks of sources and results; experiments' algorithms; demand and overlays at their edges."""

import json

import pytest
from pyspark.sql import functions as F

from headwater.operators import network, shelter
from headwater.sources import geo, inventory


def test_geojson_collection_and_lines(spark, tmp_path):
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2.5]}, "properties": {"a": 1}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": None},
    ]
    (tmp_path / "one.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "many.geojsonl").write_text("\n".join(json.dumps(f) for f in features) + "\n")
    for name in ("one.geojson", "many.geojsonl"):
        got = geo.read_source(spark, "geojson", str(tmp_path / name)).select("kind", F.to_json("coordinates").alias("c"), F.try_variant_get("properties", "$.a", "int").alias("a"))
        assert sorted(map(tuple, got.collect())) == [("LineString", "[[1,2],[3,4]]", None), ("Point", "[1,2.5]", 1)]


def test_refused_sources(spark, tmp_path):
    for fmt, path, error in (("geotiff", "x", geo.UnsupportedFormat), ("csv", None, ValueError), ("csv", "x", ValueError)):
        with pytest.raises(error):
            geo.read_source(spark, fmt, path)
    (tmp_path / "bad.csv").write_text("a\nx\n")
    with pytest.raises(Exception, match="[Mm]alformed|MALFORMED|FAILFAST|parse"):
        geo.read_source(spark, "csv", str(tmp_path / "bad.csv"), "a int").collect()


def test_a_run_replaces_its_own_results_only(spark, tmp_path):
    for rows in ([("E1", 1), ("E2", 2)], [("E2", 3)]):
        geo.write_metrics(spark.createDataFrame(rows, "experiment string, n int"), str(tmp_path / "m"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "m")).select("experiment", "n").collect())) == [("E1", 1), ("E2", 3)]


def test_latex_table(spark):
    df = spark.createDataFrame([("a_b", 1.5), (None, None)], "name string, x double")
    text = geo.latex_table(df)
    assert r"a\_b & 1.5 \\" in text and "-- & -- " in text and text.startswith(r"\begin{tabular}{ll}")
    with pytest.raises(ValueError):
        geo.latex_table(df, 1)


def test_algorithms(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], "src int, dst int, cost double")
    source = spark.createDataFrame([(0,)], "node int")
    for name in ("dijkstra", "a_star"):
        assert sorted(map(tuple, network.route(edges, source, name).collect())) == [(0, 0.0), (1, 1.0), (2, 2.0)]
    for name in ("flow", None, "bfs"):
        with pytest.raises(network.UnknownAlgorithm):
            network.route(edges, source, name)
    pairs = network.reach_pairs(edges, spark.createDataFrame([(0,), (1,)], "node int"), 1)
    assert sorted(map(tuple, pairs.collect())) == [(0, 0, 0), (0, 1, 1), (0, 2, 1), (1, 1, 0), (1, 2, 1)]


def test_overlay_and_flags(spark, monkeypatch):
    links = spark.createDataFrame([(1,), (2,), (2,)], "link int")
    masks = spark.createDataFrame([(1, "S1", 0.1), (1, "S1", 0.5)], "link int, scenario string, depth double")
    scenarios = spark.createDataFrame([("S0", True, None, None), ("S1", False, 0.3, "scenario_based"), ("S2", False, None, None)], "scenario string, baseline boolean, threshold double, provenance string")
    kept = network.passable(network.overlay(links, masks, scenarios.where("scenario <> 'S2'"), ["link"])).select("link", "scenario", "depth_unknown")
    assert sorted(map(tuple, kept.collect())) == [(1, "S0", False), (2, "S0", False), (2, "S0", False), (2, "S1", True), (2, "S1", True)]
    flags = scenarios.select("scenario", network.flags(F.col("threshold"), F.col("provenance"), F.col("baseline")).alias("f")).collect()
    assert {r["scenario"]: r["f"] for r in flags} == {"S0": [], "S1": ["threshold_assumed"], "S2": ["threshold_unknown"]}
    monkeypatch.setattr(network, "MOST_SCENARIOS", 2)
    with pytest.raises(ValueError):
        network.overlay(links, masks, scenarios, ["link"])


def test_demand_and_unknown_requests(spark):
    zones = spark.createDataFrame([("a", 100), ("b", None), ("c", 10)], "zone string, people long")
    cells = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("a", -5), ("b", 1), ("c", 0)], "zone string, w long")
    got = shelter.dasymetric(zones, cells, "zone", "people", "w").select("zone", "w", "demand").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1, 33), ("a", 2, 66), ("a", None, 0), ("a", -5, 0), ("b", 1, None), ("c", 0, None)], key=str)
    requests = spark.createDataFrame([(1, 1, None), (1, 2, 3), (1, 3, 9), (1, 4, 1)], "s int, o int, q long")
    out = shelter.place(requests, spark.createDataFrame([(1, 5)], "s int, cap long"), "s", F.col("q"), F.col("cap"), [F.col("o")], 2)
    assert sorted((r["o"], r["placed"]) for r in out.collect()) == [(1, None), (2, True), (3, False), (4, False)]


def test_stored_of_a_missing_folder(spark, tmp_path):
    (tmp_path / "x.parquet").mkdir()
    assert [tuple(r) for r in inventory.stored(spark, str(tmp_path)).collect()] == [("x.parquet", True)]
    assert inventory.stored(spark, str(tmp_path / "none")).count() == 0
