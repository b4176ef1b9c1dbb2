"""Validation, inventory, command line and rules: each documented behaviour, gaps included."""

import copy

import pytest
import yaml
from pyspark.sql import functions as F

from headwater import cli
from headwater.functions import rules
from headwater.operators import integrity, network, shelter
from headwater.sources import config_files as cf
from headwater.sources import inventory

SHELTERS = {"schema_version": "1.0", "shelters": [{"id": "T1", "lon": -122.25, "accessible": True, "capacity": {"value": None, "provenance": None}}]}
SCENARIOS = {"schema_version": "1.0", "scenarios": [{"id": "a", "label": "b", "provenance": "observed"}]}
CONFIGS = cli.Path(__file__).resolve().parents[1] / "configs"


def broken(name, doc):
    return [(v.path, v.rule) for v in cf.check(name, doc)[1]]


def test_valid_municipality_and_defaults():
    doc = {"schema_version": "1.0", "municipality": {"name": "N", "population": {"value": 10000, "provenance": "observed"}, "extra": 1}}
    out, found = cf.check("municipality", doc)
    assert not found and out["municipality"]["population"]["value"] == 10000
    assert "extra" not in out["municipality"]
    assert out["municipality"]["area_km2"] == {"value": None, "provenance": None, "source": None}


def test_null_capacity_stays_null():
    out, found = cf.check("shelters", SHELTERS)
    assert not found and out["shelters"][0]["capacity"]["value"] is None and out["shelters"][0]["accessible"] is True


def test_bad_provenance_is_located():
    doc = {"schema_version": "1.0", "municipality": {"area_km2": {"value": 1.0, "provenance": "guessed"}}}
    assert broken("municipality", doc) == [("municipality.area_km2.provenance", "enum")]


@pytest.mark.parametrize("version, rule", [("2.0", "version"), (1.0, "type"), (None, "type")])
def test_version(version, rule):
    assert broken("scenarios", SCENARIOS | {"schema_version": version}) == [("schema_version", rule)]


def test_missing_version_and_payload_are_reported_together():
    assert broken("scenarios", {}) == [("schema_version", "required"), ("scenarios", "required")]
    assert broken("scenarios", None) == [("", "type")]


@pytest.mark.parametrize("kind, value, want", [
    ("int", "42", 42), ("int", 42.0, 42), ("int", True, 1), ("float", "1.5", 1.5), ("float", True, 1.0), ("bool", "yes", True), ("bool", 1, True),
    ("scalar", 5, 5), ("scalar", "5", "5"), ("scalar", True, 1.0),
])
def test_lenient_casts(kind, value, want):
    got = cf._coerce(kind, value)
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize("kind, value", [("int", 42.5), ("int", "x"), ("int", 2**63), ("bool", "2"), ("str", 7), ("prov", "Observed"), ("float", []), ("scalar", {})])
def test_refused_casts(kind, value):
    assert cf._coerce(kind, value) is cf._BAD


def test_required_seed_and_explicit_null_records():
    base = {"id": "e", "label": "l", "seed": 42, "provenance": "observed"}
    doc = lambda **kw: {"schema_version": "1.0", "experiments": [{k: v for k, v in (base | kw).items() if v != "absent"}]}
    assert cf.check("experiments", doc())[0]["experiments"][0]["parameters"] == {}
    assert broken("experiments", doc(seed="absent")) == [("experiments[0].seed", "required")]
    assert broken("experiments", doc(provenance=None)) == [("experiments[0].provenance", "enum")]
    assert broken("experiments", doc(parameters=None)) == [("experiments[0].parameters", "type")]
    doc = copy.deepcopy(SHELTERS)
    doc["shelters"][0]["capacity"] = None
    assert broken("shelters", doc) == [("shelters[0].capacity", "type")]


def test_eligibility_rules_are_not_validated_but_must_be_a_map():
    assert not broken("eligibility", {"schema_version": "1.0", "eligibility": {"x": {"provenance": "guessed"}}})
    assert broken("eligibility", {"schema_version": "1.0", "eligibility": []}) == [("eligibility", "type")]


def test_accepted_gaps():
    """No uniqueness, ranges or references in the loader: these are separate checks."""
    two = {"schema_version": "1.0", "shelters": [{"id": "A", "lon": 999}, {"id": "A", "capacity": {"value": -1}}]}
    assert not broken("shelters", two)


def test_files(spark, tmp_path):
    docs = cf.load_all(CONFIGS)
    assert [len(docs[k][k]) for k in ("scenarios", "experiments", "shelters")] == [4, 1, 1]
    frames = cf.frames(spark, docs)
    assert frames["data_sources"].count() == 4
    assert frames["shelters"].select("capacity.value").first()[0] is None
    assert frames["experiments"].select("seed").first()[0] == 42
    assert cf.violation_frame(spark, CONFIGS).count() == 0
    with pytest.raises(FileNotFoundError):
        cf.load_all(tmp_path)
    (tmp_path / "scenarios.yaml").write_text("a: 1\n---\nb: 2\n")
    got = {(r["file"], r["rule"]) for r in cf.violation_frame(spark, tmp_path).collect()}
    assert ("scenarios.yaml", "syntax") in got and ("shelters.yaml", "missing") in got
    (tmp_path / "shelters.yaml").write_text(yaml.safe_dump({"schema_version": "9", "shelters": None}))
    with pytest.raises(cf.ConfigInvalid, match="version"):
        cf.load("shelters", tmp_path / "shelters.yaml")


def test_inventory(spark, tmp_path, capsys):
    (tmp_path / "raw").mkdir()
    (tmp_path / "interim").mkdir()
    (tmp_path / "interim/.gitkeep").touch()
    (tmp_path / "manifests").mkdir()
    (tmp_path / "manifests/a.yaml").touch()
    (tmp_path / "manifests/b.yml").touch()
    per = inventory.counts(inventory.listing(spark, tmp_path))
    assert {r["directory"]: (r["present"], r["n"]) for r in per.collect()} == {"raw": (True, 0), "interim": (True, 0), "processed": (False, 0), "manifests": (True, 1)}
    assert inventory.all_empty(per).first()[0]
    assert cli.inspect_data(tmp_path, spark) == 0
    assert "No case-study data" in capsys.readouterr().out
    (tmp_path / "raw/sub").mkdir()
    assert not inventory.all_empty(inventory.counts(inventory.listing(spark, tmp_path))).first()[0]


def test_manifest_report(spark, tmp_path):
    import hashlib

    (tmp_path / "a.csv").write_bytes(b"x")
    (tmp_path / "b.csv").write_bytes(b"y")
    m = spark.createDataFrame([("a.csv", hashlib.sha256(b"x").hexdigest().upper()), ("b.csv", "00"), ("c.csv", None)], "filename string, checksum_sha256 string")
    got = {r["filename"]: r["status"] for r in inventory.manifest_report(spark, m, f"{tmp_path}/*.csv").collect()}
    assert got == {"a.csv": "ok", "b.csv": "differs", "c.csv": "absent"}


def test_command_line(capsys, tmp_path):
    assert cli.main(["validate-config"]) == 0
    assert "scenarios=4  experiments=1  shelters=1" in capsys.readouterr().out
    assert cli.main(["validate-config", "--configs-dir", str(tmp_path / "no")]) == 1
    for name in cli.MISSING:
        assert cli.main([name]) == 1
    assert cli.main(["run-experiment", "E1"]) == 1
    with pytest.raises(AttributeError):
        cli.configure_logging("LOUD")
    with pytest.raises(SystemExit) as e:
        cli.main(["--help"])
    assert e.value.code == 0


def test_rules(spark):
    df = spark.createDataFrame([("a", "1.0", "observed", "7"), ("b", None, "x", "q"), ("c", "2", None, None)], "k string, v string, p string, raw string")
    found = rules.violations(df, F.col("k"), {
        "version": (rules.version_broken(F.col("v")), F.col("v"), "1.0"),
        "enum": (rules.enum_broken(F.col("p")), F.col("p"), "a label"),
        "required": (rules.enum_broken(F.col("p"), required=True), F.col("p"), "a label"),
        "cast": (rules.cast_broken(F.col("raw"), "bigint"), F.col("raw"), "bigint"),
    })
    assert sorted((r["key"], r["rule"]) for r in found.collect()) == [("b", "cast"), ("b", "enum"), ("b", "required"), ("b", "version"), ("c", "required"), ("c", "version")]


def test_unknown_threshold_is_refused_and_unknown_depth_flagged(spark):
    bad = spark.createDataFrame([("S1", False, None)], "scenario string, baseline boolean, threshold double")
    with pytest.raises(network.MissingThreshold, match="S1"):
        network.checked_scenarios(bad)
    sc = spark.createDataFrame([("S0", True, None), ("S1", False, 0.5)], "scenario string, baseline boolean, threshold double")
    links = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, None)], "id int, depth double")
    got = sorted((r["scenario"], r["id"], r["depth_unknown"]) for r in network.passable_links(links, sc, F.col("depth")).collect())
    assert got == [("S0", 1, False), ("S0", 2, False), ("S0", 3, False), ("S1", 2, False), ("S1", 3, True)]


def test_paths(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0), (1, 0, 1.0), (3, 4, 1.0)], "src int, dst int, cost double")
    start = spark.createDataFrame([(0,)], "node int")
    assert sorted(map(tuple, network.reach(e, start, 9).collect())) == [(0, 0), (1, 1), (2, 1)]
    assert sorted(map(tuple, network.cheapest_paths(e, start).collect())) == [(0, 0.0), (1, 2.0), (2, 1.0)]
    with pytest.raises(ValueError):
        network.cheapest_paths(spark.createDataFrame([(0, 1, -1.0)], "src int, dst int, cost double"), start)


def test_placement_of_a_hot_shelter(spark):
    r = spark.range(200).selectExpr("id", "if(id % 10 < 8, 'hot', 'cold') as s", "1L as q")
    s = spark.createDataFrame([("hot", 50), ("cold", None)], "s string, cap long")
    got = shelter.place(r, s, "s", F.col("q"), F.col("cap"), [F.col("id")], blocks=7)
    hot = sorted(x["id"] for x in got.where("s = 'hot' and placed").collect())
    assert hot == sorted(i for i in range(200) if i % 10 < 8)[:50]
    assert got.where("s = 'cold' and placed and uncapacitated").count() == 40


def test_nulls_in_eligibility_and_integrity(spark):
    r = spark.createDataFrame([(1, True, False), (2, False, True), (3, False, False)], "id int, needs boolean, pet boolean").selectExpr("*", "1 as zone")
    s = spark.createDataFrame([(10, None), (11, True)], "sid int, acc boolean").selectExpr("*", "1 as zone")
    got = shelter.eligible_pairs(r, s, ["zone"], F.col("needs"), F.col("acc"), F.col("pet"), F.lit(False))
    assert sorted((x["id"], x["sid"]) for x in got.collect()) == [(1, 11), (3, 10), (3, 11)]
    c = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    assert [x[0] for x in integrity.dangling(c, "k", c.where("k = 1"), "k").collect()] == [2]
    assert integrity.clip(spark.range(5).selectExpr("id", "id as y"), "id", "y", (1.0, None, None, 3.0)).count() == 3
    a, b = (integrity.seeded_sample(spark.range(100).repartition(n), "id", 1, 5).collect() for n in (1, 7))
    assert a == b


def test_streaming_links(spark, tmp_path):

    spark.range(4).selectExpr("id", "id / 4.0D as depth").write.parquet(str(tmp_path / "in"))
    sc = spark.createDataFrame([("S1", False, 0.5)], "scenario string, baseline boolean, threshold double")
    stream = spark.readStream.schema("id long, depth double").parquet(str(tmp_path / "in"))
    q = network.passable_links(stream, sc, F.col("depth")).writeStream.format("memory").queryName("links").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.table("links").collect()) == [0, 1]
