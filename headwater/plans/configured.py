"""Queries that run the inventory, overlays, experiments, sinks and readers themselves, and the same in SQL.

Scenarios and experiments come from documents made of the ``region`` table, which has 5 rows at every scale, through YAML text.
"""

from __future__ import annotations

import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators import network, shelter
from headwater.plans.analogues import edges_of
from headwater.session import TABLES, remove, set_checkpoint_folder, table
from headwater.sources import config_files, geo, inventory


def _loaded(spark: SparkSession, name: str, body) -> DataFrame:
    """The frame of one document that is written as YAML and read back."""
    payload = config_files.FILES[name][0]
    out, found = config_files.check(name, config_files.parse_yaml(yaml.safe_dump({"schema_version": "1.0", payload: body, "unknown": 1})))
    if found:
        raise config_files.ConfigInvalid(found)
    return config_files.frames(spark, {name: out})[name]


def _rows(df: DataFrame, order: str, most: int = 1000) -> list:
    """All rows of a configuration table in order; more than ``most`` are an error, never left out."""
    rows = df.orderBy(order).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of configuration")
    return rows


def _nations(spark: SparkSession, d: str) -> list:
    return _rows(table(spark, d, "nation"), "n_nationkey")


def _scenario_frame(spark: SparkSession, d: str) -> DataFrame:
    body = []
    for r in _rows(table(spark, d, "region"), "r_regionkey"):
        k = r["r_regionkey"]
        value = {"value": None if k in (0, 4) else k / 50, "provenance": (None, "observed", "scenario_based", None, None)[k % 5]}
        body.append({"id": f"S{k}", "label": r["r_name"], "return_period_years": str(10 * k) if k else None, "inundation_depth_threshold_m": value, "provenance": "scenario_based"})
    loaded = _loaded(spark, "scenarios", body)
    depth = F.col("inundation_depth_threshold_m")
    return loaded.select(F.col("id").alias("scenario"), "label", "return_period_years", F.col("return_period_years").isNull().alias("baseline"), F.try_variant_get(depth["value"], "$", "double").alias("threshold"), depth["provenance"].alias("provenance"))


def stored_tables(spark: SparkSession, d: str) -> DataFrame:
    """The entries of the table folder, from directory metadata, with the records that each holds."""
    names = [r["name"] for r in _rows(inventory.stored(spark, d).where(F.col("name").endswith(".parquet")).select("name"), "name")]
    out = None
    for name in names:
        one = spark.read.parquet(f"{d}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "name string, n long") if out is None else out


def directory_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries per directory without the placeholder, among manifests only YAML; parts stand for entries."""
    kind = F.when(F.col("p_size") <= 10, "raw").when(F.col("p_size") <= 20, "interim").when(F.col("p_size") <= 40, "processed").otherwise("manifests")
    name = F.when(F.col("p_size") == 10, ".gitkeep").when(F.col("p_size") > 45, F.concat("p_name", F.lit(".yaml"))).otherwise(F.col("p_name"))
    entries = table(spark, d, "part").select(kind.alias("directory"), name.alias("name"), F.lit(True).alias("present"))
    counted = inventory.counts(entries)
    return counted.join(F.broadcast(inventory.all_empty(counted)))


def manifest_status(spark: SparkSession, d: str) -> DataFrame:
    """Manifests against files; parts stand for files, those of size 50 are not listed, those under 5 not there."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("filename"), "p_name", "p_size")
    listed = p.where("p_size < 50").select("filename", F.when(F.col("p_size") > 25, F.upper(F.sha2("p_name", 256))).otherwise(F.sha2("filename", 256)).alias("checksum_sha256"))
    return inventory.compare_manifests(listed, p.where("p_size >= 5").select("filename", F.sha2("p_name", 256).alias("actual"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _masks(spark: SparkSession, d: str) -> DataFrame:
    """Depths by part and scenario: a part's size in hundredths, deeper in rarer scenarios; parts over 40 are not covered."""
    p = table(spark, d, "part").where("p_size <= 40")
    each = p.select(F.col("p_partkey").alias("l_partkey"), "p_size", F.explode(F.array(*[F.lit(k) for k in range(1, 4)])).alias("k"))
    return each.select("l_partkey", F.concat(F.lit("S"), F.col("k").cast("string")).alias("scenario"), (F.col("p_size") * F.col("k") / 1000).alias("depth"))


def _floods(spark: SparkSession, d: str) -> DataFrame:
    return network.checked_scenarios(_scenario_frame(spark, d).where("baseline or threshold is not null"))


def overlay_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that stay in each scenario, with depths by link and scenario; those without a mask are flagged."""
    over = network.overlay(table(spark, d, "lineitem").select("l_partkey", "l_quantity"), _masks(spark, d), _floods(spark, d), ["l_partkey"])
    return network.passable(over).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.count_if("depth_unknown").alias("n_unknown"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def reachable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of one region under the access rule whose shelter's nation can be reached in one hop, over all rows.

    Nations decide which can be reached, so each customer first gets the few nations where it may look; pairs are listed last.
    """
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("zone"))
    near = n.select(F.col("node").alias("c_nationkey"), "zone").join(n.select(F.col("node").alias("s_nationkey"), "zone"), "zone").select("c_nationkey", "s_nationkey")
    reached = shelter.reachable_pairs(near, network.reach_pairs(edges_of(spark, d), n, 1), "c_nationkey", "s_nationkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(reached), "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    none = F.lit(False)
    pairs = shelter.eligible_pairs(c, s, ["s_nationkey"], F.col("c_mktsegment") == "BUILDING", F.when(F.col("s_acctbal") > 0, True), none, none, tasks=4 * spark.sparkContext.defaultParallelism)
    return pairs.select("c_custkey", "s_suppkey")


def dasymetric_demand(spark: SparkSession, d: str) -> DataFrame:
    """A nation's people, a thousand a customer, dealt to its customers by the whole part of their balance."""
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.floor("c_acctbal").alias("w"))
    zones = c.groupBy("c_nationkey").agg((F.count(F.lit(1)) * 1000).alias("people"))
    return shelter.dasymetric(zones, c, "c_nationkey", "people", "w").groupBy("c_mktsegment").agg(F.sum("demand").alias("demand"), F.count(F.lit(1)).alias("n"))


def experiments_of(spark: SparkSession, d: str) -> list:
    """(id, seed, algorithm, baseline, threshold) of three experiments, resolved against their scenarios."""
    body = [
        {"id": f"E{i}", "label": "route", "scenario_id": s, "algorithm": a, "seed": 40 + i, "provenance": "scenario_based"}
        for i, (s, a) in enumerate((("S0", "dijkstra"), ("S1", "a_star"), ("S3", "dijkstra")))
    ]
    chosen = _loaded(spark, "experiments", body).join(_floods(spark, d), F.col("scenario_id") == F.col("scenario"))
    return _rows(chosen.select("id", "seed", "algorithm", "baseline", "threshold"), "id")


def _routes(spark: SparkSession, d: str) -> DataFrame:
    """(experiment, seed, node, cost) of three experiments, each on the links that its scenario leaves, by the algorithm it names."""
    out = None
    for e in experiments_of(spark, d):
        left = None if e["baseline"] else e["threshold"]
        one = network.route(edges_of(spark, d, left), spark.createDataFrame([(0,)], "node int"), e["algorithm"])
        one = one.select(F.lit(e["id"]).alias("experiment"), F.lit(e["seed"]).cast("long").alias("seed"), "node", "cost")
        out = one if out is None else out.unionByName(one)
    return out


def experiment_routes(spark: SparkSession, d: str) -> DataFrame:
    """Experiments run by name."""
    return _routes(spark, d)


def results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results written per experiment as JSON, CSV and GeoJSON in the shared folder, and read again by the readers."""
    folder = f"{set_checkpoint_folder(spark)}/results-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select(F.concat(F.lit("E"), F.col("n_regionkey").cast("string")).alias("experiment"), "n_name", (F.col("n_nationkey") / 4).alias("lon"), F.when(F.col("n_nationkey") > 4, F.col("n_nationkey")).alias("n"))
    geo.write_metrics(n, f"{folder}/metrics")
    geo.write_table(n, f"{folder}/tables")
    geo.write_routes(n, f"{folder}/routes", "Point", F.array(F.col("lon"), F.lit(1.5)), {"name": F.col("n_name"), "n": F.col("n")})
    m = spark.read.schema("n_name string, lon double, n int, experiment string").json(f"{folder}/metrics")
    t = geo.read_source(spark, "csv", f"{folder}/tables", "n_name string, lon double, n int, experiment string")
    g = geo.read_source(spark, "geojson", f"{folder}/routes/*")
    g = g.select(F.variant_get("properties", "$.name", "string").alias("n_name"), F.variant_get("coordinates", "$[0]", "double").alias("lon"), F.variant_get("properties", "$.n", "int").alias("n"), "kind")
    joined = m.join(t.withColumnRenamed("n", "n_csv"), ["experiment", "n_name", "lon"]).join(g.withColumnRenamed("n", "n_geo"), ["n_name", "lon"])
    result = network.checkpointed(joined.select("experiment", "n_name", "lon", "n", "n_csv", "n_geo", "kind"))
    remove(spark, folder)
    return result


_SCENARIOS = """sc AS (SELECT 'S' || r_regionkey AS scenario, r_name AS label, CASE WHEN r_regionkey > 0 THEN CAST(10 * r_regionkey AS BIGINT) END AS return_period_years,
  r_regionkey = 0 AS baseline, CASE WHEN r_regionkey NOT IN (0, 4) THEN r_regionkey / 50.0::DOUBLE END AS threshold FROM region)"""
_PATHS = " UNION ALL ".join(f"SELECT 'E{i}' AS experiment, CAST({40 + i} AS BIGINT) AS seed, node, cost FROM r{i}" for i in range(3))
_WALKS = ", ".join(
    f"""e{i} AS (SELECT src, dst, min(q) AS cost FROM l WHERE {keep} GROUP BY 1, 2),
  r{i}(node, cost) USING KEY (node) AS (SELECT 0, CAST(0 AS DOUBLE) UNION SELECT e.dst, min(r{i}.cost + e.cost) FROM r{i} JOIN e{i} e ON r{i}.node = e.src
  LEFT JOIN recurring.r{i} known ON known.node = e.dst WHERE known.node IS NULL OR r{i}.cost + e.cost < known.cost GROUP BY 1)"""
    for i, keep in enumerate(("true", "NOT (depth >= 1 / 50.0::DOUBLE)", "NOT (depth >= 3 / 50.0::DOUBLE)"))
)

SQL: dict[str, str] = {
    "stored_tables": " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, count(*) AS n FROM {t}" for t in TABLES),
    "directory_counts": """WITH e AS (SELECT CASE WHEN p_size <= 10 THEN 'raw' WHEN p_size <= 20 THEN 'interim' WHEN p_size <= 40 THEN 'processed' ELSE 'manifests' END AS directory,
      CASE WHEN p_size = 10 THEN '.gitkeep' WHEN p_size > 45 THEN p_name || '.yaml' ELSE p_name END AS name FROM part), c AS (SELECT directory, true AS present,
      count(CASE WHEN directory = 'manifests' THEN CASE WHEN name LIKE '%.yaml' THEN 1 END WHEN name <> '.gitkeep' THEN 1 END) AS n FROM e GROUP BY 1)
      SELECT directory, present, n, (SELECT bool_and(n = 0) FROM c WHERE directory <> 'manifests') AS all_empty FROM c""",
    "manifest_status": """SELECT CASE WHEN p_size < 5 THEN 'absent' WHEN p_size >= 50 THEN 'unlisted' WHEN p_size > 25 THEN 'ok' ELSE 'differs' END AS status, count(*) AS n FROM part GROUP BY 1""",
    "overlay_links": f"""WITH {_SCENARIOS}, m AS (SELECT p_partkey, 'S' || k AS scenario, p_size * k / 1000.0::DOUBLE AS depth FROM part, (VALUES (1), (2), (3)) AS v(k) WHERE p_size <= 40)
      SELECT s.scenario, count(*) AS n, count(CASE WHEN NOT baseline AND depth IS NULL THEN 1 END) AS n_unknown, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
      FROM (SELECT * FROM sc WHERE baseline OR threshold IS NOT NULL) s CROSS JOIN lineitem LEFT JOIN m ON l_partkey = p_partkey AND m.scenario = s.scenario WHERE baseline OR depth IS NULL OR NOT (depth >= threshold) GROUP BY 1""",
    "reachable_pairs": """WITH g AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
      UNION SELECT n_nationkey, n_nationkey FROM nation)
      SELECT c_custkey, s_suppkey FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey
      WHERE (c_mktsegment <> 'BUILDING' OR s_acctbal > 0) AND EXISTS (SELECT 1 FROM g WHERE src = c_nationkey AND dst = s_nationkey)""",
    "dasymetric_demand": """WITH c AS (SELECT c_nationkey, c_mktsegment, greatest(floor(c_acctbal), 0) AS w, count(*) OVER (PARTITION BY c_nationkey) * 1000 AS people, sum(greatest(floor(c_acctbal), 0)) OVER (PARTITION BY c_nationkey) AS total FROM customer)
      SELECT c_mktsegment, CAST(sum(CASE WHEN total > 0 THEN floor(people * w / total) END) AS BIGINT) AS demand, count(*) AS n FROM c GROUP BY 1""",
    "experiment_routes": f"""WITH RECURSIVE l AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_quantity AS q, l_discount AS depth FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), {_WALKS} {_PATHS}""",
    "results_round_trip": """SELECT 'E' || n_regionkey AS experiment, n_name, n_nationkey / 4.0::DOUBLE AS lon, CASE WHEN n_nationkey > 4 THEN n_nationkey END AS n,
      CASE WHEN n_nationkey > 4 THEN n_nationkey END AS n_csv, CASE WHEN n_nationkey > 4 THEN n_nationkey END AS n_geo, 'Point' AS kind FROM nation""",
}

QUERIES = {name: globals()[name] for name in SQL}
