"""Queries on the driver's tables with the semantics of the studied design, and the same in SQL.

The design has no tables of this shape, so each query is an analogue: its rules on columns of our choice. The
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import rules
from headwater.operators import integrity, network, shelter
from headwater.session import table

INVENTORY = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: (scenario, baseline, threshold): the baseline is told by its flag, never by a null threshold.
SCENARIOS = (("S0", True, None), ("S1", False, 0.05), ("S2", False, 0.02))


def _scenarios(spark: SparkSession) -> DataFrame:
    return network.checked_scenarios(spark.createDataFrame(list(SCENARIOS), "scenario string, baseline boolean, threshold double"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in INVENTORY:
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records per collection, absent ones included."""
    names = spark.createDataFrame([(n,) for n in (*INVENTORY, "missing")], "name string")
    return names.join(_counts(spark, d), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


def all_empty(spark: SparkSession, d: str) -> DataFrame:
    """Every existing collection is empty; vacuously true on none. A first row tells: no table is counted."""
    some = None
    for name in INVENTORY:
        one = table(spark, d, name).select(F.lit(True).alias("row")).limit(1)
        some = one if some is None else some.unionByName(one)
    some = some.agg((F.count("row") == 0).alias("all_empty")).select(F.lit("tables").alias("name"), "all_empty")
    return some.unionByName(spark.createDataFrame([("nothing", True)], "name string, all_empty boolean"))


def name_filter(spark: SparkSession, d: str) -> DataFrame:
    """Drop one exact name, count the rest per group."""
    return table(spark, d, "part").where(F.col("p_name") != ".gitkeep").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def version_violations(spark: SparkSession, d: str) -> DataFrame:
    """I8: exact version, null included; the version comes from an optional sub-record."""
    o = table(spark, d, "orders").withColumn("version", F.when(F.col("o_orderstatus") == "F", "1.0").when(F.col("o_orderstatus") == "O", "1.1"))
    return o.where(rules.version_broken(F.col("version"))).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


def enum_violations(spark: SparkSession, d: str) -> DataFrame:
    """Values outside the permitted labels."""
    o = table(spark, d, "orders")
    return o.where(rules.enum_broken(F.col("o_orderstatus"), ("F", "O"))).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def required_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows that miss a required field, in one violation frame with the rule's name."""
    c = table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus"), "c_custkey", "left")
    broken = rules.violations(
        c,
        F.col("c_custkey"),
        {
            "required": (F.col("o_orderstatus").isNull(), F.col("o_orderstatus"), "a value"),
            "enum": (rules.enum_broken(F.col("c_mktsegment"), ("BUILDING", "MACHINERY")), F.col("c_mktsegment"), "BUILDING | MACHINERY"),
        },
    )
    return broken.groupBy("rule", "found").agg(F.count(F.lit(1)).alias("n"))


def lenient_cast(spark: SparkSession, d: str) -> DataFrame:
    """Casts that fail where a raw value is there, by event type."""
    e = table(spark, d, "events").withColumn("raw", F.get_json_object("props", "$.k")).withColumn("raw", F.when(F.col("event_id") % 7 == 0, F.concat("raw", F.lit("x"))).otherwise(F.col("raw")))
    return e.groupBy("event_type").agg(
        F.count("raw").alias("n_raw"),
        F.count(F.when(rules.cast_broken(F.col("raw"), "bigint"), 1)).alias("n_broken"),
        F.sum(F.col("raw").try_cast("bigint")).alias("total"),
    )


def null_preservation(spark: SparkSession, d: str) -> DataFrame:
    """Unknown stays unknown through an outer join."""
    o = table(spark, d, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("big"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy("c_mktsegment").agg(*integrity.null_profile(c, F.col("big")))


def nested_default(spark: SparkSession, d: str) -> DataFrame:
    """An absent sub-record becomes a record of nulls; only known fields are kept."""
    s = table(spark, d, "supplier")
    record = F.when(F.col("s_acctbal") > 0, F.struct(F.col("s_acctbal").alias("value"), F.lit("observed").alias("provenance")))
    empty = F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("provenance"))
    return s.select("s_suppkey", F.coalesce(record, empty).alias("c")).select("s_suppkey", F.col("c.value").alias("value"), F.col("c.provenance").alias("provenance"))


def compose_fail_fast(spark: SparkSession, d: str) -> DataFrame:
    """Collections in order; the first with violations is the one reported, all of its violations together."""
    checks = [
        (1, "customer", table(spark, d, "customer"), F.col("c_mktsegment").isNull()),
        (2, "orders", table(spark, d, "orders"), rules.enum_broken(F.col("o_orderstatus"), ("F", "O"))),
        (3, "lineitem", table(spark, d, "lineitem"), rules.enum_broken(F.col("l_returnflag"), ("A",))),
    ]
    for _, name, df, broken in checks:
        if not df.where(broken).limit(1).isEmpty():  # later collections are not read
            return df.where(broken).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return spark.createDataFrame([], "name string, n long")


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    """References without a target."""
    parents = table(spark, d, "customer").where("c_acctbal > 0")
    return integrity.dangling(table(spark, d, "orders"), "o_custkey", parents, "c_custkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def experiment_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Experiments resolved against their scenario by an inner join."""
    e = spark.createDataFrame([("E1", "S1", 42), ("E2", "S2", 7), ("E3", "S9", 1)], "experiment string, scenario string, seed long")
    kept = network.passable_links(table(spark, d, "lineitem").select("l_discount"), _scenarios(spark), F.col("l_discount")).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    return e.join(kept, "scenario").select("experiment", "scenario", "seed", "n")


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Gap 4: identifiers that are not unique."""
    return integrity.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def passable_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that stay passable, with l_discount as the inundation depth."""
    links = table(spark, d, "lineitem").select("l_discount", "l_quantity")
    return network.passable_links(links, _scenarios(spark), F.col("l_discount")).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def scenario_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid of scenarios and assumed depth factors; extrapolated cells are flagged."""
    grid = _scenarios(spark).crossJoin(spark.createDataFrame([(1.0,), (1.5,), (3.0,)], "factor double"))
    depth = F.col("l_discount") * F.col("factor")
    kept = network.passable_links(table(spark, d, "lineitem").select("l_discount"), grid, depth)
    return kept.groupBy("scenario", "factor").agg(F.count(F.lit(1)).alias("n")).withColumn("flags", F.when(F.col("factor") > 2, "extrapolated").otherwise(""))


def eligible_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers of one nation under the access, pet and cut-off rules."""
    r = table(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), "c_custkey", "c_mktsegment", "c_acctbal")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("zone"), "s_suppkey", "s_acctbal")
    pairs = shelter.eligible_pairs(
        r, s, ["zone"], F.col("c_mktsegment") == "BUILDING", F.when(F.col("s_acctbal") > 0, True), F.col("c_acctbal") < 0, F.col("s_suppkey") % 3 == 0,
        ("c_acctbal", "s_acctbal"), 5000.0, tasks=4 * spark.sparkContext.defaultParallelism,
    )
    return pairs.select("zone", "c_custkey", "s_suppkey")


def capacity_placement(spark: SparkSession, d: str) -> DataFrame:
    """Line items as requests in order of shipping, suppliers as shelters; a negative balance is an unknown capacity."""
    l = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax")
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "q", "l_extendedprice", "l_discount", "l_tax")]
    out = shelter.place(l, s, "l_suppkey", F.col("q"), F.when(F.col("s_acctbal") >= 0, F.floor("s_acctbal")), order)
    return out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("placed"), 1)).alias("n_placed"), F.bool_or("uncapacitated").alias("uncapacitated"))


def checksum_report(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of content against a listed value, differing rows counted."""
    p = table(spark, d, "part").withColumn("listed", F.when(F.col("p_size") > 25, F.upper(F.sha2("p_name", 256))).when(F.col("p_size") > 5, F.sha2("p_brand", 256)))
    status = integrity.checksum_mismatch(F.col("p_name"), F.col("listed"))
    return p.groupBy(F.when(status, "differs").when(~status, "ok").otherwise("unlisted").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2("p_name", 256)).alias("least"))


def clip_box(spark: SparkSession, d: str) -> DataFrame:
    """Rows within a box; both ranges reach the scan."""
    return integrity.clip(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", (1000.0, 20000.0, 10.0, None)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def edges_of(spark: SparkSession, d: str, threshold: float | None = None) -> DataFrame:
    """Nation graph: customer's nation to supplier's nation of a lineitem; the cost is the least quantity.

    With a threshold only of lineitems whose l_discount, as a depth, is below it. The joins are pre-aggregated to at
    most 625 nation pairs.
    """
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount")
    l = l if threshold is None else l.where(F.col("l_discount").isNull() | ~(F.col("l_discount") >= threshold))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    joined = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("src", "dst").agg(F.min("l_quantity").alias("cost"))


def reach_hops(spark: SparkSession, d: str) -> DataFrame:
    """Fewest hops from nation 0, up to three."""
    return network.reach(edges_of(spark, d), spark.createDataFrame([(0,)], "node int"), 3)


def cheapest_path(spark: SparkSession, d: str) -> DataFrame:
    """D5 (Dijkstra's answer): least cost from nation 0."""
    return network.cheapest_paths(edges_of(spark, d), spark.createDataFrame([(0,)], "node int"))


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """The same k rows for the same seed whatever the partitioning. The k is the feature."""
    return integrity.seeded_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 42, 25)


_SC = "(VALUES ('S0', true, CAST(NULL AS DOUBLE)), ('S1', false, 0.05), ('S2', false, 0.02)) AS sc(scenario, baseline, threshold)"
_ALL = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in INVENTORY)
_EDGES = """edges AS (SELECT c_nationkey AS src, s_nationkey AS dst, min(l_quantity) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""

SQL: dict[str, str] = {
    "inventory_counts": f"SELECT v.name, coalesce(t.n, 0) AS n, t.n IS NOT NULL AS present FROM (SELECT unnest([{', '.join(repr(n) for n in (*INVENTORY, 'missing'))}]) AS name) v LEFT JOIN ({_ALL}) t ON v.name = t.name",
    "all_empty": f"SELECT 'tables' AS name, coalesce(bool_and(n = 0), true) AS all_empty FROM ({_ALL}) UNION ALL SELECT 'nothing', coalesce(bool_and(n = 0), true) FROM ({_ALL}) WHERE false",
    "name_filter": "SELECT p_brand, count(*) AS n FROM part WHERE p_name <> '.gitkeep' GROUP BY 1",
    "version_violations": "SELECT version, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN '1.0' WHEN 'O' THEN '1.1' END AS version FROM orders) WHERE version IS DISTINCT FROM '1.0' GROUP BY 1",
    "enum_violations": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O') GROUP BY 1",
    "required_violations": """WITH c AS (SELECT c_mktsegment, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey)
      SELECT 'required' AS rule, o_orderstatus AS found, count(*) AS n FROM c WHERE o_orderstatus IS NULL GROUP BY 1, 2
      UNION ALL SELECT 'enum', c_mktsegment, count(*) FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2""",
    "lenient_cast": """WITH e AS (SELECT event_type, json_extract_string(props, '$.k') || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END AS raw FROM events)
      SELECT event_type, count(raw) AS n_raw, count(CASE WHEN raw IS NOT NULL AND try_cast(raw AS BIGINT) IS NULL THEN 1 END) AS n_broken, CAST(sum(try_cast(raw AS BIGINT)) AS BIGINT) AS total FROM e GROUP BY 1""",
    "null_preservation": """SELECT c_mktsegment, count(*) AS n, count(big) AS n_known, count(*) - count(big) AS n_null FROM customer
      LEFT JOIN (SELECT o_custkey, count(*) AS big FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1""",
    "nested_default": "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS value, CASE WHEN s_acctbal > 0 THEN 'observed' END AS provenance FROM supplier",
    "compose_fail_fast": """SELECT name, n FROM (SELECT 1 AS place, 'customer' AS name, count(*) AS n FROM customer WHERE c_mktsegment IS NULL
      UNION ALL SELECT 2, 'orders', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 3, 'lineitem', count(*) FROM lineitem WHERE l_returnflag <> 'A') WHERE n > 0 ORDER BY place LIMIT 1""",
    "dangling_refs": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) GROUP BY 1",
    "experiment_scenarios": f"""SELECT experiment, e.scenario, CAST(seed AS BIGINT) AS seed, n FROM (VALUES ('E1', 'S1', 42), ('E2', 'S2', 7), ('E3', 'S9', 1)) AS e(experiment, scenario, seed)
      JOIN (SELECT scenario, count(*) AS n FROM lineitem, {_SC} WHERE baseline OR NOT (l_discount >= threshold) GROUP BY 1) k ON e.scenario = k.scenario""",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "passable_links": f"SELECT scenario, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem, {_SC} WHERE baseline OR l_discount IS NULL OR NOT (l_discount >= threshold) GROUP BY 1",
    "scenario_grid": f"""SELECT scenario, factor, count(*) AS n, CASE WHEN factor > 2 THEN 'extrapolated' ELSE '' END AS flags FROM lineitem, {_SC}, (VALUES (CAST(1.0 AS DOUBLE)), (1.5), (3.0)) AS f(factor)
      WHERE baseline OR NOT (l_discount * factor >= threshold) GROUP BY 1, 2""",
    "eligible_pairs": """SELECT c_nationkey AS zone, c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey
      WHERE (c_mktsegment <> 'BUILDING' OR s_acctbal > 0) AND (NOT c_acctbal < 0 OR s_suppkey % 3 = 0) AND abs(c_acctbal - s_acctbal) <= 5000""",
    "capacity_placement": """WITH r AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), l_extendedprice, l_discount, l_tax
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM lineitem)
      SELECT l_suppkey, count(*) AS n, count(CASE WHEN s_acctbal < 0 OR running <= floor(s_acctbal) THEN 1 END) AS n_placed, bool_or(s_acctbal < 0) AS uncapacitated FROM r JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
    "checksum_report": """WITH p AS (SELECT sha256(p_name) AS h, CASE WHEN p_size > 25 THEN sha256(p_name) WHEN p_size > 5 THEN sha256(p_brand) END AS listed FROM part)
      SELECT CASE WHEN h <> listed THEN 'differs' WHEN h = listed THEN 'ok' ELSE 'unlisted' END AS status, count(*) AS n, min(h) AS least FROM p GROUP BY 1""",
    "clip_box": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 20000 AND l_quantity >= 10 GROUP BY 1",
    "reach_hops": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 0 AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM r JOIN edges ON node = src WHERE hops < 3)
      SELECT node, min(hops) AS hops FROM r GROUP BY 1""",
    "cheapest_path": f"""WITH RECURSIVE {_EDGES}, r(node, cost) USING KEY (node) AS (SELECT 0, CAST(0 AS DOUBLE) UNION SELECT e.dst, min(r.cost + e.cost) FROM r JOIN edges e ON r.node = e.src
      LEFT JOIN recurring.r known ON known.node = e.dst WHERE known.node IS NULL OR r.cost + e.cost < known.cost GROUP BY 1)
      SELECT node, cost FROM r""",
    "seeded_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 25",
}

QUERIES = {name: globals()[name] for name in SQL}
