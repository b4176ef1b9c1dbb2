"""Queries on networks of the driver's tables: routes with their nodes, assignment, flow, areas, overlays, and the same in SQL.

Links are those of the tables themselves, whole: parts and the suppliers that deliver them, customers and the suppliers that they buy
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators import assignment, flow, network, routing, shelter
from headwater.plans.analogues import edges_of
from headwater.plans.configured import experiments_of
from headwater.session import remove, set_checkpoint_folder, table
from headwater.sources import geo


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Both ways between parts (even nodes) and suppliers (odd): the cost is the least quantity delivered."""
    l = table(spark, d, "lineitem").groupBy((F.col("l_partkey") * 2).alias("part"), (F.col("l_suppkey") * 2 + 1).alias("supplier")).agg(F.min("l_quantity").alias("cost"))
    return l.select(F.col("part").alias("src"), F.col("supplier").alias("dst"), "cost").unionByName(l.select(F.col("supplier").alias("src"), F.col("part").alias("dst"), "cost"))


def cheapest_routes(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest routes from the first supplier to every part and supplier, with all nodes in order."""
    first = table(spark, d, "supplier").agg((F.min("s_suppkey") * 2 + 1).alias("node"))
    found = routing.routes(_deliveries(spark, d), first)
    return found.select("node", "source", "cost", "hops", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


def experiment_lines(spark: SparkSession, d: str) -> DataFrame:
    """The routes of three experiments, each on the links that its scenario leaves, written as GeoJSON lines per experiment and read again."""
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") / 4).alias("lon"), F.col("n_regionkey").cast("double").alias("lat"))
    out, nation0 = None, spark.createDataFrame([(0,)], "node int")
    for e in experiments_of(spark, d):
        found = routing.routes(edges_of(spark, d, None if e["baseline"] else e["threshold"]), nation0)
        one = routing.route_lines(found, places, ["node"]).withColumn("experiment", F.lit(e["id"]))
        out = one if out is None else out.unionByName(one)
    folder = f"{set_checkpoint_folder(spark)}/lines-{uuid.uuid4().hex}"
    properties = {k: F.col(k) for k in ("experiment", "node", "cost", "hops", "path")}
    geo.write_routes(out, folder, "LineString", F.col("coordinates"), properties)
    read = geo.read_source(spark, "geojson", f"{folder}/*")
    value = lambda key, kind: F.variant_get("properties", f"$.{key}", kind)
    line = F.variant_get("coordinates", "$", "array<array<double>>")
    result = network.checkpointed(read.select(
        value("experiment", "string").alias("experiment"), value("node", "int").alias("node"), value("cost", "double").alias("cost"),
        F.array_join(value("path", "array<string>"), ">").alias("path"), "kind", F.size(line).alias("points"),
        F.element_at(line, -1)[0].alias("lon"), F.element_at(line, -1)[1].alias("lat"),
    ))
    remove(spark, folder)
    return result


#: The cut-off of travel to a shelter.
CUT_OFF = 4000.0


def _eligible(c: DataFrame, s: DataFrame, reach: float) -> DataFrame:
    """Customers and suppliers of one nation under the access rule within a reach, with the travel."""
    none = F.lit(False)
    pairs = shelter.eligible_pairs(c, s, ["zone"], F.col("c_mktsegment") == "BUILDING", F.when(F.col("s_acctbal") > 0, True), none, none, ("c_acctbal", "s_acctbal"), reach)
    return pairs.withColumn("travel", F.abs(F.col("c_acctbal") - F.col("s_acctbal")))


def _nearest(c: DataFrame, s: DataFrame, ends: list[float]) -> DataFrame:
    """(request, nearest): the least travel of every customer that has an eligible supplier; only those without one look further."""
    out, rest = None, c
    for reach in ends:
        found = network.checkpointed(_eligible(rest, s, reach).groupBy(F.col("c_custkey").alias("request")).agg(F.min("travel").alias("nearest")))
        rest = rest.join(found.select(F.col("request").alias("c_custkey")), "c_custkey", "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def shelter_assignment(spark: SparkSession, d: str) -> DataFrame:
    """D9 with D10, D11: each customer takes one place at any eligible supplier of its nation within the cut-off, the nearest that keeps it; a supplier has room for one a whole thousand of its balance, without limit where that is negative.

    The lists of all pairs are never held: nearer suppliers are asked first, further ones only by the refused, and only those that may keep somebody
    from so far. Nobody looks beyond the nearest supplier without limit, which keeps all.
    """
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), "c_custkey", "c_mktsegment", "c_acctbal")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("zone"), "s_suppkey", "s_acctbal")
    room = F.when(F.col("s_acctbal") >= 0, F.floor(F.col("s_acctbal") / 1000)).alias("capacity")
    shelters = s.select(F.col("s_suppkey").alias("shelter"), room)
    steps = assignment.rings(c, s, ["zone"], "c_acctbal", "s_acctbal", CUT_OFF)
    ends = [up for _, up in steps]
    endless = network.checkpointed(_nearest(c, s.where("s_acctbal < 0"), ends))

    def part(over: float, up: float) -> assignment.Part:
        def choices(asking: DataFrame, some: DataFrame) -> DataFrame:
            left = c.join(asking.withColumnRenamed("request", "c_custkey"), "c_custkey")
            left = left.join(endless.withColumnRenamed("request", "c_custkey"), "c_custkey", "left").where(F.col("nearest").isNull() | (F.col("nearest") > over))
            right = s.join(some.withColumnRenamed("shelter", "s_suppkey"), "s_suppkey")
            if over >= 0:  # a full shelter's bar is the travel of the last that it keeps
                right = right.where(F.col("bar").isNull() | (F.col("bar.priority") > over))
            travel = F.col("travel")
            near = _eligible(left, right.drop("bar"), up).where((travel > over) & (F.col("nearest").isNull() | (travel <= F.col("nearest"))))
            return near.select(F.col("c_custkey").alias("request"), F.struct(travel.alias("travel"), "s_suppkey").alias("place"), F.col("s_suppkey").alias("shelter"), travel.alias("priority"))

        return choices

    out = assignment.assign_parts(_nearest(c, s, ends), [part(*x) for x in steps], shelters)
    named = out.join(shelters, "shelter", "left")
    return named.select(F.col("request").alias("c_custkey"), F.col("shelter").alias("s_suppkey"), F.when(F.col("shelter").isNotNull(), F.col("capacity").isNull()).alias("uncapacitated"))


def evacuation_flow(spark: SparkSession, d: str) -> DataFrame:
    """D5 "flow": the most that gets from the customers' segments through their regions and the suppliers' regions to the return flags, with the cut that bounds it.

    Links carry a hundredth of the quantities, rounded down, by segment and region, by both regions, and by region and flag; the latter two only what lies under a depth of 0.05.
    """
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", F.col("n_regionkey").alias("c_region"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("s_region"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    q = F.col("l_quantity").cast("bigint")
    cells = network.checkpointed(joined.groupBy("c_mktsegment", "c_region", "s_region", "l_returnflag").agg(F.sum(q).alias("q"), F.sum(F.when(F.col("l_discount") < 0.05, q).otherwise(0)).alias("dry")))
    name = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    carried = lambda a, b, amount: cells.groupBy(a.alias("src"), b.alias("dst")).agg(F.floor(F.sum(amount) / 100).cast("long").alias("capacity"))
    segment, region, other, flag = name("seg-", "c_mktsegment"), name("from-", "c_region"), name("to-", "s_region"), name("flag-", "l_returnflag")
    edges = carried(F.lit("source"), segment, "q").unionByName(carried(segment, region, "q")).unionByName(carried(region, other, "dry"))
    edges = edges.unionByName(carried(other, flag, "dry")).unionByName(carried(flag, F.lit("sink"), "q"))
    found = flow.max_flow(edges, "source", "sink")
    return found.cut.agg(F.sum("capacity").alias("cut")).select(F.lit(found.value).cast("long").alias("flow"), "cut")


def _trades(spark: SparkSession, d: str) -> DataFrame:
    """One-way links by scenario: customer to supplier for returned goods, supplier to customer for accepted ones, both by the least depth of any."""
    l = table(spark, d, "lineitem").where("l_returnflag <> 'N'").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    customer, supplier = F.col("o_custkey") * 2, F.col("l_suppkey") * 2 + 1
    out = F.col("l_returnflag") == "R"
    return l.groupBy(F.when(out, customer).otherwise(supplier).alias("src"), F.when(out, supplier).otherwise(customer).alias("dst")).agg(F.min("l_discount").alias("depth"))


def connected_areas(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers that can still reach each other both ways where links of depth 0.01 or more are gone: areas with their size, isolated nodes counted together."""
    left = _trades(spark, d).where(~(F.col("depth") >= 0.01))
    nodes = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("node")).unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("node")))
    sizes = routing.strong_areas(left, nodes).groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    alone = F.col("n") == 1
    return sizes.groupBy(F.when(~alone, F.col("area")).alias("area")).agg(F.sum("n").alias("n"))


_LINES = ", ".join(
    f"""e{i} AS (SELECT src, dst, min(q) AS cost FROM l WHERE {keep} GROUP BY 1, 2),
  r{i}(node, cost, hops) USING KEY (node) AS (SELECT 0, CAST(0 AS DOUBLE), 0 UNION SELECT node, x.cost, x.hops FROM (SELECT e.dst AS node, min({{'cost': r{i}.cost + e.cost, 'hops': r{i}.hops + 1}}) AS x
    FROM r{i} JOIN e{i} e ON r{i}.node = e.src GROUP BY 1) LEFT JOIN recurring.r{i} k USING (node) WHERE k.cost IS NULL OR x < {{'cost': k.cost, 'hops': k.hops}}),
  p{i} AS (SELECT v.node, min(u.node) AS pred FROM r{i} v JOIN e{i} e ON e.dst = v.node JOIN r{i} u ON u.node = e.src AND u.cost + e.cost = v.cost AND u.hops + 1 = v.hops GROUP BY 1),
  w{i}(node, path) AS (SELECT 0, ['0'] UNION ALL SELECT p.node, list_append(w.path, CAST(p.node AS VARCHAR)) FROM w{i} w JOIN p{i} p ON p.pred = w.node)"""
    for i, keep in enumerate(("true", "NOT (depth >= 1 / 50.0::DOUBLE)", "NOT (depth >= 3 / 50.0::DOUBLE)"))
)
_EACH = " UNION ALL ".join(f"SELECT 'E{i}' AS experiment, node, cost, path FROM r{i} JOIN w{i} USING (node)" for i in range(3))

SQL: dict[str, str] = {
    "cheapest_routes": """WITH RECURSIVE l AS (SELECT l_partkey * 2 AS p, l_suppkey * 2 + 1 AS s, min(l_quantity) AS cost FROM lineitem GROUP BY 1, 2),
      e AS (SELECT p AS src, s AS dst, cost FROM l UNION ALL SELECT s, p, cost FROM l),
      r(node, cost, hops) USING KEY (node) AS (SELECT min(s_suppkey) * 2 + 1, CAST(0 AS DOUBLE), 0 FROM supplier UNION
        SELECT node, x.cost, x.hops FROM (SELECT e.dst AS node, min({'cost': r.cost + e.cost, 'hops': r.hops + 1}) AS x FROM r JOIN e ON r.node = e.src GROUP BY 1)
        LEFT JOIN recurring.r k USING (node) WHERE k.cost IS NULL OR x < {'cost': k.cost, 'hops': k.hops}),
      pred AS (SELECT v.node, min(u.node) AS pred FROM r v JOIN e ON e.dst = v.node JOIN r u ON u.node = e.src AND u.cost + e.cost = v.cost AND u.hops + 1 = v.hops GROUP BY 1),
      w(node, source, path) AS (SELECT node, node, CAST(node AS VARCHAR) FROM r WHERE hops = 0 UNION ALL SELECT p.node, w.source, w.path || '>' || p.node FROM w JOIN pred p ON p.pred = w.node)
      SELECT node, source, cost, hops, path FROM r JOIN w USING (node)""",
    "experiment_lines": f"""WITH RECURSIVE l AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_quantity AS q, l_discount AS depth FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), {_LINES}
      SELECT experiment, node, cost, array_to_string(path, '>') AS path, 'LineString' AS kind, CAST(len(path) AS INTEGER) AS points, n_nationkey / 4.0::DOUBLE AS lon, CAST(n_regionkey AS DOUBLE) AS lat FROM ({_EACH}) JOIN nation ON node = n_nationkey""",
    "shelter_assignment": """WITH RECURSIVE sh AS (SELECT s_suppkey, s_nationkey, s_acctbal, CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal / 1000) AS BIGINT) END AS room FROM supplier),
      every AS (SELECT c_custkey AS c, s_suppkey AS s, abs(c_acctbal - s_acctbal) AS travel, room FROM customer JOIN sh ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) <= 4000 AND (c_mktsegment <> 'BUILDING' OR s_acctbal > 0)),
      lists AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY travel, s) AS k FROM every WHERE room IS NULL OR room > 0),
      state(c, k, round) AS (SELECT DISTINCT c, CAST(1 AS BIGINT), 0 FROM every UNION ALL
        SELECT c, CASE WHEN kept THEN k ELSE k + 1 END, round + 1 FROM (SELECT *, bool_and(kept) OVER () AS settled FROM (
          SELECT t.c, t.k, t.round, x.s IS NULL OR x.room IS NULL OR row_number() OVER (PARTITION BY x.s ORDER BY x.travel, t.c) <= x.room AS kept FROM state t LEFT JOIN lists x ON t.c = x.c AND t.k = x.k)) WHERE NOT settled)
      SELECT t.c AS c_custkey, x.s AS s_suppkey, CASE WHEN x.s IS NOT NULL THEN x.room IS NULL END AS uncapacitated FROM state t LEFT JOIN lists x ON t.c = x.c AND t.k = x.k WHERE round = (SELECT max(round) FROM state)""",
    "evacuation_flow": """WITH cells AS (SELECT c_mktsegment AS seg, a.n_regionkey AS f, b.n_regionkey AS t, l_returnflag AS flag, sum(CAST(l_quantity AS BIGINT)) AS q, sum(CASE WHEN l_discount < 0.05 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS dry
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY ALL),
      e AS (SELECT 'source' AS src, 'seg-' || seg AS dst, floor(sum(q) / 100) AS capacity FROM cells GROUP BY ALL UNION ALL SELECT 'seg-' || seg, 'from-' || f, floor(sum(q) / 100) FROM cells GROUP BY ALL
        UNION ALL SELECT 'from-' || f, 'to-' || t, floor(sum(dry) / 100) FROM cells GROUP BY ALL UNION ALL SELECT 'to-' || t, 'flag-' || flag, floor(sum(dry) / 100) FROM cells GROUP BY ALL
        UNION ALL SELECT 'flag-' || flag, 'sink', floor(sum(q) / 100) FROM cells GROUP BY ALL),
      v AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT unnest([src, dst]) AS node FROM e) WHERE node NOT IN ('source', 'sink')),
      arcs AS (SELECT CASE WHEN src = 'source' THEN -1 ELSE a.i END AS a, CASE WHEN dst = 'sink' THEN -2 ELSE b.i END AS b, capacity FROM e LEFT JOIN v a ON a.node = src LEFT JOIN v b ON b.node = dst),
      sides AS (SELECT unnest(range(CAST(1 << (SELECT count(*) FROM v) AS BIGINT))) AS m),
      cuts AS (SELECT m, sum(capacity) AS cut FROM sides, arcs WHERE (a = -1 OR (m >> greatest(a, 0)) & 1 = 1) AND (b = -2 OR (m >> greatest(b, 0)) & 1 = 0) GROUP BY m)
      SELECT CAST(min(cut) AS BIGINT) AS flow, CAST(min(cut) AS BIGINT) AS cut FROM cuts""",
    "connected_areas": """WITH RECURSIVE e AS (SELECT DISTINCT CASE l_returnflag WHEN 'R' THEN o_custkey * 2 ELSE l_suppkey * 2 + 1 END AS src, CASE l_returnflag WHEN 'R' THEN l_suppkey * 2 + 1 ELSE o_custkey * 2 END AS dst
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N' AND NOT (l_discount >= 0.01)),
      v AS (SELECT c_custkey * 2 AS node FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier),
      r AS (SELECT node AS a, node AS b FROM v UNION SELECT a, dst FROM r JOIN e ON b = src),
      area AS (SELECT x.a AS node, min(x.b) AS area FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1), sizes AS (SELECT area, count(*) AS n FROM area GROUP BY 1)
      SELECT CASE WHEN n > 1 THEN area END AS area, CAST(sum(n) AS BIGINT) AS n FROM sizes GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
