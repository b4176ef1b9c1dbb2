"""Queries on geometry, grids, time and margins over the driver's tables, and the same in SQL.

"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators import integrity, network, spatial, temporal
from headwater.plans.analogues import _SC, _scenarios
from headwater.session import remove, set_checkpoint_folder, table
from headwater.sources import grid, shapes
from headwater.streaming import links

#: Corners of a polygon about its supplier, in tens; a notch makes it not convex.
SHAPE = ((-3, -2), (3, -2), (3, 3), (0, 0), (-3, 3))
CELL = 60.0
ZONE = "EPSG:32610"
GRID = {"cols": 25, "rows": 51, "corner": (0.0, 0.0), "size": 2.0, "tall": 20}


def _links(spark: SparkSession, d: str) -> DataFrame:
    """A link a part: from its size and price, some steps on by its key."""
    x, y, k = F.col("p_size") * 20, F.floor("p_retailprice"), F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", *[c.cast("double").alias(n) for c, n in ((x, "x1"), (y, "y1"), (x + k % 41 - 20, "x2"), (y + k % 37 - 18, "y2"))])


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    """A polygon a supplier and scenario, larger and deeper in rarer ones."""
    s = table(spark, d, "supplier").select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    x, y = F.col("s_nationkey") * 40, F.col("s_suppkey") * 2 + 900
    corners = F.array(*[F.struct((x + a * 5 * F.col("k")).cast("double").alias("x"), (y + b * 5 * F.col("k")).cast("double").alias("y")) for a, b in SHAPE])
    return s.select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("scenario"), ((F.col("s_suppkey") % 9 + 1) * F.col("k") / 100).alias("depth"), corners.alias("ring"))


def flooded_links(spark: SparkSession, d: str) -> DataFrame:
    """D3: depth of every link that meets a polygon of a scenario, by geometry."""
    return spatial.flood_depths(_links(spark, d), _polygons(spark, d), ["p_partkey"], CELL)


def surviving_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that stay in each scenario after the overlay by geometry; where no polygon lies the depth is unknown."""
    sc = spark.createDataFrame([("S0", True, None), ("S1", False, 0.05), ("S2", False, 0.1), ("S3", False, 0.2)], "scenario string, baseline boolean, threshold double")
    over = network.overlay(_links(spark, d), flooded_links(spark, d), network.checked_scenarios(sc), ["p_partkey"])
    return network.passable(over).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.count_if("depth_unknown").alias("n_unknown"))


def projected_places(spark: SparkSession, d: str) -> DataFrame:
    """customers' places in metres of a zone, to the millimetre, and whether they come back to a billionth of a degree."""
    lon, lat = F.col("c_nationkey") / 5 - 125, F.col("c_acctbal") / 200
    at = table(spark, d, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"), lon.alias("x"), lat.alias("y"))
    there = spatial.reproject(at, "x", "y", "EPSG:4326", ZONE)
    back = spatial.reproject(there.withColumns({"u": F.col("x"), "v": F.col("y")}), "u", "v", ZONE, "EPSG:4326")
    near = (F.abs(F.col("u") - F.col("lon")) < 1e-9) & (F.abs(F.col("v") - F.col("lat")) < 1e-9)
    return back.select("c_custkey", F.round("x", 3).alias("easting"), F.round("y", 3).alias("northing"), near.alias("returns"))


def sampled_grid(spark: SparkSession, d: str) -> DataFrame:
    """A grid of parts' counts by size and price, written as tiles and read again by the grid reader, sampled where the suppliers are."""
    folder = f"{set_checkpoint_folder(spark)}/grid-{uuid.uuid4().hex}"
    col, row = F.col("p_size") % GRID["cols"], F.floor("p_retailprice") % GRID["rows"]
    cells = table(spark, d, "part").groupBy(row.alias("row"), col.alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    grid.write_grid(cells, folder, **GRID)
    read = grid.read_grid(spark, f"{folder}/*")
    points = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 2.25).alias("px"), (F.col("s_suppkey") % 120 * 0.875 - 1).alias("py"))
    out = network.checkpointed(grid.sample(points, read, "px", "py", GRID["corner"], GRID["size"], "parts").select("s_suppkey", "parts"))
    remove(spark, folder)
    return out


def _packed(batches):
    """A shapefile of each nation's suppliers: corners about their places, with their names."""
    for batch in batches:
        out = []
        for nation, rows in zip(batch.column("n").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            rings = [[[(r["x"] + a, r["y"] + b) for a, b in SHAPE]] if r["held"] else [] for r in rows]
            out += [(f"nation-{nation}.shp", shapes.pack_shapes("Polygon", rings)), (f"nation-{nation}.dbf", shapes.pack_attributes([("key", "N", 12), ("name", "C", 40), ("rich", "L", 1)], [(r["key"], r["name"], r["rich"]) for r in rows]))]
        yield pa.RecordBatch.from_pylist([{"path": p, "content": c} for p, c in out], pa.schema([("path", pa.string()), ("content", pa.binary())]))


def shapefile_areas(spark: SparkSession, d: str) -> DataFrame:
    """Shapefiles with attributes, one for some suppliers of each nation, packed and parsed again: area by the ring and attributes of every shape."""
    s = table(spark, d, "supplier")
    row = F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") > 5000).alias("rich"), (F.col("s_nationkey") * 40.0).alias("x"), (F.col("s_suppkey") * 2.0).alias("y"), (F.col("s_suppkey") % 7 > 0).alias("held"))
    # A file holds some hundred suppliers of a nation, whatever their number.
    files = s.groupBy(F.concat_ws("-", "s_nationkey", F.floor(F.col("s_suppkey") / 1000).cast("string")).alias("n")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    found = shapes.parse(files.mapInArrow(_packed, "path string, content binary"))
    ring = F.col("parts")[0]
    turned = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    area = F.aggregate(F.zip_with(ring, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x) / 2
    value = lambda key, kind: F.variant_get("properties", f"$.{key}", kind)
    return found.select(value("key", "long").alias("s_suppkey"), value("name", "string").alias("name"), value("rich", "boolean").alias("rich"), "kind", F.when(F.col("kind") == "Polygon", F.abs(area)).alias("area"))


def last_observed(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: for each purchase the same user's last view before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen_value"))
    out = temporal.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["seen_value"])
    return out.select("event_id", F.unix_micros("ts_seen").alias("seen_us"), "seen_value")


def sensitivity_margins(spark: SparkSession, d: str) -> DataFrame:
    """Links that stay by scenario, assumed factor and flag, with every margin of the three in one shuffle.

    Only the depth and the flag decide, so links are counted by these first; the grid fans out the counts, not the links.
    """
    counted = table(spark, d, "lineitem").groupBy("l_discount", "l_returnflag").agg(F.count(F.lit(1)).alias("links"))
    cells = network.checked_scenarios(_scenarios(spark)).crossJoin(spark.createDataFrame([(1.0,), (1.5,), (3.0,)], "factor double"))
    kept = network.passable_links(counted, cells, F.col("l_discount") * F.col("factor"))
    dims = ["scenario", "factor", "l_returnflag"]
    sets = [dims, dims[:2], [dims[0], dims[2]], dims[1:], *[[c] for c in dims], []]
    return integrity.margins(kept, dims, sets, [F.sum("links").alias("n")]).withColumn("margin", F.col("margin").cast("long"))


def link_stream(spark: SparkSession, d: str) -> DataFrame:
    """Streaming: events replayed through the state of each link (a user) in a bounded trigger; the last update of each."""
    folder = f"{set_checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    links.state_store(spark)
    schema = table(spark, d, "events").schema
    seen = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select(F.col("user_id").alias("link"), "ts", F.col("value").alias("depth"))
    write = links.link_states(seen).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    # A batch that is run again replaces its own rows.
    query = write.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")).start()
    query.awaitTermination()
    read = spark.read.schema(f"{links.STATES}, batch long").parquet(f"{folder}/out")
    last = read.groupBy("link").agg(F.max(F.struct("batch", "seen", "expired", "depth", "observed")).alias("x"))
    out = network.checkpointed(last.select("link", F.unix_micros("x.seen").alias("seen_us"), "x.depth", "x.observed", "x.expired"))
    remove(spark, folder)
    return out


def _utm_sql() -> str:
    """The same series in DuckDB."""
    middle = spatial._zone(ZONE)[0]
    e = spatial._ECCENTRICITY
    x = " + ".join(["eta", *[f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(spatial.FORWARD, 1)]])
    y = " + ".join(["xi", *[f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(spatial.FORWARD, 1)]])
    scale = spatial.SCALE * spatial.RADIUS
    return f"""WITH p AS (SELECT c_custkey, radians(c_nationkey / 5.0::DOUBLE - 125 - ({middle!r}::DOUBLE)) AS turn, sin(radians(c_acctbal / 200)) AS s FROM customer),
      q AS (SELECT c_custkey, turn, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS t FROM p),
      r AS (SELECT c_custkey, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM q)
      SELECT c_custkey, round({spatial.EASTING!r} + {scale!r}::DOUBLE * ({x}), 3) AS easting, round({scale!r}::DOUBLE * ({y}), 3) AS northing, true AS returns FROM r"""


_TURN = "(({bx}) - ({ax})) * (({cy}) - ({ay})) - (({by}) - ({ay})) * (({cx}) - ({ax}))"


def _turns(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    return _TURN.format(ax=a[0], ay=a[1], bx=b[0], by=b[1], cx=c[0], cy=c[1])


def _meet_sql() -> str:
    """Every link against every side of every polygon."""
    a, b, c, e = ("x1", "y1"), ("x2", "y2"), ("u1", "v1"), ("u2", "v2")
    shape = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(SHAPE))
    across = lambda p, q: f"(sign({p}) * sign({q}) <= 0)"
    return f"""l AS (SELECT p_partkey, CAST(p_size * 20 AS DOUBLE) AS x1, floor(p_retailprice) AS y1, CAST(p_size * 20 + p_partkey % 41 - 20 AS DOUBLE) AS x2, floor(p_retailprice) + p_partkey % 37 - 18 AS y2 FROM part),
      corner AS (SELECT s_suppkey, k, i, CAST(s_nationkey * 40 + a * 5 * k AS DOUBLE) AS u, CAST(s_suppkey * 2 + 900 + b * 5 * k AS DOUBLE) AS v FROM supplier, (VALUES (1), (2), (3)) AS v(k), (VALUES {shape}) AS c(i, a, b)),
      side AS (SELECT p.s_suppkey, p.k, p.u AS u1, p.v AS v1, q.u AS u2, q.v AS v2 FROM corner p JOIN corner q ON p.s_suppkey = q.s_suppkey AND p.k = q.k AND q.i = (p.i + 1) % {len(SHAPE)}),
      pair AS (SELECT p_partkey, s_suppkey, k,
          bool_or(greatest(x1, x2) >= least(u1, u2) AND greatest(u1, u2) >= least(x1, x2) AND greatest(y1, y2) >= least(v1, v2) AND greatest(v1, v2) >= least(y1, y2)
            AND {across(_turns(a, b, c), _turns(a, b, e))} AND {across(_turns(c, e, a), _turns(c, e, b))}) AS touches,
          sum(CASE WHEN (v1 > y1) <> (v2 > y1) AND x1 < (u2 - u1) * (y1 - v1) / (v2 - v1) + u1 THEN 1 ELSE 0 END) % 2 = 1 AS inside
        FROM l, side GROUP BY 1, 2, 3),
      flooded AS (SELECT p_partkey, 'S' || k AS scenario, max((s_suppkey % 9 + 1) * k / 100.0::DOUBLE) AS depth FROM pair WHERE touches OR inside GROUP BY 1, 2)"""


SQL: dict[str, str] = {
    "flooded_links": f"WITH {_meet_sql()} SELECT p_partkey, scenario, depth FROM flooded",
    "surviving_links": f"""WITH {_meet_sql()}, sc(scenario, baseline, threshold) AS (VALUES ('S0', true, CAST(NULL AS DOUBLE)), ('S1', false, 0.05), ('S2', false, 0.1), ('S3', false, 0.2))
      SELECT sc.scenario, count(*) AS n, count(CASE WHEN NOT baseline AND depth IS NULL THEN 1 END) AS n_unknown FROM part CROSS JOIN sc LEFT JOIN flooded f ON f.p_partkey = part.p_partkey AND f.scenario = sc.scenario
      WHERE baseline OR depth IS NULL OR NOT (depth >= threshold) GROUP BY 1""",
    "projected_places": _utm_sql(),
    "sampled_grid": f"""WITH cells AS (SELECT p_size % {GRID['cols']} AS c, floor(p_retailprice) % {GRID['rows']} AS r, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1, 2),
      p AS (SELECT s_suppkey, floor(s_nationkey * 2.25 / 2) AS c, {GRID['rows']} - 1 - floor((s_suppkey % 120 * 0.875 - 1) / 2) AS r FROM supplier)
      SELECT s_suppkey, n AS parts FROM p LEFT JOIN cells ON p.c = cells.c AND p.r = cells.r""",
    "shapefile_areas": """SELECT s_suppkey, s_name AS name, CASE WHEN s_acctbal >= 0 THEN s_acctbal > 5000 END AS rich, CASE WHEN s_suppkey % 7 > 0 THEN 'Polygon' ELSE 'Null' END AS kind,
      CASE WHEN s_suppkey % 7 > 0 THEN CAST(21 AS DOUBLE) END AS area FROM supplier""",
    "last_observed": """WITH views AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
      SELECT event_id, epoch_us(v.ts) AS seen_us, v.value AS seen_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN views v ON e.user_id = v.user_id AND e.ts >= v.ts""",
    "sensitivity_margins": f"""SELECT scenario, factor, l_returnflag, CAST(GROUPING(scenario, factor, l_returnflag) AS BIGINT) AS margin, count(*) AS n FROM lineitem, {_SC}, (VALUES (CAST(1.0 AS DOUBLE)), (1.5), (3.0)) AS f(factor)
      WHERE baseline OR NOT (l_discount * factor >= threshold) GROUP BY CUBE (scenario, factor, l_returnflag)""",
    "link_stream": """WITH last AS (SELECT user_id, max(ts) AS ts, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1), now AS (SELECT max(ts) AS ts FROM events WHERE user_id IS NOT NULL)
      SELECT user_id AS link, epoch_us(last.ts) AS seen_us, (SELECT max(value) FROM events e WHERE e.user_id = last.user_id AND e.ts = last.ts) AS depth, n AS observed,
        epoch_ms(last.ts) + 86400000 <= epoch_ms(now.ts) - 7200000 AS expired FROM last, now""",
}

QUERIES = {name: globals()[name] for name in SQL}
