"""Queries that load catalogues of configuration documents, a YAML text a row, and the same in SQL.

The texts are written by Spark from the driver's tables, one for every part, customer, supplier or order, so that parsing, types, lenient
casts, defaults and checks are those of real files and work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators.network import flags
from headwater.session import table
from headwater.sources import config_rows

HEAD = 'schema_version: "1.0"\n'


def _lines(*parts: str | Column) -> Column:
    """A text of literals and columns; a null column is YAML's null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def _items(rows: DataFrame, key: str, payload: str, line: Column, order: list[str]) -> DataFrame:
    """(file, text): one document a key, whose payload is the list of its rows in order. An order has a few rows."""
    held = rows.groupBy(F.col(key).cast("string").alias("file")).agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))["line"].alias("lines"))
    return held.select("file", F.concat(F.lit(f"{HEAD}{payload}:\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", *_ORDER, "l_returnflag", "l_linestatus")


def load_municipality(spark: SparkSession, d: str) -> DataFrame:
    """A document a customer; absent and partial sub-records, unknown keys."""
    k = F.col("c_custkey")
    area = F.when(k % 2 == 1, F.concat(F.lit("  area_km2: {value: "), (k % 50).cast("string"), F.lit(", provenance: derived}\n"))).otherwise("")
    text = _lines(f"{HEAD}municipality:\n  name: '", F.col("c_name"), "'\n  fips_code: '", F.lpad(k.cast("string"), 7, "0"), "'\n  crs: null\n  population: {value: \"", k * 1000, "\", provenance: observed}\n", area, "  extra: [dropped]\nunknown: 1\n")
    r = config_rows.load("municipality", table(spark, d, "customer").select(k.cast("string").alias("file"), text.alias("text"))).select("record.*")
    return r.select("name", "fips_code", "crs", F.col("area_km2.value").alias("area"), F.col("area_km2.provenance").alias("area_from"), F.col("population.value").alias("population"), F.col("bounding_box.min_lon").alias("min_lon"))


def load_data_sources(spark: SparkSession, d: str) -> DataFrame:
    """A document a part, a map of two sources; years as text are cast, absent fields are null."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = _lines(
        f"{HEAD}sources:\n  grid-", k, ":\n    format: ", F.when(size % 2 == 1, "csv"), "\n    provenance: observed\n    reference_year: \" ", size + 1990, " \"\n",
        "  roads-", k, ":\n    url: '", F.col("p_name"), "'\n    provenance: scenario_based\n    reference_year: ", size.cast("double") + 1900, "\n",
    )
    r = config_rows.load("data_sources", table(spark, d, "part").select(k.cast("string").alias("file"), text.alias("text")))
    return r.select(F.col("key").alias("source_id"), "record.format", "record.provenance", "record.reference_year", "record.url")


def load_shelters(spark: SparkSession, d: str) -> DataFrame:
    """A document an order, its items as shelters; casts of numbers and booleans, unknown capacities stay null."""
    line = _lines(
        "- {id: S", F.col("l_suppkey"), ", lon: \"", F.col("l_quantity"), "\", lat: ", F.col("l_linenumber"), ", accessible: ", F.when(F.col("l_returnflag") == "A", "'yes'").when(F.col("l_returnflag") == "R", "0"),
        ", capacity: {value: ", F.when(F.col("l_linestatus") == "O", F.col("l_quantity")), ", provenance: scenario_based}}",
    )
    r = config_rows.load("shelters", _items(_ordered(spark, d), "l_orderkey", "shelters", line, _ORDER)).select("record.*")
    return r.groupBy("id", "accessible").agg(F.count(F.lit(1)).alias("n"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat"), F.sum("capacity.value").alias("capacity"), F.count("activation_lead_time_hours.provenance").alias("leads"))


def load_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """A document a supplier; free rules as variants, read by path."""
    k = F.col("s_suppkey")
    text = _lines(f"{HEAD}eligibility:\n  cut-off:\n    max_travel_time_minutes: {{value: ", F.when(k % 3 > 0, k), "}\n  named:\n    description: >\n      of ", F.col("s_name"), "\n      and others\n")
    r = config_rows.load("eligibility", table(spark, d, "supplier").select(k.cast("string").alias("file"), text.alias("text")))
    body = F.col("record")
    return r.select(F.col("file").cast("long").alias("s_suppkey"), F.col("key").alias("rule"), F.try_variant_get(body, "$.max_travel_time_minutes.value", "long").alias("cutoff"), F.rtrim(F.regexp_replace(F.try_variant_get(body, "$.description", "string"), "\\n", "")).alias("description"))


def load_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """A document a part of two scenarios, with the flags that their thresholds' provenance asks for."""
    k, size = F.col("p_partkey"), F.col("p_size")
    value = F.when(size % 5 > 0, size / 50)
    origin = F.when(size % 3 == 0, "observed").when(size % 3 == 1, "scenario_based")
    text = _lines(
        f"{HEAD}scenarios:\n- {{id: S0, label: baseline, return_period_years: null, provenance: scenario_based}}\n- id: S1\n  label: flood\n  return_period_years: \"", size * 10,
        "\"\n  inundation_depth_threshold_m: {value: ", value, ", provenance: ", origin, "}\n  provenance: scenario_based\n",
    )
    r = config_rows.load("scenarios", table(spark, d, "part").select(k.cast("string").alias("file"), text.alias("text"))).select("file", "record.*")
    depth = F.col("inundation_depth_threshold_m")
    threshold = F.try_variant_get(depth["value"], "$", "double")
    told = F.array_join(flags(threshold, depth["provenance"], F.col("return_period_years").isNull()), ",")
    return r.select(F.col("file").cast("long").alias("p_partkey"), F.col("id").alias("scenario"), "return_period_years", threshold.alias("threshold"), told.alias("flags"))


def load_experiments(spark: SparkSession, d: str) -> DataFrame:
    """A document an order, its items as experiments; seeds are carried as integers, parameters as variants."""
    line = _lines(
        "- {id: E", F.col("l_linenumber"), ", label: run, scenario_id: S", F.col("l_suppkey"), ", seed: ", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('"'), F.col("l_partkey").cast("string"), F.lit('"'))).otherwise(F.col("l_partkey").cast("string")),
        ", provenance: derived, parameters: {speed: ", F.col("l_quantity"), "}}",
    )
    r = config_rows.load("experiments", _items(_ordered(spark, d), "l_orderkey", "experiments", line, _ORDER)).select("record.*")
    return r.groupBy("scenario_id", "algorithm").agg(F.count(F.lit(1)).alias("n"), F.sum("seed").alias("seeds"), F.sum(F.try_variant_get("parameters", "$.speed", "double")).alias("speed"))


def config_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every violation of every document with its path: wrong labels, seeds, missing keys, versions and one unreadable text in each hundred items."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    line = _lines(
        "- {id: E", F.col("l_linenumber"), F.when(F.col("l_quantity") > 45, "").otherwise(", label: x"), ", seed: ", F.when(flag == "R", "many").otherwise("7"),
        ", provenance: ", F.when((flag == "A") & (status == "F"), "guessed").otherwise("observed"), "}",
    )
    docs = _items(_ordered(spark, d), "l_orderkey", "experiments", line, _ORDER)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.col("o_orderpriority").alias("p"))
    text = F.when(F.col("p") == "1-URGENT", F.replace("text", F.lit('"1.0"'), F.lit('"1.1"'))).when(F.col("p") == "5-LOW", F.concat("text", F.lit("}\n"))).otherwise(F.col("text"))
    _, broken = config_rows.check("experiments", docs.join(orders, "file").select("file", text.alias("text")))
    # The text of a syntax error is the parser's own.
    return broken.groupBy(F.regexp_replace("path", r"\[\d+\]", "[]").alias("path"), "rule", F.when(F.col("rule") != "syntax", F.col("found")).alias("found")).agg(F.count(F.lit(1)).alias("n"))


SQL: dict[str, str] = {
    "load_municipality": """SELECT c_name AS name, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS fips_code, CAST(NULL AS VARCHAR) AS crs, CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey % 50 AS DOUBLE) END AS area,
      CASE WHEN c_custkey % 2 = 1 THEN 'derived' END AS area_from, CAST(1000 * c_custkey AS BIGINT) AS population, CAST(NULL AS DOUBLE) AS min_lon FROM customer""",
    "load_data_sources": """SELECT 'grid-' || p_partkey AS source_id, CASE WHEN p_size % 2 = 1 THEN 'csv' END AS format, 'observed' AS provenance, CAST(1990 + p_size AS BIGINT) AS reference_year, CAST(NULL AS VARCHAR) AS url FROM part
      UNION ALL SELECT 'roads-' || p_partkey, NULL, 'scenario_based', CAST(1900 + p_size AS BIGINT), p_name FROM part""",
    "load_shelters": """SELECT 'S' || l_suppkey AS id, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS accessible, count(*) AS n, sum(l_quantity) AS lon, sum(CAST(l_linenumber AS DOUBLE)) AS lat,
      CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS capacity, CAST(0 AS BIGINT) AS leads FROM lineitem GROUP BY 1, 2""",
    "load_eligibility": """SELECT s_suppkey, 'cut-off' AS rule, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey END AS cutoff, CAST(NULL AS VARCHAR) AS description FROM supplier
      UNION ALL SELECT s_suppkey, 'named', NULL, 'of ' || s_name || ' and others' FROM supplier""",
    "load_scenarios": """SELECT p_partkey, 'S0' AS scenario, CAST(NULL AS BIGINT) AS return_period_years, CAST(NULL AS DOUBLE) AS threshold, '' AS flags FROM part
      UNION ALL SELECT p_partkey, 'S1', CAST(p_size * 10 AS BIGINT), CASE WHEN p_size % 5 > 0 THEN p_size / 50.0::DOUBLE END,
        CASE WHEN p_size % 5 = 0 THEN 'threshold_unknown' WHEN p_size % 3 = 1 THEN 'threshold_assumed' WHEN p_size % 3 = 2 THEN 'provenance_unknown' ELSE '' END FROM part""",
    "load_experiments": """SELECT 'S' || l_suppkey AS scenario_id, CAST(NULL AS VARCHAR) AS algorithm, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS seeds, sum(l_quantity) AS speed FROM lineitem GROUP BY 1""",
    "config_violations": """WITH l AS (SELECT *, o_orderpriority AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT 'schema_version' AS path, 'version' AS rule, '1.1' AS found, count(DISTINCT l_orderkey) AS n FROM l WHERE p = '1-URGENT' HAVING count(*) > 0
      UNION ALL SELECT '', 'syntax', NULL, count(DISTINCT l_orderkey) FROM l WHERE p = '5-LOW' HAVING count(*) > 0
      UNION ALL SELECT 'experiments[].label', 'required', NULL, count(*) FROM l WHERE p <> '5-LOW' AND l_quantity > 45 HAVING count(*) > 0
      UNION ALL SELECT 'experiments[].seed', 'type', 'many', count(*) FROM l WHERE p <> '5-LOW' AND l_returnflag = 'R' HAVING count(*) > 0
      UNION ALL SELECT 'experiments[].provenance', 'enum', 'guessed', count(*) FROM l WHERE p <> '5-LOW' AND l_returnflag = 'A' AND l_linestatus = 'F' HAVING count(*) > 0""",
}

QUERIES = {name: globals()[name] for name in SQL}
