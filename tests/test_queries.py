"""Each registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from headwater.plans import analogues, catalogues, configured, fields, networks

QUERIES, SQL = analogues.QUERIES | configured.QUERIES | catalogues.QUERIES | networks.QUERIES | fields.QUERIES, analogues.SQL | configured.SQL | catalogues.SQL | networks.SQL | fields.SQL
SF = os.environ.get("HEADWATER_SF", "/root/testdata/sf0.001")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_graph_has_every_lineitem(spark):
    """Nations that a supplier of any lineitem of nation 0's customers has are one hop away."""
    want = duckdb.sql(f"""SELECT DISTINCT s_nationkey FROM '{SF}/lineitem.parquet' JOIN '{SF}/orders.parquet' ON l_orderkey = o_orderkey
      JOIN '{SF}/customer.parquet' ON o_custkey = c_custkey JOIN '{SF}/supplier.parquet' ON l_suppkey = s_suppkey WHERE c_nationkey = 0""").fetchall()
    hops = {r["node"]: r["hops"] for r in QUERIES["reach_hops"](spark, SF).collect()}
    assert {n for n, h in hops.items() if h <= 1} == {0, *[n for n, in want]}


def test_reachable_pairs_are_pairs_of_all_rows(spark):
    """Every pair is listed, of customers of any balance, not a count by nations."""
    got = QUERIES["reachable_pairs"](spark, SF)
    assert got.columns == ["c_custkey", "s_suppkey"] and got.count() == got.distinct().count() > 125
    poor = duckdb.sql(f"SELECT c_custkey FROM '{SF}/customer.parquet' WHERE c_acctbal < 9000").fetchall()
    assert {r["c_custkey"] for r in got.select("c_custkey").distinct().collect()} & {c for c, in poor}
