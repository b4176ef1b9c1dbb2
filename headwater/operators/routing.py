"""Routes as sequences of nodes, and what a network looks like once links are gone: flow and strongly connected areas.

All of them are rounds of joins over a checkpointed state; nothing but a row count or a flag of a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.operators.network import checkpointed


def cheapest_tree(edges: DataFrame, sources: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, cost, hops, pred) of the cheapest way from any source over edges (src, dst, cost >= 0).

    Of equally cheap ways that of fewest hops, then that whose last node but one is least; so the tree is the same whatever
    the partitioning, and edges of no cost make no cycle. Sources have cost 0, no hops and no ``pred``. Rounds relax only the edges of
    nodes that have changed, and end when none does.
    """
    edges = checkpointed(edges.groupBy("src", "dst").agg(F.min("cost").cast("double").alias("cost")))
    if not edges.where(F.col("cost") < 0).isEmpty():
        raise ValueError("negative edge costs")
    node = edges.schema["src"].dataType
    label = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(node).alias("pred"))
    best = checkpointed(sources.select(F.col("node").cast(node).alias("node")).distinct().withColumn("label", label))
    changed = best
    for _ in range(max_rounds):
        offer = F.struct((F.col("label.cost") + F.col("cost")).alias("cost"), (F.col("label.hops") + 1).alias("hops"), F.col("src").alias("pred"))
        offers = changed.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(offer).alias("offer"))
        merged = best.join(offers, "node", "full_outer")
        better = F.col("offer").isNotNull() & (F.col("label").isNull() | (F.col("offer") < F.col("label")))
        merged = checkpointed(merged.select("node", F.when(better, F.col("offer")).otherwise(F.col("label")).alias("label"), better.alias("better")))
        best, changed = merged.select("node", "label"), merged.where("better").select("node", "label")
        if changed.isEmpty():
            return best.select("node", "label.cost", "label.hops", "label.pred")
    raise RuntimeError(f"costs still improve after {max_rounds} rounds")


def paths(tree: DataFrame) -> DataFrame:
    """(node, path): nodes in order from the source to each node of a tree (node, pred).

    By pointer doubling: after round k every row knows the last 2 ** k nodes of its way, so a way of n nodes takes log2 n joins.
    """
    state = checkpointed(tree.select("node", F.col("pred").alias("at"), F.array("node").alias("path")))
    while not state.where("at is not null").isEmpty():
        above = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("path").alias("head"))
        further = state.where("at is not null").join(above, "at").select("node", F.col("next").alias("at"), F.concat("head", "path").alias("path"))
        state = checkpointed(state.where("at is null").unionByName(further))
    return state.select("node", "path")


def routes(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, source, cost, hops, path) of every node that can be reached: the nodes of its cheapest way in order, both ends included."""
    tree = checkpointed(cheapest_tree(edges, sources))
    return tree.join(paths(tree), "node").select("node", F.col("path")[0].alias("source"), "cost", "hops", "path")


def route_lines(found: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Routes (``keys``, path, ...) with ``coordinates``: the (lon, lat) of the path's nodes in order, as of a GeoJSON line.

    ``places`` is (node, lon, lat). A route with a node of unknown place has null coordinates: no line is invented.
    """
    steps = found.select(*keys, F.posexplode("path").alias("_step", "_at"))
    placed = steps.join(places.select(F.col("node").alias("_at"), F.col("lon").cast("double").alias("_lon"), F.col("lat").cast("double").alias("_lat")), "_at", "left")
    known = F.col("_lon").isNotNull() & F.col("_lat").isNotNull()
    point = F.struct("_step", F.array("_lon", "_lat").alias("at"))
    lines = placed.groupBy(*keys).agg(F.bool_and(known).alias("_known"), F.sort_array(F.collect_list(point))["at"].alias("_line"))
    return found.join(lines, keys).withColumn("coordinates", F.when(F.col("_known"), F.col("_line"))).drop("_known", "_line")


# Strongly connected areas.


def _spread(pairs: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """(root, node) of all nodes that roots (root, node) reach over edges (src, dst) within their own part."""
    seen = frontier = checkpointed(pairs)
    for _ in range(max_rounds):
        step = frontier.join(edges, [F.col("node") == F.col("src"), F.col("part") == F.col("edge_part")]).select("root", "part", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, ["root", "node"], "left_anti").select("root", "part", "node"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"a reach still grows after {max_rounds} rounds")


def strong_areas(edges: DataFrame, nodes: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, area): strongly connected areas, named by their least node. ``edges`` (src, dst), ``nodes`` (node).

    Trimming takes nodes without a way in or out among those left: each is an area of its own. Then every part sends its
    least node forwards and backwards; what both reach is an area, and what either alone reaches, or neither, are parts that
    no area crosses. All parts are worked on at once, so rounds follow the depth of the parts, not their number.
    """
    edges = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    left = checkpointed(nodes.select("node").unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("part", F.lit("")))
    done = None
    for _ in range(max_rounds):
        parts = left.select("node", "part")
        inner = edges.join(parts.select(F.col("node").alias("src"), F.col("part").alias("edge_part")), "src").join(parts.select(F.col("node").alias("dst"), F.col("part").alias("other")), "dst")
        inner = checkpointed(inner.where("edge_part = other").select("src", "dst", "edge_part"))
        through = inner.select(F.col("src").alias("node")).distinct().intersect(inner.select(F.col("dst").alias("node")).distinct())
        trimmed = parts.join(through, "node", "left_anti").select("node", F.col("node").alias("area"))
        kept = checkpointed(parts.join(through, "node", "left_semi"))
        done = checkpointed(trimmed if done is None else done.unionByName(trimmed))
        if kept.isEmpty():
            return done
        if kept.count() < left.count():  # trimming goes on while it takes something
            left = kept
            continue
        root = kept.groupBy("part").agg(F.min("node").alias("root")).select("root", "part", F.col("root").alias("node"))
        forth = _spread(root, inner, max_rounds).select("node", F.col("root").alias("ahead"))
        back = _spread(root, inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_part"), max_rounds).select("node", F.col("root").alias("behind"))
        told = kept.join(forth, "node", "left").join(back, "node", "left")
        both = F.col("ahead").isNotNull() & F.col("behind").isNotNull()
        told = checkpointed(told.withColumn("both", both))
        done = checkpointed(done.unionByName(told.where("both").select("node", F.col("ahead").alias("area"))))
        # A part's new name: its own root's number and the side.
        side = F.when(F.col("ahead").isNotNull(), "a").when(F.col("behind").isNotNull(), "b").otherwise("n")
        rest = told.where("not both").join(root.select("part", "root"), "part")
        left = checkpointed(rest.select("node", F.concat_ws(":", F.col("root").cast("string"), side).alias("part")))
        if left.isEmpty():
            return done
    raise RuntimeError(f"areas are not told apart after {max_rounds} rounds")
