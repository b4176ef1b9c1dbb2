"""Degraded networks: link removal per scenario, reachability and cheapest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.session import set_checkpoint_folder


class MissingThreshold(ValueError):
    """A flood scenario without a depth threshold: unknown is not 'no flood'."""


class UnknownAlgorithm(ValueError):
    """A routing algorithm that is not defined here."""


#: Scenarios are configuration: more rows than this are refused rather than broadcast.
MOST_SCENARIOS = 10_000


def _configured(scenarios: DataFrame) -> DataFrame:
    """The scenario rows for broadcast, after a look at their number."""
    if len(scenarios.limit(MOST_SCENARIOS + 1).take(MOST_SCENARIOS + 1)) > MOST_SCENARIOS:
        raise ValueError(f"more than {MOST_SCENARIOS} scenarios")
    return F.broadcast(scenarios)


def checked_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenarios (scenario, baseline, threshold), refused if a non-baseline threshold is null.

    The scenario table is configuration (a handful of rows), so the check is a bounded look at the driver.
    """
    bad = [r["scenario"] for r in scenarios.where(~F.col("baseline") & F.col("threshold").isNull()).select("scenario").take(20)]
    if bad:
        raise MissingThreshold(f"no inundation depth threshold for: {', '.join(map(str, bad))}")
    return scenarios


def passable_links(links: DataFrame, scenarios: DataFrame, depth: Column) -> DataFrame:
    """Links that remain in each scenario: all of them in the baseline, else those whose depth is below the threshold.

    A null depth is unknown: the link stays and ``depth_unknown`` flags it. The scenario side is a few
    configuration rows, so this is one scan of the links and no shuffle.
    """
    keep = F.col("baseline") | depth.isNull() | ~(depth >= F.col("threshold"))
    return links.join(_configured(scenarios), keep).withColumn("depth_unknown", depth.isNull() & ~F.col("baseline"))


def overlay(links: DataFrame, masks: DataFrame, scenarios: DataFrame, on: list[str]) -> DataFrame:
    """A row per link and scenario, with the depth that the scenario's mask has where the link is; null where it has none.

    ``masks`` is (``on``..., scenario, depth), as overlaid beforehand (``spatial.flood_depths``). They are gathered to one row a link first, with its
    depths by scenario, of which there are few; links are joined once, by equal keys, and only then fan out over the scenarios.
    """
    depths = masks.where("scenario is not null").groupBy(*on, "scenario").agg(F.max("depth").alias("depth"))
    held = depths.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("scenario", "depth"))).alias("_depths"))
    each = links.join(held, on, "left").join(_configured(scenarios.select("scenario", "baseline", "threshold")))
    return each.withColumn("depth", F.try_element_at("_depths", F.col("scenario"))).drop("_depths")


def passable(overlaid: DataFrame) -> DataFrame:
    """The rows of ``overlay`` whose link stays: as ``passable_links``, for depths that differ by scenario."""
    depth = F.col("depth")
    keep = F.col("baseline") | depth.isNull() | ~(depth >= F.col("threshold"))
    return overlaid.where(keep).withColumn("depth_unknown", depth.isNull() & ~F.col("baseline"))


def flags(threshold: Column, provenance: Column, baseline: Column) -> Column:
    """array<string>: what a reader of a result has to know of its scenario; empty where the threshold was observed."""
    return F.array_compact(
        F.array(
            F.when(~baseline & threshold.isNull(), "threshold_unknown"),
            F.when(~baseline & threshold.isNotNull() & (provenance == "scenario_based"), "threshold_assumed"),
            F.when(~baseline & threshold.isNotNull() & provenance.isNull(), "provenance_unknown"),
        )
    )


def route(edges: DataFrame, sources: DataFrame, algorithm: str | None) -> DataFrame:
    """(node, cost) by the algorithm that an experiment names.

    "a_star" with any admissible heuristic has the answer of "dijkstra"; "flow" has no defined objective, and a null
    algorithm none at all: both are refused by name.
    """
    if algorithm in ("dijkstra", "a_star"):
        return cheapest_paths(edges, sources)
    raise UnknownAlgorithm(f"algorithm {algorithm!r}; expected dijkstra or a_star" + (" (flow has no defined objective)" if algorithm == "flow" else ""))


def reach_pairs(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(source, node, hops): for each source node its own fewest hops, up to ``max_hops``."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    seen = frontier = checkpointed(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")).distinct())
    for hop in range(1, max_hops + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("source", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reach(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(node, hops): fewest hops from any source, up to ``max_hops``.

    Each round joins only the newly reached frontier; lineage is cut in the shared checkpoint folder.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())  # else each hop would do the edges' joins again
    seen = sources.select(F.col("node"), F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def cheapest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, cost): least total cost from any source over edges (src, dst, cost >= 0), by rounds of relaxation.

    Rounds end when no cost improves. The answer is Dijkstra's, and A*'s with any admissible heuristic.
    """
    edges = checkpointed(edges.groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    if not edges.where(F.col("cost") < 0).isEmpty():
        raise ValueError("negative edge costs")
    best = sources.select("node", F.lit(0).cast("double").alias("cost")).distinct()
    changed = best
    for _ in range(max_rounds):
        offers = (
            changed.withColumnRenamed("cost", "so_far").join(edges, F.col("node") == F.col("src"))
            .groupBy(F.col("dst").alias("node")).agg(F.min(F.col("so_far") + F.col("cost")).alias("offer"))
        )
        merged = checkpointed(
            best.join(offers, "node", "full_outer").select(
                "node",
                F.least("cost", "offer").alias("cost"),
                (F.col("cost").isNull() | (F.col("offer") < F.col("cost"))).alias("improved"),
            )
        )
        best = merged.select("node", "cost")
        changed = merged.where(F.coalesce("improved", F.lit(False))).select("node", "cost")
        if changed.isEmpty():
            return best
    raise RuntimeError(f"costs still improve after {max_rounds} rounds")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names; without one only a local session may use its own."""
    set_checkpoint_folder(df.sparkSession)
    return df.checkpoint()
