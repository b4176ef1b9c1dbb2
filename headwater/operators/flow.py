"""Maximum flow of a capacitated network, with the cut that proves it.

The design names "flow" without an objective; ours is the documented choice: the most that can leave the source and reach
the sink, links carrying no more than their capacity. Algorithm: phases of waves. A phase measures how far each node is from the
sink over links with room (a reach against the links). A wave then carries as much as links let through from the source, one
distance at a time, always to nodes one nearer; what a node cannot pass on goes back by the links on which it came. Every wave
brings something to the sink, as each node on it has a way. When the source cannot reach the sink any more, the nodes that can are one
side of a minimum cut, and its capacity equals the flow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.operators.assignment import blocked_sum
from headwater.operators.network import checkpointed


@dataclass
class Flow:
    value: int
    links: DataFrame  # (src, dst, capacity, flow): net flow of each link that has some capacity
    cut: DataFrame  # (src, dst, capacity): links from the source's side of a minimum cut to the sink's


def _distances(arcs: DataFrame, sink: DataFrame, max_rounds: int) -> DataFrame:
    """(node, level): links to the sink with room, for every node that has a way."""
    seen = frontier = checkpointed(sink.withColumn("level", F.lit(0)))
    back = arcs.where("room > 0").select("src", "dst")
    for level in range(1, max_rounds + 1):
        step = frontier.join(back, frontier["node"] == back["dst"]).select(F.col("src").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return checkpointed(seen)
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"distances still grow after {max_rounds} rounds")


def _dealt(arcs: DataFrame, held: DataFrame, room: str) -> DataFrame:
    """(src, dst, push): each node's amount (node, amount) dealt to its links in order, as far as their room goes."""
    own = arcs.join(held, F.col("src") == F.col("node")).select("src", "dst", F.col(room).alias("room"), "amount")
    upto = blocked_sum(own, "src", ["dst"], F.col("room"), "upto", 8)
    push = F.least("room", F.col("amount") - (F.col("upto") - F.col("room")))
    return checkpointed(upto.select("src", "dst", push.alias("push")).where("push > 0"))


def max_flow(edges: DataFrame, source, sink, max_rounds: int = 1000) -> Flow:
    """Of links (src, dst, capacity), whole numbers from 0 on; several links between two nodes count together, null holds nothing.

    Loops carry nothing. A source that has no way to the sink has flow 0 and an empty cut. Amounts are longs, so results are exact.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    if source == sink:
        raise ValueError("source and sink are one node")
    given = checkpointed(edges.where("src <> dst and capacity is not null").groupBy("src", "dst").agg(F.sum("capacity").cast("long").alias("capacity")))
    if not given.where("capacity < 0").isEmpty():
        raise ValueError("negative capacities")
    none = F.lit(0).cast("long")
    both = given.select("src", "dst", F.col("capacity").alias("room")).unionByName(given.select(F.col("dst").alias("src"), F.col("src").alias("dst"), none.alias("room")))
    arcs = checkpointed(both.groupBy("src", "dst").agg(F.sum("room").alias("room")))
    start, end = (spark.createDataFrame([(v,)], f"node {kind}") for v in (source, sink))
    value = 0
    for _ in range(max_rounds):
        levels = _distances(arcs, end, max_rounds)
        first = levels.join(start, "node", "left_semi").first()
        if first is None:
            break
        here, there = levels.select(F.col("node").alias("src"), F.col("level").alias("from")), levels.select(F.col("node").alias("dst"), F.col("level").alias("to"))
        nearer = checkpointed(arcs.where("room > 0").join(here, "src").join(there, "dst").where(F.col("from") == F.col("to") + 1).select("src", "dst", "room", "from"))
        out = nearer.join(start, F.col("src") == F.col("node"), "left_semi").agg(F.sum("room")).first()[0]
        amounts = start.withColumn("amount", F.lit(out).cast("long"))
        pushed, kept = [], {}
        for level in range(first["level"], 0, -1):
            push = _dealt(nearer.where(F.col("from") == level), amounts, "room")
            pushed.append(push)
            sent = push.groupBy(F.col("src").alias("node")).agg(F.sum("push").alias("sent"))
            kept[level] = amounts.join(sent, "node", "left").select("node", (F.col("amount") - F.coalesce("sent", none)).alias("amount")).where("amount > 0")
            amounts = push.groupBy(F.col("dst").alias("node")).agg(F.sum("push").alias("amount"))
        arrived = amounts.agg(F.sum("amount")).first()[0] or 0
        # What is left over goes back, from the nodes nearest to the sink on; the source keeps nothing.
        returned, over = [], None
        for level in range(1, first["level"]):
            push = pushed[first["level"] - level - 1]  # the links that lead to this level
            mine = kept[level] if over is None else kept[level].unionByName(over).groupBy("node").agg(F.sum("amount").alias("amount"))
            back = _dealt(push.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("push").alias("room")), mine, "room")
            returned.append(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("push")).alias("push")))
            over = back.groupBy(F.col("dst").alias("node")).agg(F.sum("push").alias("amount"))
        moved = pushed[0]
        for more in (*pushed[1:], *returned):
            moved = moved.unionByName(more)
        change = moved.select("src", "dst", (-F.col("push")).alias("room")).unionByName(moved.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("push").alias("room")))
        arcs = checkpointed(arcs.unionByName(change).groupBy("src", "dst").agg(F.sum("room").alias("room")))
        value += arrived
    else:
        raise RuntimeError(f"the flow still grows after {max_rounds} phases")
    left = given.join(arcs, ["src", "dst"])
    links = left.select("src", "dst", "capacity", F.greatest(F.col("capacity") - F.col("room"), none).alias("flow")).where("capacity > 0")
    ends = given.join(levels.select(F.col("node").alias("dst")), "dst", "left_semi").join(levels.select(F.col("node").alias("src")), "src", "left_anti")
    reached = _ahead(given, start, max_rounds)
    return Flow(int(value), checkpointed(links), checkpointed(ends.join(reached.select(F.col("node").alias("src")), "src", "left_semi").where("capacity > 0").select("src", "dst", "capacity")))


def _ahead(given: DataFrame, start: DataFrame, max_rounds: int) -> DataFrame:
    """Nodes that the source reaches over links of some capacity: others have no part in a cut."""
    turned = given.where("capacity > 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("room"))
    return _distances(turned, start, max_rounds).select("node")
