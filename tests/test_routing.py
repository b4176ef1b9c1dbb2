"""Routes, assignment, ranges, areas against plain Python."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from headwater.operators import assignment, flow, routing


def brute_routes(edges, sources):
    """Least (cost, hops), then the least predecessor, node by node."""
    best = {}
    heap = [(0.0, 0, s) for s in sources]
    while heap:
        c, h, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = (c, h)
        for a, b, w in edges:
            if a == v and b not in best:
                heapq.heappush(heap, (c + w, h + 1, b))
    out = {}
    for v in sorted(best, key=lambda x: best[x][1]):
        c, h = best[v]
        out[v] = [v] if h == 0 else out[min(a for a, b, w in edges if b == v and a in best and best[a] == (c - w, h - 1))] + [v]
    return sorted((v, p[0], *best[v], p) for v, p in out.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_routes(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(30), rnd.randrange(30), float(rnd.choice([0, 0, 1, 1, 2, 5]))) for _ in range(90)]
    least = {}
    for a, b, w in edges:
        least[a, b] = min(w, least.get((a, b), w))
    sources = [3, 17]
    got = routing.routes(spark.createDataFrame(edges, "src long, dst long, cost double"), spark.createDataFrame([(s,) for s in sources], "node long"))
    assert sorted((r["node"], r["source"], r["cost"], r["hops"], r["path"]) for r in got.collect()) == brute_routes([(a, b, w) for (a, b), w in least.items()], sources)


def test_long_route_and_lines(spark):
    """A way of 70 nodes takes a few doublings; a node without a place leaves no line."""
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "node long, next long")
    tree = e.select(F.col("next").alias("node"), F.col("node").alias("pred")).unionByName(spark.createDataFrame([(0, None)], "node long, pred long"))
    found = {r["node"]: r["path"] for r in routing.paths(tree).collect()}
    assert all(found[i] == list(range(i + 1)) for i in range(71))
    some = spark.createDataFrame([(1, [5, 6, 5]), (2, [6, 7]), (3, [5])], "id long, path array<long>")
    lines = routing.route_lines(some, spark.createDataFrame([(5, 0.5, 1.0), (6, 2.0, 3.0)], "node long, lon double, lat double"), ["id"])
    assert {r["id"]: r["coordinates"] for r in lines.collect()} == {1: [[0.5, 1.0], [2.0, 3.0], [0.5, 1.0]], 2: None, 3: [[0.5, 1.0]]}


def test_negative_costs_are_refused(spark):
    with pytest.raises(ValueError, match="negative"):
        routing.cheapest_tree(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, cost double"), spark.createDataFrame([(1,)], "node long"))


@pytest.mark.parametrize(("seed", "m"), [(1, 30), (2, 45), (3, 60)])
def test_strong_areas(spark, seed, m):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(m)]
    reach = {v: {v} for v in range(32)}
    for _ in range(32):
        for a, b in edges:
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    want = sorted((v, min(u for u in reach if u in reach[v] and v in reach[u])) for v in reach)
    got = routing.strong_areas(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(v,) for v in range(32)], "node long"))
    assert sorted(map(tuple, got.collect())) == want


def gale_shapley(choices, capacity):
    """One request at a time."""
    lists = {}
    for r, place, s, p in choices:
        lists.setdefault(r, [])
        if s in capacity and (capacity[s] is None or capacity[s] > 0):
            lists[r].append((place, s, p))
    for v in lists.values():
        v.sort()
    held = {s: [] for s in capacity}
    free, at = list(lists), dict.fromkeys(lists, 0)
    while free:
        r = free.pop()
        if at[r] == len(lists[r]):
            continue
        place, s, p = lists[r][at[r]]
        at[r] += 1
        held[s].append((p, r, place))
        held[s].sort()
        if capacity[s] is not None and len(held[s]) > capacity[s]:
            free.append(held[s].pop()[1])
    got = {r: (s, place) for s, v in held.items() for _, r, place in v}
    return sorted((r, *got.get(r, (None, None))) for r in lists)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assignment_is_the_stable_one(spark, seed):
    rnd = random.Random(seed)
    capacity = {s: rnd.choice([0, 1, 2, 3, 5]) for s in range(8)} | {8: None if seed == 2 else 1}
    choices = []
    for r in range(60):
        for place, s in enumerate(rnd.sample(range(10), rnd.randint(0, 6))):  # 9 is no shelter
            choices.append((r, place, s, rnd.randrange(5)))
    got = assignment.assign(spark.createDataFrame(choices, "request long, place int, shelter long, priority int"), spark.createDataFrame(list(capacity.items()), "shelter long, capacity long"))
    rows = sorted((tuple(r) for r in got.select("request", "shelter", "place").collect()), key=lambda r: r[0])
    assert rows == gale_shapley(choices, capacity)
    n = {s: sum(r[1] == s for r in rows) for s in capacity}
    kept = {r[0]: r[2] for r in rows}
    for r, place, s, _ in choices:  # nobody is refused by a shelter with room left
        if s in capacity and (kept[r] is None or place < kept[r]):
            assert capacity[s] is not None and n[s] == capacity[s]
    room = {r["shelter"]: (r["n"], r["room"]) for r in assignment.occupancy(got, spark.createDataFrame(list(capacity.items()), "shelter long, capacity long")).collect()}
    assert room == {s: (n[s], None if c is None else c - n[s]) for s, c in capacity.items()}


def test_assignment_of_nobody(spark):
    none = spark.createDataFrame([], "request long, place int, shelter long, priority int")
    assert assignment.assign(none, spark.createDataFrame([(1, 1)], "shelter long, capacity long")).count() == 0


@pytest.mark.parametrize("reach", [0, 0.5, 3, 100])
def test_within_range(spark, reach):
    rnd = random.Random(4)
    value = lambda: rnd.choice([None, float("nan"), *[x / 2 for x in range(-12, 12)], 1e9])
    left = [(rnd.randrange(3), i, value()) for i in range(60)]
    right = [(rnd.randrange(3), i, value()) for i in range(60)]
    out = assignment.within_range(spark.createDataFrame(left, "zone int, a int, x double"), spark.createDataFrame(right, "zone int, b int, y double"), ["zone"], "x", "y", reach)
    want = sorted((i, j) for (p, i, x), (q, j, y) in itertools.product(left, right) if p == q and x is not None and y is not None and abs(x - y) <= reach)
    assert sorted((r["a"], r["b"]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_range_errors(spark):
    df = spark.createDataFrame([(1, 1.0)], "k int, x double")
    with pytest.raises(ValueError, match="reach"):
        assignment.within_range(df, df.withColumnRenamed("x", "y"), ["k"], "x", "y", float("inf"))
    with pytest.raises(ValueError, match="both sides"):
        assignment.within_range(df, df, ["k"], "x", "x", 1)


def ford_fulkerson(edges, s, t):
    room = {}
    for a, b, c in edges:
        if a != b and c is not None:
            room[a, b] = room.get((a, b), 0) + c
            room.setdefault((b, a), 0)
    total = 0
    while True:
        before, todo = {s: None}, [s]
        for v in todo:
            for (a, b), c in room.items():
                if a == v and c > 0 and b not in before:
                    before[b] = a
                    todo.append(b)
        if t not in before:
            return total
        way, v = [], t
        while v != s:
            way.append((before[v], v))
            v = before[v]
        least = min(room[e] for e in way)
        for a, b in way:
            room[a, b] -= least
            room[b, a] += least
        total += least


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flow_equals_its_cut(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(9), rnd.randrange(9), rnd.choice([None, 0, 1, 3, 7, 20])) for _ in range(28)]
    got = flow.max_flow(spark.createDataFrame(edges, "src long, dst long, capacity long"), 0, 8)
    links = got.links.collect()
    assert got.value == ford_fulkerson(edges, 0, 8) == sum(r["capacity"] for r in got.cut.collect())
    assert all(0 <= r["flow"] <= r["capacity"] for r in links)
    net = {}
    for r in links:
        net[r["src"]] = net.get(r["src"], 0) - r["flow"]
        net[r["dst"]] = net.get(r["dst"], 0) + r["flow"]
    assert all(n == (-got.value if v == 0 else got.value if v == 8 else 0) for v, n in net.items())


def test_flow_that_has_to_turn_back(spark):
    """The first wave sends more to a node than it can pass on, and takes a link that a later one has to undo."""
    edges = [(0, 1, 10), (0, 2, 10), (1, 3, 4), (2, 3, 2), (3, 5, 5), (1, 4, 3), (2, 4, 9), (4, 5, 6), (2, 1, 5)]
    got = flow.max_flow(spark.createDataFrame(edges, "src long, dst long, capacity long"), 0, 5)
    assert got.value == ford_fulkerson(edges, 0, 5) == 11
    none = flow.max_flow(spark.createDataFrame([(0, 1, 5), (2, 3, 5)], "src long, dst long, capacity long"), 0, 3)
    assert none.value == 0 and none.cut.isEmpty()


def test_lists_in_parts_are_asked_for_by_the_refused_alone(spark):
    """Parts give what whole lists give, also where a later part's request displaces an earlier one; full shelters' bars come with the call."""
    rnd, seen = random.Random(5), []
    choices = [(r, p, s, rnd.randrange(4)) for r in range(30) for p, s in enumerate(rnd.sample(range(12), 6))]
    df = spark.createDataFrame(choices, "request long, place int, shelter long, priority int").cache()
    shelters = spark.createDataFrame([(s, None if s == 11 else s % 3) for s in range(12)], "shelter long, capacity long")

    def part(low, high):
        def of(asking, some):
            seen.append((low, asking.count(), some.where("bar is not null").count()))
            return df.where(f"place between {low} and {high}").join(asking, "request").select(*df.columns)

        return of

    got = assignment.assign_parts(df.select("request"), [part(0, 1), part(2, 5)], shelters)
    assert sorted(map(str, got.collect())) == sorted(map(str, assignment.assign(df, shelters).collect()))
    assert seen[0] == (0, 30, 0) and all(n < 30 and full > 0 for low, n, full in seen[1:])
    steps = assignment.rings(df, df, ["shelter"], "place", "place", 4.0, 2)
    assert steps[0][0] < 0 and steps[-1][1] == 4.0 and [up for _, up in steps[:-1]] == [over for over, _ in steps[1:]] and len(steps) > 1


def test_dealt_joins_keep_their_tasks_and_rows(spark):
    """Few keys with many pairs and few bytes are dealt to several tasks; the pairs are those of the plain join."""
    a = spark.range(300).selectExpr("id % 2 k", "id a", "double(id % 7) x")
    b = spark.range(200).selectExpr("id % 2 k", "id b", "double(id % 5) y")
    got = assignment.within_range(a, b, ["k"], "x", "y", 2.0, tasks=16)
    assert sorted(got.select("a", "b").collect()) == sorted(assignment.within_range(a, b, ["k"], "x", "y", 2.0).select("a", "b").collect())
    held = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 4


@pytest.mark.parametrize("reach", [0, 0.5, 3, 100])
def test_runs_hold_the_pairs_of_the_plain_join(spark, monkeypatch, reach):
    """Runs of four rows, with ties over their ends, rows without a value or key, equal rows; every pair is there, each once."""
    monkeypatch.setattr(assignment, "RUN", 4)
    rnd = random.Random(7)
    value = lambda: rnd.choice([None, float("nan"), *[x / 2 for x in range(-12, 12)], 1e9])
    left = [(rnd.choice([None, 0, 1, 2]), i, value()) for i in range(60)]
    right = [(rnd.choice([None, 0, 1, 2]), i // 2, value()) for i in range(80)] + [(1, 99, 2.0)] * 9
    out = assignment.within_range(spark.createDataFrame(left, "zone int, a int, x double"), spark.createDataFrame(right, "zone int, b int, y double"), ["zone"], "x", "y", reach, tasks=4)
    want = sorted((p, i, x, j, y) for (p, i, x), (q, j, y) in itertools.product(left, right) if None not in (p, q, x, y) and p == q and abs(x - y) <= reach)
    assert sorted((r["zone"], r["a"], r["x"], r["b"], r["y"]) for r in out.collect()) == want


def test_many_pairs_take_little_room(spark, tmp_path):
    """Pairs come in an order that column files shorten: far below a byte each, where a number of 2,000 takes 11 bits."""
    a = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("a"), (F.rand(1) * 100).alias("x"))
    b = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("b"), (F.rand(2) * 100).alias("y"))
    assignment.within_range(a, b, ["k"], "x", "y", 50.0, tasks=4).select("a", "b").write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 2_000_000 and sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < n / 2
