"""Cross-polytope near-duplicates against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from headwater.llm import polytope


def brute(rows, threshold=0.95):
    """(id, n_links, component_id, kept) in plain loops over valid vectors."""
    unit = []
    for _, v in rows:
        ok = v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / max(map(abs, v)) if ok else None)
        if ok:
            unit[-1] /= np.linalg.norm(unit[-1])
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rid", F.lit("x")).withColumn("code", F.lit(1))
    return sorted((tuple(r) for r in polytope.near_vectors(df).collect()), key=str)


def around(rng, centre, count, cosine):
    x = rng.normal(size=(count, len(centre)))
    x -= (x @ centre)[:, None] * centre
    x /= np.linalg.norm(x, axis=1)[:, None]
    return cosine * centre + np.sqrt(1 - cosine**2) * x


def unit(rng, d):
    v = rng.normal(size=d)
    return v / np.linalg.norm(v)


def test_equals_all_pairs(spark):
    """Small groups at various cosines, on several lengths that are no powers of two."""
    rng, vectors = np.random.default_rng(1), []
    for d in (64, 48, 5):
        for cosine in (0.999, 0.99, 0.98):
            for _ in range(4):
                vectors += [c * rng.uniform(0.1, 9) for c in around(rng, unit(rng, d), 6, cosine)]
        vectors += list(rng.normal(size=(40, d)))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert run(spark, rows) == brute(rows)


def test_dense_groups_are_settled_by_cores(spark, monkeypatch):
    """Overlapping groups with cores, stragglers about the cores and copies: as all pairs."""
    listed = []
    monkeypatch.setattr(polytope, "DENSE", 10)
    monkeypatch.setattr(polytope, "TABLES", 24)  # many of these pairs are at the threshold itself
    whole = polytope.links
    monkeypatch.setattr(polytope, "links", lambda *a: listed.append(whole(*a)) or listed[-1])
    rng = np.random.default_rng(2)
    one = unit(rng, 64)
    other = around(rng, one, 1, 0.96)[0]
    vectors = [*around(rng, one, 150, 0.995), *around(rng, other, 90, 0.995), *around(rng, one, 20, 0.97), *[unit(rng, 64)] * 60, *rng.normal(size=(60, 64))]
    rows = [(i, v.tolist()) for i, v in enumerate(rng.permutation(np.array(vectors)))]
    assert run(spark, rows) == brute(rows)
    found, core = listed[0]
    assert core.count() >= 250  # so the pairs of a core are counted, not listed
    both = found.join(core.select(F.col("rid").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("rid").alias("b"), F.col("core").alias("cb")), "b")
    assert both.where("ca = cb").isEmpty()


def test_recall_at_the_threshold():
    """Pairs at cosine 0.95 exactly meet in some table but for a few in a thousand."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.stack([around(rng, v, 1, 0.95)[0] for v in x])
    met = np.zeros(len(x), bool)
    for table in range(polytope.TABLES):
        a, b = polytope.buckets(x, table), polytope.buckets(y, table)
        met |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    assert met.mean() > 0.998


def test_sketch_bound_is_exact():
    """No pair at the threshold is lost by the rounded coordinates, cut ones included."""
    rng = np.random.default_rng(4)
    for d in (16, 64, 1024):
        x = np.stack([unit(rng, d) for _ in range(300)])
        y = np.stack([around(rng, v, 1, 0.95)[0] for v in x])
        a, b = (polytope.sketches(v).view(np.int8).astype(int) for v in (x, y))
        assert (((a - b) ** 2).sum(1) <= polytope._within(0.95)).all()


def test_odd_rows(spark):
    v = [0.1 * i for i in range(1, 20)]
    rows = [
        (1, v), (1, v), (None, [2 * c for c in v]), (4, None), (5, []), (6, [0.0] * 19), (7, [float("nan"), *v[1:]]), (8, [float("inf"), *v[1:]]),
        (9, [None, *v[1:]]), (10, v[:18]), (11, [-c for c in v]), (12, [1e300 * c for c in v]), (13, [1e-300 * c for c in v]), (None, None), (14, [3.0]), (15, [4.0]), (16, [1.0] * 5000), (17, [2.0] * 5000),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert polytope.near_vectors(spark.createDataFrame([(1, [1.0])], "vec_id int, embedding array<float>")).first().kept


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    assert sorted((tuple(r) for r in polytope.near_vectors(df).collect()), key=str) == brute(rows)
