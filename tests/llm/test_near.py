"""Chosen-path join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from headwater.llm import near


def shingle_set(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    root, links, texts = list(range(n)), [0] * n, [set() for _ in range(n)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                for x, y in ((i, j), (j, i)):
                    links[x] += 1
                    if sets[x] != sets[y]:
                        texts[x].add(sets[y])
                p, q = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[q] = p
    return sorted((rows[i][0], rows[find(i)][0], links[i], len(texts[i])) for i in range(n))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("rep", F.lit(1))
    return sorted(tuple(r)[:4] for r in near.ngram_jaccard_join(df).collect())


def corpus(seed, groups=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ñandú", "don't"]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 30, 120]))]
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append(" ".join(w))
    rows += ["", "", "...", "One two", "one TWO!", "long " * 3000]
    return [(i, t) for i, t in enumerate(rnd.sample(rows, len(rows)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_large_buckets_are_split_and_blocked(spark, monkeypatch):
    """With a tiny limit, recursion and block pairs give the same links."""
    monkeypatch.setattr(near, "LIMIT", 7)
    rows = corpus(3, 20) + [(1000 + i, " ".join(f"t{j}" for j in range(200)) + f" end{i}") for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_driver_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert sorted(tuple(r)[:4] for r in near.ngram_jaccard_join(d).collect()) == brute(rows)


def test_odd_rows(spark):
    same = "a b c d e f g"
    rows = [(None, same), (3, same), (3, same), (5, None), (7, "x y z u v w other text here")]
    got = sorted((tuple(r)[:4] for r in near.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 3, 2, 0), (3, 3, 2, 0), (3, 3, 2, 0), (5, 5, 0, 0), (7, 7, 0, 0)], key=str)
    kept = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 5, 7] and "lang" in kept.columns
    assert near.ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs():
    assert near.runs_needed(3.0, 0.999) == 3 and near.runs_needed(3.0, 0.999999) > 3


def near_copies(seed, count, words=120, most=8, families=1):
    """(texts of copies of a few bases with up to ``most`` words changed, all different)."""
    rnd = random.Random(seed)
    bases = [[f"b{f}n{i}" for i in range(words)] for f in range(families)]
    for f in range(1, families):  # families that overlap
        bases[f] = bases[0][: words - 8 * f] + bases[f][words - 8 * f :]
    out = set()
    while len(out) < count:
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(1, most)):
            w[rnd.randrange(words)] = f"e{rnd.randrange(30)}"
        out.add(" ".join(w))
    return sorted(out)


def fast_brute(rows):
    """``brute`` for thousands of alike texts, by a matrix product of the sets."""
    import numpy as np

    sets = [shingle_set(t) for _, t in rows]
    number = {}
    flat = [[number.setdefault(x, len(number)) for x in s] for s in sets]
    m = np.zeros((len(rows), len(number)), np.float32)
    for i, s in enumerate(flat):
        m[i, s] = 1
    size = m.sum(1)
    both = m @ m.T
    links = (both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-6) & (size > 0)
    np.fill_diagonal(links, False)
    label = np.arange(len(rows))
    ids = np.array([d for d, _ in rows])
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(rows)).min(1))
        if (new == label).all():
            break
        label = new
    least = {k: ids[label == k].min() for k in set(label.tolist())}
    keys = {}
    of = np.array([keys.setdefault(s, len(keys)) for s in sets])
    texts = [len(set(of[links[i]].tolist()) - {of[i]}) for i in range(len(rows))]
    return sorted((d, int(least[label[i]]), int(links[i].sum()), texts[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("families", "block"), [(1, 40), (1, 1024), (3, 64)])
def test_dense_groups_equal_all_pairs(spark, monkeypatch, families, block):
    """Centres, their cores and rings, copies within the group, and other documents: the links of brute force."""
    monkeypatch.setattr(near, "LIMIT", 60)
    monkeypatch.setattr(near.dense, "BLOCK", block)
    rows = [(i, t) for i, t in enumerate(near_copies(families, 260, families=families))]
    rows += [(5000 + i, t) for i, (_, t) in enumerate(rows[:30])] + [(d + 9000, t) for d, t in corpus(7, 6)]
    want = fast_brute(rows)
    assert want == brute(rows)
    assert run(spark, rows) == want


def test_five_thousand_near_copies(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(11, 5000, words=90, most=4))]
    assert run(spark, rows) == fast_brute(rows)


def test_near_copies_of_equal_or_no_id_are_linked(spark):
    """Null ids and texts that share an id: linked by text; keep_one leaves one row of each class."""
    texts = near_copies(2, 4, words=80, most=2)
    other = near_copies(3, 3, words=80, most=1)
    other = [t.replace("b0", "c0") for t in other]
    rows = [(None, texts[0]), (None, texts[1]), (9, texts[2]), (9, other[0]), (4, other[1]), (None, other[2])]
    third = [f"d{i}" for i in range(80)]
    rows += [(None, " ".join(third)), (None, " ".join([*third[:40], "edit", *third[41:]])), (9, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_near_id", F.lit(1)).withColumn("h", F.lit(2))
    got = sorted(((r["doc_id"], r["class_id"]) for r in near.ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted([(None, 9), (None, 9), (9, 9), (9, 4), (4, 4), (None, 4), (None, None), (None, None), (9, 9)], key=str)
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(left[i][0] or 0 for i in range(len(left))) == [0, 4, 9] and (9, texts[2]) in left
