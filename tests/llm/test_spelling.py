"""The trie self-join against plain Python over all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from headwater.llm import spelling


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_near(words):
    """{word: near words}, by the strings that one deletion or one blank gives."""
    masks = {}
    for w in words:
        for i in range(len(w)):
            masks.setdefault((w[:i], "*", w[i + 1 :]), set()).add(w)
    out = {w: set() for w in words}
    for same in masks.values():
        for w in same:
            out[w] |= same - {w}
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            if v in out:
                out[w].add(v)
                out[v].add(w)
    return out


def brute(rows):
    words = brute_words(rows)
    found = brute_near(words)
    form = {}
    for w, n in words.items():
        best = min(found[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(found[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    return sorted(tuple(r) for r in spelling.spelling_variants(df).collect())


def corpus(seed, letters="abcé"):
    """Texts of words that are many edits of few, in unequal numbers, so that forms chain."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(12):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(7, 13)))
        for step in range(4):
            for i in range(2 * 10 ** max(0, 2 - step) + rnd.randint(0, 3)):
                rows.append((rnd.choice([i % 7, i % 7, None]), f"{w}, {w.upper()} x1{w}"))
            at = rnd.randrange(len(w))
            w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]]) + ("a" if len(w) < 8 else "")
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, 20_000), (2, 4), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, limit):
    """Partitions are cut again and again with tiny limits, with the same result."""
    monkeypatch.setattr(spelling, "LIMIT", limit)
    rows = corpus(seed)
    got = run(spark, rows)
    assert got == brute(rows)
    assert seed == 3 or any(r[2] not in (r[0], r[1]) for r in got)  # some chain has two steps


@pytest.mark.parametrize(("limit", "walked"), [(20_000, 1 << 15), (50, 64), (2, 16)])
def test_hot_prefix(spark, monkeypatch, limit, walked):
    """Most of the vocabulary in one prefix and suffix over a small alphabet: every pair once."""
    monkeypatch.setattr(spelling, "LIMIT", limit)
    monkeypatch.setattr(spelling, "WALKED", walked)
    rnd = random.Random(5)
    words = {"aaaa" + "".join(rnd.choice("ab") for _ in range(rnd.randint(3, 8))) + "b" * rnd.randint(0, 4) for _ in range(500)}
    words = {w: rnd.choice([1, 2, 30]) for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = brute_near(words)
    want = sorted((w, len(v), min(v, key=lambda x: (-words[x], x))) for w, v in found.items() if v)
    assert sorted((r["word"], r["n_near"], r["form"]) for r in spelling.near_words(df).collect()) == want
    assert all(near(w, x) for w, v in found.items() for x in v)


def test_partitions_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LIMIT", 3)
    words = [("".join(p),) for p in __import__("itertools").product("ab", repeat=8)]
    placed = spelling.partitions(spark.createDataFrame(words, "word string").withColumn("n", F.lit(2)))
    sizes = placed.groupBy(*spelling._PLACE).count()
    assert sizes.where("l - a - b > 1 and count > 3").isEmpty() and sizes.agg(F.max("count")).first()[0] <= 6


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Straßen straßen"), (3, "straßen Straßem straßem"), (3, "straßen Straßem straßem"), (4, "short 1234567 ÀÈÌÒÙÿÿ ÀÈÌÒÙÿÿ àèìòùÿÿ"), (5, "a" * 20_000 + " " + "a" * 20_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    assert run(spark, [("k", "naturally naturally")], "string") == [("naturally", None, "naturally", 2, 0, None)]


def test_driver_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(tuple(r) for r in spelling.spelling_variants(d).collect()) == brute([(r["doc_id"], r["text"]) for r in d.collect()])
