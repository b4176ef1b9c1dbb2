"""Spelling variants by a trie self-join with active-node sets.

The vocabulary is partitioned by prefixes, and within a partition a trie is walked level by level. The active nodes of
a node are those at one edit from it; a child's follow from its parent's: siblings under the same parent (a replaced code point),
the parent itself (a deleted one), and children by the same code point of any active node of the parent (the edit lies further up).
Pairs of terminal nodes are near words. Insertions are deletions seen from the other word.

An edit inside the prefix would part two near words, so each word also stands in a partition by its last code points: of
two words at one edit, the shorter of length l, either the first l // 2 code points agree or the last l - l // 2 do. A
word therefore has four places: for l its own length or one less, by its prefix and by its suffix. A pair that agrees in both counts
by the prefix. Partitions of more than ``LIMIT`` words are cut again by the same rule on what is left of the words, until one code
point of the shorter words is open: of 90 letters that leaves 90 short and 8,100 long words at most, so no task ever holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.shared import bounded, cut, tidy

LEAST_POINTS, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a partition that is not cut again, and open code points at which cutting ends.
LIMIT, OPEN = 20_000, 1
#: Words that are walked at once: whole partitions up to so many, or one partition.
WALKED = 1 << 15
#: Doublings of the steps to a root: each step multiplies a word's count by ``RATIO``, so 2 ** 5 steps exceed any count.
MOST_ROUNDS = 6
#: No condition on the prefixes of a pair.
FREE = 1 << 30

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): results of the runs of all texts, of at least 7 code points, that occur twice or more. Counted where they are read first."""
    # A shorter run has no result of seven; so only maximal runs of seven or more are taken.
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{LEAST_POINTS},}})"), 1)
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = each.select(word.alias("word")).where(F.length("word") >= LEAST_POINTS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# Partitions: words of l or l + 1 code points that share their first a and last b, and, below ``differ``, do not share their first ``differ``.

_PLACE = ["l", "a", "b", "differ", "prefix", "suffix"]


def _cut(rows: DataFrame) -> DataFrame:
    """Each word in the two halves of its partition: half of the open code points of the shorter word become fixed."""
    rest = F.col("l") - F.col("a") - F.col("b")
    first = F.floor(rest / 2).cast("int")
    by_prefix = F.struct(
        (F.col("a") + first).alias("a"), F.col("b"), F.col("differ"),
        F.concat("prefix", F.substring("word", F.col("a") + 1, first)).alias("prefix"), F.col("suffix"),
    )
    last = rest - first
    by_suffix = F.struct(
        F.col("a"), (F.col("b") + last).alias("b"), F.least("differ", F.col("a") + first).alias("differ"), F.col("prefix"),
        F.concat(F.substring("word", F.length("word") - F.col("b") - last + 1, last), "suffix").alias("suffix"),
    )
    halves = rows.select("word", "n", "l", F.explode(F.array(by_prefix, by_suffix)).alias("p"))
    return halves.select("word", "n", "l", "p.*")


def partitions(words: DataFrame) -> DataFrame:
    """(word, n, l, a, b, differ, prefix, suffix) of all places of all words, with bounded partitions."""
    m = F.length("word")
    both = F.when(m > LEAST_POINTS, F.array(m, m - 1)).otherwise(F.array(m))
    zero = F.lit(0)
    rows = words.select("word", "n", F.explode(both).alias("l"), zero.alias("a"), zero.alias("b"), F.lit(FREE).alias("differ"), F.lit("").alias("prefix"), F.lit("").alias("suffix"))
    rows, out = cut(_cut(rows)), None
    while True:
        sizes = rows.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("m"))
        large = cut(sizes.where((F.col("m") > LIMIT) & (F.col("l") - F.col("a") - F.col("b") > OPEN)).drop("m"))
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        few = bounded(large)
        done = rows.join(few, _PLACE, "left_anti").select(*rows.columns)
        out = done if out is None else out.unionByName(done)
        rows = cut(_cut(rows.join(few, _PLACE, "left_semi").select(*rows.columns)))


# The walk.


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, length of each)."""
    texts = words.to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges (start, count): (number of the range, member) of every member."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - (np.cumsum(count) - count)[which] + start[which]


def walk(group: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Pairs of words at one edit in each group, by the active nodes of the trie whose first level are the groups.

    The ``size`` code points of a word stand in ``flat`` from its ``start``; words of a group are distinct.
    Yields ("replaced", x, y) with both orders, and ("deleted", longer, shorter).
    """
    _, node = np.unique(group, return_inverse=True)  # the node of each word at this depth
    alive, nodes = np.arange(len(group)), int(node.max(initial=-1)) + 1
    ends = np.full(nodes, -1)
    ends[node[size == 0]] = np.flatnonzero(size == 0)
    none = np.zeros(0, np.int64)
    same, fewer = (none, none), (none, none)  # active nodes at this depth, and those one level up
    up = np.zeros(0, np.int64)  # terminal words of the level above
    for depth in range(int(size.max(initial=0))):
        alive = alive[size[alive] > depth]
        if not len(alive):
            return
        # The children: distinct (parent, code point).
        key = node[alive] << 21 | flat[start[alive] + depth]
        edges, child = np.unique(key, return_inverse=True)
        parent, point = edges >> 21, edges & ((1 << 21) - 1)
        first = np.searchsorted(parent, np.arange(nodes))
        width = np.searchsorted(parent, np.arange(nodes), "right") - first

        def by_point(u: np.ndarray, v: np.ndarray, edges_of_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Children of u, with the child of v by the same code point where there is one."""
            which, c = _spread(first[u], width[u])  # noqa: B023
            wanted = v[which] << 21 | point[c]  # noqa: B023
            at = np.minimum(np.searchsorted(edges_of_v, wanted), len(edges_of_v) - 1)
            hit = edges_of_v[at] == wanted if len(edges_of_v) else np.zeros(len(wanted), bool)
            return c[hit], at[hit]

        which, other = _spread(first[parent], width[parent])
        apart = which != other
        further = by_point(*same, edges)
        # At one depth: siblings, or active nodes of the parent followed by the same code point.
        now = np.concatenate([which[apart], further[0]]), np.concatenate([other[apart], further[1]])
        # One level up: the parent, or what a shorter active node of the parent has by the same code point.
        if depth:
            shorter = by_point(*fewer, above)
            u, v = np.concatenate([np.arange(len(edges)), shorter[0]]), np.concatenate([parent, shorter[1]])
            both = np.unique(u * np.int64(nodes) + v)
            fewer = both // nodes, both % nodes
        else:
            fewer = np.arange(len(edges)), parent
        same, above, nodes = now, edges, len(edges)
        node = np.full(len(group), -1)
        node[alive] = child
        up, ends = ends, np.full(nodes, -1)
        done = alive[size[alive] == depth + 1]
        ends[node[done]] = done
        for kind, (u, v), of in (("replaced", same, ends), ("deleted", fewer, up)):
            x, y = ends[u], of[v]
            hit = (x >= 0) & (y >= 0)
            if hit.any():
                yield kind, x[hit], y[hit]


_NEAR = "word string, near long, n_form long, form string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and walk: how many near words, and the one of largest n, ties by code points."""
    for rows in _whole(batches):
        words, n = rows["word"].combine_chunks(), rows["n"].to_numpy()
        l, a, b, differ = (rows[k].to_numpy().astype(np.int64) for k in ("l", "a", "b", "differ"))
        flat, lengths = _points(words)  # no matrix of words by places: one word may be very long
        size, start = lengths - a - b, np.cumsum(lengths) - lengths + a
        group = np.concatenate([[0], np.cumsum(_changes(rows))])
        # Words of one place come twice only if the table repeats them; the vocabulary is distinct.
        left, right = [], []
        for kind, x, y in walk(group, flat, start, size):
            if kind == "replaced":  # of l code points; longer ones meet where l is their length
                ok = lengths[x] == l[x]
                left.append(x[ok])
                right.append(y[ok])
            else:
                left += [x, y]
                right += [y, x]
        if not left:
            continue
        x, y = np.concatenate(left), np.concatenate(right)
        asked = differ[x] < FREE
        texts = words.to_pylist()
        if asked.any():  # a pair that also shares the prefix counts there
            ok = np.ones(len(x), bool)
            ok[asked] = [texts[i][:w] != texts[j][:w] for i, j, w in zip(x[asked].tolist(), y[asked].tolist(), differ[x[asked]].tolist(), strict=True)]
            x, y = x[ok], y[ok]
        if not len(x):
            continue
        rank = np.empty(len(texts), np.int64)
        rank[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
        order = np.lexsort([rank[y], -n[y], x])
        x, y = x[order], y[order]
        head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        near = np.diff(np.concatenate([head, [len(x)]]))
        yield pa.RecordBatch.from_arrays([words.take(pa.array(x[head])), pa.array(near), pa.array(n[y[head]]), words.take(pa.array(y[head]))], ["word", "near", "n_form", "form"])


def _changes(rows: pa.Table) -> np.ndarray:
    """Whether each row after the first is in another partition than the one before."""
    out = np.zeros(rows.num_rows - 1, bool)
    for k in _PLACE:
        values = rows[k].combine_chunks()
        if pa.types.is_string(values.type):
            values = values.dictionary_encode().indices
        values = values.to_numpy(zero_copy_only=False)
        out |= values[1:] != values[:-1]
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole partitions together, about ``WALKED`` rows at once, from rows sorted by partition."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows >= WALKED:
            held = held.combine_chunks()
            ends = np.flatnonzero(_changes(held))
            if len(ends):
                yield held.slice(0, int(ends[-1]) + 1)
                held = held.slice(int(ends[-1]) + 1)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, n_form): of the words (word, n; distinct) that have any near word, their number and the one of largest n."""
    placed = partitions(words).select("word", "n", *_PLACE).repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    found = placed.mapInArrow(tidy(_joined), _NEAR)
    best = F.min(F.struct((-F.col("n_form")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("x")).select("word", "n_near", F.col("x.form").alias("form"), (-F.col("x.n")).alias("n_form"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, by doubled steps along the forms."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(MOST_ROUNDS):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            break
        now = stepped.drop("moved")
    return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): see the module, and the contract's words.

    A word is what a maximal run of letters gives, A-Z lower-cased, one code point deleted where the crc32 of ``<id>:<run>`` says so; those
    of under seven code points or that occur once are left out. form: the near word of largest n (ties: least in code-point order), if
    that is ten times the word's own at least; root: the last form of a chain of forms (n grows tenfold a step, so chains end). Null and
    empty texts have no runs; a null id counts as an empty one; ids of any type count as their text; repeated rows count each. Very long
    texts are taken whole. An empty table gives none. Other columns, whatever their names, are not read.
    """
    words = cut(vocabulary(docs, id_col, text_col))
    near = words.join(near_words(words), "word", "left")
    is_form: Column = F.col("n_form") >= RATIO * F.col("n")
    named = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("n_form")).alias("form_n")))
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
