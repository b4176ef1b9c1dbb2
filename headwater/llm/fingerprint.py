"""Order MinHash fingerprints with Spark expressions only.

A text is cut into pieces (up to ten characters of a word with the white space after it); every ``K`` consecutive pieces
are a k-mer, numbered by its occurrences so far. A hash of (k-mer, number) deals the numbered k-mers to ``BINS`` bins
(one permutation of all stands for many); in each bin the ``L`` least are selected, put back in text order and hashed
together. A bin that holds fewer, as in short texts, selects among all numbered k-mers by a permutation of its own, so that
every tuple tells of order. The likeness of two fingerprints is the share of equal bins, which falls with edits and with changed order.

Everything works on arrays of longs inside one row: nothing is exploded, grouped or shuffled. Sorting takes n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.shared import bounded, cut

K, L, BIN_BITS = 3, 2, 6
BINS = 1 << BIN_BITS
PIECE = r"(?s)\S{1,10}\s*|\s+"
#: Bits of a place: a text of two gigabytes, the longest that Spark holds, has no more pieces.
_PLACE_BITS = 30
_PLACE = (1 << _PLACE_BITS) - 1
_REST = 64 - _PLACE_BITS - 1  # bits of a hash that stay beside a place


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(h: Column, place: Column) -> Column:
    """A hash's high bits with a place below: sorts by hash, then by place."""
    return h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(F.least(place.cast("long"), F.lit(_PLACE)))


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_PLACE))


def _numbered(s: Column) -> Column:
    """Hash of k-mer and occurrence with the place, from the sorted k-mers."""

    def fresh(x: Column, n: Column) -> Column:
        return _packed(F.xxhash64(_high(x), n), x.bitwiseAND(F.lit(_PLACE)))

    def general(s: Column) -> Column:
        n = F.size(s)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_high(F.get(s, i)) != _high(F.get(s, i - 1))))
        return let(
            begins,
            lambda b: F.flatten(F.transform(b, lambda start, j: F.transform(F.slice(s, start + 1, F.coalesce(F.get(b, j + 1), n) - start), lambda x, i: fresh(x, i)))),
        )

    again = F.exists(F.sequence(F.lit(1), F.size(s)), lambda i: _high(F.get(s, i)) == _high(F.get(s, i - 1)))
    return F.when(F.size(s) == 0, s).when(again, general(s)).otherwise(F.transform(s, lambda x: fresh(x, F.lit(0))))


def signature(text: Column) -> Column:
    """array<long>, one entry per bin: the bin in the high bits, a hash of the ordered tuple below. An empty text has none."""

    def kmers(p: Column) -> Column:
        n = F.size(p)
        last = F.greatest(n - K, F.lit(0))
        each = F.transform(F.sequence(F.lit(0), last), lambda i: _packed(F.xxhash64(*[F.coalesce(F.get(p, i + j), F.lit("")) for j in range(K)]), i))
        return F.when(n == 0, F.array().cast("array<long>")).otherwise(each)

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, 64 - BIN_BITS)

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < L) | (bin_of(F.get(s, i - L)) != bin_of(x)))

    def chained(b: Column, own: Column) -> Column:
        """The entry of bin b: a hash of its k-mers in text order."""
        by_place = F.array_sort(F.transform(own, lambda y: F.shiftleft(y.bitwiseAND(F.lit(_PLACE)), _REST).bitwiseOR(F.shiftrightunsigned(y, _PLACE_BITS + 1))))
        h = F.xxhash64(F.transform(by_place, lambda y: y.bitwiseAND(F.lit((1 << _REST) - 1))))
        return F.shiftleft(b, 64 - BIN_BITS).bitwiseOR(F.shiftrightunsigned(h, BIN_BITS))

    def tuples(s: Column, c: Column) -> Column:
        ends = F.filter(c, lambda x, i: (i >= L - 1) & (bin_of(F.get(c, i - (L - 1))) == bin_of(x)) if L > 1 else F.lit(True))
        place = lambda x: F.array_position(c, x).cast("int")
        full = F.transform(ends, lambda x: let(place(x), lambda i: chained(bin_of(x), F.slice(c, i - (L - 1), L))))
        lacking = let(F.transform(ends, bin_of), lambda filled: F.filter(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)).cast("array<long>"), lambda b: ~F.array_contains(filled, b)))
        drawn = lambda b: F.slice(F.sort_array(F.transform(s, lambda x: _packed(F.xxhash64(_high(x), b), x.bitwiseAND(F.lit(_PLACE))))), 1, L)
        return let(lacking, lambda free: F.when(F.size(free) == 0, full).otherwise(F.sort_array(F.concat(full, F.transform(free, lambda b: chained(b, drawn(b)))))))

    return let(
        F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)),
        lambda p: let(F.sort_array(kmers(p)), lambda s: let(F.sort_array(_numbered(s)), lambda s2: F.when(F.size(s2) == 0, s2).otherwise(let(least(s2), lambda c: tuples(s2, c))))),
    )


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins; two empty fingerprints are alike."""
    bins = F.greatest(F.size(a), F.size(b))
    return F.when(bins == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / bins)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): one row per row of ``docs``, without a shuffle. Null text: empty, with an empty fingerprint.

    Null and repeated ids and repeated rows pass as they are; ids keep their type. A very long text is one row, whose arrays of longs take some
    twenty bytes a piece. Other columns, whatever their names, are not read. An empty table gives none.
    """
    return docs.select(F.col(id_col).alias("doc_id"), as_text(signature(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("fingerprint"))


def next_of(keys: DataFrame) -> DataFrame:
    """(id, h, next_id, next_h) of distinct keys (id, h): descending ids, then ascending h; after the last comes the first.

    The keys are sorted over range partitions, ``lead`` works inside each, and the seams need one row per partition.
    """
    session = keys.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("id"), F.asc("h")]
    ranged = cut(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    first = F.struct((-F.col("id").cast("decimal(20,0)")).alias("rank"), "h", "id")
    heads = ranged.groupBy("part").agg(F.min(first).alias("head"))
    around = Window.orderBy("part")  # one row per partition
    above = F.coalesce(F.lead("head").over(around), F.first("head").over(around))
    seams = F.broadcast(heads.select("part", above.alias("seam")))
    inside = ranged.withColumn("after", F.lead(F.struct("h", "id")).over(Window.partitionBy("part").orderBy(*order)))
    after = F.coalesce(F.col("after"), F.struct(F.col("seam.h").alias("h"), F.col("seam.id").alias("id")))
    return inside.join(seams, "part").withColumn("after", after).select("id", "h", F.col("after.id").alias("next_id"), F.col("after.h").alias("next_h"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per row of ``docs``.

    The edited text is the text whose last third (code points, rounded down) gives way to as many of the next
    document's first, or all of them. The next document is that of the next lower id; different texts of one id
    follow each other in the order of a hash, and rows that repeat an id and a text are one document. Null text: empty. A row with a null
    id has an empty next text. One document is its own next. An empty table gives none. Ids are cast to long. A very long text
    is one row, whose arrays of longs take some twenty bytes a piece. Other columns, whatever their names, are not read.

    Only ids and hashes are ordered. Of the next text no more than a third of the document's length is sent to it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    known = rows.where("id is not null")
    keys = cut(known.groupBy("id", "h").agg(F.count(F.lit(1)).alias("copies"), F.first(F.char_length("text")).alias("n")))
    links = cut(next_of(keys.select("id", "h")).join(keys.select("id", "h", "n"), ["id", "h"]))
    signed = known.withColumn("sig", signature(F.col("text")))
    sent = signed.join(links.select(F.col("id").alias("to_id"), F.col("h").alias("to_h"), "n", F.col("next_id").alias("id"), F.col("next_h").alias("h")), ["id", "h"])
    sent = sent.select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), F.substring("text", F.lit(1), F.floor(F.col("n") / 3).cast("int")).alias("begin"), F.col("sig").alias("next_sig"))
    if not keys.where("copies > 1").isEmpty():  # a next document of several rows is sent once
        sent = sent.dropDuplicates(["id", "h"])
    none = F.array().cast("array<long>")
    lone = rows.where("id is null").select("id", "text", signature(F.col("text")).alias("sig"), F.lit("").alias("begin"), none.alias("next_sig"))
    linked = signed.join(sent, ["id", "h"]).select("id", "text", "sig", "begin", "next_sig").unionByName(lone)
    n = F.char_length("text")
    edited = linked.select("id", n.cast("long").alias("n_chars"), "sig", "next_sig", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("begin")).alias("edited"))
    out = edited.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sig", "next_sig", signature(F.col("edited")).alias("edited_sig"))
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
