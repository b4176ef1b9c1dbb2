"""Chat formatting in relational form: Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged into one block, in
which ``<|also|>`` stands between them, so that the turns can be read back. Texts and roles are escaped reversibly: a
backslash is doubled, and every control string of this or of a common other template gets a backslash after its
first character, so none can occur inside a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, ALSO, END = "<|turn|>", "<|text|>", "<|also|>", "<|end|>"
#: Control strings: those between <| and |>, and those of a widespread bracket template.
CONTROL = r"(<|\[)(\||/?s>|/?INST\]|</?SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though the body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _segments(turns: Column) -> Column:
    """array<struct<text, loss>>: the formatted text in order, cut where the loss mask changes."""

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(t: Column, start: Column, stop: Column) -> Column:
        inside = F.slice(t, start + 1, stop - start)
        loss = F.get(t, start)["role"] == "assistant"
        body = F.transform(
            inside,
            lambda x, i: F.array(
                segment(F.when(i == 0, F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT))).otherwise(F.lit(ALSO)), F.lit(False)),
                segment(escape(x["text"]), loss),
            ),
        )
        return F.concat(F.flatten(body), F.array(segment(F.lit(END), F.lit(False))))

    def all_blocks(t: Column) -> Column:
        n = F.size(t)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return let(begins, lambda b: F.flatten(F.transform(b, lambda s, j: block(t, s, F.coalesce(F.get(b, j + 1), n)))))

    return let(turns, all_blocks)


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted string, segments array<struct<text, loss>>): one row per conversation.

    The segments joined are the formatted text; those with loss are the (escaped) assistant texts. Null role or text:
    empty; a null turn comes first; rows with the same turn are ordered by role, then text, and repeated rows stay.
    Rows with a null conversation id are one conversation; ids keep their type. An empty table gives none. A conversation is one row of the
    result, so its turns do meet in one task; nothing else does. Very long texts stand whole in that row. Other columns, whatever their names, are not read.
    """
    t = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    got = rows.select(F.col(conv).alias("conv_id"), t.alias("t")).groupBy("conv_id").agg(F.collect_list("t").alias("turns"))
    return got.select("conv_id", _segments(F.array_sort("turns")).alias("segments")).select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        return let(
            F.split(b, r"<\|text\|>", 2),
            lambda p: F.transform(
                F.split(F.get(p, F.lit(1)), r"<\|also\|>"),
                lambda x: F.struct(unescape(F.substring(F.get(p, F.lit(0)), len(TURN) + 1, 2**31 - 1)).alias("role"), unescape(x).alias("text")),
            ),
        )

    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """Everything read back from the formatted output: counts and hashes of turns and of the text under the loss mask."""
    turns = let(read_turns(F.col("formatted")), lambda a: F.struct(
        F.size(a).cast("long").alias("n"),
        F.array_join(F.transform(a, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("all"),
    ))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("r"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.col("r.n").alias("n_turns"),
        F.sha2(F.col("r.all").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
