"""Chat formatting of reply trees, with DataFrame functions only.

Messages name their parents.  Root-to-leaf paths come from iterated self-joins of the jump
table (message -> ancestor 2^k steps above), so their number follows the logarithm of the
deepest path.  Branches are ranked by score, and each chosen path becomes one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import col

#: Marks of the template: a turn is BEGIN role MIDDLE text END.
BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that no text may contain once it is formatted, whichever template is used downstream.
CONTROL = (BEGIN, MIDDLE, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    """A text without control strings; null becomes empty.

    Backslashes are doubled, and one is put behind the first character of each control
    string.  ``unescape`` takes every backslash away that stands before another character.
    """
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit(_CONTROL), F.lit(r"\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def reply_paths(messages: DataFrame, score: str, top: int = 1) -> DataFrame:
    """The ``top`` root-to-leaf paths of each tree: ``tree, leaf, rank, path_score, node, depth``.

    ``messages`` has ``tree``, ``node`` (unique in its tree, not null), ``parent`` and the
    score.  A parent that is null or missing makes a root.  A path's score is the sum of
    its messages' (null: 0); ties go to the least leaf.  Null is a tree like any other.
    Messages that hang on a cycle reach no root and are on no path.  ``depth`` counts from the root.
    Repeated messages have to be dropped before, as a node that is there twice is on each path twice.
    Rows only ever carry ids.  The work is messages times the logarithm of the deepest path, and the
    lengths of the chosen paths: branches that are not chosen are never listed.
    """
    m = messages.select(
        F.struct("tree", "node").alias("id"), F.struct("tree", F.col("parent").alias("node")).alias("up"),
        F.coalesce(F.col(score), F.lit(0)).cast("double").alias("s"),
    )
    known = m.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    m = materialize(m.join(known, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("up"), "s"), "messages")

    # Jumps of 1, 2, 4, ... steps with what they pass, until all end above a root; what never does is caught in a cycle.
    # Rows that have ended (``at`` is null) know their whole path's score and length and are not written again.
    moved = m.select("id", F.col("up").alias("at"), F.col("s").alias("path_score"), F.lit(1).alias("length"))
    ended, jumps, limit = moved.where("at is null"), [], m.count()
    hop = moved.where("at is not null")
    while 1 << len(jumps) <= limit and not hop.isEmpty():
        jumps.append(hop.select("id", F.col("at").alias("up")))
        onward = ended.unionByName(hop).select(
            F.col("id").alias("at"), F.col("at").alias("next"), F.col("path_score").alias("more"), F.col("length").alias("steps"))
        moved = materialize(hop.join(onward, "at").select(
            "id", F.col("next").alias("at"), (F.col("path_score") + F.col("more")).alias("path_score"),
            (F.col("length") + F.col("steps")).alias("length")), "jumps")
        ended, hop = ended.unionByName(moved.where("at is null")), moved.where("at is not null")

    # A leaf is a message that no other names.  Branches are ranked by their ends; only chosen paths are walked.
    leaves = ended.join(m.select(F.col("up").alias("id")).where("id is not null"), "id", "left_anti")
    best = Window.partitionBy("id.tree").orderBy(F.desc("path_score"), F.col("id.node"))
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    paths = materialize(chosen.select(
        F.col("id").alias("leaf"), "id", F.lit(0).alias("above"), "rank", "path_score", "length"), "paths")
    for k, hop in enumerate(jumps):
        # A path starts with its leaf and doubles with each jump.
        more = paths.join(hop, "id").withColumns({"id": F.col("up"), "above": F.col("above") + (1 << k)})
        paths = materialize(paths.unionByName(more.select(*paths.columns)), "paths")
    return paths.select(
        F.col("leaf.tree").alias("tree"), F.col("leaf.node").alias("leaf"), "rank", "path_score",
        F.col("id.node").alias("node"), (F.col("length") - 1 - F.col("above")).alias("depth"),
    )


def format_turns(turns: Column) -> tuple[Column, Column]:
    """Formatted text and loss spans of an array of (role, text) structs.

    Spans are (start, end) in code points and cover exactly the escaped texts of assistants.
    """
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"),
        (F.coalesce(t["role"], F.lit("")) == "assistant").alias("loss"),
    ))
    formatted = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    sized = F.transform(pieces, lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), p["loss"].alias("loss")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["h"]
        span = F.array(F.struct(start.alias("start"), (start + p["b"]).alias("end")))
        return F.struct(
            (start + p["b"] + len(END)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return formatted, F.aggregate(sized, empty, step, lambda acc: acc["spans"])


def format_conversations(messages: DataFrame, score: str = "score", top: int = 1) -> DataFrame:
    """``tree, leaf, rank, path_score, formatted, loss_spans``: one conversation for each chosen path.

    ``messages`` has tree, node, parent, role, text and the score, as for ``reply_paths``.
    A conversation is one row of the result, so it has to fit in one; nothing larger is
    gathered.  Null roles and texts count as empty.  An empty table gives no rows.
    """
    words = messages.select(F.struct("tree", "node").alias("id"), "role", "text")
    paths = reply_paths(messages, score, top).withColumn("id", F.struct("tree", "node"))
    rows = paths.join(words, "id").groupBy("tree", "leaf", "rank", "path_score").agg(
        F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns")
    )
    formatted, spans = format_turns(F.col("turns"))
    return rows.select("tree", "leaf", "rank", "path_score", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, re.escape(END), -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(BEGIN) + 1, 1 << 30), MIDDLE, 1)).alias("role"),
        unescape(F.substring_index(p, MIDDLE, -1)).alias("text"),
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def linear_threads(rows: DataFrame, tree: str, turn: str, others: Sequence[str] = ("role", "text")) -> DataFrame:
    """Messages of plain conversations: every row replies to the one before it.

    Rows follow by turn, nulls first; rows of one turn by the other columns, so repeated
    rows are turns of their own.  ``score`` is the length of the text.
    """
    along = Window.partitionBy(tree).orderBy(turn, *others)
    numbered = rows.select(col(tree).alias("tree"), F.row_number().over(along).alias("node"), *[col(c) for c in others])
    return numbered.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.length(F.coalesce("text", F.lit("")))})
