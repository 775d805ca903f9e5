"""Chat formatting of reply trees.

Messages form trees by their parents.  Self-joins that double the step
(parent, grandparent, four up, ...) give every message its depth and the sum of
scores on the way from its root; the leaves of a tree, each the end of a
branch, are ranked by the mean score of their branch, and the steps taken back
from the chosen leaves list the messages of each chosen branch.  The number of
joins grows with the logarithm of the depth, and only ids and scores take part.

Each chosen branch becomes one conversation:

    <|im_start|>role\\ntext<|im_end|>\\n

``<|`` inside roles and texts gets a backslash (``<\\|``, and one more where
there are some), so control strings can't be forged, and ``parse`` reads back
exactly what was written.  The loss mask is a list of character spans, one per
assistant text.  DataFrame operations only.

Edge cases: a null role or text counts as empty; a message whose parent isn't
there is a root; messages in a cycle of parents have no root and belong to no
branch; a null tree id is a tree of its own; repeated rows of a conversation
are turns of their own; ties between branches go to the smaller leaf; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.core import q
from tabsmith.session import cut_lineage

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
END_PATTERN = r"<\|im_end\|>\n"


def escape(text):
    """Add a backslash between ``<`` (and any backslashes after it) and ``|``."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text):
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role):
    """A role must stay on its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role):
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """``tree, leaf, rank, node, depth``: the messages of the ``keep`` best branches of each tree.

    ``messages``: ``tree`` (not null), ``node`` (unique in its tree), ``parent`` (or null) and ``score``."""
    m = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    have = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    # up: the message 2^k steps above; length, total: messages and scores from here to below it
    step = cut_lineage(m.join(have, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("length"),
        F.col("score").alias("total")))
    rounds = math.ceil(math.log2((step.groupBy("tree").count().agg(F.max("count")).first()[0] or 0) + 2))
    # only messages whose way to the root isn't known yet are joined again
    known, open_, steps = step.filter("up is null"), step.filter("up is not null"), []
    while len(steps) < rounds and open_.take(1):
        steps.append(open_)
        above = known.unionByName(open_).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"),
                                                F.col("length").alias("length2"), F.col("total").alias("total2"))
        further = cut_lineage(open_.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("length") + F.col("length2")).alias("length"),
            (F.col("total") + F.col("total2")).alias("total")))
        known, open_ = known.unionByName(further.filter("up is null")), further.filter("up is not null")
    whole = known
    leaves = whole.join(step.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("total") / F.col("length")).desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    found = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node")
    for table in reversed(steps):
        up = table.select("tree", "node", "up")
        found = cut_lineage(found.unionByName(found.join(up, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"))))
    return found.join(whole.select("tree", "node", F.col("length").alias("depth")), ["tree", "node"])


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``tree, leaf, formatted, loss_spans`` from ``tree, leaf, depth, role, text``: one conversation per branch.

    ``loss_spans``: ``[from, to)`` in code points of ``formatted``, one per text of ``loss_role``."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    t = turns.select("tree", "leaf", "depth", (F.coalesce("role", F.lit("")) == loss_role).alias("loss"),
                     head.alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END)))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    t = t.select("tree", "leaf", F.struct(
        "depth", F.concat("head", "body", F.lit(END)).alias("turn"), "loss",
        F.struct(F.col("at").alias("from"), (F.col("at") + F.length("body")).alias("to")).alias("span")).alias("t"))
    t = t.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return t.select("tree", "leaf", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
                    F.transform(F.filter("t", lambda x: x["loss"]), lambda x: x["span"]).alias("loss_spans"))


def parse(formatted):
    """The turns (role, text) of a formatted conversation, as an array of structs."""
    parts = F.split(formatted, END_PATTERN)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part):
        line = F.instr(part, "\n")
        return F.struct(unescape_role(F.substring(part, F.lit(len(START) + 1), line - F.lit(len(START) + 1))).alias("role"),
                        unescape(F.substring(part, line + F.lit(1), F.length(part))).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted, spans):
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), "")


def threads(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations as trees in which each turn answers the one before: ``tree, node, parent, score, role, text``."""
    i = F.col(q(id_col))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = turns.select(F.coalesce(i.cast("string"), F.lit("\x00")).alias("tree"), F.col(q(turn_col)).alias("turn"), "role", "text")
    t = t.withColumn("node", F.row_number().over(order).cast("long"))
    return t.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``id, formatted, loss_spans`` of each conversation of ``turns`` (role, text; by turn)."""
    messages = cut_lineage(threads(turns, id_col, turn_col))
    path = branches(messages).select("tree", "leaf", "node", "depth")
    out = format_turns(path.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]))
    kind = turns.schema[id_col].dataType
    return out.select(F.when(F.col("tree") != "\x00", F.col("tree")).cast(kind).alias(id_col), "formatted", "loss_spans")
