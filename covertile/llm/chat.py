"""Chat formatting of reply trees. DataFrame functions only.

A message is (tree, node, parent, role, text, score). Iterative self-joins double each node's jump to its ancestors, so
depth d takes about log2(d) joins; the summed score of a root-to-leaf path ranks its leaf; the chosen leaves' paths are
collected by the same jumps and each becomes one conversation.

Template: ``<|role|>`` + text + ``<|end|>``. A control string is ``<``, any backslashes, ``|``; inside texts and roles each
gets one more backslash, which reading takes away again, so the formatted text reads back exactly; ``|>`` and ``%`` in
roles are written as %7C> and %25.

Cases: null texts are empty, null roles ``unknown``; rows of one turn follow each other by role and text; null turns come
first; repeated rows are turns of their own; a node whose parent is missing is a root; on a cycle of parents (a node that is its own
parent too) the smallest node is the root; an empty table gives no rows; messages without a tree (null) are one tree. Nodes of a tree have
different numbers; of rows that repeat one, the first by parent, role, text and score stays. Conversations and texts are taken whole; a
conversation is one string. Only the named columns are read, whatever others there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covertile.llm.common import saved

END = "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("%"), F.lit("%25")), F.lit("|>"), F.lit("%7C>"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%")))


def threads(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows by turn as reply trees: each message answers the one before it. The score of a message is its length."""
    w = Window.partitionBy(tree).orderBy(turn, "role", "text")
    node = F.row_number().over(w).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(F.col(tree).alias("tree"), node.alias("node"), F.when(node > 1, node - 1).alias("parent"), F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("text"), F.length(text).cast("double").alias("score"))


def _keyed(messages: DataFrame) -> DataFrame:
    """``messages`` with the tree in a struct: that is never null, and structs of a null are equal, so joins keep the null tree."""
    return messages.withColumn("tree", F.struct("tree"))


def _once(messages: DataFrame) -> DataFrame:
    """One row for each node; ``threads`` has no other."""
    w = Window.partitionBy("tree", "node").orderBy(F.col("parent").asc_nulls_first(), *(c for c in ("role", "text", "score") if c in messages.columns))
    return messages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, branch, node, depth) of the nodes on each tree's ``top`` best root-to-leaf paths (ties: smaller leaf).

    branch is the path's rank from 1. Only ids and scores are joined, never texts.
    """
    return _paths(_keyed(_once(messages)), top).withColumn("tree", F.col("tree.tree"))


def _paths(messages: DataFrame, top: int) -> DataFrame:
    nodes = messages.select("tree", "node", "parent", "score")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    # a parent that is not there makes a root; low is the smallest ancestor that jumps have passed
    up = F.when(F.col("known"), F.col("parent"))
    step = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", up.alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth"), up.alias("low"))
    first = saved(step)
    # after so many jumps every node of a tree has passed its root, unless it leads into a cycle
    largest = first.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # nodes whose jump passed the root are done; only the others are joined and written again
    done, active, jumps = [first.filter("up is null")], first.filter("up is not null"), []
    while not active.isEmpty():
        if len(jumps) > int(largest).bit_length():
            roots = active.filter("low = node").select("tree", "node", F.lit(True).alias("_root"))
            cut = nodes.join(roots, ["tree", "node"], "left").withColumn("parent", F.when(F.col("_root").isNull(), F.col("parent"))).drop("_root")
            return _paths(saved(cut), top)
        jumps.append(active.select("tree", "node", "up"))
        level = reduce(DataFrame.unionByName, [*done, active])
        over = level.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2"), F.col("low").alias("l2"))
        step = saved(active.join(over, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("depth") + F.col("d2")).alias("depth"), F.least("low", "l2").alias("low")))
        done.append(step.filter("up is null"))
        active = step.filter("up is not null")
    level = reduce(DataFrame.unionByName, done)
    inner = first.filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = level.join(inner, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    path = leaves.withColumn("branch", rank).filter(F.col("branch") <= top).select("tree", "branch", "node", "depth")
    for k in range(len(jumps) - 1, -1, -1):  # ancestors 2^k above what is there
        above = path.join(jumps[k], ["tree", "node"]).select("tree", "branch", F.col("up").alias("node"), (F.col("depth") - F.lit(1 << k)).alias("depth"))
        path = saved(path.unionByName(above))
    return path


def formatted(messages: DataFrame, top: int = 1, once: bool = False) -> DataFrame:
    """(tree, branch, formatted): one string for each chosen path. ``once``: no node stands twice, as in ``threads``."""
    messages = _keyed(messages if once else _once(messages))
    path = _paths(messages, top)
    turn = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>"), escape(F.col("text")), F.lit(END))
    lines = path.join(messages.select("tree", "node", turn.alias("line")), ["tree", "node"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "line"))), lambda x: x["line"]), "")
    return lines.groupBy("tree", "branch").agg(joined.alias("formatted")).withColumn("tree", F.col("tree.tree"))


def read_back(text: Column) -> Column:
    """array<struct(role, text)> of a formatted conversation; the loss mask covers the texts of assistants."""
    parts = F.filter(F.split(text, r"<\|end\|>", -1), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(unescape_role(F.substring_index(F.substring(s, 3, 2147483647), "|>", 1)).alias("role"), unescape(F.substring(s, F.instr(s, "|>") + 2, F.lit(2147483647))).alias("text")))


def report(rows: DataFrame) -> DataFrame:
    """The digest columns of the contract, read back from the formatted conversations."""
    out = formatted(threads(rows), once=True).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
