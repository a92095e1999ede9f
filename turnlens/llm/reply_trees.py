"""Chat formatting of reply trees (DataFrame and SQL functions only).

Nodes (conv_id, node, parent, role, text, score) form trees. Self-joins that double the length of
each node's upward jump find every node's depth and the score of its path from the root in a
logarithmic number of rounds; leaves are root-to-leaf paths, ranked by that score; the same jumps
walk the chosen leaves back to their roots. Only ids travel in these joins, texts join once.

Template per turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles ``&`` becomes ``&amp;``
and ``<|`` becomes ``&lt;|`` (a line feed in a role ``&#10;``), so no control string can occur in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def linear_nodes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees: each row replies to the one before it.

    Rows of one conversation are ordered by turn (nulls first), ties by role and text; null ids make
    one conversation; null roles and texts count as empty.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    nodes = turns.select(
        "conv_id", F.row_number().over(order).cast("long").alias("node"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return nodes.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def one_of_each(nodes: DataFrame) -> DataFrame:
    """``nodes`` with one row per (conv_id, node): of several the first by parent, role, text and score, nulls first."""
    first = F.min(F.struct("parent", "role", "text", F.col("score").cast("double").alias("score")))
    return nodes.groupBy("conv_id", "node").agg(first.alias("_")).select("conv_id", "node", "_.*")


def upward(ids: DataFrame) -> list[DataFrame]:
    """Jumps (conv_id, node, up, depth, total, least) of doubling length; in the last one every node has reached its root or runs in a cycle."""
    same = lambda a, b: a.eqNullSafe(b)
    n, p = ids.alias("n"), ids.select("conv_id", "node").alias("p")
    hop = n.join(p, same(F.col("n.conv_id"), F.col("p.conv_id")) & (F.col("n.parent") == F.col("p.node")), "left")
    jump = cut(hop.select("n.conv_id", "n.node", F.col("p.node").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("n.score").alias("total"), F.col("n.node").alias("least")), "reply-jump")
    jumps = [jump]
    most = None
    while jump.where("up is not null").limit(1).count():
        if most is None:
            most = ids.groupBy("conv_id").count().agg(F.max("count")).first()[0]
        if 2 ** (len(jumps) - 1) > most:
            break
        a, b = jump.where("up is not null").alias("a"), jump.alias("b")  # nodes that reached their root are done
        joined = a.join(b, same(F.col("a.conv_id"), F.col("b.conv_id")) & (F.col("a.up") == F.col("b.node")))
        longer = joined.select(
            "a.conv_id", "a.node", "b.up", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.total") + F.col("b.total")).alias("total"),
            F.least("a.least", "b.least").alias("least"),
        )
        jump = cut(longer.unionByName(jump.where("up is null")), "reply-jump")
        jumps.append(jump)
    return jumps


def best_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """The ``paths`` best root-to-leaf paths of each conversation: (conv_id, path, depth, node).

    A path's score is the sum of its nodes' scores (null: 0), ties go to the smaller leaf. A parent that
    does not exist makes a root; a cycle is opened at its smallest node, which becomes a root. Of several
    rows with one conv_id and node ``one_of_each`` takes the first; rows with a null node are left out;
    null conv_ids make one conversation; an empty table gives no paths.
    """
    same = lambda a, b: a.eqNullSafe(b)
    ids = one_of_each(nodes.where("node is not null")).select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    jumps = upward(ids)
    jump = jumps[-1]
    if jump.where("up is not null").limit(1).count():
        # so many steps on, every walk that has not ended is inside its cycle and has gone all the way round it
        open_ = jump.where("up is not null")
        inside = open_.select("conv_id", F.col("up").alias("node")).distinct().alias("i")
        o = open_.select("conv_id", "node", "least").alias("o")
        heads = o.join(inside, same(F.col("o.conv_id"), F.col("i.conv_id")) & (F.col("o.node") == F.col("i.node")), "left_semi").where("node = least").select("conv_id", "node").alias("h")
        opened = ids.alias("n").join(heads, same(F.col("n.conv_id"), F.col("h.conv_id")) & (F.col("n.node") == F.col("h.node")), "left")
        jumps = upward(cut(opened.select("n.conv_id", "n.node", F.when(F.col("h.node").isNull(), F.col("n.parent")).alias("parent"), "n.score"), "reply-opened"))
        jump = jumps[-1]
    replied = jumps[0].where("up is not null").select(F.col("conv_id").alias("c"), F.col("up").alias("u")).distinct()
    leaves = jump.join(replied, same(F.col("conv_id"), F.col("c")) & (F.col("node") == F.col("u")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "node"))
    chosen = leaves.withColumn("path", rank).where(F.col("path") <= paths).select("conv_id", "path", "node")
    for up in reversed(jumps[:-1]):  # every node also names the one its jump ends at
        a, b = chosen.alias("a"), up.where("up is not null").alias("b")
        joined = a.join(b, same(F.col("a.conv_id"), F.col("b.conv_id")) & (F.col("a.node") == F.col("b.node")), "left")
        chosen = joined.select("a.conv_id", "a.path", F.explode(F.array_compact(F.array("a.node", "b.up"))).alias("node"))
    a, b = chosen.alias("a"), jump.alias("b")
    return a.join(b, same(F.col("a.conv_id"), F.col("b.conv_id")) & (F.col("a.node") == F.col("b.node"))).select("a.conv_id", "a.path", "b.depth", "a.node")


def format_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """Each chosen path as one conversation: conv_id, path, formatted, mask.

    ``mask`` holds (start, length) in code points of the assistant texts inside ``formatted``. One
    conversation is one output row, so its turns meet in one task by the nature of the result. Null roles
    and texts are empty; columns beside those of nodes are left out; see ``best_paths`` for the rest.
    """
    a, b = best_paths(nodes, paths).alias("a"), one_of_each(nodes).alias("b")
    turns = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.node") == F.col("b.node"))).select(
        "a.conv_id", "a.path", "a.depth",
        F.replace(escape(F.coalesce("b.role", F.lit(""))), F.lit("\n"), F.lit("&#10;")).alias("role"),
        (F.coalesce("b.role", F.lit("")) == "assistant").alias("loss"),
        escape(F.coalesce("b.text", F.lit(""))).alias("text"),
    )
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    turns = turns.select("*", F.concat(head, "text", F.lit(END + "\n")).alias("chunk"), F.char_length(head).alias("skip"), F.char_length("text").alias("len"))
    before = Window.partitionBy("conv_id", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.char_length("chunk")).over(before), F.lit(0)) + F.col("skip"))
    return turns.groupBy("conv_id", "path").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "chunk"))), lambda x: x.chunk), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), F.struct(F.col("start").cast("int").alias("start"), F.col("len").cast("int").alias("length"))))).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) parsed from the formatted string and the texts under its loss mask, unescaped."""
    parts = F.slice(F.split(F.col("formatted"), r"<\|im_end\|>\n"), 1, F.size(F.split(F.col("formatted"), r"<\|im_end\|>\n")) - 1)
    body = lambda x: F.substr(x, F.lit(len(START) + 1))
    turns = F.transform(parts, lambda x: F.struct(
        unescape(F.replace(F.substring_index(body(x), "\n", 1), F.lit("&#10;"), F.lit("\n"))).alias("role"),
        unescape(F.substr(body(x), F.char_length(F.substring_index(body(x), "\n", 1)) + 2)).alias("text"),
    ))
    loss = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m.start + 1, m.length)))
    return formatted.select("conv_id", "path", "formatted", turns.alias("turns"), loss.alias("loss"))
