"""Trajectory graph of tool calls: chain edges, back edges to the previous call with the same key, loops.

Components need no iteration: with chain edges and back edges only, a call starts a new component
exactly if no later call (itself included) points back before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions.columns import has_error, in_order, ratio

LOOP = 3


def grounded(turns: DataFrame) -> DataFrame:
    """One row per call in order (``seq`` from 0): file, symbol, key and if it mutates. Git commands mutate by their second word."""
    c = turns.select("session_key", "turn_index", F.posexplode("tool_calls").alias("call_pos", "call"))
    kind, arg = F.col("call.intent.kind"), F.col("call.intent")
    file = F.when(kind.isin("FileRead", "FileEdit", "FileCreate"), arg.path)
    symbol = F.when(kind == "CodeSearch", arg["query"])
    second = F.get(F.split(F.trim(arg.action), r"\s+"), F.lit(1))
    mutates = kind.isin("FileEdit", "FileCreate") | ((kind == "VersionControl") & F.coalesce(second.isin("commit", "push"), F.lit(False)))
    seq = F.row_number().over(Window.partitionBy("session_key").orderBy("turn_index", "call_pos")).cast("long") - 1
    return c.select("session_key", "turn_index", seq.alias("seq"), kind.alias("kind"), file.alias("file"), symbol.alias("symbol"), F.coalesce(symbol, file).alias("key"), mutates.alias("mutates"))


def with_back_edges(nodes: DataFrame) -> DataFrame:
    same = Window.partitionBy("session_key", "key").orderBy("seq")
    return nodes.withColumn("back", F.when(F.col("key").isNotNull(), F.lag("seq").over(same)))


def edges(nodes: DataFrame) -> DataFrame:
    """(session_key, src, dst, kind) of chain and back edges."""
    both = F.array(
        F.struct((F.col("seq") - 1).alias("src"), F.col("seq").alias("dst"), F.lit("chain").alias("edge")),
        F.struct(F.col("seq").alias("src"), F.col("back").alias("dst"), F.lit("back").alias("edge")),
    )
    return with_back_edges(nodes).select("session_key", F.inline(both)).where("src >= 0 and dst is not null")


def components(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``component``, numbered from 1 in order."""
    w = Window.partitionBy("session_key").orderBy("seq")
    reach = F.min("back").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = with_back_edges(nodes).withColumn("reach", reach)
    starts = F.col("reach").isNull() | (F.col("reach") > F.col("seq") - 1)
    return rows.withColumn("component", F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("reach")


def component_sums(nodes: DataFrame) -> DataFrame:
    """One row per component: size, its key if all calls share one, whether it is a loop, and the calls that mutate.

    A loop has at least ``LOOP`` calls, all on one key, none of which mutates.
    """
    c = components(nodes).groupBy("session_key", "component").agg(
        F.count(F.lit(1)).alias("size"), F.count("key").alias("keyed"), F.min("key").alias("key"), F.max("key").alias("top"), F.count_if("mutates").alias("changes"),
    )
    loop = (F.col("size") >= LOOP) & (F.col("keyed") == F.col("size")) & (F.col("key") == F.col("top")) & (F.col("changes") == 0)
    return c.select("session_key", "component", "key", "size", "changes", F.coalesce(loop, F.lit(False)).alias("loop"))


def circular_loops(nodes: DataFrame) -> DataFrame:
    """(session_key, component, key, size): components of at least three calls, all on one key, none of which mutates."""
    return component_sums(nodes).where("loop").select("session_key", "component", "key", "size")


def node_metrics(nodes: DataFrame) -> DataFrame:
    """(session_key, n_nodes, efficiency, monotonicity, n_loops), summed from the components in the partitioning they have."""
    size = F.sum("size")
    sums = component_sums(nodes).groupBy("session_key").agg(size.alias("n_nodes"), ((size + F.sum("changes")) * 0.5 / size).alias("efficiency"), F.sum(F.when(F.col("loop"), F.col("size")).otherwise(0)).alias("looping"), F.count_if("loop").alias("n_loops"))
    return sums.select("session_key", "n_nodes", "efficiency", (1 - F.least(F.lit(1.0), F.col("looping") / F.col("n_nodes"))).alias("monotonicity"), "n_loops")


def monotonicity(nodes: DataFrame) -> DataFrame:
    return node_metrics(nodes).select("session_key", "n_nodes", "efficiency", "monotonicity")


def turn_metrics(turns: DataFrame) -> DataFrame:
    """(session_key, grounding, recovery) in one pass over the turns.

    Grounding is the share of calls that are not a read, edit or search without an argument; recovery that of error
    turns that are followed by a turn without error. Each is 1 where there is nothing to share.
    """
    kind = lambda c: c.intent.kind
    blank = lambda c: (kind(c).isin("FileRead", "FileEdit") & (F.coalesce(c.intent.path, F.lit("")) == "")) | ((kind(c) == "CodeSearch") & (F.coalesce(c.intent["query"], F.lit("")) == ""))
    rows = turns.select("session_key", "turn_index", F.size("tool_calls").alias("n"), F.size(F.filter("tool_calls", lambda c: ~blank(c))).alias("good"), has_error().alias("wrong"))
    rows = rows.withColumn("next", F.lead("wrong").over(in_order()))
    out = rows.groupBy("session_key").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count_if("wrong").alias("errors"), F.count_if(F.col("wrong") & ~F.col("next")).alias("mended"))
    return out.select("session_key", ratio(F.col("good"), F.col("n"), 1.0).alias("grounding"), ratio(F.col("mended"), F.col("errors"), 1.0).alias("recovery"))


def grounding_score(turns: DataFrame) -> DataFrame:
    return turn_metrics(turns).select("session_key", "grounding")


def recovery_index(turns: DataFrame) -> DataFrame:
    return turn_metrics(turns).select("session_key", "recovery")


def trajectory_metrics(turns: DataFrame) -> DataFrame:
    """Monotonicity, efficiency, grounding, recovery and the number of loops of every session: one pass over turns, one over calls."""
    out = turn_metrics(turns).join(node_metrics(grounded(turns)), "session_key", "left")
    return out.select("session_key", *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("monotonicity", "efficiency", "grounding", "recovery")], F.coalesce("n_loops", F.lit(0)).alias("n_loops"))
