"""Maximal cliques of an undirected graph, one small search for each vertex."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions.shared import written


#: Rows of a batch of results.
RESULTS = 20_000


class Cliques(NamedTuple):
    """``members`` (root, nth, node): the maximal cliques by their first vertex; ``twins`` (node, twin): what each node stands for."""

    members: DataFrame
    twins: DataFrame


def twin_classes(edges: DataFrame) -> DataFrame:
    """(node, twin) of every node of ``edges`` (a, b): the least node with the same neighbours, itself included.

    Twins are adjacent and stand in the same maximal cliques, so a dense group is searched as one node. Neighbourhoods
    are compared by their size and two 64-bit sums of hashes, never collected.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = both.unionByName(both.select("a", F.col("a").alias("b")).distinct())
    mark = lambda salt: F.sum(F.xxhash64("b", F.lit(salt)).cast("decimal(38,0)"))
    marks = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), mark(1).alias("x"), mark(2).alias("y"))
    return marks.select("node", F.min("node").over(Window.partitionBy("n", "x", "y")).alias("twin"))


def around(rows: list[tuple[str, str, str, str | None]]) -> Iterator[tuple[str, ...]]:
    """The maximal cliques whose first vertex is that of the rows (root, kind, x, y)."""
    root = rows[0][0]
    near: dict[str, set[str]] = {}
    may, seen = set(), set()
    for _, kind, x, y in rows:
        if kind == "later":
            may.add(x)
            continue
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
        if kind == "earlier":
            seen.add(x)
    none: set[str] = set()
    todo = [((), may, seen)]
    while todo:  # candidates that are no neighbours of the pivot open a branch each
        chosen, may, seen = todo.pop()
        if not may:
            if not seen:
                yield (root, *chosen)
            continue
        pivot = max(may | seen, key=lambda v: (len(near.get(v, none) & may), v))
        for v in sorted(may - near.get(pivot, none)):
            near_v = near.get(v, none)
            todo.append(((*chosen, v), may & near_v, seen & near_v))
            may, seen = may - {v}, seen | {v}


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cliques of rows (root, kind, x, y) that come sorted by root, as rows (root, nth, node); a root may go on in the next batch.

    One root's rows and one batch of results are in memory, and no pandas frame is built for each root.
    """
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    found = ((root, n, v) for root, group in groupby(rows, key=itemgetter(0)) for n, clique in enumerate(around(list(group))) for v in clique)
    while some := list(islice(found, RESULTS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["root", "nth", "node"])


def maximal_cliques(edges: DataFrame) -> Cliques:
    """All maximal cliques of at least two nodes of ``edges`` (a, b), strings, each edge once or twice in any direction.

    Twins are merged first. Edges then point from the node of lower to that of higher (degree, name), so
    no node has more than sqrt(2 * edges) later neighbours. A task gets one node, the edges among
    its later neighbours, and those between them and earlier ones, which tell whether a clique is maximal; all
    come from one join for triangles, bounded by edges * sqrt(2 * edges). Cliques of a component never meet in one task.
    The cliques are written once, so however often ``members`` is read, they are searched once.
    """
    edges = written(edges.select("a", "b"), "edges")
    twins = written(twin_classes(edges), "twins")
    name = lambda c: twins.select(F.col("node").alias(c), F.col("twin").alias(f"{c}_twin"))
    pairs = edges.join(name("a"), "a").join(name("b"), "b").select(F.least("a_twin", "b_twin").alias("a"), F.greatest("a_twin", "b_twin").alias("b")).where("a <> b").distinct()
    pairs = written(pairs, "reduced")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    rank = lambda c: degree.select(F.col("node").alias(c), F.struct("d", "node").alias(f"{c}_rank"))
    ranked = pairs.join(rank("a"), "a").join(rank("b"), "b").select(F.least("a_rank", "b_rank").alias("u"), F.greatest("a_rank", "b_rank").alias("v"))
    later = written(ranked.select(F.col("u.node").alias("u"), F.col("v.node").alias("v"), F.col("v.d").alias("d")), "later")
    one, two = later.select("u", F.col("v").alias("x"), F.col("d").alias("dx")), later.select("u", F.col("v").alias("y"), F.col("d").alias("dy"))
    wedges = one.join(two, "u").where(F.struct("dx", "x") < F.struct("dy", "y")).select("u", "x", "y")
    triangles = written(wedges.join(later.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"]).select("u", "x", "y"), "triangles")
    rows = (
        later.select(F.col("u").alias("root"), F.lit("later").alias("kind"), F.col("v").alias("x"), F.lit(None).cast("string").alias("y"))
        .unionByName(triangles.select(F.col("u").alias("root"), F.lit("among").alias("kind"), "x", "y"))
        .unionByName(triangles.select(F.col("x").alias("root"), F.lit("earlier").alias("kind"), F.col("u").alias("x"), "y"))
    )
    found = rows.repartition("root").sortWithinPartitions("root").mapInArrow(search, "root string, nth long, node string")
    alone = twins.select(F.col("twin").alias("node")).distinct().join(later.select(F.explode(F.array("u", "v")).alias("node")), "node", "left_anti")
    members = found.unionByName(alone.select(F.col("node").alias("root"), F.lit(0).cast("long").alias("nth"), "node"))
    return Cliques(written(members, "cliques"), twins)
