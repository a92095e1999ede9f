"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Rows near one of a few sampled centers form blocks of bounded size; queries form groups in the same way. A block
keeps a list of its rows for each dimension, sorted by the distance from the block's mean. For one query the lists
are read from the end that its sign prefers, all to one depth; rows seen get their whole score; no row that is
not seen scores more than the bound, the sum of what the lists hold at that depth. Reading ends when the
bound is less than the kth best score known. First each group meets the block of its own center, which
gives every query a kth score to begin with; with it most far blocks end at depth zero. A query whose bound cannot
fall below its kth score before most rows are seen reads the lists to their ends: then every row gets its
score by one matrix product. Scores are whole numbers, summed exactly.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm.common import cut

#: Rows of a block, queries of a group (about), and the most centers, which are sampled rows.
BLOCK, GROUP, CENTERS = 16_384, 4_096, 64
SCALE = 256
#: Depths at which a walk looks at its bound; beyond the last share of a list nearly all rows have been seen.
STEP, FIRST = 2, 4
#: Queries of one matrix product: bounds its result.
STRIP = 256
#: Sums of products up to this are exact in doubles.
EXACT = 2.0**53
MOST = 2**63 - 1
NO_SCORE = -(2**63)
HITS = "query_id long, query_row long, vec_id long, tie long, score long"


class Lists(NamedTuple):
    """A block: values (rows by dimensions), their mean rounded down, and for each dimension rows and values sorted by what exceeds the mean."""

    values: np.ndarray
    center: np.ndarray
    order: np.ndarray
    sorted: np.ndarray


def lists(values: np.ndarray) -> Lists:
    center = np.floor(values.mean(axis=0))
    rest = values - center
    order = np.argsort(rest, axis=0, kind="stable")
    return Lists(values, center, order, np.take_along_axis(rest, order, axis=0))


def depths(n: int, dim: int) -> list[int]:
    """Growing depths up to where all lists together could have shown half of the rows."""
    out, at = [0], FIRST
    while at * dim * 2 <= n:
        out.append(at)
        at *= STEP
    return out


def bounds(queries: np.ndarray, block: Lists, at: list[int]) -> np.ndarray:
    """The most that a row not seen at each depth can score, for every query: queries by depths."""
    n = len(block.values)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return (queries @ block.center)[:, None] + up @ block.sorted[[n - 1 - d for d in at]].T + down @ block.sorted[at].T


def best(scores: np.ndarray, ties: np.ndarray, k: int, least: float) -> np.ndarray:
    """The rows of the ``k`` highest scores that reach ``least``, ties to the smaller tie value."""
    who = np.flatnonzero(scores >= least)
    if len(who) > 4 * k:
        kth = np.partition(scores[who], len(who) - k)[len(who) - k]
        who = who[scores[who] >= kth]
    return who[np.lexsort((ties[who], -scores[who]))][:k]


def search(queries: np.ndarray, own: list[int | None], known: np.ndarray, block: Lists, ids: np.ndarray, ties: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Rows and scores of the ``k`` best of a block for each query, among those that reach its ``known`` kth score, and how many rows were scored.

    ``own`` is the id that a query's own rows have (``ids``), which do not count.
    """
    n, dim = block.values.shape
    at = depths(n, dim)
    bound = bounds(queries, block, at)
    rows: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    scores: list[np.ndarray] = [np.zeros(0)] * len(queries)
    todo, scored = [], 0
    for i, q in enumerate(queries):
        least = known[i]
        if bound[i, 0] < least:
            continue
        signs = np.sign(q)
        seen = np.zeros(0, np.int64)
        done = False
        for r, depth in enumerate(at[1:], 1):
            tops = block.order[n - depth :, signs > 0].ravel(), block.order[:depth, signs < 0].ravel()
            seen = np.unique(np.concatenate(tops))
            seen = seen[ids[seen] != own[i]] if own[i] is not None else seen
            got = block.values[seen] @ q
            scored += len(seen)
            top = best(got, ties[seen], k, least)
            kth = max(least, got[top[-1]]) if len(top) == k else least
            if bound[i, r] < kth:
                rows[i], scores[i], done = seen[top], got[top], True
                break
            if bound[i, -1] >= kth:  # no depth of the walk would end it
                break
        if not done:
            todo.append(i)
    for s in range(0, len(todo), STRIP):
        part = todo[s : s + STRIP]
        got = queries[part] @ block.values.T
        scored += got.size
        for i, row in zip(part, got, strict=True):
            if own[i] is not None:
                row = np.where(ids == own[i], -np.inf, row)
            top = best(row, ties, k, max(known[i], np.finfo(float).min))
            rows[i], scores[i] = top, row[top]
    return rows, scores, scored


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows; what a shorter one lacks is zero."""
    flat = column.combine_chunks()
    size = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dim).all():
        return values.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = values
    return out


def exact_hits(queries: np.ndarray, own: list, known: np.ndarray, values: np.ndarray, ids: np.ndarray, ties: np.ndarray, k: int) -> tuple[list[np.ndarray], list[list[int]]]:
    """As ``search`` for components too large for doubles: sums of Python integers, kept inside a long; rows in turn."""
    whole = [[int(x) for x in v] for v in values]
    rows, scores = [], []
    for i, q in enumerate(queries):
        q = [int(x) for x in q]
        got = {r: max(NO_SCORE, min(MOST, sum(a * b for a, b in zip(q, v, strict=True)))) for r, v in enumerate(whole) if own[i] is None or ids[r] != own[i]}
        top = sorted((r for r in got if got[r] >= known[i]), key=lambda r: (-got[r], ties[r]))[:k]
        rows.append(np.array(top, np.int64))
        scores.append([got[r] for r in top])
    return rows, scores


def meet(k: int):
    """A function for cogrouped tables: (cell, query_id, query_row, known, asked) with (cell, vec_id, tie, vector)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in HITS.split(", ")]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        longest = lambda column: pc.max(pc.list_value_length(column)).as_py()
        dim = max(longest(left["asked"]), longest(right["vector"]), 1)
        queries, values = matrix(left["asked"], dim), matrix(right["vector"], dim)
        ids = right["vec_id"].to_numpy(zero_copy_only=False) if not right["vec_id"].null_count else np.array(right["vec_id"].to_pylist(), object)
        ties, own, known = right["tie"].to_numpy(), left["query_id"].to_pylist(), left["known"].to_numpy().astype(object)
        size = np.abs(queries).max(initial=0) * (2 * np.abs(values).max(initial=0) + 1) * dim
        if size < EXACT:
            block = lists(values)
            rows, scores, _ = search(queries, own, np.where(known == NO_SCORE, -np.inf, known).astype(float), block, ids, ties, k)
        else:
            rows, scores = exact_hits(queries, own, known, values, ids, ties, k)
        n = [len(r) for r in rows]
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        out = [left[c].take(pa.array(np.repeat(np.arange(len(n)), n))) for c in ("query_id", "query_row")]
        out += [right[c].take(pa.array(at)) for c in ("vec_id", "tie")]
        return pa.table(dict(zip(names, [*out, pa.array([int(x) for s in scores for x in s], pa.int64())], strict=True)))

    return run


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, tie, row): components scaled and rounded down; vectors that are null or hold null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(x.isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("vector"))
    return rows.select("vec_id", "vector", F.coalesce("vec_id", F.lit(MOST)).alias("tie"), F.xxhash64("vec_id", "vector").alias("row"))


def whole(v: Column) -> Column:
    """``SCALE`` times a component, rounded down, as a double: a long would not hold the largest ones."""
    big = v * SCALE
    return F.when(F.abs(big) < 2.0**52, F.floor(big).cast("double")).otherwise(big)


def near(centers: list[list[float]]) -> Column:
    """The number of the center with the largest inner product less half its own square: the nearest one."""
    if len(centers) < 2:
        return F.lit(0)
    product = lambda a, b: F.coalesce(a * b, F.lit(0.0))
    dot = lambda c: F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(x)) for x in c]), product), F.lit(0.0), lambda s, x: s + x)
    fit = F.array(*[dot(c) - sum(x * x for x in c) / 2 for c in centers])
    return F.greatest(F.array_position(fit, F.array_max(fit)).cast("int") - 1, F.lit(0))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, group: int = GROUP, centers: int = CENTERS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` the ``k`` rows with the highest inner product.

    ``vectors`` has vec_id and embedding; other columns are ignored. A query's own rows are those with its vec_id.
    Null ids are candidates only and come last among ties. Repeated rows are candidates each; a repeated query
    counts once (an id with two vectors is two queries). What a shorter vector lacks counts as zero;
    scores beyond a long stay at its ends. Fewer candidates than ``k`` give fewer rows; an empty table gives none.
    """
    rows = cut(prepared(vectors), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "row"])
    n = rows.count()
    few = min(centers, -(-n // block))
    sample = [r.vector for r in rows.select("vector", "row").distinct().orderBy("row", "vector").limit(few).collect()] if few > 1 else []
    placed = rows.withColumn("center", near(sample))
    sizes = {r.center: r.n for r in placed.groupBy("center").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a block and a group are a center and a share of its rows; copies of one vector are dealt out by their ids
    cells = [(c, s) for c, m in sorted(sizes.items()) for s in range(-(-m // block))]
    first = {c: cells.index((c, 0)) for c in sizes}
    groups = max(1, -(-n // (every * group)))
    if not cells:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("center") + 1)
    shares, begins = [-(-sizes.get(c, 0) // block) or 1 for c in range(max(sizes) + 1)], [first.get(c, 0) for c in range(max(sizes) + 1)]
    index = placed.select("vec_id", "tie", "vector", (at(begins) + F.pmod(F.xxhash64("tie", "row"), at(shares))).cast("int").alias("block"))
    queries = asked.withColumn("center", near(sample)).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("vector").alias("asked"), at(begins).alias("home"), F.pmod("row", F.lit(groups)).cast("int").alias("group"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.select("cell", "query_id", "query_row", "known", "asked").groupBy("cell")
        return left.cogroup(right.select("cell", "vec_id", "tie", "vector").groupBy("cell")).applyInArrow(meet(k), HITS)

    none = F.lit(NO_SCORE).cast("long").alias("known")
    cell = lambda b, g: (F.col(b).cast("long") * groups + F.col(g)).alias("cell")
    every_group, every_block = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1)))
    spread = index.withColumn("group", every_group)
    at_home = met(queries.select(cell("home", "group"), "*", none), spread.where(F.col("block").isin(*begins)).select(cell("block", "group"), "*"))
    at_home = cut(at_home, "home")
    floor = at_home.groupBy("query_id", "query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("known"))
    left = queries.join(floor, ["query_id", "query_row"], "left").withColumn("known", F.coalesce("known", F.lit(NO_SCORE))).withColumn("block", every_block)
    far = met(left.where("block <> home").select(cell("block", "group"), "*"), spread.select(cell("block", "group"), "*")) if len(cells) > 1 else at_home.limit(0)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "tie")
    ranked = at_home.unionByName(far).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
