"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame and SQL functions only).

The ring has ``RING`` slots. Each shard owns ``vnodes`` slots; a row goes to the slot of its id's
hash and from there clockwise to the next virtual node whose shard has room. Rows of one arc (the
slots before a virtual node) are alike to the ring, so the walk runs on the counts of arcs, at most
``shards * vnodes`` rows whatever the input; rows then look up their rank in the arc.

Law ``rows``: the capacities of the shards add up to the number of rows and differ by at most one,
so every shard ends exactly full.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = 16_384


def ring_nodes(shards: int, vnodes: int) -> list[tuple[int, list[int]]]:
    """(slot, shards in clockwise order from it) of each occupied slot; from the parameters alone."""
    at: dict[int, set[int]] = {}
    for shard in range(shards):
        for replica in range(vnodes):
            digest = hashlib.sha256(f"{shard}#{replica}".encode()).digest()
            at.setdefault(int.from_bytes(digest[:8], "big") % RING, set()).add(shard)
    slots = sorted(at)
    out = []
    for k, slot in enumerate(slots):
        order: list[int] = []
        for other in slots[k:] + slots[:k]:
            order += [s for s in sorted(at[other]) if s not in order]
            if len(order) == shards:
                break
        out.append((slot, order))
    return out


def place_arcs(arcs: DataFrame, shards: int) -> DataFrame:
    """Bounded loads over (arc, prefs, n): rows (arc, shard, lo, hi, base), where ranks lo..hi-1 of the
    arc take the slots from ``base`` of the shard. Arcs come in ring order; what a full shard cannot
    take goes on to the next shard clockwise."""
    one = arcs.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("arc", "prefs", "n"))).alias("arcs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )
    walked = one.where("size(arcs) > 0").selectExpr(
        f"""
        aggregate(
          arcs,
          named_struct(
            'room', transform(sequence(0, {shards} - 1), s -> total div {shards} + if(s < total % {shards}, 1L, 0L)),
            'put', cast(array() as array<struct<arc: int, shard: int, n: bigint>>)),
          (st, a) -> aggregate(
            a.prefs,
            named_struct('left', a.n, 'room', st.room, 'put', st.put),
            (x, s) -> if(least(x.left, x.room[s]) = 0, x, named_struct(
              'left', x.left - least(x.left, x.room[s]),
              'room', transform(x.room, (r, i) -> if(i = s, r - least(x.left, r), r)),
              'put', concat(x.put, array(named_struct('arc', a.arc, 'shard', s, 'n', least(x.left, x.room[s])))))),
            x -> named_struct('room', x.room, 'put', x.put)),
          st -> transform(st.put, (p, i) -> named_struct('arc', p.arc, 'shard', p.shard, 'n', p.n, 'pos', i))
        ) AS put"""
    )
    pieces = walked.select(F.expr("inline_outer(put)")).where("arc is not null")
    in_arc, in_shard = Window.partitionBy("arc").orderBy("pos"), Window.partitionBy("shard").orderBy("pos")
    return pieces.select(
        "arc", "shard",
        (F.sum("n").over(in_arc) - F.col("n")).alias("lo"),
        F.sum("n").over(in_arc).alias("hi"),
        (F.sum("n").over(in_shard) - F.col("n")).alias("base"),
    )


def shard_rows(docs: DataFrame, shards: int = 16, vnodes: int = 64) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its shard and its slot there.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32, shard, slot. Null texts count as empty,
    null ids are keyed by their text; repeated rows each get a slot of their own; an empty table
    gives no rows. Only ids and sizes are shuffled, never texts.
    """
    nodes = ring_nodes(shards, vnodes)
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))).alias("_h"),
    ).withColumn("_slot", F.pmod("_h", F.lit(RING)).cast("int"))
    arc_of, k = [], 0
    for slot in range(RING):
        while k < len(nodes) and nodes[k][0] < slot:
            k += 1
        arc_of.append(k % len(nodes))
    ring = spark.range(RING).select(
        F.col("id").cast("int").alias("_slot"),
        F.element_at(F.lit(arc_of), (F.col("id") + 1).cast("int")).alias("arc"),
    )
    counts = rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(ring), "_slot")
    prefs = spark.range(len(nodes)).select(
        F.col("id").cast("int").alias("arc"),
        F.element_at(F.array(*[F.lit(p) for _, p in nodes]), (F.col("id") + 1).cast("int")).alias("prefs"),
    )
    arcs = counts.groupBy("arc").agg(F.sum("n").alias("n")).join(F.broadcast(prefs), "arc")
    pieces = place_arcs(arcs.select("arc", "prefs", "n"), shards)
    per_arc = pieces.groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("hi", "lo", "shard", "base"))).alias("pieces"))
    before = Window.partitionBy("arc").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).join(per_arc, "arc")
    rank = F.row_number().over(Window.partitionBy("_slot").orderBy("_h", "doc_id", "text_crc32", "size"))
    placed = (
        rows.withColumn("_rank", rank - 1)
        .join(slots.select("_slot", "offset", "pieces"), "_slot")
        .withColumn("_at", F.col("offset") + F.col("_rank"))
        .withColumn("_p", F.filter("pieces", lambda p: p.hi > F.col("_at"))[0])
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("_p.shard").alias("shard"),
        (F.col("_p.base") + F.col("_at") - F.col("_p.lo")).alias("slot"),
    )
