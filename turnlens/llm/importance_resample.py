"""Resampling towards a target distribution by hashed n-gram importance.

Every task interns the n-grams of a batch in an open-addressed NumPy table: XXH64 of an n-gram's bytes
picks its slot, linear probing goes on from there, and a slot counts as found only if the bytes are equal too. A
slot keeps the bucket of its n-gram and how often it occurs; each occurrence keeps the number of its slot. A first
pass adds the slots' counts up by bucket, a second one gathers the gains of the buckets by the occurrences'
slots. What leaves a task is one row for each bucket, or one for each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm.common import cut, whole_text

#: Bytes of text that are interned together: bounds a task's memory unless one text is longer.
BATCH = 4 << 20
#: Words longer than this are hashed one by one; the shorter ones in columns of eight bytes.
LANES = 32
SCALE, OFFSET = 1000, 4294967296
U = np.uint64
# The five primes of XXH64.
P1, P2, P3, P4, P5 = (U(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32  # A-Z
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1)


class Grams(NamedTuple):
    """N-grams of a batch: ``data`` has words with one blank after each; the other arrays have an entry for each occurrence."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    words: np.ndarray  # of each document


def grams(texts: list[bytes], longest: int) -> Grams:
    """All runs of 1 to ``longest`` consecutive words of each text, in no particular order."""
    joined = PLAIN[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = IN_WORD[joined]
    ends_after = np.zeros(len(joined), bool)
    ends_after[1:] = inside[:-1] & ~inside[1:]
    kept = inside | ends_after
    doc_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    at = np.cumsum(kept)  # place after each byte in the kept data
    data = np.where(ends_after, np.uint8(32), joined)[kept]
    end = np.flatnonzero(data == 32)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    doc = np.searchsorted(at[doc_end - 1], begin, side="right") if len(end) else end
    words = np.bincount(doc, minlength=len(texts))
    starts, sizes, docs = [], [], []
    for k in range(min(longest, len(begin))):
        near = slice(0, len(begin) - k)
        same = doc[near] == doc[k:] if k else slice(None)
        starts.append(begin[near][same])
        sizes.append((end[k:] - begin[near])[same])
        docs.append(doc[near][same])
    none = np.zeros(0, np.int64)
    return Grams(data, *(np.concatenate(x) if x else none for x in (starts, sizes, docs)), words)


def rotl(x: np.ndarray, by: int) -> np.ndarray:
    return x << U(by) | x >> U(64 - by)


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The little-endian 8 bytes that begin at each byte."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


def xxh64(g: Grams, lanes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of every n-gram; those of equal length go through the rounds together."""
    out = np.empty(len(g.start), U)
    kind = np.minimum(g.size, LANES).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    edge = np.searchsorted(kind[order], np.arange(LANES + 1))
    for size in range(1, LANES):
        who = order[edge[size] : edge[size + 1]]
        if not len(who):
            continue
        p = g.start[who]
        h = np.full(len(who), P5 + U(size), U)
        k = 0
        while k + 8 <= size:
            h = rotl(h ^ rotl(lanes[p + k] * P2, 31) * P1, 27) * P1 + P4
            k += 8
        if k + 4 <= size:
            h = rotl(h ^ (lanes[p + k] & U(0xFFFFFFFF)) * P1, 23) * P2 + P3
            k += 4
        while k < size:
            h = rotl(h ^ g.data[p + k].astype(U) * P5, 11) * P1
            k += 1
        h = (h ^ h >> U(33)) * P2
        h = (h ^ h >> U(29)) * P3
        out[who] = h ^ h >> U(32)
    for i in order[edge[LANES] :].tolist():
        out[i] = xxhash.xxh64_intdigest(g.data[g.start[i] : g.start[i] + g.size[i]].tobytes())
    return out


def equal_bytes(g: Grams, lanes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the n-grams ``a`` and ``b`` (numbers of occurrences) have equal bytes."""
    same = g.size[a] == g.size[b]
    long = same & (g.size[a] > 2 * LANES)
    for i in np.flatnonzero(long).tolist():
        x, y, n = g.start[a[i]], g.start[b[i]], g.size[a[i]]
        same[i] = x == y or np.array_equal(g.data[x : x + n], g.data[y : y + n])
    k = 0
    left = np.flatnonzero(same & ~long)
    while len(left):
        x, y = a[left], b[left]
        rest = np.minimum(g.size[x] - k, 8)
        mask = U(0xFFFFFFFFFFFFFFFF) >> (U(64) - rest.astype(U) * U(8))
        wrong = ((lanes[g.start[x] + k] ^ lanes[g.start[y] + k]) & mask) != 0
        same[left[wrong]] = False
        k += 8
        left = left[~wrong & (g.size[x] > k)]
    return same


def crc32(g: Grams, who: np.ndarray) -> np.ndarray:
    """CRC-32 of the n-grams ``who``, short ones byte by byte together."""
    out = np.empty(len(who), np.uint32)
    order = np.argsort(-g.size[who], kind="stable")
    size, p = g.size[who][order], g.start[who][order]
    n_long = int(np.searchsorted(-size, -2 * LANES, side="left"))
    for i in range(n_long):
        out[order[i]] = zlib.crc32(g.data[p[i] : p[i] + size[i]].tobytes())
    size, p = size[n_long:], p[n_long:]
    crc = np.full(len(p), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, side="left"))  # those longer than k
        crc[:live] = CRC[(crc[:live] ^ g.data[p[:live] + k]) & np.uint32(0xFF)] ^ crc[:live] >> np.uint32(8)
    out[order[n_long:]] = ~crc
    return out


class Interned(NamedTuple):
    slot: np.ndarray  # of each occurrence
    bucket: np.ndarray  # of each slot
    count: np.ndarray  # of each slot


def intern(g: Grams, buckets: int) -> Interned:
    """The open-addressed table of a batch. It has at least twice as many slots as there are occurrences, so probing ends."""
    n = len(g.start)
    room = 1 << max(4, (2 * n - 1).bit_length())
    mask = U(room - 1)
    owner = np.full(room, -1, np.int64)
    slot = np.empty(n, np.int64)
    lanes = lanes_of(g.data)
    at = (xxh64(g, lanes) & mask).astype(np.int64)
    left = np.arange(n)
    while len(left):
        here = at[left]
        free = owner[here] < 0
        owner[here[free]] = left[free]  # of those that meet on a free slot one stays
        found = equal_bytes(g, lanes, left, owner[here])
        slot[left[found]] = here[found]
        left = left[~found]
        at[left] = (at[left] + 1) & int(mask)
    used = np.flatnonzero(owner >= 0)
    bucket = np.zeros(room, np.int64)
    bucket[used] = crc32(g, owner[used]) % np.uint32(buckets)
    return Interned(slot, bucket, np.bincount(slot, minlength=room))


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of rows whose texts (last column) have about ``BATCH`` bytes together."""
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        start = held = 0
        for k, t in enumerate(texts):
            held += len(t)
            if held >= BATCH or k + 1 == len(texts):
                yield b.slice(start, k + 1 - start), texts[start : k + 1]
                start, held = k + 1, 0


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): occurrences of n-grams by bucket over all rows of ``texts`` (text); buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, held in batched(batches):
            table = intern(grams(held, longest), buckets)
            total += np.bincount(table.bucket, weights=table.count, minlength=buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    rows = texts.select(whole_text().cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, gain) of all ``buckets``, one row each: the scaled log ratio of smoothed frequencies, rounded down."""
    spark = docs.sparkSession
    s, t = (bucket_counts(d, longest, buckets).withColumnRenamed("n", name) for d, name in ((docs, "s"), (target, "t")))
    rows = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    whole = lambda c: F.sum(c).over(Window.partitionBy()).cast("double")
    rows = rows.withColumns({"all_s": whole("s"), "all_t": whole("t")})
    odds = (F.col("t").cast("double") + 1) * (F.col("all_s") + buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + buckets))
    return rows.select("bucket", F.floor(SCALE * F.ln(odds)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs``; ``gain`` has an entry for each bucket."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in batched(batches):
            g = grams(held, longest)
            table = intern(g, len(gain))
            each = gain[table.bucket][table.slot]
            n = np.bincount(g.doc, minlength=len(held))
            total = np.zeros(len(held), np.int64)
            if len(each):
                order = slice(None) if longest == 1 else np.argsort(g.doc, kind="stable")
                sums = np.concatenate([[0], np.cumsum(each[order])])
                edge = np.concatenate([[0], np.cumsum(n)])
                total = sums[edge[1:]] - sums[edge[:-1]]
            yield pa.record_batch([b.column(0), pa.array(g.words, pa.int64()), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Seeded Gumbel noise of a row's id, scaled and rounded down; null ids draw from the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.ln(-F.ln((h + 0.5) / OFFSET))).cast("long")


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score) with ``rank``: place among the drawn rows, null for the others.

    The rows above a score are counted from the frequencies of all scores. Scores are whole numbers between bounds
    that doubles set (about 130,000 values), so their running sum is small and is broadcast. Ties of one score are counted in its
    own window, after equal rows of a task have been merged: a third of all rows may be equal.
    """
    eligible = scored.where(F.col("n_words") >= least_words).withColumn("part", F.spark_partition_id())
    drawn = F.lit(percent) * F.sum("here").over(Window.partitionBy()) / 100
    by_score = eligible.groupBy("score").agg(F.count(F.lit(1)).alias("here"))
    above = F.sum("here").over(Window.orderBy(F.desc("score"))) - F.col("here")
    heads = F.broadcast(by_score.select("score", above.alias("above"), F.floor(drawn).alias("quota")).where("above < quota"))
    same = ["doc_id", "n_words", "n_features", "weight", "score"]
    merged = eligible.join(heads, "score", "left_semi").groupBy(*same, "part").agg(F.count(F.lit(1)).alias("copies"))
    tie = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "n_words", "part")
    first = F.col("above") + F.coalesce(F.sum("copies").over(tie.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = merged.join(heads, "score").withColumn("first", first)
    each = placed.select(*same, "quota", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("copies"))).alias("rank"))
    rank = F.when(F.col("rank") <= F.col("quota"), F.col("rank"))
    beyond = scored.where(F.col("n_words") < least_words).unionByName(eligible.join(heads, "score", "left_anti").select(*scored.columns))
    return each.select(*same, rank.alias("rank")).unionByName(beyond.select(*same, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Null texts have no features and weight 0. Null ids share one noise and come last among ties; repeated rows each
    get a rank of their own; an empty table gives no rows, an empty target gains from smoothing alone. Other
    columns are ignored. The gains pass the driver: ``buckets`` numbers, however large the tables are.
    """
    gain = np.zeros(buckets, np.int64)
    for r in gains(docs, target, longest, buckets).collect():
        gain[r.bucket] = r.gain
    scored = cut(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(seed)), "weights")
    return ranked(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
