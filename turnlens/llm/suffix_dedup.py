"""Exact removal of repeated byte strings by column-wise construction of suffix orders.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or the
same document further left). The suffixes of whole documents would need a round per byte of the
longest text over the whole collection, so the collection is first cut to the strings that can repeat:

1. Each window of ``LENGTH`` bytes names an anchor, its ``GRAM`` bytes with the least hash; equal
   windows have equal anchors at the same place. Windows in a row with one anchor form a run. Equal
   runs are settled by their hashes: all but the first are repeats.
2. Runs that share an anchor with a different run become the strings of a collection, lined up at the
   anchor. One symbol per string is inserted each round, from the last column to the first; each round
   turns the order of the suffixes one column on into the order at this column (a stable sort by the
   inserted symbols, which are the Burrows-Wheeler column of the order before) and updates the common
   prefixes of neighbours by range minima. The columns lie in an external file that is read
   sequentially. Neighbours with ``LENGTH`` bytes in common are equal windows.
3. An anchor with over ``STRINGS`` runs (a passage that very many documents share) is split by the bytes
   around it: first the windows that reach further before it from those that reach further behind it,
   then each half again, until a part is small or holds one window alone. No task holds a whole anchor.

Every window of every text is covered. Comparisons in steps 2 and 3 are of bytes; those of step 1, which settles
most runs, are of two 64-bit hashes, of the anchor and of the run.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import cut, pieces, whole_text

LENGTH, GRAM = 100, 24
WINDOWS = LENGTH - GRAM + 1
#: Bytes of text that a task hashes at once; strings in one external collection.
BLOCK, STRINGS = 2_000_000, 60_000
NULL_ID = -(2**63)
R = np.uint64(0x9E3779B97F4A7C15 | 1)


def inverse(r: int) -> int:
    return pow(int(r), -1, 1 << 64)


class Hasher:
    """Hashes of substrings from prefix sums of byte values times powers (mod 2**64)."""

    def __init__(self, size: int) -> None:
        one = np.ones(1, np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(size, R)]))
        self.down = np.cumprod(np.concatenate([one, np.full(size, np.uint64(inverse(R)))]))
        mix = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mix ^= mix >> np.uint64(32)
        self.value = mix * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)

    def load(self, data: np.ndarray) -> None:
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.up[: len(data)])])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)


def runs(data: np.ndarray, ends: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Runs of windows in concatenated texts that end at ``ends``: first window, number of windows, anchor."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    hasher.load(data)
    grams = len(data) - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    least = hasher.of(slice(0, grams), slice(GRAM, GRAM + grams)) & ~low | np.arange(grams, dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOWS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[WINDOWS - width : WINDOWS - width + n])
    anchor = (least & low).astype(np.int64)
    at = np.arange(n)
    text = np.searchsorted(ends, at, "right")
    whole = at + LENGTH <= ends[text]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.concatenate([new[1:] | ~whole[1:], [True]]) & whole)
    return first, stop - first + 1, anchor[first]


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each key joined where they touch."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start, end
    step = np.int64(1) << 40
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    reach = np.maximum.accumulate(end + group * step)
    new = np.concatenate([[True], (start + group * step)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return key[at], start[at], np.maximum.reduceat(end, at)


def column_orders(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, order of the suffixes from it, common prefixes of neighbours), from the last column to the first.

    ``symbols``: a row per string, bytes plus one, 0 where a string has no byte (an empty suffix
    sorts first and has nothing in common). The columns go through a file that is read in order.
    """
    n, width = symbols.shape
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        path = os.path.join(folder, "columns")
        np.ascontiguousarray(symbols.T[::-1]).tofile(path)
        with open(path, "rb") as file:
            order, lcp = np.arange(n), np.zeros(n, np.uint8)
            for t in range(width - 1, -1, -1):
                symbol = np.frombuffer(file.read(2 * n), np.uint16)[order]
                moved = np.argsort(symbol, kind="stable")
                order, symbol = order[moved], symbol[moved]
                fresh = np.zeros(n, np.uint8)
                same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0))
                if len(same):
                    lo, hi = moved[same] + 1, moved[same + 1]  # the old neighbours between them
                    levels = [lcp]
                    while 2 << len(levels) - 1 <= int((hi - lo).max()) + 1:
                        half = 1 << len(levels) - 1
                        last = levels[-1]
                        levels.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))
                    table = np.stack(levels)
                    k = np.frexp((hi - lo + 1).astype(float))[1] - 1
                    fresh[same + 1] = np.minimum(np.minimum(table[k, lo], table[k, hi - (1 << k) + 1]), 250) + 1
                lcp = fresh
                yield t, order, lcp


def later_windows(texts: list[bytes], before: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of every window that a string of smaller rank also has at the same distance from the anchor.

    ``before``: bytes of each string in front of its anchor; a window is counted from the first byte of its string.
    """
    size = np.array([len(t) for t in texts])
    symbols = np.zeros((len(texts), WINDOWS - 1 + LENGTH), np.uint16)
    row = np.repeat(np.arange(len(texts)), size)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    symbols[row, within + np.repeat(WINDOWS - 1 - before, size)] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    who, where = [], []
    for t, order, lcp in column_orders(symbols):
        if t >= WINDOWS:
            continue
        equal = lcp >= LENGTH
        if not equal.any():
            continue
        head = np.flatnonzero(~equal)
        first = np.repeat(np.minimum.reduceat(rank[order], head), np.diff(np.append(head, len(order))))
        late = order[rank[order] > first]
        who.append(late)
        where.append(t - (WINDOWS - 1 - before[late]))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(where)


# Rows between the steps hold five longs: key, hash, doc, x, y. A run has x = its first window and
# y = text crc << 16 | bytes before the anchor << 8 | windows; a removed interval has
# x = end << 32 | start and y = -1 - text crc.
ROW = "key long, hash long, doc long, x long, y long"
NAMES = ["key", "hash", "doc", "x", "y"]


def rows_of(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=NAMES)


def intervals(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Columns of the removed intervals, joined where they touch."""
    both, at = np.unique(np.stack([doc, crc], axis=1), axis=0, return_inverse=True) if len(doc) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    key, start, end = merged(at.ravel(), start, end)
    return [both[key, 0], np.zeros(len(key), np.int64), both[key, 0], end << 32 | start, -1 - both[key, 1]]


def split_runs(key: np.ndarray, h: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs sorted by (key, hash, doc, crc, x): masks of the first of each equal set, and of later ones (not the same run again)."""
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    again = (doc == doc[lead]) & (y >> 16 == y[lead] >> 16) & (x == x[lead])
    return first, ~first & ~again


def hash_runs(docs: DataFrame) -> DataFrame:
    """Step 1 inside the tasks: runs, without those that equal an earlier run of the same block, and the intervals these leave."""

    def solve(held: list[tuple[int, int, int, bytes]], hasher: Hasher) -> pa.RecordBatch:
        doc, crc, shift = (np.array(v, np.int64) for v in list(zip(*held, strict=True))[:3])
        data = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        ends = np.cumsum([len(x[3]) for x in held])
        first, n, anchor = runs(data, ends, hasher)
        text = np.searchsorted(ends, first, "right")
        begin = (ends - np.diff(np.concatenate([[0], ends])))[text]
        key, whole = hasher.of(anchor, anchor + GRAM), hasher.of(first, first + n + LENGTH - 1)
        key, whole = key.view(np.int64), whole.view(np.int64)
        doc, crc, x = doc[text], crc[text], first - begin + shift[text]
        order = np.lexsort((x, crc, doc, whole, key))
        key, whole, doc, x, n, before, crc = (v[order] for v in (key, whole, doc, x, n, anchor - first, crc))
        y = crc << 16 | before << 8 | n
        keep, late = split_runs(key, whole, doc, x, y)
        gone = intervals(doc[late], crc[late], x[late], x[late] + n[late] + LENGTH - 1)
        return rows_of([np.concatenate([a[keep], b]) for a, b in zip((key, whole, doc, x, y), gone, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(2 * BLOCK + LENGTH), [], 0
        for b in pieces(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                crc = zlib.crc32(data)
                for at in range(0, max(1, len(data) - LENGTH + 1), BLOCK):  # long texts in blocks of windows
                    part = data[at : at + BLOCK + LENGTH - 1]
                    if len(part) < LENGTH:
                        continue
                    held.append((doc, crc, at, part))
                    size += len(part)
                    if size >= BLOCK:
                        yield solve(held, hasher)
                        held, size = [], 0
        if held:
            yield solve(held, hasher)

    return docs.mapInArrow(run, ROW)


def settle_runs(hashed: DataFrame) -> DataFrame:
    """Step 1 across tasks: the intervals of later equal runs, and the first runs whose anchor has other runs too.

    A task reads its runs in order and keeps one: the first of the set of equal runs it is in.
    """

    def solve(lead: list[np.ndarray] | None, told: bool, c: list[np.ndarray]) -> tuple[pa.RecordBatch, list[np.ndarray] | None, bool]:
        """What the runs ``c`` settle, after the first run ``lead`` of the last set (returned before, if ``told``); the new such run."""
        done = c[4] < 0
        through = [v[done] for v in c]
        live = [v[~done] for v in c]
        if not len(live[0]):
            return rows_of(through), lead, told
        if lead is not None:
            live = [np.concatenate(v) for v in zip(lead, live, strict=True)]
        key, h, doc, x, y = live
        keep, late = split_runs(key, h, doc, x, y)
        gone = intervals(doc[late], y[late] >> 16, x[late], x[late] + (y[late] & 255) + LENGTH - 1)
        kept = [v[keep] for v in live]
        same = kept[0][1:] == kept[0][:-1]
        near = np.zeros(len(kept[0]), bool)
        near[1:] |= same
        near[:-1] |= same
        ends_told = bool(near[-1]) or (told and len(near) == 1)
        near[0] &= not told
        return rows_of([np.concatenate([a, b, v[near]]) for a, b, v in zip(through, gone, kept, strict=True)]), [v[-1:] for v in kept], ends_told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, told = None, False
        for b in batches:
            if b.num_rows:
                out, lead, told = solve(lead, told, [v.to_numpy(zero_copy_only=False) for v in b.columns])
                yield out

    dealt = hashed.repartition("key").sortWithinPartitions("key", "hash", "doc", F.shiftright("y", 16), "x")
    return dealt.mapInArrow(run, ROW)


def strings(runs_left: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of runs (key, doc, x, y) out of ``docs`` (doc, crc, text)."""
    asked = runs_left.groupBy("doc", F.shiftright("y", 16).alias("crc")).agg(F.collect_list(F.struct("key", "x", "y")).alias("runs"))
    found = docs.join(asked, ["doc", "crc"]).select("doc", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for doc, text, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                key, x, y = ([r[k] for r in asked] for k in ("key", "x", "y"))
                part = [data[a : a + (v & 255) + LENGTH - 1] for a, v in zip(x, y, strict=True)]
                yield pa.record_batch([*(pa.array(v, pa.int64()) for v in (key, [doc] * len(key), x, y)), pa.array(part, pa.binary())], names=["key", "doc", "x", "y", "part"])

    return found.mapInArrow(run, "key long, doc long, x long, y long, part binary")


def compare_runs(parts: DataFrame) -> DataFrame:
    """Step 2: the intervals of windows that an earlier run with the same anchor also has."""

    def solve(c: list[np.ndarray]) -> pa.RecordBatch:
        key, doc, x, y, part = c
        before = y >> 8 & 255
        place = np.stack([doc, y >> 16, x + before])
        order = np.lexsort(place[::-1])
        rank = np.zeros(len(key), np.int64)  # equal for the copies that a repeated row makes
        rank[order[1:]] = np.cumsum((place[:, order[1:]] != place[:, order[:-1]]).any(axis=0))
        who, where = later_windows(part.tolist(), before, rank)
        start = x[who] + where
        return rows_of(intervals(doc[who], y[who] >> 16, start, start + LENGTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            c = [v.to_numpy(zero_copy_only=False) for v in b.columns]
            if size >= STRINGS:  # a collection ends between two anchors
                cut_at = int(np.searchsorted(c[0], held[-1][0][-1], "right"))
                if cut_at < len(c[0]):
                    yield solve([np.concatenate(v) for v in zip(*held, [v[:cut_at] for v in c], strict=True)])
                    held, size, c = [], 0, [v[cut_at:] for v in c]
            held.append(c)
            size += len(c[0])
        if held:
            yield solve([np.concatenate(v) for v in zip(*held, strict=True)])

    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, ROW)


def halves(parts: DataFrame) -> DataFrame:
    """Each string (key, low, high, ...) as at most two: its windows with the anchor ``low`` to the middle and above the middle bytes behind their start.

    All windows of one half share the bytes that reach as far before and behind the anchor as each of them
    does; the new key hashes these, so equal windows still have equal keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1024):
            out = []
            for key, doc, x, y, part, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                before, n, middle = y >> 8 & 255, y & 255, (low + high) // 2
                for a, z in ((low, middle), (middle + 1, high)):
                    first, last = max(0, before - z), min(n - 1, before - a)
                    if first > last:
                        continue
                    shared = part[before - a : before - z + LENGTH]
                    digest = hashlib.blake2b(key.to_bytes(8, "big", signed=True) + bytes([a, z]) + shared, digest_size=8).digest()
                    out.append((int.from_bytes(digest, "big", signed=True), doc, x + first, y >> 16 << 16 | before - first << 8 | last - first + 1, part[first : last + LENGTH], a, z))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, pa.binary() if k == 4 else pa.int32() if k > 4 else pa.int64()) for k, c in enumerate(columns)], names=["key", "doc", "x", "y", "part", "low", "high"])

    return parts.select("key", "doc", "x", "y", "part", "low", "high").mapInArrow(run, "key long, doc long, x long, y long, part binary, low int, high int")


def settle_windows(leaves: DataFrame) -> DataFrame:
    """The intervals of single windows (key, doc, x, y, part) that an equal one comes before: a minimum per window, whatever their number."""
    place = F.struct("doc", F.shiftright("y", 16).alias("crc"), "x")
    first = leaves.groupBy("key", "part").agg(F.min(place).alias("first"))
    late = leaves.join(first, ["key", "part"]).where(place > F.col("first"))
    end = F.shiftleft(F.col("x") + LENGTH, 32).bitwiseOR(F.col("x"))
    return late.select(F.col("doc").alias("key"), F.lit(0).cast("long").alias("hash"), "doc", end.alias("x"), (-1 - F.shiftright("y", 16)).alias("y"))


def repeats(runs_left: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Step 2 for all runs: an anchor of more than ``limit`` runs is split by the bytes around it, again and again, so that no task holds it."""
    limit = STRINGS if limit is None else limit
    crowded = cut(runs_left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key"), "crowded-anchors")
    out = compare_runs(strings(runs_left.join(crowded, "key", "left_anti"), docs))
    group = ["key", "low", "high"]
    left = strings(runs_left.join(crowded, "key", "left_semi"), docs).withColumns({"low": F.lit(0), "high": F.lit(WINDOWS - 1)}) if crowded.limit(1).count() else None
    while left is not None:
        split = cut(halves(left), "split-anchors")
        crowded = cut(split.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(*group), "crowded-anchors")
        calm = split.join(crowded, group, "left_anti").select("key", "doc", "x", "y", "part")
        again = split.join(crowded, group, "left_semi")
        out = out.unionByName(compare_runs(calm)).unionByName(settle_windows(again.where("low = high")))
        left = again.where("low < high") if crowded.where("low < high").limit(1).count() else None
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the maximal removed spans (start, end) in bytes, and the bytes left.

    ``docs``: doc_id, text. Null texts are empty, texts under ``LENGTH`` bytes lose nothing. Null ids
    come before all others; rows with equal ids are ordered by the crc of their texts; a repeated row
    (equal id and text) counts once and each copy gets the same result. An empty table gives no rows.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), whole_text().cast("string").alias("text"))
    settled = cut(settle_runs(hash_runs(keyed)), "repeat-runs")
    known = keyed.select("doc", F.crc32(F.col("text").cast("binary")).alias("crc"), "text")
    compared = cut(repeats(settled.where("y >= 0"), known), "repeat-windows")
    gone = settled.where("y < 0").unionByName(compared).groupBy("doc", (-1 - F.col("y")).alias("crc")).agg(F.collect_list("x").alias("gone"))
    joined = known.join(gone, ["doc", "crc"], "left").select("doc", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, sizes, spans, kept = [], [], [], []
            for doc, text, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                x = np.array(gone or [], np.int64)
                _, start, end = merged(np.zeros(len(x), np.int64), x & 0xFFFFFFFF, x >> 32)
                cuts = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(data)]
                ids.append(None if doc == NULL_ID else doc)
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                kept.append(b"".join(data[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
