"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most ``BITS`` of 64 bits agree on two of four 16-bit blocks, so the
distinct fingerprints are dealt out by the six pairs of blocks. A group of over ``HOT`` is dealt out again by
pairs of 8-bit pieces of its other 32 bits, so none exceeds 65,536 fingerprints. Inside one such group they are sorted
by Gray rank and indexed as a tree: a node keeps the bits that all its members share and that no node
above it has, so a query adds up differences on its way down and leaves whole groups as soon as the
sum passes the limit. Links are reduced to a spanning forest where they are found; pairs are never
listed. Equal fingerprints are one node from the start, so groups of copies cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import cut, drop, pieces
from turnlens.llm.components import components

BITS = 2
WORDS = 3
FAN = 8
#: Fingerprints with two equal blocks from which on their other 32 bits deal them out further.
HOT = 4096
#: For groups by similarity: words of a shingle, least Jaccard similarity, lanes of 64 bits, least
#: shingle hashes by which rows are dealt, and rows of one key that meet in one task.
GROUP_WORDS, SIMILAR, LANES, LEASTS, BLOCK = 5, 0.8, 8, 6, 1024
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of ``text``, A-Z lower-cased; few words make one shingle, none no hash."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    size = min(words, len(found))
    shingles = map(b" ".join, zip(*(found[k:] for k in range(size)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_000):
        bits = np.unpackbits(h[k : k + 65_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of ``text``."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Levels from the leaves up; each has the shared bits (mask, pattern) that the level above lacks."""

    def __init__(self, fps: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        mask, pattern = np.full(len(fps), ~np.uint64(0)), self.fps
        full = [(mask, pattern)]
        while len(mask) > FAN:
            at = np.arange(0, len(mask), FAN)
            all_and, all_or = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            mask = np.bitwise_and.reduceat(mask, at) & ~(all_and ^ all_or)
            pattern = all_and & mask
            full.append((mask, pattern))
        self.levels = []
        for k, (m, p) in enumerate(full):
            own = m if k + 1 == len(full) else m & ~np.repeat(full[k + 1][0], FAN)[: len(m)]
            self.levels.append((own, p & own))

    def within(self, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) index pairs that differ in at most ``bits``."""
        top = len(self.levels[-1][0])
        q, node, sofar = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries)), np.zeros(len(queries) * top, np.int64)
        for depth, (mask, pattern) in enumerate(reversed(self.levels)):
            sofar = sofar + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            keep = sofar <= bits
            q, node, sofar = q[keep], node[keep], sofar[keep]
            if depth + 1 < len(self.levels):
                below = len(self.levels[-depth - 2][0])
                q, sofar = np.repeat(q, FAN), np.repeat(sofar, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < below
                q, node, sofar = q[real], node[real], sofar[real]
        return q, node


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root), as indices into ``fps``, that join all fingerprints linked by chains of at most ``bits`` differences."""
    tree = GrayTree(fps)
    where = tree.order
    root = np.arange(len(fps))
    for k in range(0, len(fps), 128):
        q, m = tree.within(tree.fps[k : k + 128], bits)
        a, b = root[q + k], root[m]
        while True:
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            open_ = hi != lo
            if not open_.any():
                break
            np.minimum.at(root, hi[open_], lo[open_])
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
    child = np.flatnonzero(root != np.arange(len(root)))
    return where[child], where[root[child]]


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns behind the first ``keys`` ones, for each run of rows with equal keys that has over one row."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns[:keys]:
            change |= c[1:] != c[:-1]
        at = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            mine = tuple(c[lo] for c in columns[:keys])
            if mine != last:
                if sum(len(h[0]) for h in held) > 1:
                    yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, last = [], mine
            held.append([c[lo:hi] for c in columns[keys:]])
    if sum(len(h[0]) for h in held) > 1:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def groups(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(pair, key, sub, fp): any two fingerprints ``fp`` that differ in at most two bits are in one group of equal (pair, key, sub)."""
    piece = lambda at, size: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1))
    pairs_of = lambda k: [(i, j) for i in range(k) for j in range(i + 1, k)]
    keys, others = [], []
    for i, j in pairs_of(4):
        keys.append(F.struct(F.lit(4 * i + j).alias("pair"), F.shiftleft(piece(16 * i, 16), 16).bitwiseOR(piece(16 * j, 16)).alias("key")))
        # at most two of the four pieces of the other blocks differ
        rest = [16 * k + low for k in range(4) if k not in (i, j) for low in (0, 8)]
        subs = [F.shiftleft(piece(rest[a], 8), 8).bitwiseOR(piece(rest[b], 8)).bitwiseOR(F.lit((4 * a + b) << 16)) for a, b in pairs_of(4)]
        others.append(F.when(F.col("pair") == 4 * i + j, F.array(*subs)))
    dealt = distinct.select(F.inline(F.array(*keys)), "fp")
    crowded = dealt.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot).select("pair", "key", F.lit(True).alias("crowded"))
    sub = F.when(F.col("crowded"), F.coalesce(*others)).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(F.broadcast(crowded), ["pair", "key"], "left").select("pair", "key", F.explode(sub).alias("sub"), "fp")


def links(distinct: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``fp`` that differ in at most ``bits`` (2 or less)."""
    if not 0 <= bits <= 2:
        raise ValueError("four blocks find up to two differing bits")
    shared = groups(distinct, hot).repartition("pair", "key", "sub").sortWithinPartitions("pair", "key", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (fp,) in in_groups(batches, 3):
            a, b = forest(fp.view(np.uint64), bits)
            yield pa.record_batch([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return shared.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    Rows link when their fingerprints differ in at most ``bits``; component_id is the smallest
    doc_id reachable (null only where all ids reachable are null). Empty and null texts have the
    fingerprint zero and link like any other; repeated rows stay; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), bits))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.select("fp", "root").join(component, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def wide_fingerprints(docs: DataFrame, words: int = GROUP_WORDS) -> DataFrame:
    """(doc_id, key, node, n, lanes, leasts, shingles) of ``docs`` (doc_id, key, text), over the distinct shingle hashes of each text.

    ``node`` hashes the whole set, ``shingles`` is the set in 32 bits a hash, sorted (so two texts of 20,000 words share
    one by chance in one case of ten, far below any limit of similarity); ``lanes`` is its SimHash in ``LANES`` lanes of 64 bits as bytes, ``leasts`` the least hashes of ``LEASTS`` lanes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in pieces(batches):
            nodes, lanes, leasts, sets = [], [], [], []
            for text in b.column(2).to_pylist():
                h, out = np.unique(shingle_hashes(text, words)), []
                low = np.zeros(LEASTS, np.uint64)
                for k in range(LANES):
                    x = h + add[k]
                    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                    x ^= x >> np.uint64(31)
                    out.append(majority(x))
                    if k < LEASTS and len(x):
                        low[k] = x.min()
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), 43))
                lanes.append(np.array(out, np.uint64).tobytes())
                leasts.append(low.view(np.int64).tolist())
                sets.append(np.unique(h.astype(np.uint32)).view(np.int32))
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), pa.array(lanes, pa.binary()), pa.array(leasts, longs), pa.array(sets, ints)],
                names=["doc_id", "key", "node", "n", "lanes", "leasts", "shingles"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("key").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, key string, node long, n long, lanes binary, leasts array<long>, shingles array<int>")


def differing_bits(similar: float, bits: int = 64 * LANES, sigmas: float = 4.8) -> int:
    """Most bits that differ between two sets of Jaccard similarity ``similar``, but for a share of under one in 100,000."""
    p = np.arccos(2 * similar / (1 + similar)) / np.pi
    return int(np.ceil(bits * p + sigmas * np.sqrt(bits * p * (1 - p))))


def near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similar: float) -> np.ndarray:
    """Differing bits of each row of ``a`` and each of ``b`` (lanes); 1000 where sizes or bits rule out that the sets are similar.

    The Gray-order tree over the first lanes of ``b`` finds whose first lane is near; the other lanes are compared for these only.
    """
    out = np.full((len(a), len(b)), 1000, np.int16)
    if not len(a) or not len(b):
        return out
    tree = GrayTree(b[:, 0])
    # sets of under six shingles differ by more bits, 96 of 512 at 4 of 5, as even sizes have ties
    q, leaf = tree.within(a[:, 0], differing_bits(similar, 64) + 6 * int(min(na.min(), nb.min()) < 6))
    m = tree.order[leaf]
    bits = np.bitwise_count(a[q] ^ b[m]).sum(axis=1, dtype=np.int16)
    low, high = np.minimum(na[q], nb[m]), np.maximum(na[q], nb[m])
    keep = (bits <= differing_bits(similar) + np.where(low < 6, 24, 0)) & (low >= similar * high - 1e-9)
    out[q[keep], m[keep]] = bits[keep]
    return out


def as_lanes(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), np.uint64).reshape(-1, LANES)


def sets_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, shingles) of the asked ``nodes``, once each."""
    return rows.select("node", "shingles").join(nodes.distinct(), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, rows: DataFrame, similar: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets, in ``rows`` (node, shingles), have a Jaccard similarity of at least ``similar``."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    sets = cut(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows), "simhash-asked")
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").where(both / (F.size("sa") + F.size("sb") - both) >= similar)
    links = cut(found.select("a", "b"), "simhash-links")
    drop(pairs)
    drop(sets)
    return links


class SetIndex:
    """Inverted index from shingles to the sets that hold them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        flat, who = np.concatenate([*sets, np.zeros(0, np.int32)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.who = flat[order], who[order]

    def similarity(self, asked: np.ndarray) -> np.ndarray:
        """Jaccard similarity of a set to each set of the index; empty sets are equal."""
        low, high = np.searchsorted(self.flat, asked), np.searchsorted(self.flat, asked, "right")
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(self.who[at], minlength=len(self.sizes))
        return np.where(self.sizes + len(asked) == 0, 1.0, both / np.maximum(self.sizes + len(asked) - both, 1))


def spanning(asks: np.ndarray, root: np.ndarray, n: np.ndarray, lanes: np.ndarray, sets: np.ndarray, similar: float) -> tuple[list[int], list[int]]:
    """Links between rows that ask and rows that do not, as many as join the roots that have similar members: fewer than there are rows.

    SimHash lanes say which rows may be similar; the sets of those decide.
    """
    q, m = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
    local = np.unique(root, return_inverse=True)[1]
    top = np.arange(local.max() + 1)  # root of each root in this group
    index, a, b = None, [], []
    for k in range(0, len(q), 128):
        some = q[k : k + 128]
        bits = near(lanes[some], lanes[m], n[some], n[m], similar)
        for row, i in zip(bits, some, strict=True):
            maybe = np.flatnonzero((row < 1000) & (top[local[i]] != top[local[m]]))
            if not len(maybe):
                continue
            if index is None:
                index = SetIndex([sets[x] for x in m])
            hit = maybe[index.similarity(sets[i])[maybe] >= similar]
            others, first = np.unique(top[local[m[hit]]], return_index=True)
            if len(others):
                a += [i] * len(others)
                b += m[hit[first]].tolist()
                top[np.isin(top, others)] = top[local[i]]
    return a, b


def similar_links(sets: DataFrame, rows: DataFrame, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the distinct ``sets`` (node, n, lanes, leasts) of ``rows`` as all pairs found of at least that exact similarity do.

    Sets that share two of their ``LEASTS`` least hashes have a key in common. First each proposes its nearest
    one among up to ``block`` sets of a key; the exact links of these give components. Then, in the
    keys that still hold several components, every two sets of different ones are compared by their
    SimHash lanes, block by block, and what may be similar is compared exactly where it meets; a block
    returns the links that join its components, never its pairs.
    """
    two = [F.xxhash64(F.lit(LEASTS * i + j), F.col("leasts")[i], F.col("leasts")[j]) for i in range(LEASTS) for j in range(i)]
    keys = sets.select(F.explode(F.array(*two)).alias("key"), "node", "n", "lanes")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("hub")).where("rows > 1")
    shared = cut(keys.join(sizes, "key"), "simhash-shared")
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    blocks = lambda rows: F.ceil(F.col(rows) / block)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, n, lanes in in_groups(batches, 2):
            lanes = as_lanes(lanes)
            for k in range(0, len(node), 128):
                bits = near(lanes[k : k + 128], lanes, n[k : k + 128], n, similar)
                bits[np.arange(len(node))[None, :] >= np.arange(k, k + len(bits))[:, None]] = 1000
                to = bits.argmin(axis=1)
                q = np.flatnonzero(bits[np.arange(len(bits)), to] < 1000)
                yield pa.record_batch([pa.array(node[q + k]), pa.array(node[to[q]])], names=["a", "b"])

    # the least set of a key is in all of its blocks
    own = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), blocks("rows") - 1)).otherwise(F.array(part(blocks("rows"), 1)))
    dealt = shared.select("key", F.explode(own).alias("block"), "node", "n", "lanes").repartition("key", "block").sortWithinPartitions("key", "block", "node")
    sure = verified(dealt.mapInArrow(nearest, "a long, b long"), rows, similar)

    roots = components(sure)
    named = shared.select("key", "node", "n", "lanes").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    mixed = each.groupBy("key").agg(F.max_by("root", "rows").alias("main"), F.sum("rows").alias("rows"), F.max("rows").alias("of_main")).where("rows > of_main")
    mixed = mixed.withColumn("few", F.col("rows") - F.col("of_main"))
    left = named.join(mixed, "key")
    left = cut(left.join(cut(sets_of(left.select("node"), rows), "simhash-open-sets"), "node"), "simhash-open")
    # every set of a key meets every set outside its main component in one of blocks x chunks
    grid = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    asked = left.where("root <> main").select("key", part(blocks("few"), 2).alias("chunk"), F.explode(grid(blocks("rows"))).alias("block"), F.lit(1).alias("asks"), "node", "root", "n", "lanes", "shingles")
    met = left.select("key", F.explode(grid(blocks("few"))).alias("chunk"), part(blocks("rows"), 1).alias("block"), F.lit(0).alias("asks"), "node", "root", "n", "lanes", "shingles")
    pairs = met.unionByName(asked).repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk")
    pairs = pairs.select("key", "block", "chunk", "asks", "node", "root", "n", "lanes", "shingles")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks, node, root, n, lanes, found in in_groups(batches, 3):
            a, b = spanning(asks, root, n, as_lanes(lanes), found, similar)
            yield pa.record_batch([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    more = cut(pairs.mapInArrow(others, "a long, b long").distinct(), "simhash-more-links")
    drop(shared)
    drop(left)
    return sure.unionByName(more)


def representatives(docs: DataFrame, words: int = GROUP_WORDS, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(doc_id, key) of the row with the smallest id of each group of near copies of ``docs`` (doc_id, key, text).

    Two texts link when the sets of their shingles have a Jaccard similarity of at least ``similar``, checked
    exactly. Pairs are missed only by dealing: texts of similarity 0.8 share two of six least hashes in 998 of
    1000 cases. Empty and null texts are equal to each other; null ids come after all others, equal ids go by
    ``key`` (by default the id as text); an empty table gives no rows.
    """
    keyed = docs if "key" in docs.columns else docs.withColumn("key", F.col("doc_id").cast("string"))
    rows = cut(wide_fingerprints(keyed, words), "simhash-wide")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    least = rows.groupBy("node").agg(F.min(F.struct(order.alias("row"), "n", "lanes", "leasts")).alias("x"))
    sets = cut(least.select("node", "x.*"), "simhash-sets")
    roots = components(similar_links(sets, rows, similar, block))
    groups = sets.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row"))
    return groups.select("row.doc_id", "row.key")
