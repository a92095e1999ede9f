"""Byte-level BPE by merge replay over a corpus block, and its decoding.

A block is a run of documents of one task, at least ``BLOCK`` characters. The distinct words of the
block lie end to end in one array of symbols; an inverted index maps each pair of neighbouring
symbols (known by its rank) to the positions where it stands. Ranks leave a heap in order; a merge is
applied at all positions of its pair at once, and only the two neighbours of each merged position get
new index entries. Every word is merged once however often it occurs, and remembered by the task.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.llm.common import pieces

#: Characters of text that share one inverted index, and words that a task remembers: both bound its memory.
BLOCK, KNOWN = 4_000_000, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay:
    """Merge replay under one table of ranks (a token's rank is its id)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_id = [ranks[bytes([k])] for k in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        """Rank of the merge of two symbols, -1 if there is none."""
        found = self.pair_rank.get((a, b))
        if found is None:
            found = self.pair_rank[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        whole = self.ranks
        out: list[bytes | None] = [whole[w].to_bytes(4, "little") if w in whole else None for w in words]
        todo = [k for k, x in enumerate(out) if x is None]
        byte_id, rank = self.byte_id, self.rank
        symbol: list[int] = []
        starts = []
        for k in todo:
            symbol.append(-1)  # a wall between words
            starts.append(len(symbol))
            symbol.extend([byte_id[c] for c in words[k]])
        symbol.append(-1)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for p in range(n - 1):
            a, b = symbol[p], symbol[p + 1]
            if a >= 0 and b >= 0 and (r := rank(a, b)) >= 0:
                index.setdefault(r, []).append(p)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for done, p in enumerate(places):
                a = symbol[p]
                if a < 0:
                    continue
                q = after[p]
                b = symbol[q]
                if b < 0 or rank(a, b) != r:
                    continue
                symbol[p], symbol[q] = r, -2  # -2: swallowed
                after[p] = e = after[q]
                before[e] = p
                lower = False
                for left, right in ((before[p], p), (p, e)):
                    x, y = symbol[left], symbol[right]
                    if x >= 0 and y >= 0 and (new := rank(x, y)) >= 0:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heapq.heappush(heap, new)
                        lower |= new < r
                if lower:  # an earlier merge became possible: it goes first
                    rest = places[done + 1 :]
                    if rest:
                        if r in index:
                            index[r].extend(rest)
                        else:
                            index[r] = rest
                            heapq.heappush(heap, r)
                    break
        for k, p in zip(todo, starts, strict=True):
            ids = []
            end = p + len(words[k])
            while p < end:
                ids.append(symbol[p])
                p = after[p]
            out[k] = array("I", ids).tobytes()
        return out


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Every row of ``docs`` with ``ids``, little-endian unsigned 32-bit integers, in the place of ``text``.

    Null and empty texts give no ids; repeated rows and null ids each keep their row and their other columns (one named
    ids is replaced); an empty table gives no rows.
    """
    docs = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    docs = docs.select(*[c for c in docs.columns if c != "text"], "text")
    names = [*docs.columns[:-1], "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = Replay(load_ranks(ranks_path))
        split = regex.compile(pattern).findall
        known: dict[str, bytes] = {}

        def solve(held: list[pa.RecordBatch], texts: list[str | None]) -> pa.RecordBatch:
            parts = [split(t) if t else [] for t in texts]
            fresh = list(set().union(*parts) - known.keys())
            if len(known) + len(fresh) > KNOWN:
                known.clear()
                fresh = list(set().union(*parts))
            known.update(zip(fresh, replay.encode([w.encode("utf-8", "surrogatepass") for w in fresh]), strict=True))
            others = [pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in range(len(names) - 1)]
            return pa.record_batch([*others, pa.array([b"".join(map(known.__getitem__, p)) for p in parts], pa.binary())], names=names)

        held, texts, size = [], [], 0
        for b in pieces(batches):
            held.append(b)
            texts += (more := b.column(len(names) - 1).to_pylist())
            size += sum(len(t or "") for t in more)
            if size >= BLOCK:
                yield solve(held, texts)
                held, texts, size = [], [], 0
        if texts:
            yield solve(held, texts)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, bytes): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        table = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            table[i] = word
        for b in pieces(batches):
            back = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(back, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")
