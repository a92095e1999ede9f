"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

A passage is a window of words twice as long as the longest item, at a stride of its half, so each
item-length run lies whole in a passage. Impacts are divided by the item's score against itself, so
1 means that a passage holds all of its terms. Only an item's rarest terms are essential: those that
are left when the weights of the commoner ones stay under half the threshold. Items come in blocks;
a passage adds up the block maxima of its essential terms and evaluates only blocks whose sum
reaches what their items still need; nothing above the threshold is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.llm.common import id_bounds, id_bucket, pieces

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
K1, B = 1.2, 0.75
#: Least share of an item's own BM25 score; least share of its 5-word shingles; least share of each of question and answer.
SCORE, SHINGLES, PARTS = 0.6, 0.8, 0.5
SHINGLE = 5
BLOCK = 8
#: Items in one index; more items make more indexes, each sent to the tasks on its own.
ITEMS = 20_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(found: list[str]) -> set[tuple[str, ...]]:
    size = min(SHINGLE, len(found))
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)} if found else set()


def question_answer(text: str) -> tuple[set[tuple[str, ...]], set[tuple[str, ...]]]:
    """Shingles of the question (all but the last sentence) and the answer (the last); one sentence is cut at two thirds."""
    parts = [w for s in SENTENCE.split(text) if (w := words(s))]
    whole = [w for p in parts for w in p]
    last = len(parts[-1]) if len(parts) > 1 else math.ceil(len(whole) / 3)
    return shingles(whole[: len(whole) - last]), shingles(whole[len(whole) - last :])


class Index:
    """Block-max index of items [(item_id, text)] under document frequencies ``df`` of ``total`` items, the longest of ``longest`` words or more."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], total: int, mean: float, longest: int = 1, least: float = SCORE) -> None:
        self.items = [(i, t) for i, t in sorted(items) if words(t)]
        self.least = least
        self.impacts, self.shingles, self.parts, need = [], [], [], []
        essential: dict[str, list[tuple[int, float]]] = {}
        self.longest = longest
        for k, (_, text) in enumerate(self.items):
            found = words(text)
            self.longest = max(self.longest, len(found))
            raw = {}
            for w, tf in Counter(found).items():
                idf = math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5))
                raw[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(found) / mean))
            own = sum(raw.values())
            impact = {w: x / own for w, x in raw.items()}
            self.impacts.append(impact)
            self.shingles.append(shingles(found))
            self.parts.append(question_answer(text))
            rest = 0.0
            for w in sorted(impact, key=lambda w: (-df[w], w)):
                if rest + impact[w] < least / 2:
                    rest += impact[w]
                else:
                    essential.setdefault(w, []).append((k, impact[w]))
            need.append(least - rest)
        self.terms = {w: n for n, w in enumerate(sorted(essential))}
        blocks, most, begin = [], [], [0]
        for w in sorted(essential):
            top: dict[int, float] = {}
            for k, x in essential[w]:
                top[k // BLOCK] = max(top.get(k // BLOCK, 0.0), x)
            blocks += sorted(top)
            most += [top[b] for b in sorted(top)]
            begin.append(len(blocks))
        self.blocks, self.most, self.begin = np.array(blocks, np.int64), np.array(most), np.array(begin, np.int64)
        self.top = np.array([max(most[a:b]) for a, b in zip(begin, begin[1:])]) if blocks else np.array([])
        self.n_blocks = (len(self.items) + BLOCK - 1) // BLOCK
        self.need = np.array([min(need[k : k + BLOCK]) for k in range(0, len(need), BLOCK)])

    def passages(self, n: int) -> list[tuple[int, int]]:
        """(from, to) of the windows over ``n`` words."""
        return [(k, min(n, k + 2 * self.longest)) for k in range(0, max(1, n - self.longest), self.longest)]

    def candidates(self, term: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, block) pairs whose block maxima reach the block's need; ``term`` are the essential terms at words ``at``.

        A window whose list maxima reach no need has no pivot: its posting lists are not opened.
        """
        window = at // self.longest
        key = np.unique(np.concatenate([window * len(self.terms) + term, np.maximum(window - 1, 0) * len(self.terms) + term]))
        window, term = np.divmod(key, len(self.terms))
        pivot = (np.bincount(window, self.top[term]) >= self.need.min() - 1e-9)[window]
        window, term = window[pivot], term[pivot]
        if not len(term):
            return
        many = self.begin[term + 1] - self.begin[term]
        flat = np.repeat(self.begin[term] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        pair, back = np.unique(np.repeat(window, many) * self.n_blocks + self.blocks[flat], return_inverse=True)
        bound = np.bincount(back, self.most[flat], len(pair))
        pair = pair[bound >= self.need[pair % self.n_blocks] - 1e-9]
        yield from zip((pair // self.n_blocks).tolist(), (pair % self.n_blocks).tolist(), strict=True)

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float, float]]:
        """item_id -> (score, shingle, question and answer overlap) of the best verified passage of each leaked item."""
        found = words(text)
        if not found or not self.terms:
            return {}
        term = np.fromiter(map(self.terms.get, found, (-1 for _ in found)), np.int64, len(found))
        at = np.flatnonzero(term >= 0)
        out: dict[int, tuple[float, float, float, float]] = {}
        if not len(at):
            return out
        spans = self.passages(len(found))
        last, held, here = -1, set(), set()
        for w, block in self.candidates(term[at], at):
            w = min(w, len(spans) - 1)
            if w != last:
                passage = found[slice(*spans[w])]
                last, held, here = w, set(passage), None
            for k in range(block * BLOCK, min(len(self.items), block * BLOCK + BLOCK)):
                score = sum(x for t, x in self.impacts[k].items() if t in held)
                if score < self.least - 1e-9:
                    continue
                if here is None:
                    here = {n: {tuple(passage[j : j + n]) for j in range(len(passage) - n + 1)} for n in range(1, SHINGLE + 1)}
                share = lambda s: sum(x in here[len(x)] for x in s) / len(s) if s else 1.0
                best = (share(self.shingles[k]), score, *map(share, self.parts[k]))
                if best[0] >= SHINGLES and min(best[2:]) >= PARTS:
                    item = self.items[k][0]
                    out[item] = max(out.get(item, (0.0,)), best)
        return {i: (x[1], x[0], *x[2:]) for i, x in out.items()}


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, shingle_overlap, question_overlap, answer_overlap) of every leaked item.

    ``docs`` (doc_id, text), ``items`` (item_id, text); a doc_id may be a string. Items without words match
    nothing, null texts are empty, null item ids are left out, null doc_ids are kept; repeated documents each
    give their rows, of repeated item ids the least text counts; empty tables give no rows; texts of any
    length are searched whole, window by window. Items are indexed in sets of at most about ``ITEMS``; windows,
    frequencies and so the results are the same for any number of sets.
    """
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("string").alias("text"))
    items = items.groupBy("item_id").agg(F.min("text").alias("text"))

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words(t)
                yield pa.record_batch([pa.array([i] * len(set(found)), pa.int64()), pa.array(sorted(set(found)), pa.string()), pa.array([len(found)] * len(set(found)), pa.int64())], names=["item_id", "term", "size"])

    terms = items.mapInArrow(said, "item_id long, term string, size long")
    mean, longest = terms.groupBy("item_id").agg(F.max("size").alias("size")).agg(F.avg("size"), F.max("size")).first()
    total = items.count()
    named = docs.schema["doc_id"].dataType == T.StringType()
    docs = docs.select(F.col("doc_id").cast("string" if named else "long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = f"doc_id {'string' if named else 'long'}, item_id long, score double, shingle_overlap double, question_overlap double, answer_overlap double"
    bounds = id_bounds(items, math.ceil(total / ITEMS), "item_id") if total > ITEMS else []
    kinds = [pa.string() if named else pa.int64(), pa.int64(), *[pa.float64()] * 4]
    frames = []
    for part in range(len(bounds) + 1):
        mine = items.where(id_bucket(bounds, "item_id") == part)
        df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms.join(mine, "item_id", "left_semi").select("term").distinct(), "term", "left_semi")
        index = Index([tuple(r) for r in mine.collect()], dict(tuple(r) for r in df.collect()), total, mean or 1.0, longest or 1)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                rows = [(d, i, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in index.leaks(t).items()]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(c, kinds[k]) for k, c in enumerate(cols)], names=["doc_id", "item_id", "score", "shingle_overlap", "question_overlap", "answer_overlap"])

        frames.append(docs.mapInArrow(run, columns))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
