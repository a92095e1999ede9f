"""Toxicity by noisy-channel deobfuscation.

The corpus' own letters are counted, then a character trigram model over them, both over all documents.
Words that look disguised (leet characters inside letters, letters written apart, repeated letters) become
lattices whose cheapest path under channel costs and the language model is found by Viterbi decoding, however
long they are; the restored text is then scored. The scorer is a logistic model over the character 5-grams
that labelled toxic texts hold far more often than clean ones. Labels come from a bounded sample
(``TOXIC_ROWS`` and ``CLEAN_ROWS`` rows with the smallest id hashes); corpus counts and scores cover every row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.llm.common import cut, pieces

TOXIC_ROWS, CLEAN_ROWS = 5_000, 15_000
GRAM = 5
#: Least log odds of a 5-gram, after ``CHANCE`` standard deviations of its toxic count are left out as chance.
ODDS, CHANCE = 3.0, 1.5
#: Letters with a class of their own, the commonest of the corpus; class 0 is anything else, the last one rarer letters.
LETTERS = 62

# Letters that a disguise may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = frozenset(" .-_*~")
#: Channel costs (nats): a disguised letter, a dropped separator, a dropped repetition, a dropped other character.
COST = {"leet": 1.0, "gap": 0.2, "again": 0.5, "other": 3.0}

SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(*._~€-]+[^\W\d_]|[0-9@$!|+(€][^\W\d_]{2}|[^\W\d_]{2}[0-9@$!|+€](?![^\s])|([^\W\d_])\1\1")
APART = re.compile(r"(?<!\S)[^\W_](?:[ .*~_-][^\W_]){3,}(?!\S)")
SPACE = re.compile(r"\s|$")
#: Longest word that is remembered once decoded.
LONG_WORD = 60


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def letter_counts(docs: DataFrame) -> dict[int, int]:
    """Counts of the code points of all lower-cased texts: at most as many numbers as there are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in pieces(batches):
            some = np.bincount(points("".join(t.lower() for t in b.column(0).to_pylist() if t)))
            total[: len(some)] += some
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["point", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).collect()
    return {r.point: r.n for r in rows}


def classes(counts: dict[int, int]) -> np.ndarray:
    """Class of each code point: 1 to ``LETTERS`` the commonest letters (ties by code point), ``LETTERS`` + 1 other letters, 0 the rest."""
    table = np.zeros(0x110000, np.uint8)
    letters = sorted((c for c in counts if chr(c).isalpha()), key=lambda c: (-counts[c], c))
    table[np.array(letters[LETTERS:], np.int64)] = LETTERS + 1
    table[np.array(letters[:LETTERS], np.int64)] = np.arange(1, len(letters[:LETTERS]) + 1)
    return table


def trigram_counts(docs: DataFrame, kinds: np.ndarray) -> np.ndarray:
    """Counts of class trigrams over all texts: at most 64**3 numbers, summed on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.int64)
        for b in pieces(batches):
            c = kinds[points("\n\n" + "\n\n".join(t.lower() for t in b.column(0).to_pylist() if t) + "\n\n")].astype(np.int32)
            total += np.bincount(c[:-2] << 12 | c[1:-1] << 6 | c[2:], minlength=1 << 18)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["tri", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 18, np.int64)
    for r in rows:
        out[r.tri] = r.n
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative log probabilities) of a class after two others, backed off to the class after one."""
    tri = counts.reshape(64, 64, 64).astype(float)
    bi = tri.sum(axis=0) + 0.05
    bi /= bi.sum(axis=1, keepdims=True)
    smooth = tri + 4 * bi[None]
    return -np.log(smooth / smooth.sum(axis=2, keepdims=True)).astype(np.float32)


def moves(ch: str, last: str) -> list[tuple[str, float]]:
    """Readings of a character behind a letter ``last``: (letter, or nothing, channel cost)."""
    reads = [(ch, 0.0)] if ch.isalpha() else [(x, COST["leet"]) for x in LEET.get(ch, "")]
    out = list(reads)
    if not ch.isalpha():
        out.append(("", COST["gap"] if ch in SEPARATORS else COST["other"]))
    if any(x == last for x, _ in reads):
        out.append(("", COST["again"]))
    return out


def restore(word: str, cost: np.ndarray, kinds: np.ndarray) -> str:
    """Cheapest reading of a disguised word (lower case): Viterbi over states (two classes before, last letter).

    Each state points back to the one that it came from, so a word of any length takes a step a character.
    """
    best: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for ch in word:
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (a, b, last), (sofar, said) in best.items():
            for x, price in moves(ch, last):
                if x:
                    k = int(kinds[ord(x)])
                    state, value = (b, k, x), sofar + price + float(cost[a, b, k])
                else:
                    state, value = (a, b, last), sofar + price
                if state not in after or value < after[state][0]:
                    after[state] = (value, (said, x) if x else said)
        best = after
    (_, said) = min(((v + float(cost[a, b, 0]), s) for (a, b, _), (v, s) in best.items()), key=lambda x: x[0])
    out = []
    while said is not None:
        said, x = said
        out.append(x)
    return "".join(reversed(out))


class Restorer:
    """Restores whole texts; remembers the short words that it has decoded."""

    def __init__(self, cost: np.ndarray, kinds: np.ndarray) -> None:
        self.cost, self.kinds, self.known = cost, kinds, {}

    def word(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            found = restore(word, self.cost, self.kinds)
            if len(word) <= LONG_WORD:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[word] = found
        return found

    def text(self, text: str | None) -> str:
        low = (text or "").lower()
        if APART.search(low):
            low = APART.sub(lambda m: self.word(m[0]), low)
        out, at = [], 0
        m = SUSPECT.search(low)
        while m:
            lo = m.start()
            while lo > at and not low[lo - 1].isspace():
                lo -= 1
            hi = SPACE.search(low, m.end()).start()
            out += [low[at:lo], self.word(low[lo:hi])]
            at = hi
            m = SUSPECT.search(low, hi)
        return "".join(out) + low[at:] if out else low


def grams(text: str, kinds: np.ndarray) -> np.ndarray:
    """Codes of the 5-grams of classes in a restored text, one boundary at either end."""
    c = np.concatenate([[0], kinds[points(text)], [0]]).astype(np.uint32)
    if len(c) < GRAM:
        return np.zeros(0, np.uint32)
    code = np.zeros(len(c) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        code = code << np.uint32(6) | c[k : len(c) - GRAM + 1 + k]
    return code


def features(code: np.ndarray, known: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Largest weight and log of the summed weights of the distinct known 5-grams."""
    if not len(known):
        return 0.0, 0.0
    at = np.searchsorted(known, code)
    at[at == len(known)] = 0
    hit = np.unique(at[known[at] == code])
    return (float(weight[hit].max()), math.log1p(float(weight[hit].sum()))) if len(hit) else (0.0, 0.0)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Model:
    """What ``fit`` learns: letter classes, restorer costs, known 5-grams with weights, logistic coefficients."""

    def __init__(self, kinds: np.ndarray, cost: np.ndarray, known: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> None:
        self.kinds, self.cost, self.known, self.weight, self.beta = kinds, cost, known, weight, beta


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs`` (doc_id, text) and the labels (doc_id, toxic) of rows that are not held out.

    Null labels and ids are left out; a document with several labels is toxic if one says so; repeated rows
    of ``docs`` count each; ties in the sample's hashes go by id. Without labelled toxic rows no 5-gram is
    known and every text gets the same low score.
    """
    kinds = classes(letter_counts(docs))
    cost = language_model(trigram_counts(docs, kinds))
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda t, n: train.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = docs.join(F.broadcast(pick(1, TOXIC_ROWS).unionByName(pick(0, CLEAN_ROWS))), "doc_id").select("text", "toxic")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(cost, kinds)
        for b in pieces(batches):
            yield pa.record_batch([pa.array([r.text(t) for t in b.column(0).to_pylist()], pa.string()), b.column(1).cast(pa.int32())], names=["text", "toxic"])

    sample = cut(sample.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(restored, "text string, toxic int"), "toxic-sample")
    size = {int(r.toxic): r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    a_all, b_all = size.get(1, 0), size.get(0, 0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_pylist()
            found = [np.unique(grams(t, kinds)) for t in b.column(0).to_pylist()]
            code, back = np.unique(np.concatenate([*found, np.zeros(0, np.uint32)]), return_inverse=True)
            hit = np.bincount(back, np.repeat(np.array(toxic, float), list(map(len, found))), len(code))
            columns = [code, hit, np.bincount(back, minlength=len(code)) - hit]
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["code", "a", "b"])

    counts = sample.mapInArrow(counted, "code long, a long, b long").groupBy("code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sure = F.greatest(F.lit(0.0), F.col("a") - CHANCE * F.sqrt("a"))  # what a rare 5-gram may owe to chance is left out
    odds = F.log((sure + 0.5) / (a_all + 1)) - F.log((F.col("b") + 0.5) / (b_all + 1))
    sure_ones = counts.where("a > 0").select("code", odds.alias("odds")).where(F.col("odds") >= ODDS).orderBy("code").collect() if a_all else []
    known, weight = np.array([r.code for r in sure_ones], np.uint32), np.array([r.odds for r in sure_ones], float)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            f = [features(grams(t, kinds), known, weight) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([x for x, _ in f], pa.float64()), pa.array([y for _, y in f], pa.float64()), b.column(1)], names=["x", "y", "toxic"])

    # features repeat, so they come to the driver as counted values of the bounded sample
    rows = sample.mapInArrow(measured, "x double, y double, toxic int").groupBy("x", "y", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "y", "toxic").collect()
    x = np.array([[1.0, r.x, r.y] for r in rows]).reshape(-1, 3)
    t, n = np.array([float(r.toxic) for r in rows]), np.array([float(r.n) for r in rows])
    beta = np.array([math.log((a_all + 0.5) / (b_all + 0.5)), 0.0, 0.0])
    for _ in range(60 if a_all and b_all else 0):  # Newton steps of the penalised logistic likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (t - p)) - 0.01 * beta
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    if not a_all:
        beta = np.array([math.log(0.5 / (b_all + 1.5)), 0.0, 0.0])
    return Model(kinds, cost, known, weight, beta)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` (text and any other columns) with ``score`` and ``restored``, which replace columns of these names.

    Null and empty texts get the score of a text without signs; each row is scored by itself, so repeated
    rows score alike; an empty table gives no rows.
    """
    kinds, known, weight, beta, cost = model.kinds, model.known, model.weight, model.beta, model.cost
    docs = docs.drop("score", "restored").withColumn("text", F.col("text").cast("string"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(cost, kinds)
        maybe = np.zeros(1 << 20, bool)  # quick test before the exact one
        fold = lambda c: (c * np.uint32(2654435761)) >> np.uint32(12)
        maybe[fold(known)] = True
        for b in pieces(batches):
            texts = [r.text(t) for t in b.column(names.index("text")).to_pylist()]
            out = []
            for t in texts:
                code = grams(t, kinds)
                f = features(code[maybe[fold(code)]], known, weight)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(beta @ np.array([1.0, *f])))))))
            yield pa.record_batch([*b.columns, pa.array(out, pa.float64()), pa.array(texts, pa.string())], names=[*names, "score", "restored"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("restored", T.StringType())])
    return docs.mapInArrow(run, schema)
