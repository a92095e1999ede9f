"""Brute-force checks of fill-in-the-middle assembly, top-k search and importance resampling, over odd rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnlens.llm import fim_assembly, importance_resample, topk_threshold


def draws(seed, doc_id):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def fim_brute(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), draws(7, doc_id)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate
    form = "plain" if plain else "spm" if h[3] % 100 < 50 else "psm"
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, n, form, None if plain else len(pre), None if plain else len(mid), digest(out), digest(text)


@pytest.mark.parametrize("rate", [100, 40])
def test_fim_equals_brute_force(spark, odd, nothing, rate, monkeypatch):
    extra = [(100, "a\nb <S> c\nd", 0), (101, "no markers < P> <S\n>\n<\n", 0), (102, "\n\n\n", 0), (103, ("é漢🙂\n" * 7 + "x" * 70_000 + "\n") * 5, 0), (104, "tail\n<", 0), (105, "P>\nS>\nM>", 0)]
    more = spark.createDataFrame(extra, "doc_id long, text string, row long").unionByName(odd.select("doc_id", "text", F.lit(1).cast("long").alias("row")))
    got = sorted(map(tuple, fim_assembly.transform(more, fim_rate=rate).collect()), key=str)
    assert got == sorted((fim_brute(r.doc_id, r.text, rate) for r in more.collect()), key=str)
    assert fim_assembly.transform(nothing).count() == 0


def test_fim_pieces_are_small_and_make_the_output(spark):
    text = ("line of text\n" * 9 + "y" * 200_000 + "\n") * 3
    rows = fim_assembly.outputs(spark.createDataFrame([(5, text)], "doc_id long, text string")).orderBy("place").collect()
    assert max(len(r.bytes) for r in rows) == fim_assembly.PIECE and len(rows) > 8
    assert hashlib.sha256(b"".join(bytes(r.bytes) for r in rows)).hexdigest() == fim_brute(5, text)[5]


def test_fim_restoration_reads_markers_not_the_emitting_side(spark):
    """Pieces whose hidden section is wrong are restored all the same, from the markers."""
    import pyarrow as pa

    docs = spark.createDataFrame([(k, "one\ntwo\nthree\nfour\n") for k in range(9)], "doc_id long, text string")
    rows = fim_assembly.in_order(docs, 7, 100, 50).withColumn("section", F.lit(0)).toArrow().sort_by([("row", "ascending"), ("place", "ascending")])
    parts = pa.Table.from_batches(fim_assembly.assembled(iter(rows.to_batches()))).sort_by([("row", "ascending"), ("section", "ascending"), ("place", "ascending")])
    out = pa.Table.from_batches(fim_assembly.restored(iter(parts.to_batches())))
    assert set(out["restored_sha256"].to_pylist()) == {hashlib.sha256(b"one\ntwo\nthree\nfour\n").hexdigest()} and out.num_rows == 9


def top_brute(rows, k=5, every=50):
    """Rows (vec_id, embedding) as the docstring has it."""
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, q in {(i, tuple(v)) for i, v in sound if i is not None and i % every == 0}:
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), math.inf if j is None else j) for j, v in sound if j != i)
        for rank, (score, j) in enumerate(scored[:k], 1):
            out[i, rank, None if j == math.inf else j, -score] += 1
    return out


def vectors(seed, n, dim, groups, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    v = (middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


SMALL = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("shape", [dict(), dict(block=60, group=4, centers=8), dict(block=7, group=1, centers=3)])
def test_top_k_equals_brute_force(spark, shape):
    rows = vectors(3, 400, 12, 5, 0.2)
    odd = [(401, None), (402, [float("nan")] * 12), (403, [1.0, None] * 6), (404, [float("inf")] * 12), (None, rows[7][1]), (None, None), (405, []), (450, [1.0, 2.0]), (406, rows[50][1] + [9.0]), rows[9], rows[100], rows[50], (500, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], SMALL + ", query_id string, rank int")
    got = Counter(map(tuple, topk_threshold.top_k(df, **shape).collect()))
    assert got == top_brute(rows + odd)


def test_top_k_of_ties_few_rows_and_none(spark):
    same = [(i, [0.5, -0.25, 0.0]) for i in range(120)]
    for rows in (same, same[:3], same[1:9], [(0, [1.0])], []):
        got = Counter(map(tuple, topk_threshold.top_k(spark.createDataFrame(rows, SMALL), block=16, group=2).collect()))
        assert got == top_brute(rows)


def test_top_k_of_huge_components_is_exact(spark):
    rows = [(i, [(-1.0) ** i * 3e38 / (i + 1), 1e30, 0.001 * i]) for i in range(60)] + [(60, [1e6, 2e6, 3.0]), (100, [1e5, 1e5, 1e5])]
    got = Counter(map(tuple, topk_threshold.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=20).collect()))
    assert got == top_brute(rows)


def test_threshold_walk_ends_early_on_blocks_of_near_rows():
    """With a kth score from elsewhere a far block is not read; in a skewed block the walk sees few rows; all scores are those of brute force."""
    rng = np.random.default_rng(8)
    values = np.floor(256 * rng.exponential(0.2, size=(4000, 4)))
    values[rng.integers(0, 4000, 60)] *= 6
    ids = np.arange(4000)
    block = topk_threshold.lists(values)
    queries = np.floor(256 * rng.normal(0.3, 0.2, size=(40, 4)))
    rows, scores, scored = topk_threshold.search(queries, [None] * 40, np.full(40, -np.inf), block, ids, ids, 5)
    want = queries @ values.T
    for q, s in enumerate(scores):
        assert sorted(s, reverse=True) == sorted(want[q], reverse=True)[:5]
    assert scored < 0.5 * want.size
    far = topk_threshold.bounds(queries, block, [0])[:, 0] + 1
    none = topk_threshold.search(queries, [None] * 40, far, block, ids, ids, 5)
    assert none[2] == 0 and not any(map(len, none[0]))
    tied = [np.lexsort((ids, -want[q]))[:5].tolist() for q in range(40)]
    assert [r.tolist() for r in rows] == tied


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)


def resample_brute(docs, target, longest, buckets, least_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)[0]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        found, words = features(x, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[4]))
    quota = percent * len(order) // 100
    rank = iter(range(1, quota + 1))
    return sorted([(*r[:4], next(rank)) for r in order[:quota]] + [(*r[:4], None) for r in order[quota:] + [r for r in rows if r[4] < least_words]], key=str)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 40), (3, 7, 100)])
def test_resampling_equals_brute_force(spark, odd, nothing, longest, buckets, percent):
    texts = [(k, f"Alpha{k % 7} beta gamma-{k} {'delta ' * (k % 30)} Zürich 漢字 {k} " + "w" * (k % 80) + " " + "long" * (30 * (k % 3))) for k in range(300)]
    same = [(None, "twenty words " * 12)] * 40 + [(9, "again and again " * 9)] * 5
    docs = odd.select("doc_id", "text", F.lit("clash").alias("weight")).unionByName(spark.createDataFrame([(*r, "x") for r in texts + same], "doc_id long, text string, weight string")).repartition(3)
    target = spark.createDataFrame([("beta delta delta",), (None,), ("Zürich moon stone wall",)], "text string")
    got = importance_resample.resample(docs, target, longest, buckets, percent=percent)
    want = resample_brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest, buckets, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert importance_resample.resample(nothing, target).count() == 0
    alone = importance_resample.resample(docs, nothing.select("text"), longest, buckets, percent=percent).collect()
    assert sorted(map(tuple, alone), key=str) == resample_brute([(r.doc_id, r.text) for r in docs.collect()], [], longest, buckets, percent=percent)


def test_hashes_equal_the_libraries_and_equal_hashes_are_told_apart(monkeypatch):
    texts = [" ".join("ab" * (k % 9) + "é" * (k % 5) + str(k) for k in range(300)).encode(), ("z" * 31 + " " + "z" * 32 + " " + "q" * 64 + " " + "q" * 65 + " " + "m" * 5000).encode() * 3]
    g = importance_resample.grams(texts, 2)
    said = [g.data[a : a + n].tobytes() for a, n in zip(g.start, g.size)]
    lanes = importance_resample.lanes_of(g.data)
    assert importance_resample.xxh64(g, lanes).tolist() == [xxhash.xxh64_intdigest(w) for w in said]
    assert importance_resample.crc32(g, np.arange(len(said))).tolist() == [zlib.crc32(w) for w in said]
    monkeypatch.setattr(importance_resample, "xxh64", lambda g, lanes: np.full(len(g.start), 2**64 - 2, np.uint64))
    table = importance_resample.intern(g, 1000)
    assert len(set(zip(table.slot.tolist(), said))) == len(set(said)) == len(set(table.slot.tolist()))
    assert table.bucket[table.slot].tolist() == [zlib.crc32(w) % 1000 for w in said]
    assert table.count[table.slot].tolist() == [Counter(said)[w] for w in said]
