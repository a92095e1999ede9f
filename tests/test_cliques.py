"""Clique search and workflow clusters against brute force, with dense components."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from turnlens.operators import graph, insights


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()

    def grow(chosen, may, seen):
        if not may and not seen:
            out.add(frozenset(chosen))
            return
        pivot = max(may | seen, key=lambda v: len(near[v] & may))
        for v in sorted(may - near[pivot]):
            grow(chosen | {v}, may & near[v], seen & near[v])
            may, seen = may - {v}, seen | {v}

    grow(frozenset(), set(near), set())
    return {c for c in out if len(c) > 1}


def found(spark, edges):
    cliques = graph.maximal_cliques(spark.createDataFrame(edges, "a string, b string"))
    rows = cliques.members.join(cliques.twins.withColumnsRenamed({"node": "member", "twin": "node"}), "node").groupBy("root", "nth").agg(F.collect_list("member").alias("m")).collect()
    sets = [frozenset(r.m) for r in rows]
    assert len(sets) == len(set(sets))
    return set(sets)


@pytest.mark.parametrize(("n", "share"), [(30, 0.3), (25, 0.6), (18, 0.85)])
def test_cliques_of_random_graphs(spark, n, share):
    rng = random.Random(n)
    edges = [(f"v{a:02}", f"v{b:02}") if rng.random() < 0.5 else (f"v{b:02}", f"v{a:02}") for a, b in combinations(range(n), 2) if rng.random() < share]
    assert found(spark, edges + edges[:5]) == brute(edges)


def test_a_complete_group_is_searched_as_one_node(spark):
    many = [(f"n{a:04}", f"n{b:04}") for a, b in combinations(range(120), 2)] + [("n0000", "tail")]
    cliques = graph.maximal_cliques(spark.createDataFrame(many, "a string, b string"))
    assert cliques.twins.select("twin").distinct().count() == 3
    assert found(spark, many) == brute(many)


def test_roots_are_searched_once_as_a_stream(spark):
    """A root's rows may be torn over many batches, and what the cliques are read for does not search again."""
    rng = random.Random(3)
    edges = [(f"v{a:02}", f"v{b:02}") for a, b in combinations(range(28), 2) if rng.random() < 0.5]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, edges) == brute(edges)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = graph.maximal_cliques(spark.createDataFrame(edges, "a string, b string")).members._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def sessions_of(spark, sets):
    """Turns whose tool names follow each other so that a session has the given bigrams: each bigram is a tool of its own between pauses."""
    rows = [(f"s{k:05}", i, [f"t{g}"]) for k, grams in enumerate(sets) for i, g in enumerate(grams)]
    turns = spark.createDataFrame(rows, "session_key string, turn_index long, names array<string>")
    return turns.select("session_key", "turn_index", F.transform("names", lambda n: F.struct(n.alias("tool_name"))).alias("tool_calls"))


def test_clusters_of_a_dense_component(spark):
    """1,200 sessions in one component: runs of tools that shift by one, so that each session is like its next neighbours only; each run three times."""
    length, n = 22, 400
    sets = [range(k, k + length) for k in range(n) for _ in range(3)]
    got = {r.session_key: (r.cluster, r.member_count) for r in insights.workflow_clusters(sessions_of(spark, sets)).collect()}
    grams = length - 1
    reach = max(d for d in range(grams) if (grams - d) / (grams + d) >= insights.SIMILAR)
    assert len(got) == 3 * n and reach > 1
    windows = [range(k, k + reach + 1) for k in range(n - reach)]
    want = {}
    for k in range(n):
        best = min((w for w in windows if k in w), key=lambda w: w[0])
        for copy in range(3):
            want[f"s{3 * k + copy:05}"] = best[0], 3 * len(best)
    least = {}
    for s, (w, _) in want.items():
        least[w] = min(least.get(w, s), s)
    assert got == {s: (least[w], m) for s, (w, m) in want.items()}


def test_no_clusters_and_a_class_alone(spark):
    apart = [range(100 * k, 100 * k + 5) for k in range(6)]
    assert insights.workflow_clusters(sessions_of(spark, apart)).count() == 0
    got = insights.workflow_clusters(sessions_of(spark, apart + [range(5)] * 2)).orderBy("session_key").collect()
    assert [tuple(r) for r in got] == [(s, "s00000", 3) for s in ("s00000", "s00006", "s00007")]
