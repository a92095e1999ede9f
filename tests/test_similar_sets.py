"""Similar gram sets against brute force, and how few rows their join passes on."""

import random

import pytest
from pyspark.sql import functions as F

from turnlens.operators import insights


def sets_of(spark, sets):
    rows = [(f"s{k:04}", sorted(g), f"s{k:04}") for k, g in enumerate(sets)]
    return spark.createDataFrame(rows, "session_key string, g array<long>, rep string")


def brute(sets, least):
    out = {}
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if len(a & b) / len(a | b) >= least:
                out[f"s{i:04}", f"s{j:04}"] = len(a & b) / len(a | b)
    return out


def near_sets(n, universe):
    """Distinct sets of all sizes, each a seed with a few grams swapped, left out or put in."""
    rng = random.Random(n)
    found = {frozenset([1]), frozenset([1, 2]), frozenset([1, 2, 3]), frozenset([1, 2, 3, 4])}
    seeds = [set(rng.sample(range(universe), rng.choice((2, 3, 4, 6, 9, 14, 20, 30, 45)))) for _ in range(n // 10)]
    while len(found) < n:
        s = set(rng.choice(seeds))
        for _ in range(rng.randrange(6)):
            s ^= {rng.randrange(universe)}
        found.add(frozenset(s or {0}))
    return sorted(found, key=sorted)


@pytest.mark.parametrize(("least", "many", "universe"), [(0.75, 32, 100), (0.75, 10, 100), (0.75, 0, 2000), (0.6, 32, 60), (0.4, 12, 60), (0.9, 20, 700)])
def test_pairs_equal_brute_force(spark, least, many, universe):
    sets = near_sets(400, universe)
    got = [tuple(r) for r in insights.similar_sets(sets_of(spark, sets), least, many).collect()]
    want = brute(sets, least)
    assert len(got) == len({r[:2] for r in got}) and len(want) > 20
    assert {r[:2]: r[2] for r in got} == want


def test_only_similar_pairs_leave_the_join(spark):
    """No step behind the join drops candidates or repeated pairs, and no key of few grams gathers a large share of the sets."""
    rng = random.Random(5)
    sets = sorted({frozenset(rng.sample(range(100), 18)) for _ in range(2000)}, key=sorted)
    pairs = insights.similar_sets(sets_of(spark, sets))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.index("Join") < plan.index("Generate") and "Filter" not in plan[: plan.index("Join")]
    keys = sets_of(spark, sets).select(F.explode(insights.shared_keys(F.size("g"), F.col("g"), 0.75)).alias("key"))
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] < len(sets) / 10
