"""Folds against plain Python on small hand-made and random sessions."""

import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from turnlens import schema
from turnlens.operators import facts, folds, insights, ordered, pricing, trajectory, versioned
from turnlens.plans import bridge
from turnlens.plans.report import analysis_report


def call(name="view_file", kind="Other", i=0, **payload):
    fields = [f.split(":")[0] for f in schema.INTENT_DDL[7:-1].split(",")]
    intent = tuple({"kind": kind, "raw_name": name if kind == "Other" else None, **payload}.get(f) for f in fields)
    return (f"c{i}", name, intent, "{}")


def turn(index, role, calls=(), results=(), usage=None, ts=None, text=None, latency=0, session="s"):
    return (session, "p", session, None, None, index, role, ts, latency, text, list(calls), list(results), usage, None, "gpt-4o-x", None)


def wrong(i=0, error_class="ToolError", said=None):
    return (f"c{i}", 0, 0, True, error_class, said, None)


@pytest.fixture(scope="module")
def frame(spark):
    return lambda turns: spark.createDataFrame(turns, schema.TURNS_DDL)


def test_duration_ranks(frame):
    r = folds.turn_duration(frame([turn(k, "Assistant", latency=100 * (k + 1)) for k in range(10)])).first()
    assert (r.p50_ms, r.p95_ms, r.mean_ms) == (600, 1000, 550)


def test_flow(frame):
    turns = [turn(k, "Assistant", [call(i=k)]) for k in range(6)] + [turn(6, "Assistant", [call(i=6)], [wrong(6, "Permission denied")])] + [turn(7 + k, "Assistant", [call(i=7 + k)]) for k in range(2)]
    r = ordered.flow(frame(turns)).first()
    assert (r.n_streaks, r.longest, r.mean_streak, r.n_calls) == (2, 6, 4.0, 9) and r.flow_ratio == 8 / 9


def test_fuzzy_clusters(frame):
    names = ["view_file"] * 5 + ["veiw_file"] * 2 + ["grep"] * 3 + ["grpe"] + ["bash"]
    rows = folds.fuzzy_tools(frame([turn(0, "Assistant", [call(n, i=k) for k, n in enumerate(names)])])).collect()
    # a swap is two edits: too many for the short names, so each stays canonical
    assert {r.canonical: (r.n_names, r.n_calls, r.typo_calls) for r in rows} == {"view_file": (2, 7, 2), "grep": (1, 3, 0), "grpe": (1, 1, 0), "bash": (1, 1, 0)}


def test_loops(frame):
    reads = lambda keys: [turn(k, "Assistant", [call("view_file", "FileRead", k, path=p)]) for k, p in enumerate(keys)]
    loops = lambda keys: trajectory.circular_loops(trajectory.grounded(frame(reads(keys)))).count()
    assert loops("AAA") == 1 and loops("AAABA") == 0 and loops([str(k) for k in range(50)]) == 0
    assert trajectory.monotonicity(trajectory.grounded(frame(reads("AAAB")))).first().monotonicity == 0.25


def test_components_equal_plain_search(frame):
    rng = random.Random(3)
    for _ in range(3):
        keys = [rng.choice("abcdef") if rng.random() < 0.8 else None for _ in range(40)]
        turns = [turn(k, "Assistant", [call("x", "FileRead" if p else "Other", k, path=p)]) for k, p in enumerate(keys)]
        got = [r.component for r in trajectory.components(trajectory.grounded(frame(turns))).orderBy("seq").collect()]
        back = {}
        last = {}
        for k, p in enumerate(keys):
            if p and p in last:
                back[k] = last[p]
            if p:
                last[p] = k
        want, c = [], 0
        for k in range(40):
            c += not any(back.get(j, k) < k for j in range(k, 40))
            want.append(c)
        assert got == want


def test_open_streaks(frame):
    turns = [turn(0, "User"), turn(1, "Assistant"), turn(2, "Assistant"), turn(3, "User"), turn(4, "Assistant"), turn(5, "System"), turn(6, "ToolResult")]
    a, t = ordered.autonomy(frame(turns)).first(), ordered.timeline(frame(turns)).first()
    assert (a.max_streak, a.n_streaks, a.mean_streak) == (2, 2, 2.0)
    assert (t.n_streaks, t.max_streak, t.current_streak) == (2, 2, 0)


def test_golden_economics(spark, frame):
    u = (16, 1030, 187559, 461506, 0)
    usage = spark.sql(f"SELECT 's' AS session_key, 0L AS turn_index, timestamp'2025-01-01' AS ts, 'claude-3-5-sonnet-20241022' AS model, cast(null AS string) AS service_tier, named_struct('input_tokens', {u[0]}L, 'output_tokens', {u[1]}L, 'cache_creation_tokens', {u[2]}L, 'cache_read_tokens', {u[3]}L, 'reasoning_tokens', 0L) AS usage")
    r = pricing.session_economics(usage, pricing.seed_rates(spark)).first()
    assert [round(x, 4) for x in (r.cost_usd, r.baseline_usd, r.net_savings_usd)] == [0.8573, 1.9627, 1.1054]
    assert round(r.cache_hit_pct, 1) == 71.1 and round(r.efficiency, 2) == 2.29


def test_rate_windows_tiers_and_ties(spark):
    spark.sql("SELECT 1").collect()
    rates = spark.sql("""SELECT * FROM VALUES
      (0, 'gpt-4o', null, 'Input', 1L, timestamp'2024-01-01', timestamp'2025-01-01'), (1, 'gpt-4o', null, 'Input', 2L, timestamp'2025-01-01', null),
      (2, 'gpt-4o', null, 'Input', 3L, timestamp'2025-01-01', null), (3, 'gpt-4o', 'flex', 'Input', 9L, timestamp'2024-06-01', null)
      AS t(ord, model, tier, kind, rate_micro, effective_from, effective_until)""")
    usage = spark.sql("""SELECT *, 's' AS session_key FROM VALUES ('gpt-4o-a', null, timestamp'2024-12-31 23:59:59', 1L), ('gpt-4o', null, timestamp'2025-01-01', 3L), ('gpt-4o', 'flex', timestamp'2025-01-01', 9L),
      ('gpt-4o', 'flex', timestamp'2024-02-01', 1L), ('gpt-4o', 'other', timestamp'2025-02-01', 3L), ('gpt-4o', null, timestamp'2023-01-01', 0L), ('unknown', null, timestamp'2025-01-01', 0L), (null, null, timestamp'2025-01-01', 0L)
      AS t(model, service_tier, ts, want)""")
    assert all(r.rate_Input == r.want for r in pricing.rated(usage, rates).collect())


def test_ledger_dead_letter_and_upsert(spark, tmp_path):
    events = [(1, 1, "enqueue", None), (1, 2, "fail", "a"), (1, 3, "fail", "b"), (1, 4, "fail", "c"), (2, 5, "enqueue", None), (3, 6, "enqueue", None), (3, 7, "fail", "x"), (4, 8, "enqueue", None), (4, 9, "complete", None)]
    got = {r.item: (r.status, r.retry_count, r.last_error) for r in facts.ledger(spark.createDataFrame(events, "item long, seq long, event string, error string")).collect()}
    assert got == {1: ("dead_letter", 3, "c"), 2: ("pending", 0, None), 3: ("failed", 1, "x"), 4: ("completed", 0, None)}
    make = lambda rows: spark.createDataFrame(rows, "provider string, provider_session_id string, cost double")
    path = str(tmp_path / "sessions")
    for _ in range(2):
        versioned.upsert(path, make([("a", "1", 1.0), ("b", "1", 2.0)]), facts.SESSION_KEY, "provider")
    versioned.upsert(path, make([("a", "1", 5.0), ("a", "2", 6.0)]), facts.SESSION_KEY, "provider")
    rows = sorted((r.provider, r.provider_session_id, r.cost) for r in versioned.load(spark, path, make([]).schema).collect())
    assert rows == [("a", "1", 5.0), ("a", "2", 6.0), ("b", "1", 2.0)]


def test_pr_links_from_version_control(frame):
    vcs = call("run_command", "VersionControl", 1, action="git push")
    url = "see github.com/o/r/pull/12 and github.com/o/r/pull/13"
    turns = [turn(0, "Assistant", [vcs]), turn(1, "ToolResult", results=[("c1", 0, 0, False, None, url, None)]), turn(2, "ToolResult", results=[("c1", 0, 0, False, None, url, None)], text="github.com/o/r/pull/12")]
    got = {r.pr: (r.first_turn, r.mentions, r.vcs_mentions) for r in folds.pr_links(frame(turns)).collect()}
    assert got == {"o/r#12": (1, 3, 1), "o/r#13": (1, 2, 1)}


def test_similar_sessions_and_clusters(spark, frame):
    seqs = {"a": "xyzxy", "b": "xyzxy", "c": "xyzx", "d": "pqrs", "e": "xyzxw"}
    turns = [turn(k, "Assistant", [call(t, i=k)], session=s) for s, seq in seqs.items() for k, t in enumerate(seq)]
    grams = {s: set(zip(q, q[1:], strict=False)) for s, q in seqs.items()}
    want = {(a, b) for a in grams for b in grams if a < b and grams[a] != grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.75}
    assert {(r.a, r.b) for r in insights.similar_sessions(frame(turns)).collect()} == {(a, b) for a, b in want if a not in "bc" and b not in "bc"}
    near = lambda s, t: s != t and len(grams[s] & grams[t]) / len(grams[s] | grams[t]) >= 0.75
    classes = {r.session_key: (r.class_id, r.n_links) for r in insights.session_classes(frame(turns)).collect()}
    assert classes == {s: (min(t for t in grams if grams[t] == grams[s]), sum(near(s, t) for t in grams)) for s in grams}
    best = max((set(c) for n in range(1, 6) for c in combinations(grams, n) if all(near(s, t) for s in c for t in c if s != t)), key=len)
    assert {(r.cluster, r.session_key, r.member_count) for r in insights.workflow_clusters(frame(turns)).collect()} == {(min(best), s, len(best)) for s in best} and len(best) == 4



def test_sums_of_costs_are_exact_for_any_counters(frame, spark):
    """Counters that leave longs, unknown models with a tier of the default one, and null counters."""
    rates = spark.createDataFrame(
        [(k, m, t, kind, r, None, None) for k, (m, t, kind, r) in enumerate([("claude-3-5-sonnet", None, "Input", 3_000_000), ("claude-3-5-sonnet", "flex", "Input", 7), ("claude-3-5-sonnet", None, "CacheRead", 300_000), ("gpt-4o", None, "Output", 10_000_001)])],
        "ord int, model string, tier string, kind string, rate_micro long, effective_from timestamp, effective_until timestamp",
    ).withColumn("effective_from", F.lit("2020-01-01").cast("timestamp"))
    used = [("s", 0, "gpt-4o-x", None, (2**62, 2**62, 5, 6, 7)), ("s", 1, "gpt-4o", None, (1, 2**33 - 1, 3, 4, 5)), ("s", 2, "mystery", "flex", (10, 0, 2, 3, 0)), ("s", 3, "mystery", "other", (10, 0, 2, 2**40, 0)), ("s", 4, "gpt-4o", "flex", (1, None, 1, 1, 1))]
    rows = spark.createDataFrame(used, f"session_key string, turn_index long, model string, service_tier string, usage struct<{','.join(f'{c}:long' for c in ('input_tokens', 'output_tokens', 'cache_creation_tokens', 'cache_read_tokens', 'reasoning_tokens'))}>")
    priced = pricing.rated(rows.withColumn("ts", F.lit("2021-01-01").cast("timestamp")), rates)
    at = {r.turn_index: (r.rate_Input, r.rate_CacheRead, r.rate_Output) for r in priced.collect()}
    assert at == {0: (0, 0, 10_000_001), 1: (0, 0, 10_000_001), 2: (7, 300_000, 0), 3: (3_000_000, 300_000, 0), 4: (0, 0, 10_000_001)}
    got = priced.agg(pricing.summed_micro().alias("c"), pricing.summed_micro(baseline=True).alias("b"), F.sum(pricing.cost_micro()).alias("dc"), F.sum(pricing.baseline_micro()).alias("db")).first()
    assert (got.c, got.b) == (got.dc, got.db)
    assert int(got.c) == 10_000_001 * (2**62 + 2**33 - 1) + 70 + 900_000 + 30_000_000 + 300_000 * 2**40


def test_report_reads_the_turns_three_times_and_shuffles_them_three_times(spark):
    turns = bridge.turns_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    report = analysis_report(turns)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 3 and plan.count("Exchange hashpartitioning") <= 3
    rows = {r.session_key: r for r in report.collect()}
    assert duckdb.sql("SELECT count(DISTINCT user_id) FROM '/root/testdata/sf0.001/events.parquet'").fetchall()[0][0] == len(rows)
    for mark, fold in (("autonomy", ordered.autonomy), ("timeline", ordered.timeline), ("flow", ordered.flow), ("context", ordered.context_growth), ("correction", ordered.self_correction), ("breaker", ordered.circuit_breaker)):
        for r in fold(turns).collect():
            assert all(rows[r.session_key][f"{mark}_{c}"] == v for c, v in r.asDict().items() if c != "session_key")
    for fold in (folds.stats, folds.turn_duration, folds.api_health, folds.mcp_affinity, folds.permission_mode, folds.artifacts, folds.unmapped_results):
        for r in fold(turns).collect():
            assert all(rows[r.session_key][c] == v for c, v in r.asDict().items())


def test_report_of_bare_sessions(frame):
    """Sessions without calls, usage, times or roles have nulls or zeros, as the folds have; equal latencies are ties."""
    rows = [turn(0, None, session="bare"), turn(1, "User", text="yes", session="bare"), *[turn(k, "Assistant", latency=7, results=[wrong(said="github.com/a/b/pull/3 github.com/a/b/pull/3")], session="same") for k in range(3)]]
    got = {r.session_key: r for r in analysis_report(frame(rows)).collect()}
    bare, same = got["bare"], got["same"]
    assert (bare.n_turns, bare.manual, bare.distinct_tools, bare.typo_calls, bare.n_paths, bare.breaker_tripped, bare.context_max_rise, bare.charged_errors, bare.pull_requests) == (2, 1, None, None, 0, False, None, None, None)
    assert (same.p50_ms, same.p95_ms, same.mean_ms, same.pull_requests, same.timeline_current_streak, same.timeline_n_streaks, same.autonomy_max_streak) == (7, 7, 7, 1, 3, 0, 3)
    assert analysis_report(frame([])).count() == 0


def test_no_rows(frame):
    empty = frame([])
    for fold in (folds.stats, folds.turn_duration, folds.fuzzy_tools, folds.pr_links, ordered.flow, ordered.timeline, ordered.tool_nodes, ordered.circuit_breaker, trajectory.trajectory_metrics, insights.bimodal):
        assert fold(empty).count() == 0
