"""Streams over the derived turns end in the batch results."""

import pytest
from pyspark.sql import functions as F

from turnlens.operators import facts, folds, ordered, pricing, versioned
from turnlens.plans import bridge
from turnlens.streaming import sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def turns(spark):
    return bridge.turns_from_events(spark.read.parquet(f"{SF}/events.parquet"))


@pytest.fixture(scope="module")
def files(turns, tmp_path_factory):
    """Turns in three batches of files, in order."""
    root = tmp_path_factory.mktemp("turns")
    for k in range(3):
        turns.where(f"turn_index % 90 div 30 = {k}").coalesce(1).write.parquet(f"{root}/{k}")
    return root


def stream(spark, turns, files):
    return spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{files}")


def finish(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_totals(spark, turns, files, tmp_path):
    rates = pricing.seed_rates(spark)
    got = finish(sessions.running_totals(stream(spark, turns, files), rates), "complete", tmp_path, "totals")
    counts = {r.session_key: (r.n_turns, r.n_calls, r.n_user) for r in folds.stats(turns).collect()}
    costs = {r.session_key: (r.total_tokens, r.cost_usd, r.cache_hit_pct, r.efficiency) for r in pricing.session_economics(turns, rates).collect()}
    rows = sessions.session_totals(got).collect()
    assert {r.session_key: (r.n_turns, r.n_calls, r.n_user) for r in rows} == counts
    assert {r.session_key: (r.total_tokens, r.cost_usd, r.cache_hit_pct, r.efficiency) for r in rows} == costs
    assert sorted(map(str, sessions.attributed(got).collect())) == sorted(map(str, folds.attribution(turns).collect()))


def run(spark, fold, rows, root, parts, mode="update"):
    """The rows that each run over one more part gives."""
    other, out = sessions.ordered_session(spark), []
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        now = []
        q = fold(other.readStream.schema(rows.schema).parquet(f"{root}/in")).writeStream.outputMode(mode).foreachBatch(lambda b, _: now.extend(b.collect())).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()  # noqa: B023
        q.awaitTermination(120)
        out.append(now)
    return out


def test_ordered_state(spark, turns, tmp_path):
    """Turns in four parts that tear every session apart, the first turns last, and some twice."""
    rows = sessions.flags(turns)
    rows = rows.unionByName(rows.where("turn_index % 5 = 0")).withColumn("run", F.expr("CASE WHEN turn_index < 3 THEN 3 ELSE pmod(turn_index * 7, 3) END"))
    idle = 12 * 3_600_000
    runs = run(spark, lambda r: sessions.ordered_state(r.drop("run"), idle, "90 days"), rows, tmp_path, [f"run = {k}" for k in range(4)])
    assert not any(runs[:3]) and len(runs[3]) == turns.select("session_key").distinct().count()
    last = {r.session_key: r for r in runs[3]}
    a = {r.session_key: r.max_streak for r in ordered.autonomy(turns).collect()}
    t = {r.session_key: r.n_idle for r in ordered.timeline(turns, idle).collect()}
    f = {r.session_key: r.longest for r in ordered.flow(turns).collect()}
    c = {r.session_key: (r.retries, r.pivots) for r in ordered.self_correction(turns).collect()}
    assert {k: (r.max_streak, r.n_idle, (r.retries, r.pivots)) for k, r in last.items()} == {k: (a[k], t[k], c[k]) for k in a}
    assert {k: r.flow_longest for k, r in last.items()} == f
    b = {r.session_key: (r.max_run, r.stalls) for r in ordered.circuit_breaker(turns).collect()}
    o = {r.session_key: (r.max_streak, r.current_streak) for r in ordered.timeline(turns, idle).collect()}
    assert {k: (r.max_run, r.stalls) for k, r in last.items()} == b
    assert {k: (r.closed_streak, r.current_streak) for k, r in last.items()} == o


def test_a_gap_is_passed_when_the_watermark_is_beyond_it(spark, turns, tmp_path):
    """Turn 2 stays away: those after it wait, pass once other sessions move the watermark on, and turn 2 is too late then."""
    flat = sessions.flags(turns).limit(0)
    at = lambda k: f"2024-03-01 {k // 60:02}:{k % 60:02}:00"
    said = [("s", 0, 0, "User", 0), ("s", 1, 1, "Assistant", 0), ("s", 3, 3, "Assistant", 0), ("s", 4, 4, "Assistant", 0), ("other", 0, 600, "User", 1), ("other", 1, 601, "User", 2), ("s", 2, 602, "User", 2), ("s", 5, 602, "Assistant", 2)]
    rows = spark.createDataFrame([(s, k, at(m), r, n) for s, k, m, r, n in said], "session_key string, turn_index long, at string, role string, run int")
    none = {"ts": F.to_timestamp("at"), "n_calls": F.lit(0).cast("long"), "wrong": F.lit(False), "broke": F.lit(False), "keys": F.array().cast("array<string>"), "mutates": F.array().cast("array<boolean>"), "spawns": F.array().cast("array<string>")}
    rows = rows.withColumns(none).withColumn("ms", F.unix_millis("ts")).select(*flat.columns, "run")
    runs = run(spark, lambda r: sessions.ordered_state(r.drop("run"), late="1 hour"), rows, tmp_path, [f"run = {k}" for k in range(3)])
    seen = [[(r.session_key, r.n_turns, r.max_streak) for r in now] for now in runs]
    assert ("s", 2, 1) in seen[0] and ("s", 4, 3) not in seen[0]
    assert ("s", 4, 3) in seen[1] and ("s", 5, 4) in seen[2]


def test_buckets_change_no_result(spark, turns, tmp_path):
    """Sessions that share a bucket end like sessions with one of their own, those without a key too."""
    rows = sessions.flags(turns.where("turn_index < 40")).withColumn("session_key", F.expr("nullif(session_key, 'u1')"))
    last = []
    for buckets in (None, 2):
        runs = run(spark, lambda r: sessions.ordered_state(r, 1000, "90 days", buckets), rows, tmp_path / str(buckets), ["turn_index % 3 = 1", "turn_index % 3 <> 1"])  # noqa: B023
        assert not runs[0]
        last.append(sorted(map(str, runs[1])))
    assert last[0] == last[1] and len(last[0]) == rows.select("session_key").distinct().count()


def test_turns_without_a_time_open_no_gap(spark, turns, tmp_path):
    rows = sessions.flags(turns.withColumn("ts", F.when(F.col("turn_index") % 3 != 1, F.col("ts"))))
    idle = 12 * 3_600_000
    got = run(spark, lambda r: sessions.ordered_state(r, idle, "90 days"), rows, tmp_path, [F.lit(True)])[0]
    known = turns.where("turn_index % 3 <> 1")
    assert {r.session_key: r.n_idle for r in got} == {r.session_key: r.n_idle for r in ordered.timeline(known, idle).collect()}


def test_loop_alerts(spark, tmp_path):
    calls = [["a"], ["a", "a", "a"], ["b", "b", "!", "b"], [], ["b", "b", None, "b"]]
    schema = f"session_key string, turn_index long, ts timestamp, {sessions.WAITING}"
    rows = spark.createDataFrame([("s", k, None, "Assistant", None, len(x), False, False, x, [y == "!" for y in x], []) for k, x in enumerate(calls)], schema).withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    runs = run(spark, sessions.loop_alerts, rows, tmp_path, ["turn_index in (0, 2, 4)", "turn_index in (1, 3)"], "append")
    assert [[(r.turn_index, r.key) for r in now] for now in runs] == [[], [(1, "a"), (4, "b")]]


def test_late_rows_of_idle_spells(spark, tmp_path):
    """A row behind the watermark is left out, one inside it joins its spell; equal times and a gap of just the limit stay in one spell."""
    at = lambda m: f"2024-03-01 {m // 60:02}:{m % 60:02}:00"
    said = [("s", 0, 0), ("s", 5, 0), ("s", 30, 0), ("t", 60, 0), ("s", 31, 1), ("s", 55, 1), ("s", 2, 1), ("u", 1200, 2)]
    rows = spark.createDataFrame([(s, at(m), r) for s, m, r in said], "session_key string, at string, run int").withColumn("ts", F.to_timestamp("at")).drop("at")
    runs = run(spark, lambda r: sessions.idle_sessions(r.drop("run"), "5 minutes", "10 minutes"), rows, tmp_path, [f"run = {k}" for k in range(3)], "append")
    flat = sorted((r.session_key, r.started_at.strftime("%H:%M"), r.n_turns) for now in runs for r in now)
    assert flat == [("s", "00:00", 2), ("s", "00:30", 1), ("s", "00:55", 1), ("t", "01:00", 1)]


def test_lines_are_delivered_once(spark, tmp_path):
    lines = [("f", 1, 0), ("f", 2, 0), ("f", 1, 0), ("g", 1, 0), ("f", 2, 1), ("f", 3, 1), ("f", 1, 1)]
    rows = spark.createDataFrame(lines, "file_path string, line_number long, run int").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    runs = run(spark, lambda r: sessions.delivered_once(r.drop("run")), rows, tmp_path, ["run = 0", "run = 1"], "append")
    assert [sorted((r.file_path, r.line_number) for r in now) for now in runs] == [[("f", 1), ("f", 2), ("g", 1)], [("f", 3)]]


def test_windows(spark, turns):
    spells = sessions.idle_sessions(turns, "12 hours")
    gaps = {r.session_key: r.n_idle + 1 for r in ordered.timeline(turns, 12 * 3_600_000).collect()}
    assert {r.session_key: r["count"] for r in spells.groupBy("session_key").count().collect()} == gaps
    s = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_totalprice").alias("total_cost_usd"), F.lit("x").alias("provider"), F.lit(1).alias("wall_duration_ms"))
    weekly = {r.period_start: (r.session_count, r.total_cost_usd) for r in facts.periodic_rollups(s).where("provider = 'x'").collect()}
    assert {r.period_start: (r.session_count, r.total_cost_usd) for r in sessions.cost_rollup(s).collect()} == weekly


def test_lines_and_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\n{"b":2}\n')
    assert finish(sessions.line_stream(spark, f"file://{tmp_path}/in"), "append", tmp_path, "raw").count() == 2
    batch = spark.createDataFrame([("p", "1", 1.0), ("p", "1", 1.0), ("q", "1", 2.0)], "provider string, provider_session_id string, cost double")
    write = sessions.upsert_sink(str(tmp_path / "out"), facts.SESSION_KEY, "provider")
    write(batch, 1)
    write(batch, 1)
    assert versioned.load(spark, str(tmp_path / "out"), batch.schema).count() == 2
