"""Registered queries over the given tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens import schema
from turnlens.functions.columns import redacted, salted_hash
from turnlens.operators import facts, folds, insights, ordered, pricing, trajectory
from turnlens.plans import bridge
from turnlens.plans.report import analysis_report

Query = Callable[[SparkSession, str], DataFrame]
IDLE = 12 * 3_600_000
AS_OF = "2026-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.turns_from_events(read(spark, sf_dir, "events"))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.turns_from_conversations(read(spark, sf_dir, "conversations"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.usage_from_lineitem(read(spark, sf_dir, "lineitem"))


def over_turns(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(turns(s, d))


def two_window_rates(spark: SparkSession) -> DataFrame:
    """The seeded rates until 1996, doubled ones from then on, and a half-price tier of one model."""
    seed = pricing.seed_rates(spark).drop("effective_from", "effective_until")
    at = lambda a, b: [F.lit(a).cast("timestamp").alias("effective_from"), F.lit(b).cast("timestamp").alias("effective_until")]
    early = seed.select("ord", "model", "tier", "kind", "rate_micro", *at("1990-01-01", "1996-01-01"))
    late = seed.select((F.col("ord") + 100).alias("ord"), "model", "tier", "kind", (F.col("rate_micro") * 2).alias("rate_micro"), *at("1996-01-01", None))
    flex = seed.where("model = 'gpt-4o'").select((F.col("ord") + 200).alias("ord"), "model", F.lit("flex").alias("tier"), "kind", F.expr("rate_micro div 2").alias("rate_micro"), *at("1990-01-01", None))
    return early.unionByName(late).unionByName(flex)


RATE_ROWS = ", ".join(
    f"({i}, '{m}', '{k}', {round(u * 1e6)})"
    for i, (m, k, u) in enumerate((m, k, u) for m, r in pricing.SEED.items() for k, u in zip(pricing.KINDS, (r[0], r[1], r[2], r[3], r[3]), strict=True) if u is not None)
)

TURNS_SQL = r"""
base AS (
  SELECT 'u' || user_id AS session_key, user_id, event_id, ts, event_type AS et, value,
    coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_index FROM events),
kinds AS (
  SELECT *, CASE et
    WHEN 'view' THEN CASE WHEN k % 16 = 0 THEN 'McpCall' WHEN k % 8 = 0 THEN 'Other' ELSE 'FileRead' END
    WHEN 'click' THEN CASE WHEN k % 11 = 0 THEN 'SubagentSpawn' WHEN k % 4 = 0 THEN 'CodeSearch' ELSE 'FileRead' END
    WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'VersionControl' ELSE 'FileEdit' END
    WHEN 'error' THEN CASE WHEN k % 8 = 1 THEN 'Other' END END AS kind FROM base),
named AS (
  SELECT *, CASE WHEN kind IS NULL THEN NULL
      WHEN kind = 'FileRead' THEN CASE WHEN k % 20 = 0 THEN 'veiw_file' ELSE 'view_file' END
      WHEN kind = 'CodeSearch' THEN CASE WHEN k % 20 = 0 THEN 'grpe_search' ELSE 'grep_search' END
      WHEN kind = 'FileEdit' THEN CASE WHEN k % 20 = 0 THEN 'replace_flie_content' ELSE 'replace_file_content' END
      WHEN kind = 'McpCall' THEN 'mcp_get' WHEN kind = 'SubagentSpawn' THEN 'spawn_agent'
      WHEN et = 'view' THEN 'Bash' ELSE 'run_command' END AS tool_name,
    CASE WHEN kind IS NOT NULL THEN 'c' || event_id END AS call_id,
    CASE WHEN kind = 'FileRead' THEN 'f' || (turn_index // 6) WHEN kind = 'FileEdit' THEN 'e' || (k % 40) END AS path,
    CASE WHEN kind = 'CodeSearch' THEN 'q' || (k % 5) END AS query,
    CASE WHEN kind = 'VersionControl' THEN CASE WHEN k % 2 = 0 THEN 'git commit -m x' ELSE 'git status' END END AS action,
    CASE WHEN kind = 'SubagentSpawn' THEN 'a' || (k % 2) END AS agent_type FROM kinds),
turns AS (
  SELECT *, CASE WHEN kind = 'Other' THEN tool_name END AS raw_name,
    CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS n_calls,
    CASE et WHEN 'signup' THEN 'User' WHEN 'error' THEN 'ToolResult' WHEN 'view' THEN 'Assistant' WHEN 'click' THEN 'Assistant' WHEN 'purchase' THEN 'Assistant' ELSE 'System' END AS role,
    CASE WHEN et IN ('view', 'click', 'purchase') THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END AS latency_ms,
    CASE WHEN et = 'signup' THEN CASE WHEN k % 4 = 0 THEN 'yes' ELSE 'please go on' || CASE WHEN k % 9 = 0 THEN ' see github.com/acme/app/pull/' || k ELSE '' END
      || CASE WHEN k % 8 = 0 THEN ' {"$schema": "plan@1"}' ELSE '' END END END AS text,
    et = 'error' AS has_result, et = 'error' AND k % 4 <> 0 AS wrong,
    CASE k % 5 WHEN 0 THEN '429' WHEN 1 THEN '503' WHEN 2 THEN 'permission_denied' ELSE 'ToolError' END AS error_class,
    coalesce(last_value(call_id IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'none') AS result_call,
    CASE WHEN k % 2 = 0 THEN 'sp' || k END AS span_id,
    et IN ('view', 'click', 'purchase') AND k % 10 <> 0 AS has_usage,
    CAST(floor(value * 100) AS BIGINT) AS inp, CAST(floor(value * 10) AS BIGINT) AS outp, k * 10 AS cw, k * 50 AS cr, k AS rs,
    CASE k % 3 WHEN 1 THEN 'Plugin' WHEN 2 THEN 'Skill' ELSE 'Unattributed' END AS attr_kind,
    CASE k % 3 WHEN 1 THEN 'p' || (k % 4) WHEN 2 THEN 's' || (k % 4) END AS attr_name,
    CASE k % 4 WHEN 0 THEN 'claude-3-5-sonnet-20241022' WHEN 1 THEN 'gpt-4o-2024-08-06' WHEN 2 THEN 'qwen-2.5-coder-32b' ELSE 'mystery-model' END AS model,
    CASE WHEN k % 6 = 0 THEN 'flex' END AS service_tier FROM named),
used AS (SELECT *, inp + cw + cr AS prompt, inp + cw + cr + outp AS total FROM turns WHERE has_usage),
calls AS (SELECT * FROM turns WHERE kind IS NOT NULL)
"""

RATES_SQL = f"""
seed AS (SELECT * FROM (VALUES {RATE_ROWS}) t(ord, model, kind, rate)),
keyed AS (
  SELECT m.model, coalesce(max_by(s.model, length(s.model)), 'claude-3-5-sonnet') AS key FROM (SELECT DISTINCT model FROM src) m
  LEFT JOIN (SELECT DISTINCT model FROM seed) s ON m.model = s.model OR starts_with(m.model, s.model || '-') GROUP BY m.model),
wide AS (
  SELECT k.model, coalesce(max(rate) FILTER (kind = 'Input'), 0) AS r_in, coalesce(max(rate) FILTER (kind = 'CacheWrite'), 0) AS r_cw, coalesce(max(rate) FILTER (kind = 'CacheRead'), 0) AS r_cr,
    coalesce(max(rate) FILTER (kind = 'Output'), 0) AS r_out, coalesce(max(rate) FILTER (kind = 'Reasoning'), 0) AS r_rs
  FROM keyed k JOIN seed s ON s.model = k.key GROUP BY k.model),
rated AS (
  SELECT src.*, CAST(CASE WHEN ts >= TIMESTAMP '2024-01-01' THEN inp * r_in + cw * r_cw + cr * r_cr + outp * r_out + rs * r_rs ELSE 0 END AS HUGEINT) AS cost,
    CAST(CASE WHEN ts >= TIMESTAMP '2024-01-01' THEN (inp + cw + cr) * r_in + outp * r_out + rs * r_rs ELSE 0 END AS HUGEINT) AS base_cost
  FROM src JOIN wide USING (model))
"""

ECONOMICS = """
  sum(inp)::BIGINT AS input_tokens, sum(cw)::BIGINT AS cache_creation_tokens, sum(cr)::BIGINT AS cache_read_tokens, sum(outp)::BIGINT AS output_tokens, sum(rs)::BIGINT AS reasoning_tokens,
  sum(inp + cw + cr)::BIGINT AS prompt_tokens, sum(inp + cw + cr + outp)::BIGINT AS total_tokens,
  CASE WHEN sum(inp + cw + cr) = 0 THEN 0.0::DOUBLE ELSE sum(cr)::DOUBLE / sum(inp + cw + cr)::DOUBLE * 100 END AS cache_hit_pct,
  sum(cost)::DOUBLE / 1e12 AS cost_usd, sum(base_cost)::DOUBLE / 1e12 AS baseline_usd, greatest(sum(base_cost) - sum(cost), 0)::DOUBLE / 1e12 AS net_savings_usd,
  CASE WHEN sum(cost) > 0 THEN sum(base_cost)::DOUBLE / sum(cost)::DOUBLE ELSE 1.0::DOUBLE END AS efficiency, sum(cw)::BIGINT AS cache_5m_tokens, 0::BIGINT AS cache_1h_tokens
"""
PLAIN = "src AS (SELECT session_key, turn_index, ts, model, service_tier, inp, cw, cr, outp, rs FROM used)"
LAST = "src AS (SELECT session_key, arg_max_null(model, turn_index) AS model, max(ts) AS ts, sum(inp) AS inp, sum(cw) AS cw, sum(cr) AS cr, sum(outp) AS outp, sum(rs) AS rs FROM used GROUP BY session_key)"


SIMILAR_SQL = f""",
following AS (SELECT session_key, tool_name || '>' || lead(tool_name) OVER (PARTITION BY session_key ORDER BY turn_index) AS gram FROM calls),
grams AS (SELECT DISTINCT session_key, gram FROM following WHERE gram IS NOT NULL),
sets AS (SELECT session_key, string_agg(gram, ' ' ORDER BY gram) AS g, count(*) AS size FROM grams GROUP BY session_key),
classed AS (SELECT *, min(session_key) OVER (PARTITION BY g) AS rep FROM sets),
sizes AS (SELECT rep AS class_id, count(*) AS members FROM classed GROUP BY rep),
reps AS (SELECT session_key, gram, size FROM grams JOIN classed USING (session_key) WHERE session_key = rep),
pairs AS (SELECT x.session_key AS a, y.session_key AS b, count(*)::DOUBLE / (x.size + y.size - count(*))::DOUBLE AS jaccard
  FROM reps x JOIN reps y ON x.gram = y.gram AND x.session_key <> y.session_key GROUP BY x.session_key, y.session_key, x.size, y.size HAVING jaccard >= {insights.SIMILAR}::DOUBLE)
"""

WEEKLY_SQL = SIMILAR_SQL.replace("FROM calls)", "FROM weekly)", 1).replace("following AS (", "weekly AS (SELECT * REPLACE (session_key || '@' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS session_key) FROM calls),\nfollowing AS (", 1)
FUZZY_SQL = """,
tools AS (SELECT session_key, tool_name AS name, count(*) AS n FROM calls GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY n DESC, name) AS i FROM tools),
folded AS (
  WITH RECURSIVE step AS (
    SELECT DISTINCT session_key, 0::BIGINT AS i, []::VARCHAR[] AS known, NULL::VARCHAR AS name, NULL::VARCHAR AS canonical, 0::BIGINT AS n FROM ranked
    UNION ALL
    SELECT session_key, i, CASE WHEN hit IS NULL THEN list_append(known, name) ELSE known END, name, coalesce(hit, name), n FROM (
      SELECT r.session_key, r.i, s.known, r.name, r.n, [c for c in s.known if levenshtein(c, r.name) <= CASE WHEN strlen(r.name) < 5 THEN 1 ELSE 2 END][1] AS hit
      FROM step s JOIN ranked r ON r.session_key = s.session_key AND r.i = s.i + 1))
  SELECT session_key, name, canonical, n FROM step WHERE i > 0)
SELECT session_key, canonical, count(*) AS n_names, sum(n)::BIGINT AS n_calls, coalesce(sum(n) FILTER (name <> canonical), 0)::BIGINT AS typo_calls,
  coalesce(string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FILTER (name <> canonical), '') AS variants,
  (sum(coalesce(sum(n) FILTER (name <> canonical), 0)) OVER w)::DOUBLE / (sum(sum(n)) OVER w)::DOUBLE AS typo_rate
FROM folded GROUP BY session_key, canonical WINDOW w AS (PARTITION BY session_key)
"""


def over(sql: str, rates: str = "") -> str:
    """SQL over the derived turns; ``rates`` prices the CTE ``src`` it defines."""
    return "WITH " + TURNS_SQL + (f", {rates}, {RATES_SQL}" if rates else "") + sql


def economics(spark: SparkSession, sf_dir: str, grain: str = "turn") -> DataFrame:
    return pricing.session_economics(turns(spark, sf_dir), pricing.seed_rates(spark), grain)


def snapshots(rows: DataFrame) -> DataFrame:
    """Pre-compaction snapshots: three times the usage of every seventh turn."""
    u = lambda c: (F.col(f"usage.{c}") * 3).alias(c)
    return rows.where("usage is not null and turn_index % 7 = 0").select("session_key", F.struct(*[u(c) for c in pricing.COUNTERS]).alias("usage"))


def merged_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    totals = pricing.merge_snapshots(pricing.session_usage(rows), snapshots(rows))
    return pricing.summarised(pricing.rated(totals, pricing.seed_rates(spark)))


def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as session facts: provider is the priority, cost the price."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").cast("string").alias("provider_session_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_totalprice").alias("total_cost_usd"), (F.col("o_custkey") * 1000).alias("wall_duration_ms"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("batch_id"),
    )


SESSIONS_SQL = "s AS (SELECT o_orderpriority AS provider, CAST(o_orderkey AS VARCHAR) AS provider_session_id, o_orderdate AS started_at, o_totalprice AS total_cost_usd, o_custkey * 1000 AS wall_duration_ms, o_orderstatus AS status, o_custkey AS batch_id FROM orders)"


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a customer and day, later order keys replacing earlier ones."""
    rows = session_facts(spark, sf_dir).select("provider", (F.col("batch_id") % 500).cast("string").alias("provider_session_id"), "total_cost_usd", "status", F.col("provider_session_id").cast("long").alias("batch_id"))
    return facts.latest_by_key(rows, facts.SESSION_KEY)


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("enqueue")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), kind.alias("event"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))


LEDGER_SQL = """
WITH l AS (SELECT user_id AS item, event_id AS seq, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' ELSE 'enqueue' END AS event, 'e' || event_id AS error FROM events),
f AS (SELECT item, arg_max(event, seq) AS last, count(*) FILTER (event = 'fail') AS retry_count, arg_max(error, seq) FILTER (event = 'fail') AS last_error, min(seq) AS created FROM l GROUP BY item),
g AS (SELECT item, CASE WHEN last = 'enqueue' THEN 'pending' WHEN last = 'complete' THEN 'completed' WHEN retry_count >= 3 THEN 'dead_letter' ELSE 'failed' END AS status, retry_count, last_error, created FROM f)
"""


def hook_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hook lines from events: name by type, duration and decision by k."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    value = F.to_json(F.struct(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("hookEventName"), k.alias("durationMs"), F.when(k % 7 == 0, F.lit("block")).alias("decision"), F.when(k % 11 == 0, F.lit("deny")).alias("permissionDecision")))
    return read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_key"), value.alias("value"))


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is a child of the user with its tens digit, in one of three roles."""
    rows = read(spark, sf_dir, "events").select("user_id").distinct()
    return rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_key"), F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("parent_session_id"),
                       F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))).alias("subagent_role"))


def text_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-turn sessions with citations and pull requests woven in by their id."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(i % 5 == 0, F.lit(" plan@1 ")).otherwise(""), F.when(i % 10 == 0, F.lit('{"$schema": 1}')).otherwise(""), F.when(i % 7 == 0, F.concat(F.lit(" github.com/acme/app/pull/"), (i % 50).cast("string"))).otherwise(""))
    known = bridge.turns_from_conversations(d.select(F.col("source").alias("conv_id"), i.alias("turn"), F.lit("user").alias("role"), text.alias("text")))
    return known.withColumn("session_key", F.substr("session_key", F.lit(2)))


TEXT_SQL = """d AS (SELECT source AS session_key, doc_id AS turn_index, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' plan@1 ' ELSE '' END || CASE WHEN doc_id % 10 = 0 THEN '{"$schema": 1}' ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN ' github.com/acme/app/pull/' || (doc_id % 50) ELSE '' END AS text FROM documents)"""


def vcs_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of ``text_turns`` in threes: one calls version control, two have results of that call, some of these without output."""
    i = F.col("turn_index")
    call_id, step = F.concat(F.lit("c"), (F.floor(i / 60)).cast("string")), F.floor(i / 20) % 3
    call = F.struct(call_id.alias("call_id"), F.lit("git").alias("tool_name"), bridge.intent(F.lit("VersionControl"), action=F.lit("git push")).alias("intent"), F.lit("{}").alias("raw_arguments"))
    output = F.when(i % 4 > 0, F.concat(F.lit("see github.com/acme/lib/pull/"), (i % 11).cast("string"), F.lit(" and github.com/acme/app/pull/3")))
    null = lambda kind: F.lit(None).cast(kind)
    result = F.struct(call_id.alias("call_id"), null("long").alias("output_bytes"), null("long").alias("line_count"), F.lit(False).alias("is_error"), null("string").alias("error_class"), output.alias("truncated_output"), null("string").alias("otel_span_id"))
    calls, results = F.array().cast(schema.CALLS_DDL), F.array().cast(schema.RESULTS_DDL)
    return text_turns(spark, sf_dir).withColumns({"tool_calls": F.when(step == 0, F.array(call)).otherwise(calls), "tool_results": F.when(step > 0, F.array(result)).otherwise(results)})


PR_SQL = f"""WITH {TEXT_SQL},
r AS (SELECT session_key, turn_index, 'c' || (turn_index // 60) AS id, 'see github.com/acme/lib/pull/' || (turn_index % 11) AS said FROM d WHERE turn_index // 20 % 3 > 0 AND turn_index % 4 > 0),
c AS (SELECT session_key, turn_index AS call_turn, 'c' || (turn_index // 60) AS id FROM d WHERE turn_index // 20 % 3 = 0),
v AS (SELECT DISTINCT session_key, turn_index FROM (SELECT r.session_key, id, call_turn, min(turn_index) AS turn_index FROM r JOIN c USING (session_key, id) WHERE call_turn <= turn_index GROUP BY ALL)),
mentions AS (
  SELECT session_key, turn_index, v.turn_index IS NOT NULL AS from_vcs, unnest(['acme/lib#' || (turn_index % 11), 'acme/app#3']) AS pr FROM r LEFT JOIN v USING (session_key, turn_index)
  UNION ALL SELECT session_key, turn_index, false, 'acme/app#' || (turn_index % 50) FROM d WHERE turn_index % 7 = 0)
"""


def spent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions of a repository (some of none) and a category, with tokens and commits."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").cast("string").alias("session_key"), F.when(k % 13 > 0, F.concat(F.lit("r"), (k % 7).cast("string"))).alias("repository"), F.col("o_orderstatus").alias("category"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_totalprice").alias("total_cost_usd"), (k * 1000).alias("active_duration_ms"), (F.col("o_orderkey") % 1000).alias("total_tokens"), (k % 5).alias("commits"),
    )


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each returned line item, high for large quantities."""
    line = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return line.select(F.col("l_orderkey").cast("string").alias("session_key"), F.when(F.col("l_quantity") > 40, "high").otherwise("low").alias("severity"))


SPENT_SQL = """WITH f AS (SELECT l_orderkey AS k, count(*) AS n_findings, count(*) FILTER (l_quantity > 40) AS n_severe FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
s AS (SELECT coalesce(CASE WHEN o_custkey % 13 > 0 THEN 'r' || (o_custkey % 7) END, '(none)') AS repository, o_orderstatus AS category, o_orderdate AS started_at, CAST(o_totalprice AS DECIMAL(18,2)) AS cost, o_custkey * 1000 AS active_duration_ms,
  o_orderkey % 1000 AS total_tokens, o_custkey % 5 AS commits, coalesce(n_findings, 0) AS n_findings, coalesce(n_severe, 0) AS n_severe FROM orders LEFT JOIN f ON k = o_orderkey)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.loop_findings(turns(spark, sf_dir))
    return rows.withColumn("finding_id", F.concat_ws("|", "rule_id", "session_key", "evidence_json"))


def ms(df: DataFrame, *names: str) -> DataFrame:
    """Times as milliseconds, which read alike everywhere."""
    return df.withColumns({c: F.unix_millis(F.col(c).cast("timestamp")) for c in names})


def queries() -> dict[str, Query]:
    rates = pricing.seed_rates
    return {
        "b1_seed_rates": lambda s, d: used_rates(s, d),
        "b2_model_keys": lambda s, d: pricing.normalized_models(turns(s, d), rates(s)),
        "b3_as_of_rates": lambda s, d: pricing.rated(usage(s, d), two_window_rates(s)).select("session_key", "turn_index", *[f"rate_{k}" for k in pricing.KINDS]),
        "b4_turn_costs": lambda s, d: pricing.turn_costs(turns(s, d), rates(s)).select("session_key", "turn_index", "cost_usd"),
        "b5_baselines": lambda s, d: pricing.turn_costs(turns(s, d), rates(s)).select("session_key", "turn_index", "baseline_usd"),
        "b6_session_economics": economics,
        "b6_economics_at_scale": lambda s, d: pricing.session_economics(usage(s, d), two_window_rates(s)).select("session_key", "total_tokens", "cost_usd", "baseline_usd", "efficiency"),
        "b7_per_model": lambda s, d: pricing.per_model(turns(s, d), rates(s)),
        "b8_raw_model_usage": lambda s, d: pricing.raw_model_usage(turns(s, d), rates(s), AS_OF),
        "b9_session_grain": lambda s, d: economics(s, d, "session"),
        "b10_cost_drift": lambda s, d: pricing.cost_drift(economics(s, d).select("session_key", "cost_usd"), turns(s, d).groupBy("session_key").agg((F.count(F.lit(1)) / 100.0).cast("double").alias("provided_cost_usd"))),
        "b11_audit_report": lambda s, d: pricing.audit_report(economics(s, d)),
        "a17_snapshot_merge": merged_snapshots,
        "c1_trace_view": over_turns(facts.trace_view),
        "c2_scan_summary": lambda s, d: facts.scan_summary(turns(s, d), economics(s, d)),
        "c3_recent_sessions": lambda s, d: ms(facts.recent_sessions(session_facts(s, d), "1-URGENT", 20), "started_at").select("provider", "provider_session_id", "started_at", "total_cost_usd"),
        "c4_session_detail": lambda s, d: facts.session_detail(turns(s, d).select("session_key").distinct(), facts.tool_call_facts(turns(s, d)), pricing.per_model(turns(s, d), rates(s))),
        "c5_top_findings": lambda s, d: facts.top_findings(findings(s, d).select("finding_id", "session_key", "rule_id", "confidence"), 10),
        "c6_session_calls": lambda s, d: facts.calls_of(facts.tool_call_facts(turns(s, d)), "u7"),
        "c7_session_commands": lambda s, d: facts.commands_of(facts.command_facts(turns(s, d)), "u7"),
        "c8_rollup_reads": lambda s, d: ms(facts.rollups_of(facts.periodic_rollups(session_facts(s, d)).where("provider = '*'"), "week", 12), "period_start"),
        "c9_latest_snapshots": lambda s, d: facts.latest_snapshots(read(s, d, "events").select(F.col("event_type").alias("provider"), F.col("user_id").alias("session_id"), F.col("event_id").alias("snapshot_id"), F.col("props").alias("snapshot"))),
        "c10_spend_today": lambda s, d: facts.spend_since_midnight(session_facts(s, d), "1995-06-15 23:59:59"),
        "d1_session_upsert": upserted,
        "d2_rejected_usage": lambda s, d: facts.known_and_rejected(pricing.per_model(turns(s, d), rates(s)), turns(s, d).where("turn_index >= 60").select("session_key").distinct())[1].select("session_key", "model", "turns"),
        "d3_tool_call_facts": over_turns(facts.tool_call_facts),
        "d4_command_facts": over_turns(facts.command_facts),
        "d5_findings": lambda s, d: findings(s, d).drop("finding_id"),
        "d6_snapshots": lambda s, d: snapshots(turns(s, d)).select("session_key", "usage.*"),
        "d7_rollup_upsert": lambda s, d: ms(facts.latest_by_key(facts.periodic_rollups(session_facts(s, d)).withColumn("batch_id", F.col("provider")), facts.PERIOD_KEY).drop("batch_id"), "period_start"),
        "d8_ledger": lambda s, d: facts.ledger(ledger_events(s, d)),
        "d8_pending": lambda s, d: facts.pending(facts.ledger(ledger_events(s, d)), 25),
        "d9_redaction": lambda s, d: turns(s, d).select("session_key", "turn_index", F.explode("tool_calls").alias("c")).where("c.intent.action is not null").select("session_key", "turn_index", redacted(F.col("c.intent.action")).alias("sanitized")),
        "d10_identity_hash": lambda s, d: turns(s, d).select("session_key").distinct().select("session_key", salted_hash(F.col("session_key"), "pepper").alias("hashed")),
        "e1_stats": over_turns(folds.stats),
        "e1_stats_conversations": lambda s, d: folds.stats(said(s, d)),
        "e2_turn_duration": over_turns(folds.turn_duration),
        "e3_api_health": over_turns(folds.api_health),
        "e4_mcp_affinity": over_turns(folds.mcp_affinity),
        "e5_tool_inventory": over_turns(folds.tool_inventory),
        "e6_permission_mode": over_turns(folds.permission_mode),
        "e7_artifacts": over_turns(folds.artifacts),
        "e8_attribution": over_turns(folds.attribution),
        "e9_subagent_attribution": lambda s, d: folds.attribution_by_subagent(turns(s, d), children(s, d)),
        "e10_hook_activity": lambda s, d: folds.hook_activity(hook_lines(s, d)),
        "e10_hooks_by_event": lambda s, d: folds.hooks_by_event(hook_lines(s, d)),
        "e11_otel_correlation": lambda s, d: folds.otel_correlation(children(s, d).select("session_key", F.col("subagent_role").alias("conversation_id"))).select("session_key", "n_conversations", F.array_join("conversation_ids", ",").alias("ids")),
        "e12_span_mapping": over_turns(folds.span_mapping),
        "e12_unmapped_results": over_turns(folds.unmapped_results),
        "e13_session_counts": lambda s, d: facts.tool_call_facts(turns(s, d)).groupBy("session_key").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if("is_error").alias("n_errors")),
        "e14_schema_citations": lambda s, d: folds.schema_citations(text_turns(s, d)),
        "e15_pr_links": lambda s, d: folds.pr_links(vcs_turns(s, d)),
        "e15_pr_sessions": lambda s, d: folds.pr_sessions(vcs_turns(s, d)).withColumn("pull_requests", F.array_join("pull_requests", ",")),
        "e16_fuzzy_tools": over_turns(lambda t: folds.fuzzy_tools(t).withColumn("variants", F.array_join(F.transform("variants", lambda v: F.concat(v["name"], F.lit(":"), v.n_calls.cast("string"))), ","))),
        "e17_rollups_by_repository": lambda s, d: ms(facts.rollups_by_repository(spent_sessions(s, d), order_findings(s, d)), "period_start"),
        "e17_trailing_week": lambda s, d: ms(facts.trailing_week(spent_sessions(s, d), order_findings(s, d)), "day"),
        "e17_rollups": lambda s, d: ms(facts.periodic_rollups(session_facts(s, d)), "period_start"),
        "f1_autonomy": over_turns(ordered.autonomy),
        "f1_autonomy_conversations": lambda s, d: ordered.autonomy(said(s, d)),
        "f2_timeline": lambda s, d: ms(ordered.timeline(turns(s, d), IDLE), "last_ts"),
        "f3_flow": over_turns(lambda t: ordered.flow(t).withColumn("streaks", F.array_join(F.transform("streaks", lambda n: n.cast("string")), ","))),
        "f4_context_growth": over_turns(ordered.context_growth),
        "f5_self_correction": over_turns(ordered.self_correction),
        "f6_errors_by_tool": over_turns(ordered.errors_by_tool),
        "f7_circuit_breaker": over_turns(ordered.circuit_breaker),
        "f8_tool_nodes": over_turns(ordered.tool_nodes),
        "f9_forward_fill": lambda s, d: ms(ordered.forward_filled(turns(s, d).withColumn("ts", F.when(F.col("role") == "Assistant", F.col("ts")))), "ts").select("session_key", "turn_index", "ts"),
        "f10_cache_drops": over_turns(ordered.cache_drops),
        "g1_grounding": over_turns(trajectory.grounded),
        "g2_edges": over_turns(lambda t: trajectory.edges(trajectory.grounded(t))),
        "g3_components": over_turns(lambda t: trajectory.components(trajectory.grounded(t)).select("session_key", "seq", "component")),
        "g4_circular_loops": over_turns(lambda t: trajectory.circular_loops(trajectory.grounded(t))),
        "g5_monotonicity": over_turns(lambda t: trajectory.monotonicity(trajectory.grounded(t)).select("session_key", "n_nodes", "monotonicity")),
        "g6_efficiency": over_turns(lambda t: trajectory.monotonicity(trajectory.grounded(t)).select("session_key", "efficiency")),
        "g7_grounding_score": over_turns(trajectory.grounding_score),
        "g8_recovery_index": over_turns(trajectory.recovery_index),
        "g9_trajectory_metrics": over_turns(trajectory.trajectory_metrics),
        "h1_bimodal": over_turns(insights.bimodal),
        "h2_similar_sessions": over_turns(insights.similar_sessions),
        "h2_session_classes": over_turns(insights.session_classes),
        "h2_workflow_clusters": lambda s, d: insights.workflow_clusters(weekly(turns(s, d))),
        "h3_legacy_tools": lambda s, d: insights.legacy_tools(legacy_commands(s, d)),
        "h4_loop_findings": lambda s, d: findings(s, d).drop("finding_id"),
        "h4_findings": lambda s, d: insights.findings(turns(s, d), legacy_commands(s, d)),
        "j1_report": over_turns(lambda t: ms(analysis_report(t), "timeline_last_ts").withColumn("flow_streaks", F.array_join(F.transform("flow_streaks", lambda n: n.cast("string")), ","))),
    }


def weekly(rows: DataFrame) -> DataFrame:
    """Sessions of one user and week: short enough that many are alike."""
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return rows.withColumn("session_key", F.concat_ws("@", "session_key", week))


def used_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded rates of the models that the turns use."""
    keys = pricing.normalized_models(turns(spark, sf_dir), pricing.seed_rates(spark)).select(F.coalesce("key", F.lit(pricing.DEFAULT_MODEL)).alias("model")).distinct()
    return pricing.seed_rates(spark).join(keys, "model").select("ord", "model", "kind", "rate_micro")


def legacy_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("event_type") == "click", "grep").when(F.col("event_type") == "view", "find").when(F.col("event_type") == "error", "cat").otherwise("make")
    return read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_key"), base.alias("command_base"))


FLAGS = "turns.*, count(*) FILTER (role = 'User') OVER w AS island, count(*) FILTER (role <> 'Assistant') OVER w AS closed"
W = "WINDOW w AS (PARTITION BY session_key ORDER BY turn_index ROWS UNBOUNDED PRECEDING)"
NODES_SQL = """, nodes AS (
  SELECT session_key, turn_index, row_number() OVER (PARTITION BY session_key ORDER BY turn_index) - 1 AS seq, kind, path AS file, query AS symbol, coalesce(query, path) AS key,
    kind IN ('FileEdit', 'FileCreate') OR (kind = 'VersionControl' AND coalesce(string_split(action, ' ')[2] IN ('commit', 'push'), false)) AS mutates FROM calls),
backs AS (SELECT *, CASE WHEN key IS NOT NULL THEN lag(seq) OVER (PARTITION BY session_key, key ORDER BY seq) END AS back FROM nodes),
reach AS (SELECT *, min(back) OVER (PARTITION BY session_key ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM backs),
comps AS (SELECT *, CAST(sum(CASE WHEN r IS NULL OR r > seq - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS component FROM reach),
loops AS (SELECT session_key, component, min(key) AS key, count(*) AS size FROM comps GROUP BY session_key, component HAVING count(*) >= 3 AND count(key) = count(*) AND min(key) = max(key) AND NOT bool_or(mutates)),
mono AS (SELECT n.session_key, n.n_nodes, n.efficiency, 1 - least(1.0, coalesce(l.looping, 0)::DOUBLE / n.n_nodes) AS monotonicity
  FROM (SELECT session_key, count(*) AS n_nodes, avg(CASE WHEN mutates THEN 1.0::DOUBLE ELSE 0.5 END) AS efficiency FROM nodes GROUP BY session_key) n
  LEFT JOIN (SELECT session_key, sum(size) AS looping FROM loops GROUP BY session_key) l USING (session_key)),
ground AS (SELECT session_key, CASE WHEN sum(n_calls) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (n_calls = 1)::DOUBLE / sum(n_calls)::DOUBLE END AS grounding FROM turns GROUP BY session_key),
recov AS (SELECT session_key, CASE WHEN count(*) FILTER (wrong) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (wrong AND NOT nxt)::DOUBLE / count(*) FILTER (wrong)::DOUBLE END AS recovery
  FROM (SELECT *, lead(wrong) OVER (PARTITION BY session_key ORDER BY turn_index) AS nxt FROM turns) GROUP BY session_key)
"""
BREAKER_SQL = """, spawns AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY turn_index) AS n FROM calls WHERE kind = 'SubagentSpawn'),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY session_key, agent_type ORDER BY turn_index) AS run FROM spawns),
rounds AS (SELECT session_key, row_number() OVER (PARTITION BY session_key, agent_type, run ORDER BY turn_index) AS round FROM runs),
breaker AS (SELECT s.session_key, coalesce(max(round), 0) AS max_run, count(*) FILTER (round > 2) AS stalls, coalesce(max(round), 0) > 2 AS tripped FROM (SELECT DISTINCT session_key FROM turns) s LEFT JOIN rounds USING (session_key) GROUP BY s.session_key)
"""
FINDINGS_SQL = NODES_SQL + BREAKER_SQL + """, finds AS (
  SELECT session_key, 'circular-loop' AS rule_id, CASE WHEN size >= 6 THEN 'high' ELSE 'medium' END AS severity, least(1.0, size / 10.0)::DOUBLE AS confidence, 'WrongApproach' AS friction,
    '{"key":"' || key || '","size":' || size || '}' AS evidence_json, 'Looped over ' || key AS title, 'Stop reading ' || key || ' again; change it or look elsewhere' AS recommendation, '1' AS rule_version FROM loops
  UNION ALL SELECT session_key, 'gate-stall', 'high', least(1.0, max_run / 5.0)::DOUBLE, 'Other', '{"max_run":' || max_run || ',"stalls":' || stalls || '}', 'Spawned one agent again and again', 'Do the step without the agent, or ask for help', '1' FROM breaker WHERE tripped)
"""
LEGACY_SQL = "l AS (SELECT 'u' || user_id AS session_key, CASE event_type WHEN 'click' THEN 'grep' WHEN 'view' THEN 'find' WHEN 'error' THEN 'cat' END AS command_base FROM events), legacy AS (SELECT session_key, command_base, count(*) AS n_uses, CASE command_base WHEN 'grep' THEN 'rg' WHEN 'find' THEN 'fd' ELSE 'bat' END AS replacement FROM l WHERE command_base IS NOT NULL GROUP BY ALL)"
HYGIENE_SQL = f""", {LEGACY_SQL}, hygiene AS (
  SELECT session_key, 'legacy-tool' AS rule_id, CASE WHEN n_uses >= 10 THEN 'medium' ELSE 'low' END AS severity, least(1.0, 0.5 + n_uses / 20.0)::DOUBLE AS confidence, 'ProcessHygieneLapse' AS friction,
    '{{"command":"' || command_base || '","n_uses":' || n_uses || ',"replacement":"' || replacement || '","speedup":' || CASE command_base WHEN 'grep' THEN 5 WHEN 'find' THEN 4 ELSE 1 END || '}}' AS evidence_json,
    'Used ' || command_base AS title, 'Use ' || replacement || ' instead of ' || command_base AS recommendation, '1' AS rule_version FROM legacy)
"""
CALL_FACTS = """ , wrongs AS (SELECT session_key, result_call AS call_id, bool_or(wrong) AS is_error FROM turns WHERE has_result GROUP BY ALL),
cf AS (SELECT c.session_key, c.call_id, c.turn_index, 0::BIGINT AS call_pos, c.tool_name, c.kind AS intent_kind, c.latency_ms, coalesce(w.is_error, false) AS is_error FROM calls c LEFT JOIN wrongs w USING (session_key, call_id))
"""
ROLLUP_SQL = "WITH " + SESSIONS_SQL + """, w AS (SELECT CAST(date_trunc('week', started_at) AS TIMESTAMP) AS p, * FROM s),
r AS (SELECT (epoch_us(p) // 1000) AS period_start, 'week' AS period_type, coalesce(provider, '*') AS provider, count(*) AS session_count, sum(CAST(total_cost_usd AS DECIMAL(18,2)))::DOUBLE AS total_cost_usd, sum(wall_duration_ms)::BIGINT AS total_duration_ms
  FROM w GROUP BY GROUPING SETS ((p, provider), (p)))
"""


def timeline_sql(idle_ms: int) -> str:
    return f""", r AS (SELECT *, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w AS gap, count(*) FILTER (role <> 'Assistant') OVER w AS island FROM turns {W}),
    g AS (SELECT session_key, island, count(*) FILTER (role = 'Assistant') AS n, count(*) FILTER (gap > {idle_ms}) AS gaps, sum(gap) FILTER (gap > {idle_ms}) AS idle, max(gap) FILTER (gap > {idle_ms}) AS longest, arg_max(ms, turn_index) AS ms FROM r GROUP BY ALL),
    l AS (SELECT *, max(island) OVER (PARTITION BY session_key) AS last FROM g)
    SELECT session_key, count(*) FILTER (n > 0 AND island < last) AS n_streaks, coalesce(max(n) FILTER (island < last), 0) AS max_streak, max(n) FILTER (island = last) AS current_streak, sum(gaps)::BIGINT AS n_idle, coalesce(sum(idle), 0)::BIGINT AS idle_ms, coalesce(max(longest), 0) AS longest_idle_ms, arg_max(ms, island) AS last_ts FROM l GROUP BY session_key"""


REPORT_SQL = """, cites AS (SELECT session_key, count(*) AS citations, count(*) FILTER (contains(text, '{"$schema"')) AS valid_citations FROM turns WHERE contains(text, 'plan@1') GROUP BY session_key),
links AS (SELECT session_key, count(DISTINCT k) AS pull_requests FROM turns WHERE contains(text, 'github.com/acme/app/pull/') GROUP BY session_key),
sources AS (SELECT session_key, coalesce(sum(total) FILTER (attr_kind = 'Plugin'), 0)::BIGINT AS plugin_tokens, coalesce(sum(total) FILTER (attr_kind = 'Skill'), 0)::BIGINT AS skill_tokens,
  coalesce(sum(total) FILTER (attr_kind = 'Unattributed'), 0)::BIGINT AS other_tokens FROM used GROUP BY session_key)
SELECT * FROM (SELECT DISTINCT session_key FROM turns) LEFT JOIN sources USING (session_key) LEFT JOIN cites USING (session_key) LEFT JOIN links USING (session_key)"""


def report_sql(parts: dict[str, str]) -> str:
    """The report as a join of the SQL of its parts on the session."""
    totals = {"e5_tool_inventory": "count(*) AS distinct_tools, sum(n_calls)::BIGINT AS tool_calls", "e16_fuzzy_tools": "count(*) AS tool_clusters, sum(typo_calls)::BIGINT AS typo_calls", "f6_errors_by_tool": "sum(n_errors)::BIGINT AS charged_errors"}
    names = {
        "autonomy": (parts["f1_autonomy"], "max_streak mean_streak n_streaks autonomous_share"), "timeline": (over(timeline_sql(ordered.IDLE_MS)), "n_streaks max_streak current_streak n_idle idle_ms longest_idle_ms last_ts"),
        "flow": (parts["f3_flow"], "n_streaks longest mean_streak permission_blocks streaks n_calls flow_ratio"), "context": (parts["f4_context_growth"], "first_tokens peak_tokens last_tokens max_rise mean_rise"),
        "correction": (parts["f5_self_correction"], "retries pivots"), "breaker": (parts["f7_circuit_breaker"], "max_run stalls tripped"),
    }
    joined = [parts[p] for p in ("e2_turn_duration", "e3_api_health", "e4_mcp_affinity", "e6_permission_mode", "e7_artifacts", "e12_unmapped_results")] + [over(REPORT_SQL)]
    joined += [f"SELECT session_key, {c} FROM ({parts[p]}) GROUP BY session_key" for p, c in totals.items()]
    joined += [f"SELECT session_key, {', '.join(f'{c} AS {mark}_{c}' for c in columns.split())} FROM ({sql})" for mark, (sql, columns) in names.items()]
    return f"SELECT * FROM ({parts['e1_stats']})" + "".join(f" LEFT JOIN ({sql}) USING (session_key)" for sql in joined)


def oracle_sql() -> dict[str, str]:
    priced = lambda sql, src=PLAIN: over(sql, src)
    found = {
        "b1_seed_rates": priced("SELECT ord, model, kind, rate::BIGINT AS rate_micro FROM seed WHERE model IN (SELECT key FROM keyed)", "src AS (SELECT * FROM turns)"),
        "b2_model_keys": over(", m AS (SELECT DISTINCT model FROM turns) SELECT model, CASE model WHEN 'claude-3-5-sonnet-20241022' THEN 'claude-3-5-sonnet' WHEN 'gpt-4o-2024-08-06' THEN 'gpt-4o' WHEN 'qwen-2.5-coder-32b' THEN 'qwen-2.5-coder' END AS key FROM m"),
        "b3_as_of_rates": LINEITEM_SQL + "SELECT session_key, turn_index, r_in AS \"rate_Input\", r_cw AS \"rate_CacheWrite\", r_cr AS \"rate_CacheRead\", r_out AS \"rate_Output\", r_rs AS \"rate_Reasoning\" FROM priced",
        "b4_turn_costs": priced("SELECT session_key, turn_index, cost::DOUBLE / 1e12 AS cost_usd FROM rated"),
        "b5_baselines": priced("SELECT session_key, turn_index, base_cost::DOUBLE / 1e12 AS baseline_usd FROM rated"),
        "b6_session_economics": priced(f"SELECT session_key, {ECONOMICS} FROM rated GROUP BY session_key"),
        "b6_economics_at_scale": LINEITEM_SQL + "SELECT session_key, sum(inp + cw + cr + outp)::BIGINT AS total_tokens, sum(cost)::DOUBLE / 1e12 AS cost_usd, sum(base_cost)::DOUBLE / 1e12 AS baseline_usd, CASE WHEN sum(cost) > 0 THEN sum(base_cost)::DOUBLE / sum(cost)::DOUBLE ELSE 1.0::DOUBLE END AS efficiency FROM (SELECT *, CAST(inp * r_in + cw * r_cw + cr * r_cr + outp * r_out + rs * r_rs AS HUGEINT) AS cost, CAST((inp + cw + cr) * r_in + outp * r_out + rs * r_rs AS HUGEINT) AS base_cost FROM priced) GROUP BY session_key",
        "b7_per_model": priced("SELECT session_key, model, sum(inp)::BIGINT AS input_tokens, sum(cw)::BIGINT AS cache_creation_tokens, sum(cr)::BIGINT AS cache_read_tokens, sum(outp)::BIGINT AS output_tokens, sum(rs)::BIGINT AS reasoning_tokens, sum(cost)::DOUBLE / 1e12 AS cost_usd, count(*) AS turns FROM rated GROUP BY session_key, model"),
        "b8_raw_model_usage": priced(f"SELECT session_key, {ECONOMICS} FROM rated GROUP BY session_key", "src AS (SELECT session_key, turn_index, TIMESTAMP '2026-01-01' AS ts, model, inp, cw, cr, outp, rs FROM used)"),
        "b9_session_grain": priced(f"SELECT session_key, {ECONOMICS} FROM rated GROUP BY session_key", LAST),
        "b10_cost_drift": priced(", e AS (SELECT session_key, sum(cost)::DOUBLE / 1e12 AS cost_usd FROM rated GROUP BY session_key), p AS (SELECT session_key, count(*) / 100.0::DOUBLE AS provided_cost_usd FROM turns GROUP BY session_key) SELECT session_key, cost_usd, provided_cost_usd, provided_cost_usd - cost_usd AS drift_usd FROM e LEFT JOIN p USING (session_key)"),
        "b11_audit_report": priced(f", e AS (SELECT session_key, {ECONOMICS} FROM rated GROUP BY session_key) " + " UNION ALL ".join(f"SELECT session_key, '{m}' AS metric, {m}::DOUBLE AS value FROM e" for m in pricing.METRICS)),
        "a17_snapshot_merge": priced(f"SELECT session_key, {ECONOMICS} FROM rated GROUP BY session_key", LAST.replace("src AS", "tot AS") + ", snap AS (SELECT session_key, max(inp) * 3 AS i, max(cw) * 3 AS w, max(cr) * 3 AS r, max(outp) * 3 AS o FROM used WHERE turn_index % 7 = 0 GROUP BY session_key), src AS (SELECT t.session_key, t.model, t.ts, greatest(inp, coalesce(i, inp)) AS inp, greatest(cw, coalesce(w, cw)) AS cw, greatest(cr, coalesce(r, cr)) AS cr, greatest(outp, coalesce(o, outp)) AS outp, CASE WHEN i IS NOT NULL THEN 0 ELSE rs END AS rs FROM tot t LEFT JOIN snap USING (session_key))"),
        "c1_trace_view": over("SELECT session_key, turn_index, role, coalesce(tool_name || '(' || call_id || ')', '-') AS calls, CASE WHEN has_usage THEN inp || '/' || cw || '/' || cr || '/' || outp ELSE '-' END AS tokens FROM turns"),
        "c2_scan_summary": priced(f", e AS (SELECT session_key, {ECONOMICS} FROM rated GROUP BY session_key) SELECT t.session_key, 'bridge' AS provider, n_turns, coalesce(cache_hit_pct, 0) AS cache_hit_pct, coalesce(cost_usd, 0) AS cost_usd, coalesce(net_savings_usd, 0) AS net_savings_usd FROM (SELECT session_key, count(*) AS n_turns FROM turns GROUP BY session_key) t LEFT JOIN e USING (session_key)"),
        "c3_recent_sessions": f"WITH {SESSIONS_SQL} SELECT provider, provider_session_id, (epoch_us(started_at) // 1000) AS started_at, total_cost_usd FROM s WHERE provider = '1-URGENT' ORDER BY s.started_at DESC, provider, provider_session_id LIMIT 20",
        "c4_session_detail": over(CALL_FACTS + "SELECT s.session_key, coalesce(n_calls, 0) AS n_calls, coalesce(n_errors, 0) AS n_errors, coalesce(n_tools, 0) AS n_tools, coalesce(n_models, 0) AS n_models, coalesce(i, 0)::BIGINT AS input_tokens, coalesce(w, 0)::BIGINT AS cache_creation_tokens, coalesce(r, 0)::BIGINT AS cache_read_tokens, coalesce(o, 0)::BIGINT AS output_tokens, 0::BIGINT AS reasoning_tokens FROM (SELECT DISTINCT session_key FROM turns) s LEFT JOIN (SELECT session_key, count(*) AS n_calls, count(*) FILTER (is_error) AS n_errors, count(DISTINCT tool_name) AS n_tools FROM cf GROUP BY session_key) a USING (session_key) LEFT JOIN (SELECT session_key, count(DISTINCT model) AS n_models, sum(inp) AS i, sum(cw) AS w, sum(cr) AS r, sum(outp) AS o FROM used GROUP BY session_key) b USING (session_key)"),
        "c5_top_findings": over(FINDINGS_SQL + "SELECT rule_id || '|' || session_key || '|' || evidence_json AS finding_id, session_key, rule_id, confidence FROM finds ORDER BY confidence DESC, finding_id DESC LIMIT 10"),
        "c6_session_calls": over(CALL_FACTS + "SELECT * FROM cf WHERE session_key = 'u7'"),
        "c7_session_commands": over(COMMANDS + " AND session_key = 'u7'"),
        "c8_rollup_reads": ROLLUP_SQL + "SELECT * FROM r WHERE provider = '*' ORDER BY period_start DESC LIMIT 12",
        "c9_latest_snapshots": "SELECT event_type AS provider, user_id AS session_id, arg_max_null(props, event_id) AS snapshot, max(event_id) AS snapshot_id FROM events GROUP BY event_type, user_id",
        "c10_spend_today": f"WITH {SESSIONS_SQL} SELECT coalesce(sum(CAST(total_cost_usd AS DECIMAL(18,2))), 0)::DOUBLE AS spent_usd FROM s WHERE started_at >= TIMESTAMP '1995-06-15' AND started_at <= TIMESTAMP '1995-06-15 23:59:59'",
        "d1_session_upsert": "WITH u AS (SELECT o_orderpriority AS provider, CAST(o_custkey % 500 AS VARCHAR) AS provider_session_id, o_totalprice AS total_cost_usd, o_orderstatus AS status, o_orderkey AS batch_id FROM orders) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY provider, provider_session_id ORDER BY batch_id DESC) = 1",
        "d2_rejected_usage": over("SELECT session_key, model, count(*) AS turns FROM used WHERE session_key NOT IN (SELECT session_key FROM turns WHERE turn_index >= 60) GROUP BY session_key, model"),
        "d3_tool_call_facts": over(CALL_FACTS + "SELECT * FROM cf"),
        "d4_command_facts": over(COMMANDS),
        "d5_findings": over(FINDINGS_SQL + "SELECT * FROM finds"),
        "d6_snapshots": over("SELECT session_key, inp * 3 AS input_tokens, cw * 3 AS cache_creation_tokens, cr * 3 AS cache_read_tokens, outp * 3 AS output_tokens, rs * 3 AS reasoning_tokens FROM used WHERE turn_index % 7 = 0"),
        "d7_rollup_upsert": ROLLUP_SQL + "SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY period_start ORDER BY provider DESC) = 1",
        "d8_ledger": LEDGER_SQL + "SELECT * FROM g",
        "d8_pending": LEDGER_SQL + "SELECT * FROM g WHERE status = 'pending' ORDER BY created, item LIMIT 25",
        "d9_redaction": over("SELECT session_key, turn_index, CASE WHEN action = 'git status' THEN 'git [REDACTED]' ELSE 'git [REDACTED] -m [REDACTED]' END AS sanitized FROM calls WHERE action IS NOT NULL"),
        "d10_identity_hash": over("SELECT DISTINCT session_key, sha256('pepper' || session_key) AS hashed FROM turns"),
        "e1_stats": over("SELECT session_key, count(*) AS n_turns, count(*) FILTER (role = 'User') AS n_user, count(*) FILTER (role = 'Assistant') AS n_assistant, count(*) FILTER (role = 'System') AS n_system, count(*) FILTER (role = 'ToolResult') AS n_toolresult, sum(n_calls)::BIGINT AS n_calls, count(*) FILTER (has_result) AS n_results, coalesce(sum(strlen(text)), 0)::BIGINT AS text_bytes FROM turns GROUP BY session_key"),
        "e1_stats_conversations": "SELECT 'v' || conv_id AS session_key, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role NOT IN ('user', 'assistant')) AS n_system, 0::BIGINT AS n_toolresult, 0::BIGINT AS n_calls, 0::BIGINT AS n_results, coalesce(sum(strlen(text)), 0)::BIGINT AS text_bytes FROM conversations GROUP BY conv_id",
        "e2_turn_duration": over(", r AS (SELECT session_key, latency_ms, row_number() OVER (PARTITION BY session_key ORDER BY latency_ms) AS k, count(*) OVER (PARTITION BY session_key) AS n FROM turns WHERE role = 'Assistant' AND latency_ms > 0), g AS (SELECT session_key, max(latency_ms) FILTER (k = least(floor(n * 0.5), n - 1) + 1) AS p50, max(latency_ms) FILTER (k = least(floor(n * 0.95), n - 1) + 1) AS p95, sum(latency_ms) // count(*) AS mean FROM r GROUP BY session_key) SELECT session_key, coalesce(p50, 0) AS p50_ms, coalesce(p95, 0) AS p95_ms, coalesce(mean, 0)::BIGINT AS mean_ms FROM (SELECT DISTINCT session_key FROM turns) LEFT JOIN g USING (session_key)"),
        "e3_api_health": over("SELECT session_key, count(*) FILTER (wrong AND error_class = '429') AS rate_limits, count(*) FILTER (wrong AND error_class = '503') AS server_errors, count(*) FILTER (wrong AND error_class IN ('429', '503')) AS retries FROM turns GROUP BY session_key"),
        "e4_mcp_affinity": over(", g AS (SELECT session_key, count(*) FILTER (kind = 'McpCall') AS structured, count(*) FILTER (kind = 'Other') AS shell FROM turns GROUP BY session_key) SELECT *, CASE WHEN structured + shell = 0 THEN 1.0::DOUBLE ELSE structured::DOUBLE / (structured + shell) END AS affinity FROM g"),
        "e5_tool_inventory": over("SELECT session_key, tool_name, count(*) AS n_calls FROM calls GROUP BY session_key, tool_name"),
        "e6_permission_mode": over(", g AS (SELECT session_key, count(*) FILTER (role = 'User' AND text = 'yes') AS manual, coalesce(sum(n_calls) FILTER (role <> 'User'), 0)::BIGINT AS auto FROM turns GROUP BY session_key) SELECT *, CASE WHEN auto + manual = 0 THEN 1.0::DOUBLE ELSE auto::DOUBLE / (auto + manual) END AS auto_rate FROM g"),
        "e7_artifacts": over("SELECT session_key, count(DISTINCT path) FILTER (kind = 'FileRead') AS n_read, 0::BIGINT AS n_created, count(DISTINCT path) FILTER (kind = 'FileEdit') AS n_edited, count(DISTINCT path) AS n_paths FROM turns GROUP BY session_key"),
        "e8_attribution": over("SELECT session_key, attr_kind AS kind, attr_name AS name, sum(total)::BIGINT AS tokens FROM used GROUP BY ALL"),
        "e9_subagent_attribution": over(", u AS (SELECT user_id, sum(total) AS t FROM used GROUP BY user_id) SELECT 'p' || (user_id % 10) AS parent_session_id, CASE WHEN user_id % 3 > 0 THEN 'r' || (user_id % 3) ELSE CAST(user_id AS VARCHAR) END AS subagent, coalesce(sum(t), 0)::BIGINT AS tokens FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN u USING (user_id) GROUP BY ALL"),
        "e10_hook_activity": over(", h AS (SELECT session_key, CASE WHEN et <> 'error' THEN et END AS event, k AS ms, k % 7 = 0 OR k % 11 = 0 AS blocked FROM turns), g AS (SELECT session_key, count(event) AS n_hooks, coalesce(sum(ms) FILTER (event IS NOT NULL), 0)::BIGINT AS total_ms, count(*) FILTER (blocked) AS n_blocked FROM h WHERE event IS NOT NULL OR blocked GROUP BY session_key) SELECT *, CASE WHEN n_hooks = 0 THEN 0.0::DOUBLE ELSE n_blocked::DOUBLE / n_hooks END AS block_rate FROM g"),
        "e10_hooks_by_event": over("SELECT session_key, et AS event, count(*) AS n_hooks, sum(k)::BIGINT AS total_ms FROM turns WHERE et <> 'error' GROUP BY ALL"),
        "e11_otel_correlation": "SELECT DISTINCT 'u' || user_id AS session_key, CASE WHEN user_id % 3 > 0 THEN 1 ELSE 0 END::BIGINT AS n_conversations, CASE WHEN user_id % 3 > 0 THEN 'r' || (user_id % 3) ELSE '' END AS ids FROM events",
        "e12_span_mapping": over("SELECT session_key, result_call AS call_id, arg_max(span_id, turn_index) AS span_id FROM turns WHERE has_result AND span_id IS NOT NULL GROUP BY ALL"),
        "e12_unmapped_results": over("SELECT session_key, count(*) FILTER (has_result AND span_id IS NULL) AS n_unmapped FROM turns GROUP BY session_key"),
        "e13_session_counts": over(CALL_FACTS + "SELECT session_key, count(*) AS n_calls, count(*) FILTER (is_error) AS n_errors FROM cf GROUP BY session_key"),
        "e14_schema_citations": f"WITH {TEXT_SQL} SELECT session_key, turn_index, s AS schema_id, contains(text, '```json') OR contains(text, '{{\"$schema\"') AS valid FROM d, (VALUES ('spec@1'), ('plan@1'), ('changeset@1'), ('eval-report@1'), ('finding-report@1')) v(s) WHERE contains(text, s)",
        "e15_pr_links": PR_SQL + "SELECT session_key, pr, min(turn_index) AS first_turn, count(*) AS mentions, count(*) FILTER (from_vcs) AS vcs_mentions FROM mentions GROUP BY session_key, pr",
        "e17_rollups": ROLLUP_SQL + "SELECT * FROM r",
        "f1_autonomy": over(AUTONOMY.format(src="turns", a="'Assistant', 'ToolResult'", u="User")),
        "f1_autonomy_conversations": "WITH v AS (SELECT 'v' || conv_id AS session_key, turn AS turn_index, role FROM conversations)" + AUTONOMY.format(src="v", a="'assistant'", u="user"),
        "f2_timeline": over(timeline_sql(IDLE)),
        "e16_fuzzy_tools": over(FUZZY_SQL),
        "h2_similar_sessions": over(SIMILAR_SQL + "SELECT a, b, jaccard FROM pairs WHERE a < b"),
        "h2_session_classes": over(SIMILAR_SQL + """, near AS (SELECT a AS class_id, sum(members) AS n FROM pairs JOIN sizes ON sizes.class_id = pairs.b GROUP BY a)
          SELECT session_key, rep AS class_id, (members - 1 + coalesce(n, 0))::BIGINT AS n_links FROM classed JOIN sizes ON sizes.class_id = rep LEFT JOIN near ON near.class_id = rep"""),
        "h2_workflow_clusters": over(WEEKLY_SQL + """, near AS (SELECT a AS node, list(b) AS nbrs FROM pairs GROUP BY a),
          cliques AS (WITH RECURSIVE grown AS (
            SELECT [rep] AS m, rep AS last FROM classed WHERE session_key = rep
            UNION ALL SELECT list_append(m, p.b), p.b FROM grown JOIN pairs p ON p.a = last AND p.b > last JOIN near ON near.node = p.b WHERE list_has_all(nbrs, m)) SELECT m FROM grown),
          sized AS (SELECT m, (SELECT sum(members) FROM sizes WHERE list_contains(m, class_id)) AS size FROM cliques WHERE NOT EXISTS (SELECT 1 FROM near WHERE list_has_all(nbrs, m))),
          chosen AS (SELECT class_id, m, size FROM (SELECT unnest(m) AS class_id, m, size FROM sized WHERE size >= 3) QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY size DESC, m) = 1)
          SELECT session_key, min(session_key) OVER (PARTITION BY m) AS cluster, chosen.size::BIGINT AS member_count FROM classed JOIN chosen ON class_id = rep"""),
        "f3_flow": over(f""", r AS (SELECT *, wrong AND error_class = 'permission_denied' AS broke FROM turns), i AS (SELECT *, count(*) FILTER (broke) OVER w AS island FROM r {W}),
          g AS (SELECT session_key, island, sum(CASE WHEN broke THEN 0 ELSE n_calls END) AS streak, sum(n_calls) AS calls, count(*) FILTER (broke) AS blocks FROM i GROUP BY ALL)
          SELECT session_key, sum(blocks)::BIGINT AS permission_blocks, coalesce(string_agg(streak::BIGINT::VARCHAR, ',' ORDER BY island) FILTER (streak > 0), '') AS streaks, count(*) FILTER (streak > 0) AS n_streaks, max(streak)::BIGINT AS longest, coalesce(avg(streak) FILTER (streak > 0), 0)::DOUBLE AS mean_streak, sum(calls)::BIGINT AS n_calls, CASE WHEN sum(calls) = 0 THEN 0.0::DOUBLE ELSE coalesce(sum(streak) FILTER (streak >= 2), 0)::DOUBLE / sum(calls)::DOUBLE END AS flow_ratio FROM g GROUP BY session_key"""),
        "f4_context_growth": over(", r AS (SELECT session_key, turn_index, prompt AS p, greatest(prompt - lag(prompt) OVER (PARTITION BY session_key ORDER BY turn_index), 0) AS rise, lag(prompt) OVER (PARTITION BY session_key ORDER BY turn_index) IS NOT NULL AS later FROM used) SELECT session_key, arg_min(p, turn_index) AS first_tokens, max(p) AS peak_tokens, arg_max(p, turn_index) AS last_tokens, coalesce(max(rise), 0) AS max_rise, coalesce(sum(rise) FILTER (later)::DOUBLE / nullif(count(*) - 1, 0), 0) AS mean_rise FROM r GROUP BY session_key"),
        "f5_self_correction": over(", r AS (SELECT *, coalesce(lag(wrong) OVER (PARTITION BY session_key ORDER BY turn_index), false) AND n_calls > 0 AS aft FROM turns) SELECT session_key, count(*) FILTER (aft AND NOT wrong) AS retries, count(*) FILTER (aft AND wrong) AS pivots FROM r GROUP BY session_key"),
        "f6_errors_by_tool": over(f", r AS (SELECT *, last_value(tool_name IGNORE NULLS) OVER w AS t FROM turns {W}) SELECT session_key, t AS tool_name, count(*) AS n_errors FROM r WHERE wrong AND t IS NOT NULL GROUP BY ALL"),
        "f7_circuit_breaker": over(BREAKER_SQL + "SELECT * FROM breaker"),
        "f8_tool_nodes": over(", e AS (SELECT session_key, result_call AS call_id, arg_min(wrong, turn_index) AS w FROM turns WHERE has_result GROUP BY ALL) SELECT c.session_key, c.turn_index, 0::BIGINT AS call_pos, c.call_id, c.path AS file, c.query AS symbol, c.kind = 'FileEdit' AS mutates, coalesce(e.w, false) AS had_error FROM calls c LEFT JOIN e USING (session_key, call_id)"),
        "f9_forward_fill": over(f"SELECT session_key, turn_index, last_value(CASE WHEN role = 'Assistant' THEN (epoch_us(ts) // 1000) END IGNORE NULLS) OVER w AS ts FROM turns {W}"),
        "f10_cache_drops": over(", r AS (SELECT session_key, turn_index, CASE WHEN prompt = 0 THEN 0.0::DOUBLE ELSE cr::DOUBLE / prompt END AS hit FROM used), l AS (SELECT *, lag(hit) OVER (PARTITION BY session_key ORDER BY turn_index) AS before FROM r) SELECT * FROM l WHERE before >= 0.75 AND hit < 0.75"),
        "g1_grounding": over(NODES_SQL + "SELECT * FROM nodes"),
        "g2_edges": over(NODES_SQL + "SELECT session_key, seq - 1 AS src, seq AS dst, 'chain' AS edge FROM backs WHERE seq > 0 UNION ALL SELECT session_key, seq, back, 'back' FROM backs WHERE back IS NOT NULL"),
        "g3_components": over(NODES_SQL + "SELECT session_key, seq, component FROM comps"),
        "g4_circular_loops": over(NODES_SQL + "SELECT * FROM loops"),
        "g5_monotonicity": over(NODES_SQL + "SELECT session_key, n_nodes, monotonicity FROM mono"),
        "g6_efficiency": over(NODES_SQL + "SELECT session_key, efficiency FROM mono"),
        "g7_grounding_score": over(NODES_SQL + "SELECT * FROM ground"),
        "g8_recovery_index": over(NODES_SQL + "SELECT * FROM recov"),
        "g9_trajectory_metrics": over(NODES_SQL + "SELECT g.session_key, coalesce(monotonicity, 1.0) AS monotonicity, coalesce(efficiency, 1.0) AS efficiency, grounding, recovery, coalesce(n, 0) AS n_loops FROM ground g JOIN recov USING (session_key) LEFT JOIN mono USING (session_key) LEFT JOIN (SELECT session_key, count(*) AS n FROM loops GROUP BY session_key) USING (session_key)"),
        "h1_bimodal": over(", g AS (SELECT session_key, count(*) AS n_turns, sum(n_calls)::BIGINT AS n_calls, count(*) FILTER (kind = 'FileEdit') AS changes, count(*) FILTER (kind = 'CodeSearch') AS searches FROM turns GROUP BY session_key) SELECT *, CASE WHEN n_calls = 0 THEN 'Balanced' WHEN changes::DOUBLE / n_calls >= 0.6 AND searches <= 2 THEN 'Acceleration' WHEN searches >= 6 AND n_turns >= 15 THEN 'Exploration' ELSE 'Balanced' END AS mode FROM g"),
        "h3_legacy_tools": f"WITH {LEGACY_SQL} SELECT * FROM legacy",
        "h4_loop_findings": over(FINDINGS_SQL + "SELECT * FROM finds"),
        "h4_findings": over(FINDINGS_SQL + HYGIENE_SQL + "SELECT * FROM finds UNION ALL SELECT * FROM hygiene"),
        "e15_pr_sessions": PR_SQL + "SELECT session_key, coalesce(string_agg(DISTINCT pr, ',' ORDER BY pr), '') AS pull_requests, min(turn_index) AS first_turn, count(*) FILTER (from_vcs) AS linked_via_vcs FROM (SELECT DISTINCT session_key FROM d) LEFT JOIN mentions USING (session_key) GROUP BY session_key",
        "e17_rollups_by_repository": SPENT_SQL + """, r AS (SELECT CAST(date_trunc('week', started_at) AS TIMESTAMP) AS p, * FROM s)
          SELECT epoch_us(p) // 1000 AS period_start, 'week' AS period_type, CASE grouping(repository, category) WHEN 0 THEN 'repository and category' WHEN 1 THEN 'repository' WHEN 2 THEN 'category' ELSE 'period' END AS level, repository, category,
            count(*) AS session_count, sum(cost)::DOUBLE AS total_cost_usd, sum(active_duration_ms)::BIGINT AS active_duration_ms, sum(n_findings)::BIGINT AS finding_count, sum(n_severe)::BIGINT AS severe_count
          FROM r GROUP BY GROUPING SETS ((p), (p, repository), (p, category), (p, repository, category))""",
        "e17_trailing_week": SPENT_SQL + """, days AS (SELECT repository, CAST(started_at AS DATE) AS day, count(*) AS session_count, sum(cost) AS total_cost_usd, sum(active_duration_ms) AS active_duration_ms, sum(n_findings) AS finding_count, sum(n_severe) AS severe_count, sum(total_tokens) AS total_tokens, sum(commits) AS commits FROM s GROUP BY ALL)
          SELECT repository, epoch_us(CAST(day AS TIMESTAMP)) // 1000 AS day, sum(session_count) OVER w::BIGINT AS session_count, (sum(total_cost_usd) OVER w)::DOUBLE AS total_cost_usd, (sum(active_duration_ms) OVER w)::BIGINT AS active_duration_ms, (sum(finding_count) OVER w)::BIGINT AS finding_count,
            (sum(severe_count) OVER w)::BIGINT AS severe_count, (sum(total_tokens) OVER w)::BIGINT AS total_tokens, (sum(commits) OVER w)::BIGINT AS commits FROM days WINDOW w AS (PARTITION BY repository ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""".replace("sum(session_count) OVER w::BIGINT", "(sum(session_count) OVER w)::BIGINT"),
    }
    return found | {"j1_report": report_sql(found)}


COMMANDS = "SELECT session_key, turn_index, 0::BIGINT AS call_pos, string_split(coalesce(action, raw_name), ' ')[1] AS command_base, CASE action WHEN 'git status' THEN 'git [REDACTED]' WHEN 'git commit -m x' THEN 'git [REDACTED] -m [REDACTED]' ELSE raw_name END AS sanitized FROM calls WHERE kind IN ('VersionControl', 'Other')"
AUTONOMY = """, i AS (SELECT *, count(*) FILTER (role = '{u}') OVER (PARTITION BY session_key ORDER BY turn_index ROWS UNBOUNDED PRECEDING) AS island FROM {src}),
 g AS (SELECT session_key, island, count(*) FILTER (role IN ({a})) AS n, count(*) AS c FROM i GROUP BY ALL)
 SELECT session_key, max(n) AS max_streak, coalesce(avg(n) FILTER (n > 0), 0)::DOUBLE AS mean_streak, count(*) FILTER (n > 0) AS n_streaks, sum(n)::DOUBLE / sum(c)::DOUBLE AS autonomous_share FROM g GROUP BY session_key"""
LINEITEM_SQL = f"""
WITH seed AS (SELECT * FROM (VALUES {RATE_ROWS}) t(ord, model, kind, rate)),
src AS (SELECT 'o' || l_orderkey AS session_key, l_linenumber::BIGINT AS turn_index, CASE l_returnflag WHEN 'A' THEN 'claude-3-5-sonnet' WHEN 'N' THEN 'gpt-4o' ELSE 'deepseek-r1' END AS key, l_shipdate AS ts,
  CASE WHEN l_linestatus = 'O' THEN 'flex' END AS tier, CAST(floor(l_extendedprice / 10) AS BIGINT) AS inp, CAST(floor(l_quantity) AS BIGINT) AS outp, CAST(floor(l_quantity) AS BIGINT) * 7 AS cw, CAST(floor(l_extendedprice / 2) AS BIGINT) AS cr, l_linenumber::BIGINT AS rs FROM lineitem),
wide AS (SELECT model, max(rate) FILTER (kind = 'Input') AS a, max(rate) FILTER (kind = 'CacheWrite') AS b, max(rate) FILTER (kind = 'CacheRead') AS c, max(rate) FILTER (kind = 'Output') AS d FROM seed GROUP BY model),
priced AS (SELECT src.*, (CASE WHEN flex THEN a // 2 ELSE a * f END)::BIGINT AS r_in, (CASE WHEN flex THEN b // 2 ELSE b * f END)::BIGINT AS r_cw, (CASE WHEN flex THEN c // 2 ELSE c * f END)::BIGINT AS r_cr, (CASE WHEN flex THEN d // 2 ELSE d * f END)::BIGINT AS r_out, (CASE WHEN flex THEN d // 2 ELSE d * f END)::BIGINT AS r_rs
  FROM (SELECT *, coalesce(key = 'gpt-4o' AND tier = 'flex', false) AS flex, CASE WHEN ts < TIMESTAMP '1996-01-01' THEN 1 ELSE 2 END AS f FROM src) src JOIN wide ON wide.model = src.key)
"""
