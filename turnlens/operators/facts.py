"""Fact tables: builders, reads, idempotent writes, ledger and rollups. Everything is keyed by (provider, session)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions.columns import redacted

DEFAULT_LIMIT = 50
DEAD_AFTER = 3
SESSION_KEY = ("provider", "provider_session_id")
PERIOD_KEY = ("period_start", "period_type")


# -- reads


def trace_view(turns: DataFrame) -> DataFrame:
    """Per turn: role, ``name(call_id)`` list and tokens ``in/write/read/out``, ``-`` where there is none."""
    named = F.array_join(F.transform("tool_calls", lambda c: F.concat(c.tool_name, F.lit("("), c.call_id, F.lit(")"))), ", ")
    u = F.col("usage")
    tokens = F.concat_ws("/", *[u[f].cast("string") for f in ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens")])
    return turns.select("session_key", "turn_index", "role", F.when(F.coalesce(named, F.lit("")) == "", "-").otherwise(named).alias("calls"), F.when(u.isNull(), "-").otherwise(tokens).alias("tokens"))


def scan_summary(turns: DataFrame, economics: DataFrame) -> DataFrame:
    sessions = turns.groupBy("session_key").agg(F.max("provider").alias("provider"), F.count(F.lit(1)).alias("n_turns"))
    return sessions.join(economics, "session_key", "left").select(
        "session_key", "provider", "n_turns", F.coalesce("cache_hit_pct", F.lit(0.0)).alias("cache_hit_pct"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("net_savings_usd", F.lit(0.0)).alias("net_savings_usd")
    )


def recent_sessions(sessions: DataFrame, provider: str | None = None, limit: int = 0) -> DataFrame:
    """Newest sessions first, ties by key; limit 0 stands for the default."""
    rows = sessions if provider is None else sessions.where(F.col("provider") == provider)
    return rows.orderBy(F.desc("started_at"), *SESSION_KEY).limit(limit or DEFAULT_LIMIT)


def session_detail(sessions: DataFrame, tool_calls: DataFrame, model_usage: DataFrame) -> DataFrame:
    """Sessions with tool and error counts and token totals summed again from the model rows; reasoning is not stored: 0."""
    tools = tool_calls.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if("is_error").alias("n_errors"), F.count_distinct("tool_name").alias("n_tools"))
    used = model_usage.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_models"), *[F.sum(c).alias(c) for c in ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens")])
    return sessions.join(tools, "session_key", "left").join(used, "session_key", "left").na.fill(0).withColumn("reasoning_tokens", F.lit(0).cast("long"))


def top_findings(findings: DataFrame, limit: int) -> DataFrame:
    return findings.orderBy(F.desc("confidence"), F.desc("finding_id")).limit(limit)


def calls_of(tool_calls: DataFrame, session_key: str) -> DataFrame:
    return tool_calls.where(F.col("session_key") == session_key).orderBy("turn_index", "call_pos")


def commands_of(events: DataFrame, session_key: str) -> DataFrame:
    return events.where(F.col("session_key") == session_key).orderBy("turn_index", "call_pos")


def rollup_at(rollups: DataFrame, start: dt.date, period_type: str) -> DataFrame:
    return rollups.where((F.col("period_start") == F.lit(start)) & (F.col("period_type") == period_type))


def rollups_of(rollups: DataFrame, period_type: str, limit: int) -> DataFrame:
    return rollups.where(F.col("period_type") == period_type).orderBy(F.desc("period_start")).limit(limit)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshot of the highest id per (provider, session_id)."""
    return snapshots.groupBy("provider", "session_id").agg(F.max_by("snapshot", "snapshot_id").alias("snapshot"), F.max("snapshot_id").alias("snapshot_id"))


def spend_since_midnight(sessions: DataFrame, as_of: str) -> DataFrame:
    day = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    return sessions.where((F.col("started_at") >= day) & (F.col("started_at") <= F.lit(as_of).cast("timestamp"))).agg(F.coalesce(F.sum(F.col("total_cost_usd").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("spent_usd"))


# -- builders


def tool_call_facts(turns: DataFrame) -> DataFrame:
    """One row per call; error flag from its results by call id, latency of its turn."""
    c = turns.select("session_key", "turn_index", "latency_ms", F.posexplode("tool_calls").alias("call_pos", "call"))
    r = turns.select("session_key", F.explode("tool_results").alias("r")).groupBy("session_key", F.col("r.call_id").alias("call_id")).agg(F.bool_or("r.is_error").alias("is_error"))
    c = c.select("session_key", "turn_index", F.col("call_pos").cast("long").alias("call_pos"), F.col("call.tool_name").alias("tool_name"), F.col("call.call_id").alias("call_id"), F.col("call.intent.kind").alias("intent_kind"), "latency_ms")
    return c.join(r, ["session_key", "call_id"], "left").withColumn("is_error", F.coalesce("is_error", F.lit(False)))


def command_facts(turns: DataFrame) -> DataFrame:
    """Shell and version-control calls with their binary and redacted command line."""
    c = turns.select("session_key", "turn_index", F.posexplode("tool_calls").alias("call_pos", "call"))
    line = F.coalesce("call.intent.action", "call.intent.raw_name")
    rows = c.where(F.col("call.intent.kind").isin("VersionControl", "Other", "TestExecution")).withColumn("line", line)
    return rows.select("session_key", "turn_index", F.col("call_pos").cast("long").alias("call_pos"), F.split("line", r"\s+")[0].alias("command_base"), redacted(F.col("line")).alias("sanitized"))


def known_and_rejected(facts: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of known sessions, and the others: a write must not lose rows in silence."""
    keys = sessions.select("session_key")
    return facts.join(keys, "session_key", "left_semi"), facts.join(keys, "session_key", "left_anti")


def periodic_rollups(sessions: DataFrame, period_type: str = "week") -> DataFrame:
    """Sessions, cost and duration by provider and period (weeks start on Monday), with a subtotal over providers."""
    start = F.to_date(F.date_trunc(period_type, "started_at"))
    rows = sessions.withColumn("period_start", start).cube("period_start", "provider").agg(
        F.count(F.lit(1)).alias("session_count"), F.sum(F.col("total_cost_usd").cast("decimal(18,2)")).alias("cost"), F.sum("wall_duration_ms").alias("total_duration_ms"), F.grouping_id().alias("level")
    )
    return rows.where("level in (0, 1)").select("period_start", F.lit(period_type).alias("period_type"), F.coalesce("provider", F.lit("*")).alias("provider"), "session_count", F.col("cost").cast("double").alias("total_cost_usd"), "total_duration_ms")


SUMS = ("session_count", "total_cost_usd", "active_duration_ms", "finding_count", "severe_count")


def with_findings(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """``sessions`` with the number of their ``findings`` and of those of severity high."""
    n = findings.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_findings"), F.count_if(F.col("severity") == "high").alias("n_severe"))
    return sessions.join(n, "session_key", "left").na.fill(0, ["n_findings", "n_severe"])


def summed() -> list[Column]:
    sums = (F.count(F.lit(1)), F.sum(F.col("total_cost_usd").cast("decimal(18,2)")), F.sum("active_duration_ms"), F.sum("n_findings"), F.sum("n_severe"))
    return [c.alias(n) for c, n in zip(sums, SUMS, strict=True)]


def rollups_by_repository(sessions: DataFrame, findings: DataFrame, period_type: str = "week") -> DataFrame:
    """Sessions, cost, active time and findings by period, by repository and by category in it, and by both: one pass over grouping sets.

    ``level`` names the grouping; ``repository`` and ``category`` are null where they are summed over, and
    ``(none)`` where a session has none.
    """
    start = F.to_date(F.date_trunc(period_type, "started_at"))
    named = {c: F.coalesce(c, F.lit("(none)")) for c in ("repository", "category")}
    rows = with_findings(sessions, findings).withColumns({"period_start": start, **named})
    p, r, c = (F.col(x) for x in ("period_start", "repository", "category"))
    sets = rows.groupingSets([[p], [p, r], [p, c], [p, r, c]], p, r, c).agg(F.grouping_id().alias("level"), *summed())
    level = F.element_at(F.array(*map(F.lit, ("repository and category", "repository", "category", "period"))), F.col("level").cast("int") + 1)
    return sets.select("period_start", F.lit(period_type).alias("period_type"), level.alias("level"), "repository", "category", "session_count", F.col("total_cost_usd").cast("double").alias("total_cost_usd"), *SUMS[2:])


def trailing_week(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """For each repository and each day on which it has sessions: the sums of the seven days that end there, with tokens and commits.

    Sessions are summed by day first, so a window orders no more than the days of one repository.
    """
    rows = with_findings(sessions, findings).withColumns({"repository": F.coalesce("repository", F.lit("(none)")), "day": F.to_date("started_at")})
    more = ("total_tokens", "commits")
    days = rows.groupBy("repository", "day").agg(*summed(), *[F.sum(c).alias(c) for c in more])
    week = Window.partitionBy("repository").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return days.select("repository", "day", *[(F.sum(c).over(week).cast("double") if c == "total_cost_usd" else F.sum(c).over(week)).alias(c) for c in (*SUMS, *more)])


# -- writes


def latest_by_key(rows: DataFrame, key: tuple[str, ...], batch: str = "batch_id") -> DataFrame:
    """The row of the highest batch for each key, new values replacing all old ones."""
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), batch).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in names])


def append(path: str, rows: DataFrame, partition_by: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def ledger(events: DataFrame) -> DataFrame:
    """State of each item from its status events (item, seq, event, error): pending, completed, failed or, from the third failure on, dead_letter."""
    fails = F.count_if(F.col("event") == "fail")
    out = events.groupBy("item").agg(F.max_by("event", "seq").alias("last"), fails.cast("long").alias("retry_count"), F.max_by(F.when(F.col("event") == "fail", F.col("error")), F.when(F.col("event") == "fail", F.col("seq"))).alias("last_error"), F.min("seq").alias("created"))
    status = F.when(F.col("last") == "enqueue", "pending").when(F.col("last") == "complete", "completed").when(F.col("retry_count") >= DEAD_AFTER, "dead_letter").otherwise("failed")
    return out.select("item", status.alias("status"), "retry_count", "last_error", "created")


def pending(items: DataFrame, limit: int) -> DataFrame:
    """Oldest pending items; failed ones are not fetched again."""
    return items.where("status = 'pending'").orderBy("created", "item").limit(limit)
