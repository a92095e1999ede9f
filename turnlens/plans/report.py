"""The whole report of every session: the scalar results of all per-turn folds in three passes over the turns.

``turn_marks`` reads each turn once into flat columns; the ordered folds are running windows over one order of
them and one aggregate. What needs distinct values (tools, paths, pull requests) is a second pass over
exploded items, the circuit breaker's few spawns are a third. All three group by the session.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions.columns import has_error, in_order, n_items, prompt_tokens, ratio, so_far, total_tokens, trimmed
from turnlens.operators import folds, ordered

FILES = {"n_read": "FileRead", "n_created": "FileCreate", "n_edited": "FileEdit"}


def turn_marks(turns: DataFrame) -> DataFrame:
    """What the folds need of each turn, in flat columns and without nested data."""
    role, kind = F.col("role"), lambda c: c.intent.kind
    raw = lambda c: F.coalesce(c.intent.raw_name, F.lit(""))
    is_, no = lambda c: F.coalesce(c, F.lit(False)), lambda a, f: F.size(F.filter(a, f))
    limited = lambda r: r.is_error & is_(r.error_class.rlike(folds.RATE_LIMIT))
    failed = lambda r: r.is_error & is_(~r.error_class.rlike(folds.RATE_LIMIT) & r.error_class.rlike(folds.SERVER_ERROR))
    shown = F.contains("text", F.lit("```json")) | F.contains("text", F.lit('{"$schema"'))
    source = F.when(F.col("attribution.kind").isin("Plugin", "Skill"), F.col("attribution.kind")).otherwise("Unattributed")
    timed = (role == "Assistant") & (F.col("latency_ms") > 0)
    return turns.select(
        "session_key", "turn_index", "role", "ts", F.octet_length("text").alias("text_bytes"), n_items("tool_calls").alias("n_calls"), n_items("tool_results").alias("n_results"),
        F.when(timed, F.col("latency_ms")).alias("latency"), no("tool_results", limited).alias("limited"), no("tool_results", failed).alias("failed"),
        no("tool_calls", lambda c: (kind(c) == "McpCall") | ((kind(c) == "Other") & F.contains(raw(c), F.lit("mcp")))).alias("structured"),
        no("tool_calls", lambda c: (kind(c) == "Other") & raw(c).isin("run_command", "Bash")).alias("shell"),
        ((role == "User") & is_(trimmed(F.col("text")).isin(*folds.APPROVALS))).alias("approves"), source.alias("source"), total_tokens().alias("tokens"), prompt_tokens().alias("prompt"),
        no("tool_results", lambda r: r.otel_span_id.isNull()).alias("unmapped"), no(F.array(*map(F.lit, folds.SCHEMAS)), lambda s: F.contains("text", s)).alias("cited"), shown.alias("shown"),
        is_(role == "User").alias("is_user"), is_(role.isin("Assistant", "ToolResult")).alias("is_own"), is_(role == "Assistant").alias("is_assistant"), is_(role != "Assistant").alias("is_other"),
        is_(F.exists("tool_results", lambda r: r.is_error & F.contains(F.lower(r.error_class), F.lit("permission")))).alias("broke"),
        has_error().alias("wrong"), no("tool_results", lambda r: r.is_error).alias("n_wrong"), F.when(n_items("tool_calls") > 0, F.element_at("tool_calls", -1).tool_name).alias("last_tool"),
    )


def ordered_marks(turns: DataFrame) -> DataFrame:
    """``turn_marks`` with the state of the ordered folds at each turn: one partitioning, one sort for the turn order and one for the latencies.

    A streak is a running count less its value at the latest turn that broke it, read at the turn before the next break.
    """
    session = Window.partitionBy("session_key")
    rows = turn_marks(turns).withColumns({"rank": F.row_number().over(session.orderBy(F.col("latency").asc_nulls_last())), "n_timed": F.count("latency").over(session)})
    w, past = so_far(), in_order().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "own": F.count_if("is_own").over(w), "spoken": F.count_if("is_assistant").over(w), "flown": F.sum(F.when(F.col("broke"), 0).otherwise(F.col("n_calls"))).over(w),
        "user_next": F.lead("is_user").over(in_order()), "other_next": F.lead("is_other").over(in_order()), "break_next": F.lead("broke").over(in_order()),
        "gap": F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(in_order())), "was_wrong": F.lag("wrong", 1, False).over(in_order()),
        "prompt_before": F.last("prompt", ignorenulls=True).over(past), "tool": F.last("last_tool", ignorenulls=True).over(w),
    })
    at = lambda total, broken: F.col(total) - F.coalesce(F.max(F.when(F.col(broken), F.col(total))).over(w), F.lit(0))
    return rows.withColumns({"own": at("own", "is_user"), "spoken": at("spoken", "is_other"), "flown": at("flown", "broke")})


def whole_folds(turns: DataFrame, idle_ms: int = ordered.IDLE_MS) -> DataFrame:
    """The folds that need no distinct values, one row per session."""
    ends = lambda streak, following: F.when(F.coalesce(F.col(following), F.lit(True)) & (F.col(streak) > 0), F.col(streak))
    own, flown = ends("own", "user_next"), ends("flown", "break_next")
    closed = F.when(F.col("other_next") & (F.col("spoken") > 0), F.col("spoken"))
    idle = F.when(F.col("gap") > idle_ms, F.col("gap"))
    rise = F.greatest(F.col("prompt") - F.col("prompt_before"), F.lit(0))
    rise = F.when(F.col("prompt").isNotNull() & F.col("prompt_before").isNotNull(), rise)
    retried = F.col("was_wrong") & (F.col("n_calls") > 0)
    used = F.when(F.col("prompt").isNotNull(), F.col("turn_index"))
    zero, total = lambda c: F.coalesce(c, F.lit(0)), lambda c: F.sum(c)
    ranked = lambda q: F.max(F.when(F.col("rank") == F.least(F.floor(F.col("n_timed") * q), F.col("n_timed") - 1) + 1, F.col("latency")))
    by = lambda s: F.sum(F.when(F.col("tokens").isNotNull(), F.when(F.col("source") == s, F.col("tokens")).otherwise(0)))
    with_usage = lambda c: F.when(F.count("prompt") > 0, c)
    out = ordered_marks(turns).groupBy("session_key").agg(
        F.count(F.lit(1)).alias("n_turns"), *[F.count_if(F.col("role") == r).alias(f"n_{r.lower()}") for r in ("User", "Assistant", "System", "ToolResult")],
        total("n_calls").alias("n_calls"), total("n_results").alias("n_results"), zero(total("text_bytes")).cast("long").alias("text_bytes"),
        zero(ranked(0.5)).alias("p50_ms"), zero(ranked(0.95)).alias("p95_ms"), zero(F.when(F.count("latency") > 0, F.expr("sum(latency) div nullif(count(latency), 0)"))).alias("mean_ms"),
        total("limited").alias("rate_limits"), total("failed").alias("server_errors"), total("structured").alias("structured"), total("shell").alias("shell"),
        F.count_if("approves").alias("manual"), F.sum(F.when(F.col("role") != "User", F.col("n_calls")).otherwise(0)).alias("auto"),
        by("Plugin").alias("plugin_tokens"), by("Skill").alias("skill_tokens"), by("Unattributed").alias("other_tokens"), total("unmapped").alias("n_unmapped"),
        F.sum(F.when(F.col("cited") > 0, F.col("cited"))).alias("citations"), F.sum(F.when(F.col("cited") > 0, F.when(F.col("shown"), F.col("cited")).otherwise(0))).alias("valid_citations"),
        zero(F.max(own)).alias("autonomy_max_streak"), F.coalesce(F.avg(own), F.lit(0.0)).alias("autonomy_mean_streak"), F.count(own).alias("autonomy_n_streaks"),
        (F.count_if("is_own").cast("double") / F.count(F.lit(1)).cast("double")).alias("autonomy_autonomous_share"),
        F.count(closed).alias("timeline_n_streaks"), zero(F.max(closed)).alias("timeline_max_streak"), F.max(F.when(F.col("other_next").isNull(), F.col("spoken"))).alias("timeline_current_streak"),
        F.count(idle).alias("timeline_n_idle"), zero(F.sum(idle)).alias("timeline_idle_ms"), zero(F.max(idle)).alias("timeline_longest_idle_ms"), F.max_by("ts", "turn_index").alias("timeline_last_ts"),
        F.count(flown).alias("flow_n_streaks"), zero(F.max(flown)).alias("flow_longest"), F.coalesce(F.avg(flown), F.lit(0.0)).alias("flow_mean_streak"), F.count_if("broke").alias("flow_permission_blocks"),
        F.transform(F.array_sort(F.collect_list(F.when(flown.isNotNull(), F.struct("turn_index", flown.alias("streak"))))), lambda x: x.streak).alias("flow_streaks"),
        total("n_calls").alias("flow_n_calls"), ratio(zero(F.sum(F.when(flown >= 2, flown))), F.sum("n_calls"), 0.0).alias("flow_flow_ratio"),
        F.min_by("prompt", used).alias("context_first_tokens"), F.max("prompt").alias("context_peak_tokens"), F.max_by("prompt", used).alias("context_last_tokens"),
        with_usage(zero(F.max(rise))).alias("context_max_rise"), with_usage(F.coalesce(F.sum(rise).cast("double") / F.nullif(F.count(rise), F.lit(0)), F.lit(0.0))).alias("context_mean_rise"),
        F.count_if(retried & ~F.col("wrong")).alias("correction_retries"), F.count_if(retried & F.col("wrong")).alias("correction_pivots"),
        F.sum(F.when((F.col("n_wrong") > 0) & F.col("tool").isNotNull(), F.col("n_wrong"))).alias("charged_errors"),
    )
    share = lambda a, b: ratio(F.col(a), F.col(a) + F.col(b), 1.0)
    return out.withColumns({"retries": F.col("rate_limits") + F.col("server_errors"), "affinity": share("structured", "shell"), "auto_rate": share("auto", "manual")})


def distinct_folds(turns: DataFrame) -> DataFrame:
    """Distinct tools, clusters of their names, paths and pull requests, one row per session that has any."""
    item = lambda what, name, kind: F.struct(F.lit(what).alias("what"), name.alias("name"), kind.cast("string").alias("kind"))
    is_path = lambda c: F.coalesce((c.intent.path != "") & c.intent.kind.isin(*FILES.values()), F.lit(False))
    said = F.concat(F.coalesce(F.transform("tool_results", lambda r: r.truncated_output), F.array().cast("array<string>")), F.array("text"))
    said = F.filter(said, lambda s: F.coalesce(F.contains(s, F.lit("github.com/")), F.lit(False)))
    items = F.concat(
        F.transform("tool_calls", lambda c: item("tool", c.tool_name, F.lit(None))), F.transform(F.filter("tool_calls", is_path), lambda c: item("path", c.intent.path, c.intent.kind)),
        F.transform(F.flatten(F.transform(said, folds.named_pull_requests)), lambda p: item("pr", p, F.lit(None))),
    )
    empty = lambda name: F.coalesce(name, F.array().cast(turns.schema[name].dataType)).alias(name)
    rows = turns.select("session_key", "text", empty("tool_calls"), empty("tool_results")).select("session_key", F.inline(items))
    n = F.count(F.lit(1)).alias("n")
    rows = rows.groupBy("session_key", "what", "name").agg(n, *[F.count_if(F.col("kind") == k).alias(c) for c, k in FILES.items()])
    is_ = lambda what: F.col("what") == what
    out = rows.groupBy("session_key").agg(
        F.nullif(F.count_if(is_("tool")), F.lit(0)).alias("distinct_tools"), F.sum(F.when(is_("tool"), F.col("n"))).alias("tool_calls"), *[F.count_if(F.col(c) > 0).alias(c) for c in FILES],
        F.count_if(is_("path")).alias("n_paths"), F.nullif(F.count_if(is_("pr")), F.lit(0)).alias("pull_requests"), folds.by_calls(F.when(is_("tool"), F.struct((-F.col("n")).alias("less"), "name"))).alias("names"),
    )
    out = out.withColumn("folded", folds.folded_names("names"))
    typo = F.aggregate(F.filter("folded", lambda x: x["name"] != x.canonical), F.lit(0).cast("long"), lambda done, x: done + x.n)
    some = lambda c: F.when(F.size("names") > 0, c)
    clusters = F.size(F.array_distinct(F.transform("folded", lambda x: x.canonical))).cast("long")
    return out.withColumns({"tool_clusters": some(clusters), "typo_calls": some(typo)}).drop("names", "folded")


def analysis_report(turns: DataFrame) -> DataFrame:
    """One row per session; counts of what a session does not have are null for tools, citations, pull requests and charged errors."""
    spawns = ordered.spawn_runs(turns).groupBy("session_key").agg(F.max("round").alias("breaker_max_run"), F.count_if(F.col("round") > ordered.TRIP).alias("breaker_stalls"))
    out = reduce(lambda a, b: a.join(b, "session_key", "left"), [whole_folds(turns), distinct_folds(turns), spawns])
    out = out.na.fill(0, [*FILES, "n_paths", "breaker_max_run", "breaker_stalls"]).withColumn("breaker_tripped", F.col("breaker_max_run") > ordered.TRIP)
    return out.select("session_key", *[c for c in out.columns if c != "session_key"])
