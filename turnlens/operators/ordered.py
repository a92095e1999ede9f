"""Ordered analytics per session: window functions over one partitioning and order, then one groupBy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions.columns import has_error, in_order, n_items, prompt_tokens, ratio, so_far

IDLE_MS = 300_000
TRIP = 2


def autonomy(turns: DataFrame) -> DataFrame:
    """Streaks of Assistant and ToolResult turns; a User turn ends one, System turns neither add nor end."""
    rows = turns.select("session_key", "turn_index", "role", F.count_if(F.col("role") == "User").over(so_far()).alias("island"))
    own = F.count_if(F.col("role").isin("Assistant", "ToolResult"))
    islands = rows.groupBy("session_key", "island").agg(own.alias("n"), F.count(F.lit(1)).alias("rows"))
    streak = F.when(F.col("n") > 0, F.col("n"))
    return islands.groupBy("session_key").agg(
        F.coalesce(F.max(streak), F.lit(0)).alias("max_streak"), F.coalesce(F.avg(streak), F.lit(0.0)).alias("mean_streak"),
        F.count(streak).alias("n_streaks"), (F.sum("n").cast("double") / F.sum("rows").cast("double")).alias("autonomous_share"),
    )


def timeline(turns: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Closed streaks of Assistant turns, the open one at the end, and idle gaps of more than ``idle_ms``."""
    w = in_order()
    gap = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(w))
    rows = turns.select("session_key", "turn_index", "role", "ts", gap.alias("gap"), F.count_if(F.col("role") != "Assistant").over(so_far()).alias("island"))
    idle = F.when(F.col("gap") > idle_ms, F.col("gap"))
    islands = rows.groupBy("session_key", "island").agg(
        F.count_if(F.col("role") == "Assistant").alias("n"), F.count(idle).alias("gaps"), F.sum(idle).alias("idle"), F.max(idle).alias("longest"), F.max_by("ts", "turn_index").alias("ts"),
    )
    last = F.max("island").over(Window.partitionBy("session_key"))
    closed = F.when((F.col("n") > 0) & (F.col("island") < F.col("last")), F.col("n"))
    return islands.withColumn("last", last).groupBy("session_key").agg(
        F.count(closed).alias("n_streaks"), F.coalesce(F.max(closed), F.lit(0)).alias("max_streak"),
        F.max(F.when(F.col("island") == F.col("last"), F.col("n"))).alias("current_streak"),
        F.sum("gaps").alias("n_idle"), F.coalesce(F.sum("idle"), F.lit(0)).alias("idle_ms"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest_idle_ms"),
        F.max_by("ts", "island").alias("last_ts"),
    )


def flow(turns: DataFrame) -> DataFrame:
    """Tool calls between permission errors; the calls of the breaking turn join no streak but count in the total.

    ``streaks`` lists the lengths of the streaks in order, ``permission_blocks`` counts the breaking turns.
    """
    broke = F.coalesce(F.exists("tool_results", lambda r: r.is_error & F.contains(F.lower(r.error_class), F.lit("permission"))), F.lit(False))
    rows = turns.select("session_key", "turn_index", n_items("tool_calls").alias("n"), broke.alias("broke"))
    rows = rows.withColumn("island", F.count_if("broke").over(so_far()))
    islands = rows.groupBy("session_key", "island").agg(F.sum(F.when(F.col("broke"), 0).otherwise(F.col("n"))).alias("streak"), F.sum("n").alias("calls"), F.count_if("broke").alias("blocks"))
    streak = F.when(F.col("streak") > 0, F.col("streak"))
    return islands.groupBy("session_key").agg(
        F.count(streak).alias("n_streaks"), F.coalesce(F.max(streak), F.lit(0)).alias("longest"), F.coalesce(F.avg(streak), F.lit(0.0)).alias("mean_streak"),
        F.sum("blocks").alias("permission_blocks"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("streak") > 0, F.struct("island", "streak")))), lambda x: x.streak).alias("streaks"),
        F.sum("calls").alias("n_calls"), F.coalesce(F.sum(F.when(F.col("streak") >= 2, F.col("streak"))), F.lit(0)).alias("flowing"),
    ).withColumn("flow_ratio", ratio(F.col("flowing"), F.col("n_calls"), 0.0)).drop("flowing")


def context_growth(turns: DataFrame) -> DataFrame:
    """Over turns with usage: first, peak and last prompt tokens, largest rise, mean positive rise over the steps."""
    rows = turns.where("usage is not null").select("session_key", "turn_index", prompt_tokens().alias("p"))
    step = F.col("p") - F.lag("p").over(in_order())
    rows = rows.withColumn("rise", F.when(step > 0, step).when(step <= 0, 0))
    return rows.groupBy("session_key").agg(
        F.min_by("p", "turn_index").alias("first_tokens"), F.max("p").alias("peak_tokens"), F.max_by("p", "turn_index").alias("last_tokens"),
        F.coalesce(F.max("rise"), F.lit(0)).alias("max_rise"), F.coalesce(F.sum("rise").cast("double") / F.nullif(F.count("rise"), F.lit(0)), F.lit(0.0)).alias("mean_rise"),
    )


def self_correction(turns: DataFrame) -> DataFrame:
    """A turn with calls after an error turn is a pivot if it fails too, else a retry."""
    rows = turns.select("session_key", "turn_index", has_error().alias("wrong"), n_items("tool_calls").alias("n"))
    rows = rows.withColumn("after", F.lag("wrong", 1, False).over(in_order()) & (F.col("n") > 0))
    return rows.groupBy("session_key").agg(F.count_if(F.col("after") & ~F.col("wrong")).alias("retries"), F.count_if(F.col("after") & F.col("wrong")).alias("pivots"))


def errors_by_tool(turns: DataFrame) -> DataFrame:
    """Error results charged to the latest call up to and including their turn; those before any call are left out."""
    named = F.when(n_items("tool_calls") > 0, F.element_at("tool_calls", -1).tool_name)
    wrong = F.size(F.filter("tool_results", lambda r: r.is_error))
    rows = turns.select("session_key", "turn_index", wrong.alias("wrong"), F.last(named, ignorenulls=True).over(so_far()).alias("tool_name"))
    return rows.where("wrong > 0 and tool_name is not null").groupBy("session_key", "tool_name").agg(F.sum("wrong").alias("n_errors"))


def spawn_runs(turns: DataFrame) -> DataFrame:
    """(session_key, turn_index, call_pos, agent_type, round): the round of each spawn in its run of one agent type."""
    spawns = turns.select("session_key", "turn_index", F.posexplode("tool_calls").alias("call_pos", "call")).where("call.intent.kind = 'SubagentSpawn'")
    w = Window.partitionBy("session_key").orderBy("turn_index", "call_pos")
    rows = spawns.select("session_key", "turn_index", "call_pos", F.col("call.intent.agent_type").alias("agent_type"))
    rows = rows.withColumn("new", ~F.col("agent_type").eqNullSafe(F.lag("agent_type").over(w)) | F.lag("turn_index").over(w).isNull())
    rows = rows.withColumn("run", F.count_if("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("session_key", "run").orderBy("turn_index", "call_pos")
    return rows.select("session_key", "turn_index", "call_pos", "agent_type", F.row_number().over(in_run).cast("long").alias("round"))


def circuit_breaker(turns: DataFrame) -> DataFrame:
    """Longest run of spawns of one agent type, spawns beyond round ``TRIP``, and if it tripped."""
    found = spawn_runs(turns).groupBy("session_key").agg(F.max("round").alias("max_run"), F.count_if(F.col("round") > TRIP).alias("stalls"))
    out = turns.select("session_key").distinct().join(found, "session_key", "left").na.fill(0, ["max_run", "stalls"])
    return out.withColumn("tripped", F.col("max_run") > TRIP)


def tool_nodes(turns: DataFrame) -> DataFrame:
    """One row per call with its target, mutation flag and the error of its first result.

    A result belongs to the newest call with its id at or before it. Here version control mutates only
    if the action is exactly commit or push.
    """
    c = turns.select("session_key", "turn_index", F.posexplode("tool_calls").alias("call_pos", "call"))
    same_id = Window.partitionBy("session_key", F.col("call.call_id")).orderBy("turn_index", "call_pos")
    c = c.select("session_key", "turn_index", "call_pos", "call", F.lead("turn_index").over(same_id).alias("until"))
    r = turns.select("session_key", F.col("turn_index").alias("r_turn"), F.posexplode("tool_results").alias("r_pos", "r"))
    r = r.select("session_key", "r_turn", "r_pos", F.col("r.call_id").alias("r_id"), F.col("r.is_error").alias("r_error"))
    hit = (c.session_key == r.session_key) & (F.col("call.call_id") == r.r_id) & (r.r_turn >= c.turn_index) & (c.until.isNull() | (r.r_turn < c.until))
    kind = F.col("call.intent.kind")
    out = c.join(r, hit, "left").groupBy(c.session_key, c.turn_index, c.call_pos).agg(
        F.any_value("call").alias("call"), F.min_by("r_error", F.struct("r_turn", "r_pos")).alias("r_error")
    )
    return out.select(
        "session_key", "turn_index", F.col("call_pos").cast("long").alias("call_pos"), F.col("call.call_id").alias("call_id"),
        F.when(kind.isin("FileRead", "FileEdit", "FileCreate"), F.col("call.intent.path")).alias("file"), F.when(kind == "CodeSearch", F.col("call.intent.query")).alias("symbol"),
        (kind.isin("FileEdit", "FileCreate") | ((kind == "VersionControl") & F.col("call.intent.action").isin("commit", "push"))).alias("mutates"),
        F.coalesce("r_error", F.lit(False)).alias("had_error"),
    )


def forward_filled(turns: DataFrame) -> DataFrame:
    """``turns`` with null times replaced by the latest time so far."""
    return turns.withColumn("ts", F.last("ts", ignorenulls=True).over(so_far()))


def cache_drops(turns: DataFrame, under: float = 0.75) -> DataFrame:
    """Turns whose cache hit ratio falls under ``under`` right after a turn that was not."""
    rows = turns.where("usage is not null").select("session_key", "turn_index", ratio(F.col("usage.cache_read_tokens"), prompt_tokens(), 0.0).alias("hit"))
    return rows.withColumn("before", F.lag("hit").over(in_order())).where((F.col("before") >= under) & (F.col("hit") < under))
