"""Turns, usage and session facts derived from general event tables, so that every operator has input at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens import schema


def intent(kind: Column, **payload: Column) -> Column:
    """The intent struct with the payload columns given and the others null."""
    empty = F.lit(None).cast(schema.INTENT_DDL)
    out = empty
    fields = [f.split(":")[0] for f in schema.INTENT_DDL[len("struct<") : -1].split(",")]
    kinds = dict(f.split(":") for f in schema.INTENT_DDL[len("struct<") : -1].split(","))
    values = {"kind": kind, **payload}
    out = F.struct(*[(values[f] if f in values else F.lit(None)).cast(kinds[f]).alias(f) for f in fields])
    return out


def turns_from_events(events: DataFrame) -> DataFrame:
    """One session per user_id, one turn per event in (ts, event_id) order.

    The event's type and the number ``k`` of its props choose role, call, result, usage and
    attribution. Two windows over the same partitioning: one Exchange, which ordered folds of the session share.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    order = Window.partitionBy("session_key").orderBy("ts", "event_id")
    rows = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.coalesce(k, F.lit(0)).alias("k"))
    rows = rows.withColumn("ti", (F.row_number().over(order) - 1).cast("long"))
    kk, ti = F.col("k"), F.col("ti")
    is_ = lambda t: F.col("event_type") == t
    read = F.concat(F.lit("f"), (ti / 6).cast("long").cast("string"))
    kind = (
        F.when(is_("view"), F.when(kk % 16 == 0, "McpCall").when(kk % 8 == 0, "Other").otherwise("FileRead"))
        .when(is_("click"), F.when(kk % 11 == 0, "SubagentSpawn").when(kk % 4 == 0, "CodeSearch").otherwise("FileRead"))
        .when(is_("purchase"), F.when(kk % 3 == 0, "VersionControl").otherwise("FileEdit"))
        .when(is_("error") & (kk % 8 == 1), "Other")
    )
    rows = rows.withColumn("kind", kind)
    has_call = F.col("kind").isNotNull()
    name = (
        F.when(F.col("kind") == "FileRead", F.when(kk % 20 == 0, "veiw_file").otherwise("view_file"))
        .when(F.col("kind") == "CodeSearch", F.when(kk % 20 == 0, "grpe_search").otherwise("grep_search"))
        .when(F.col("kind") == "FileEdit", F.when(kk % 20 == 0, "replace_flie_content").otherwise("replace_file_content"))
        .when(F.col("kind") == "McpCall", "mcp_get")
        .when(F.col("kind") == "SubagentSpawn", "spawn_agent")
        .when(is_("view"), "Bash")
        .otherwise("run_command")
    )
    call_id = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    what = intent(
        F.col("kind"),
        path=F.when(F.col("kind") == "FileRead", read).when(F.col("kind") == "FileEdit", F.concat(F.lit("e"), (kk % 40).cast("string"))),
        query=F.when(F.col("kind") == "CodeSearch", F.concat(F.lit("q"), (kk % 5).cast("string"))),
        action=F.when(F.col("kind") == "VersionControl", F.when(kk % 2 == 0, "git commit -m x").otherwise("git status")),
        agent_type=F.when(F.col("kind") == "SubagentSpawn", F.concat(F.lit("a"), (kk % 2).cast("string"))),
        server=F.when(F.col("kind") == "McpCall", F.lit("docs")),
        method=F.when(F.col("kind") == "McpCall", F.lit("get")),
        raw_name=F.when(F.col("kind") == "Other", name),
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last_call", F.last(F.when(has_call, call_id), ignorenulls=True).over(before))
    error_class = F.when(kk % 5 == 0, "429").when(kk % 5 == 1, "503").when(kk % 5 == 2, "permission_denied").otherwise("ToolError")
    result = F.struct(
        F.coalesce("last_call", F.lit("none")).alias("call_id"), (kk * 3).alias("output_bytes"), (kk % 7).alias("line_count"),
        (kk % 4 != 0).alias("is_error"), error_class.alias("error_class"), F.lit(None).cast("string").alias("truncated_output"),
        F.when(kk % 2 == 0, F.concat(F.lit("sp"), kk.cast("string"))).alias("otel_span_id"),
    )
    assistant = F.col("event_type").isin("view", "click", "purchase")
    usage = F.struct(
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        (kk * 10).alias("cache_creation_tokens"), (kk * 50).alias("cache_read_tokens"), kk.alias("reasoning_tokens"),
    )
    said = F.concat(
        F.lit("please go on"),
        F.when(kk % 9 == 0, F.concat(F.lit(" see github.com/acme/app/pull/"), kk.cast("string"))).otherwise(""),
        F.when(kk % 8 == 0, F.lit(' {"$schema": "plan@1"}')).otherwise(""),
    )
    none = F.array().cast(schema.CALLS_DDL), F.array().cast(schema.RESULTS_DDL)
    return rows.select(
        "session_key", F.lit("bridge").alias("provider"), F.col("session_key").alias("session_id"),
        F.lit(None).cast("string").alias("parent_session_id"), F.lit(None).cast("string").alias("subagent_role"),
        F.col("ti").alias("turn_index"),
        F.when(is_("signup"), "User").when(is_("error"), "ToolResult").when(assistant, "Assistant").otherwise("System").alias("role"),
        "ts", F.when(assistant, F.floor(F.col("value") * 10).cast("long")).otherwise(F.lit(0)).cast("long").alias("latency_ms"),
        F.when(is_("signup"), F.when(kk % 4 == 0, F.lit("yes")).otherwise(said)).alias("text"),
        F.when(has_call, F.array(F.struct(call_id.alias("call_id"), name.alias("tool_name"), what.alias("intent"), F.to_json(F.struct(kk.alias("k"))).alias("raw_arguments")))).otherwise(none[0]).alias("tool_calls"),
        F.when(is_("error"), F.array(result)).otherwise(none[1]).alias("tool_results"),
        F.when(assistant & (kk % 10 != 0), usage).alias("usage"),
        F.when(kk % 3 == 1, F.struct(F.lit("Plugin").alias("kind"), F.concat(F.lit("p"), (kk % 4).cast("string")).alias("name"), F.lit(None).cast("string").alias("plugin")))
        .when(kk % 3 == 2, F.struct(F.lit("Skill").alias("kind"), F.concat(F.lit("s"), (kk % 4).cast("string")).alias("name"), F.lit(None).cast("string").alias("plugin"))).alias("attribution"),
        F.element_at(F.array(*map(F.lit, ("claude-3-5-sonnet-20241022", "gpt-4o-2024-08-06", "qwen-2.5-coder-32b", "mystery-model"))), (kk % 4 + 1).cast("int")).alias("model"),
        F.when(kk % 6 == 0, "flex").alias("service_tier"),
    )


def turns_from_conversations(conversations: DataFrame) -> DataFrame:
    """Ready-made turns without tools, usage or time."""
    role = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    known = {"session_key": F.concat(F.lit("v"), F.col("conv_id").cast("string")), "turn_index": F.col("turn"), "role": role, "text": F.col("text"), "latency_ms": F.lit(0)}
    known |= {"provider": F.lit("conversations"), "session_id": known["session_key"], "tool_calls": F.array(), "tool_results": F.array()}
    fields = []
    depth, start = 0, 0
    for i, ch in enumerate(schema.TURNS_DDL + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = schema.TURNS_DDL[start:i].strip().split(" ", 1)
            fields.append(known.get(name, F.lit(None)).cast(kind).alias(name))
            start = i + 1
    return conversations.select(*fields)


def usage_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Usage facts at scale: session l_orderkey, turn l_linenumber, tokens from quantity and price."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    model = F.when(flag == "A", "claude-3-5-sonnet-20241022").when(flag == "N", "gpt-4o-2024-08-06").otherwise("deepseek-r1-0528")
    whole = lambda c, by: F.floor(F.col(c) / by).cast("long")
    return lineitem.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("session_key"), F.col("l_linenumber").cast("long").alias("turn_index"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), model.alias("model"), F.when(status == "O", "flex").alias("service_tier"),
        F.struct(
            whole("l_extendedprice", 10).alias("input_tokens"), whole("l_quantity", 1).alias("output_tokens"), (whole("l_quantity", 1) * 7).alias("cache_creation_tokens"),
            whole("l_extendedprice", 2).alias("cache_read_tokens"), F.col("l_linenumber").cast("long").alias("reasoning_tokens"),
        ).alias("usage"),
    )
