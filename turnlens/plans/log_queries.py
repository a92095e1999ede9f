"""Queries of the log sources and streams: lines in the four dialects are rendered from the given tables and parsed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.plans import bridge
from turnlens.sources import adapters, lines, sessions

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of lines, in blocks of a few lines."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "value"))
    return lines.number_lines(d.withColumn("block", F.floor(F.col("pos") / 3)), ["pos"], "block")


def said_lines(spark: SparkSession, sf_dir: str, render: Callable[[Column], Column]) -> DataFrame:
    """Each conversation as a file; a line per turn."""
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("file_path"), "turn", "role", "text", "conv_id")
    return lines.number_lines(c.withColumn("value", render(F.col("role"))), ["turn"])


def json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def claude_line(role: Column) -> Column:
    """Every seventh turn is a sidechain; every eleventh line is cut short; every thirteenth has a null field."""
    nth = F.col("conv_id") + F.col("turn")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    line = json(
        type=role, sessionId=F.concat(F.lit("s"), F.col("conv_id").cast("string")), parentUuid=F.lit("p"), isSidechain=nth % 7 == 0,
        timestamp=F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        message=F.struct(block.alias("content"), F.struct((F.col("turn") * 10 + 1).alias("input_tokens"), F.char_length("text").alias("output_tokens")).alias("usage")),
    )
    line = F.when(nth % 13 == 0, F.regexp_replace(line, r"\}$", ',"cwd":null}')).otherwise(line)
    return F.when(nth % 11 == 0, F.substr(line, F.lit(1), F.char_length(line) - 3)).otherwise(line)


def codex_line(role: Column) -> Column:
    item = F.struct(F.when(role == "user", "UserMessage").when(role == "assistant", "AgentMessage").otherwise("Note").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))
    return json(timestamp=F.lit("2025-01-01T00:00:00Z"), type=F.lit("event_msg"), payload=F.struct(F.lit("item_completed").alias("type"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("thread_id"), item.alias("item")))


def opencode_line(role: Column) -> Column:
    ask = json(action=F.lit("message"), source=role, args=F.struct(F.col("text").alias("content")))
    act = json(action=F.lit("run"), args=F.struct(F.concat(F.lit("git show "), F.col("turn").cast("string")).alias("command")), usage=F.struct(F.col("turn").alias("input_tokens")))
    seen = json(observation=F.lit("run"), content=F.col("text"), error=F.col("turn") % 4 == 2)
    return F.when(F.col("turn") % 4 == 1, act).when(F.col("turn") % 4 == 2, seen).otherwise(ask)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as steps: views plan k % 3 calls, errors are results, others input."""
    e = read(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    calls = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (k % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("tool"), i.cast("string")).alias("name"), F.struct(F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}")).alias("inner"), F.lit("plain").alias("word")).alias("args")))
    plan = json(step_index=F.col("event_id"), source=F.lit("MODEL"), type=F.lit("PLANNER_RESPONSE"), tool_calls=calls)
    got = json(step_index=F.col("event_id"), source=F.lit("SYSTEM"), type=F.lit("TOOL_RESULT"), content=F.col("props"), status=F.when(k % 4 == 0, "ERROR").otherwise("DONE"))
    ask = json(step_index=F.col("event_id"), source=F.lit("USER_EXPLICIT"), type=F.lit("USER_INPUT"), content=F.col("event_type"))
    value = F.when(F.col("event_type") == "view", plan).when(F.col("event_type") == "error", got).otherwise(ask)
    return lines.number_lines(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), "ts", "event_id", value.alias("value")), ["ts", "event_id"])


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in a dialect by their id, every fifth in none."""
    i = F.col("conv_id") % 4
    return said_lines(spark, sf_dir, lambda r: F.when(i == 0, claude_line(r)).when(i == 1, codex_line(r)).when(i == 2, json(action=F.lit("message"), source=r, args=F.struct(F.col("text").alias("content")))).otherwise(F.col("text")))


def claude(spark: SparkSession, sf_dir: str) -> adapters.Parsed:
    return adapters.claude(said_lines(spark, sf_dir, claude_line))


def short(turns: DataFrame) -> DataFrame:
    return turns.select("session_id", "turn_index", "role", F.char_length("text").cast("long").alias("n_chars"), F.col("usage.input_tokens").alias("input_tokens"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.antigravity(event_lines(spark, sf_dir)).turns


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of directories: every tenth is the main file, the others are its workers."""
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    i = F.col("conv_id")
    folder = F.concat(F.lit("/logs/d"), F.floor(i / 10).cast("string"))
    path = F.when(i % 10 == 0, F.concat(folder, F.lit("/main.jsonl"))).otherwise(F.concat(folder, F.lit("/subagents/w"), i.cast("string"), F.lit(".jsonl")))
    return sessions.link_subagents(c.select(path.alias("file_path"), F.concat(F.lit("s"), i.cast("string")).alias("session_id"))).select("session_id", "parent_session_id", "subagent_role")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed intent of calls with names and arguments by event."""
    e = read(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    name = F.element_at(F.array(*map(F.lit, ("view_file", "Edit", "Write", "rg", "fd", "Bash", "other"))), (k % 7 + 1).cast("int"))
    args = F.parse_json(json(file_path=F.concat(F.lit("p"), k.cast("string")), pattern=F.lit("x"), command=F.when(k % 2 == 0, "git log").otherwise("make test")))
    called = e.select("event_id", name.alias("name"), args.alias("args"))
    return called.select("event_id", adapters.tool_intent(F.col("name"), F.col("args")).alias("i")).select("event_id", "i.kind", "i.path", F.col("i.query").alias("query"), "i.action")


def queries() -> dict[str, Query]:
    turns = lambda s, d: bridge.turns_from_events(read(s, d, "events"))
    return {
        "a1_line_source": lambda s, d: document_lines(s, d).select("file_path", "line_number", "byte_offset", F.octet_length("value").cast("long").alias("n_bytes")),
        "a3_fingerprint": lambda s, d: lines.fingerprints(mixed_lines(s, d)),
        "a4_claude_turns": lambda s, d: short(claude(s, d).turns),
        "a5_codex_turns": lambda s, d: short(adapters.codex(said_lines(s, d, codex_line)).turns),
        "a6_antigravity_turns": lambda s, d: steps(s, d).select(F.col("session_key"), "turn_index", "role", F.size("tool_calls").cast("long").alias("n_calls"), F.get("tool_results", F.lit(0)).is_error.alias("is_error")),
        "a7_opencode_turns": lambda s, d: adapters.opencode(said_lines(s, d, opencode_line)).turns.select("session_key", "turn_index", "role", F.get("tool_calls", F.lit(0)).intent.action.alias("action"), F.get("tool_results", F.lit(0)).call_id.alias("result_call")),
        "a8_parse_failures": lambda s, d: claude(s, d).failures.select("file_path", "line_number", "error"),
        "a9_null_guard": lambda s, d: claude(s, d).failures.where("error = 'null in cwd'").groupBy("file_path").agg(F.count(F.lit(1)).alias("n")),
        "a10_sidechains": lambda s, d: claude(s, d).turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns")),
        "a11_subagents": linked,
        "a12_fifo_pairs": lambda s, d: steps(s, d).select("session_key", "turn_index", F.explode("tool_results").alias("r")).select("session_key", "turn_index", "r.call_id"),
        "a13_intents": intents,
        "a14_decoded_args": lambda s, d: steps(s, d).select("session_key", F.explode("tool_calls").alias("c")).select("session_key", "c.call_id", "c.raw_arguments"),
        "a15_session_headers": lambda s, d: claude(s, d).sessions.select("session_id", "model", "wall_duration_ms", F.col("usage.input_tokens").alias("input_tokens")),
        "a16_result_sizes": lambda s, d: steps(s, d).select("session_key", "turn_index", F.explode("tool_results").alias("r")).select("session_key", "turn_index", "r.output_bytes", "r.line_count"),
        "a18_json_export": lambda s, d: lines.as_json(turns(s, d).select("session_key", "turn_index", "role", "latency_ms")),
        "j2_load_by_dialect": lambda s, d: sessions.load(mixed_lines(s, d)).turns.groupBy("provider", "role").agg(F.count(F.lit(1)).alias("n_turns")),
    }


SAID = """c AS (SELECT *, 'v' || conv_id AS file_path, (conv_id + turn) AS nth, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_number, length(text) AS n, contains('user assistant', role) AS speaks FROM conversations),
ok AS (SELECT * FROM c WHERE nth % 11 <> 0 AND nth % 13 <> 0 AND nth % 7 <> 0),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END AS who FROM ok WHERE role IN ('user', 'assistant'))"""
STEPS = """b AS (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_index, 'Antigravity:agy-session:u' || user_id AS session_key FROM events),
s AS (SELECT *, CASE WHEN event_type = 'view' THEN k % 3 ELSE 0 END AS n_calls, event_type = 'error' AS is_result FROM b),
w AS (SELECT *, sum(n_calls) OVER o AS c, sum(CASE WHEN is_result THEN 1 ELSE 0 END) OVER o AS r FROM s WINDOW o AS (PARTITION BY user_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, greatest(max(r - c) OVER (PARTITION BY user_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING), 0) AS u FROM w),
f AS (SELECT *, u > coalesce(lag(u) OVER (PARTITION BY user_id ORDER BY turn_index), 0) AS grew FROM u)"""


def oracle_sql() -> dict[str, str]:
    from turnlens.plans.catalog import over

    return {
        "a1_line_source": "WITH l AS (SELECT 'd' || doc_id AS file_path, unnest(string_split(coalesce(text, ''), chr(10))) AS v, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_number FROM documents), o AS (SELECT *, coalesce(sum(strlen(v) + 1) OVER (PARTITION BY file_path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM l) SELECT file_path, line_number, byte_offset, strlen(v) AS n_bytes FROM o WHERE NOT regexp_full_match(v, '\\s*')",
        "a3_fingerprint": f"WITH {SAID} SELECT DISTINCT file_path, CASE conv_id % 4 WHEN 0 THEN 'ClaudeCode' WHEN 1 THEN 'Codex' WHEN 2 THEN 'OpenCode' END AS dialect FROM c WHERE trim(text) <> '' OR conv_id % 4 < 3",
        "a4_claude_turns": f"WITH {SAID} SELECT 's' || conv_id AS session_id, turn_index, who AS role, n AS n_chars, CASE WHEN who = 'Assistant' THEN turn * 10 + 1 END AS input_tokens FROM kept",
        "a5_codex_turns": f"WITH {SAID} SELECT 't' || conv_id AS session_id, line_number - 1 AS turn_index, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END AS role, CASE WHEN role IN ('user', 'assistant') THEN n END AS n_chars, NULL::BIGINT AS input_tokens FROM c",
        "a6_antigravity_turns": f"WITH {STEPS} SELECT session_key, turn_index, CASE event_type WHEN 'view' THEN 'Assistant' WHEN 'error' THEN 'ToolResult' ELSE 'User' END AS role, n_calls, CASE WHEN is_result THEN k % 4 = 0 END AS is_error FROM s",
        "a7_opencode_turns": f"WITH {SAID} SELECT 'OpenCode:opencode-session:v' || conv_id AS session_key, line_number - 1 AS turn_index, CASE WHEN turn % 4 = 1 THEN 'Assistant' WHEN turn % 4 = 2 THEN 'ToolResult' WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END AS role, CASE WHEN turn % 4 = 1 THEN 'git show ' || turn END AS action, CASE WHEN turn % 4 = 2 THEN 'opencode_call_' || greatest(line_number - 2, 0) END AS result_call FROM c",
        "a8_parse_failures": f"WITH {SAID} SELECT file_path, line_number, CASE WHEN nth % 11 = 0 THEN 'malformed JSON' ELSE 'null in cwd' END AS error FROM c WHERE nth % 11 = 0 OR nth % 13 = 0",
        "a9_null_guard": f"WITH {SAID} SELECT file_path, count(*) AS n FROM c WHERE nth % 13 = 0 AND nth % 11 <> 0 GROUP BY file_path",
        "a10_sidechains": f"WITH {SAID} SELECT 's' || conv_id AS session_id, count(*) AS n_turns FROM kept GROUP BY conv_id",
        "a11_subagents": "WITH c AS (SELECT DISTINCT conv_id AS i FROM conversations) SELECT 's' || a.i AS session_id, CASE WHEN a.i % 10 > 0 AND b.i IS NOT NULL THEN 's' || b.i END AS parent_session_id, CASE WHEN a.i % 10 > 0 THEN 'w' || a.i END AS subagent_role FROM c a LEFT JOIN c b ON b.i = a.i // 10 * 10",
        "a12_fifo_pairs": f"WITH {STEPS} SELECT session_key, turn_index, CASE WHEN grew THEN 'agy_unmatched_result_' || turn_index ELSE 'agy_call_' || CAST(r - u - 1 AS BIGINT) END AS call_id FROM f WHERE is_result",
        "a13_intents": "WITH b AS (SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events) SELECT event_id, CASE k % 7 WHEN 0 THEN 'FileRead' WHEN 1 THEN 'FileEdit' WHEN 2 THEN 'FileCreate' WHEN 3 THEN 'CodeSearch' WHEN 4 THEN 'FileDiscovery' WHEN 5 THEN CASE WHEN k % 2 = 0 THEN 'VersionControl' ELSE 'TestExecution' END ELSE 'Other' END AS kind, CASE WHEN k % 7 < 3 THEN 'p' || k END AS path, CASE WHEN k % 7 = 3 THEN 'x' END AS query, CASE WHEN k % 7 = 5 AND k % 2 = 0 THEN 'git log' END AS action FROM b",
        "a14_decoded_args": f"WITH {STEPS}, n AS (SELECT *, unnest(generate_series(0, n_calls - 1)) AS i FROM f WHERE n_calls > 0) SELECT session_key, 'agy_call_' || CAST(c - n_calls + i AS BIGINT) AS call_id, '{{\"inner\":{{\"k\":' || k || '}},\"word\":\"plain\"}}' AS raw_arguments FROM n",
        "a15_session_headers": f"WITH {SAID} SELECT 's' || conv_id AS session_id, 'claude-3-5-sonnet' AS model, (max(turn) - min(turn)) * 60000 AS wall_duration_ms, coalesce(sum(turn * 10 + 1) FILTER (role = 'assistant'), 0)::BIGINT AS input_tokens FROM ok GROUP BY conv_id",
        "a16_result_sizes": f"WITH {STEPS} SELECT session_key, turn_index, strlen(props) AS output_bytes, 1::BIGINT AS line_count FROM s WHERE is_result",
        "a18_json_export": over("SELECT to_json({'session_key': session_key, 'turn_index': turn_index, 'role': role, 'latency_ms': latency_ms})::VARCHAR AS value FROM turns"),
        "j2_load_by_dialect": f"""WITH {SAID}, loaded AS (SELECT 'ClaudeCode' AS provider, who AS role FROM kept WHERE conv_id % 4 = 0
          UNION ALL SELECT 'Codex', CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END FROM c WHERE conv_id % 4 = 1
          UNION ALL SELECT 'OpenCode', CASE role WHEN 'assistant' THEN 'Assistant' ELSE 'User' END FROM c WHERE conv_id % 4 = 2)
          SELECT provider, role, count(*) AS n_turns FROM loaded GROUP BY ALL""",
    }
