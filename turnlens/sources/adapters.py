"""The four dialects: numbered lines to turns, parse failures and session headers.

Every dialect is a projection of a parsed line to the same facts; windows over the lines of a file, which all
dialects share, number its turns and calls. Lines are parsed once and dealt out once by their file,
whatever their dialect; nothing is collected and no Python runs per line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens import schema
from turnlens.functions.columns import line_count
from turnlens.plans.bridge import intent
from turnlens.sources.json import at, boolean, items, kind, line_order, number, parsed, string, time
from turnlens.sources.lines import ANTIGRAVITY, CLAUDE, CODEX, OPENCODE

# Fields that must not be an explicit null, in the order in which they are reported.
NOT_NULL = (
    "$.id", "$.cwd", "$.sessionId", "$.requestId", "$.version", "$.costUSD", "$.message.model",
    "$.message.usage.cache_creation_input_tokens", "$.message.usage.cache_read_input_tokens",
)
NOT_BUILT = "response_item is recognised but not implemented"
DEFAULT_MODELS = {CLAUDE: "claude-3-5-sonnet", CODEX: "gpt-4o", ANTIGRAVITY: "antigravity-unknown-model", OPENCODE: "claude-3-5-sonnet"}
CONSTANT_IDS = {ANTIGRAVITY: "agy-session", OPENCODE: "opencode-session"}


@dataclass
class Parsed:
    """What an adapter makes of lines."""

    turns: DataFrame
    failures: DataFrame
    sessions: DataFrame


# The names that tools have in the logs, by what they do.
READS, EDITS, CREATES = ("view_file", "Read", "read_file"), ("replace_file_content", "Edit", "edit_file"), ("write_to_file", "Write")
SEARCHES, FINDS, SHELLS = ("grep_search", "rg"), ("find_by_name", "fd"), ("run_command", "Bash", "bash")


def tool_intent(name: Column, args: Column) -> Column:
    """The typed intent of a tool call by its name and arguments (a variant)."""
    arg = lambda *names: F.coalesce(*[string(args, f"$.{n}") for n in names], F.lit(""))
    command = arg("CommandLine", "command")
    return (
        F.when(name.isin(*READS), intent(F.lit("FileRead"), path=arg("AbsolutePath", "file_path")))
        .when(name.isin(*EDITS), intent(F.lit("FileEdit"), path=arg("TargetFile", "file_path"), lines_added=F.lit(0), lines_removed=F.lit(0)))
        .when(name.isin(*CREATES), intent(F.lit("FileCreate"), path=arg("TargetFile", "file_path")))
        .when(name.isin(*SEARCHES), intent(F.lit("CodeSearch"), query=arg("Query", "pattern"), is_ast=F.lit(False), tool=name))
        .when(name.isin(*FINDS), intent(F.lit("FileDiscovery"), pattern=arg("Pattern", "pattern")))
        .when(name.isin(*SHELLS) & command.startswith("git"), intent(F.lit("VersionControl"), action=command))
        .when(name.isin(*SHELLS) & F.contains(command, F.lit("test")), intent(F.lit("TestExecution"), runner=F.lit("shell")))
        .otherwise(intent(F.lit("Other"), raw_name=name))
    )


def result(call_id: Column, output: Column, is_error: Column, error_class: str) -> Column:
    said = F.coalesce(output, F.lit(""))
    return F.struct(
        call_id.alias("call_id"), F.octet_length(said).cast("long").alias("output_bytes"), line_count(said).alias("line_count"), is_error.alias("is_error"),
        F.when(is_error, F.lit(error_class)).alias("error_class"), F.lit(None).cast("string").alias("truncated_output"), F.lit(None).cast("string").alias("otel_span_id"),
    )


def usage_struct(read: Column, out: Column, write: Column, cached: Column, reasoning: Column) -> Column:
    named = zip(("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "reasoning_tokens"), (read, out, write, cached, reasoning), strict=True)
    return F.struct(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in named])


NO_CALLS, NO_RESULTS = f"cast(array() as {schema.CALLS_DDL})", f"cast(array() as {schema.RESULTS_DDL})"
COUNTERS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "reasoning_tokens")
#: What a line tells, by name and type. A null call id of a call or result is filled in by the place of its turn.
FACTS = {
    "error": "string", "live": "boolean", "own_ts": "timestamp", "role": "string", "text": "string", "tool_calls": schema.CALLS_DDL, "tool_results": schema.RESULTS_DDL, "usage": schema.USAGE_DDL,
    "first_id": "string", "last_id": "string", "model": "string", "settings": "boolean", "tier": "string", "request_id": "string", "cost": "double",
    "added": schema.USAGE_DDL, "latest": schema.USAGE_DDL,
}


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def claude_facts(v: Column, good: Column) -> dict[str, Column]:
    null = F.coalesce(*[F.when(F.is_variant_null(at(v, p)), F.lit(f"null in {p[2:]}")) for p in NOT_NULL])
    is_object = kind(v).startswith("OBJECT")
    said = string(v, "$.type")
    model = string(v, "$.message.model")
    has_usage = kind(at(v, "$.message.usage")).startswith("OBJECT")
    n = lambda f: number(v, f"$.message.usage.{f}")
    usage = F.when((said == "assistant") & has_usage, usage_struct(n("input_tokens"), n("output_tokens"), n("cache_creation_input_tokens"), n("cache_read_input_tokens"), F.lit(0)))
    blocks = items(v, "$.message.content")
    typed = lambda t: F.filter(blocks, lambda b: string(b, "$.type") == t)
    texts = F.filter(F.transform(typed("text"), lambda b: string(b, "$.text")), lambda t: t.isNotNull())
    last_text = F.when(F.size(texts) > 0, F.element_at(texts, -1))
    uses = F.filter(typed("tool_use"), lambda b: (empty(string(b, "$.id")) != "") | (empty(string(b, "$.name")) != ""))
    made = F.transform(uses, lambda b: F.struct(
        empty(string(b, "$.id")).alias("call_id"), empty(string(b, "$.name")).alias("tool_name"), tool_intent(empty(string(b, "$.name")), at(b, "$.input")).alias("intent"), F.to_json(at(b, "$.input")).alias("raw_arguments")))
    got = F.transform(typed("tool_result"), lambda b: result(empty(string(b, "$.tool_use_id")), string(b, "$.content"), boolean(b, "$.is_error"), "ToolError"))
    user_text = F.when(kind(at(v, "$.message")) == "MISSING", string(v, "$.text")).otherwise(F.coalesce(string(v, "$.message.content"), last_text))
    answers = (said == "assistant") & (usage.isNotNull() | (F.size(made) > 0) | last_text.isNotNull())
    results = (said == "user") & (F.size(got) > 0)
    asks = (said == "user") & user_text.isNotNull()
    sid = string(v, "$.sessionId")
    return {
        "error": F.when(~good, "malformed JSON").when(is_object, null), "live": good & is_object & null.isNull() & ~boolean(v, "$.isSidechain"), "own_ts": time(v, "$.timestamp"),
        "role": F.when(answers, "Assistant").when(results, "ToolResult").when(asks, "User"), "text": F.when(answers, last_text).when(~results & asks, user_text),
        "tool_calls": F.when(said == "assistant", made).otherwise(F.expr(NO_CALLS)), "tool_results": F.when(said == "user", got).otherwise(F.expr(NO_RESULTS)), "usage": usage, "added": usage,
        "first_id": F.when(sid != "unknown", sid), "model": F.when((said == "assistant") & ~model.startswith("<synthetic>"), model), "request_id": string(v, "$.requestId"), "cost": F.try_variant_get(v, "$.costUSD", "double"),
    }


def codex_facts(v: Column, good: Column) -> dict[str, Column]:
    envelope = string(v, "$.type")
    event = F.when(envelope == "event_msg", string(v, "$.payload.type"))
    done = event == "item_completed"
    item = string(v, "$.payload.item.type")
    texts = F.filter(F.transform(items(v, "$.payload.item.content"), lambda b: string(b, "$.text")), lambda t: t.isNotNull())
    argv = F.filter(F.transform(items(v, "$.payload.item.command"), lambda a: F.when(kind(a) == "STRING", F.try_variant_get(a, "$", "string"))), lambda t: t.isNotNull())
    has = lambda p: kind(at(v, p)).startswith("ARRAY")
    text = F.when(item.isin("UserMessage", "AgentMessage") & has("$.payload.item.content"), F.array_join(texts, "\n")).when((item == "CommandExecution") & has("$.payload.item.command"), F.array_join(argv, " "))
    role = F.when(item == "UserMessage", "User").when(item == "AgentMessage", "Assistant").when(item.isin("CommandExecution", "Reasoning"), "ToolResult").otherwise("System")
    n = lambda f: F.when(event == "token_count", number(v, f"$.payload.info.total_token_usage.{f}"))
    fields = ("input_tokens", "output_tokens", "cache_write_input_tokens", "cached_input_tokens", "reasoning_output_tokens")
    settings = (event == "thread_settings_applied") & (kind(at(v, "$.payload.thread_settings")) != "MISSING")
    return {
        "error": F.when(~good, "malformed JSON").when(envelope == "response_item", NOT_BUILT), "live": good, "own_ts": time(v, "$.timestamp"), "role": F.when(done, role), "text": text,
        "last_id": F.when(done, string(v, "$.payload.thread_id")), "settings": settings, "tier": string(v, "$.payload.thread_settings.service_tier"), "model": F.when(settings, string(v, "$.payload.thread_settings.model")),
        "latest": F.struct(*[n(f).alias(c) for c, f in zip(COUNTERS, fields, strict=True)]),
    }


def decoded_args(args: Column) -> Column:
    """Arguments with values that are encoded JSON decoded one level; anything but an object gives ``{}``."""
    whole = F.coalesce(F.when(kind(args).startswith("OBJECT"), F.try_variant_get(args, "$", "map<string,variant>")), F.create_map().cast("map<string,variant>"))
    inner = lambda x: F.when(kind(x) == "STRING", F.coalesce(F.try_parse_json(F.try_variant_get(x, "$", "string")), x)).otherwise(x)
    pairs = F.transform(F.map_entries(whole), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))), F.lit("\u0001"), F.to_json(inner(e["value"]))))
    # {"k":"name"} and the value become "name":value
    joined = F.transform(pairs, lambda p: F.concat(F.regexp_extract(p, r'(?s)^\{"k":(.*?)\}\u0001', 1), F.lit(":"), F.regexp_extract(p, "(?s)\u0001(.*)$", 1)))
    return F.concat(F.lit("{"), F.array_join(joined, ","), F.lit("}"))


def antigravity_facts(v: Column, good: Column) -> dict[str, Column]:
    step = string(v, "$.type")
    role = F.when(step == "USER_INPUT", "User").when(step == "PLANNER_RESPONSE", "Assistant").when(step == "TOOL_RESULT", "ToolResult")
    none = F.lit(None).cast("string")
    name = lambda c: empty(string(c, "$.name"))
    made = F.transform(items(v, "$.tool_calls"), lambda c: F.struct(none.alias("call_id"), name(c).alias("tool_name"), intent(F.lit("Other"), raw_name=name(c)).alias("intent"), decoded_args(at(c, "$.args")).alias("raw_arguments")))
    said = empty(string(v, "$.content"))
    got = F.array(result(none, said, F.coalesce(string(v, "$.status") == "ERROR", F.lit(False)), "ToolError"))
    return {
        "error": F.when(~good, "malformed JSON"), "live": good, "own_ts": time(v, "$.created_at"), "role": role,
        "text": F.when(role == "User", string(v, "$.content")).when(role == "Assistant", string(v, "$.thinking")).otherwise(said),
        "tool_calls": F.when(role == "Assistant", made).otherwise(F.expr(NO_CALLS)), "tool_results": F.when(role == "ToolResult", got).otherwise(F.expr(NO_RESULTS)),
    }


def opencode_facts(v: Column, good: Column) -> dict[str, Column]:
    action = empty(string(v, "$.action"))
    tool = action.isin("run", "read", "edit", "think")
    metrics = F.when(kind(at(v, "$.metrics")) != "MISSING", at(v, "$.metrics")).otherwise(at(v, "$.usage"))
    n = lambda f: F.coalesce(number(metrics, f"$.{f}"), F.lit(0))
    counters = [n(f) for f in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")]
    usage = F.when(counters[0] + counters[1] + counters[2] + counters[3] > 0, usage_struct(*counters, F.lit(0)))
    command, path = empty(string(v, "$.args.command")), empty(string(v, "$.args.path"))
    what = (
        F.when((action == "run") & command.startswith("git"), intent(F.lit("VersionControl"), action=command))
        .when((action == "run") & F.contains(command, F.lit("test")), intent(F.lit("TestExecution"), runner=F.lit("shell")))
        .when(action == "read", intent(F.lit("FileRead"), path=path))
        .when(action == "edit", intent(F.lit("FileEdit"), path=path, lines_added=F.lit(0), lines_removed=F.lit(0)))
        .otherwise(intent(F.lit("Other"), raw_name=action))
    )
    observed = string(v, "$.observation")
    role = F.when(action == "message", F.when(string(v, "$.source") == "assistant", "Assistant").otherwise("User")).when(tool, "Assistant").when(observed.isNotNull(), "ToolResult")
    none = F.lit(None).cast("string")
    made = F.array(F.struct(none.alias("call_id"), action.alias("tool_name"), what.alias("intent"), F.coalesce(F.to_json(at(v, "$.args")), F.lit("null")).alias("raw_arguments")))
    got = F.array(result(none, string(v, "$.content"), boolean(v, "$.error"), "ObservationError"))
    return {
        "error": F.when(~good, "malformed JSON"), "live": good, "own_ts": time(v, "$.timestamp"), "role": role,
        "text": F.when(action == "message", string(v, "$.args.content")).when(tool, string(v, "$.thought")).otherwise(F.concat(F.lit("Observation ("), observed, F.lit(")"))),
        "tool_calls": F.when(tool, made).otherwise(F.expr(NO_CALLS)), "tool_results": F.when(role == "ToolResult", got).otherwise(F.expr(NO_RESULTS)), "usage": F.when(tool, usage), "added": usage,
        "cost": F.try_variant_get(metrics, "$.accumulated_cost", "double"),
    }


DIALECTS = {CLAUDE: claude_facts, CODEX: codex_facts, ANTIGRAVITY: antigravity_facts, OPENCODE: opencode_facts}


def facts_of(lines: DataFrame) -> DataFrame:
    """(file_path, line_number, byte_offset, dialect, facts) of lines (with ``dialect``), each parsed once and read by its dialect's rules.

    ``inline`` keeps the facts apart from the filters over them, which the optimizer would else push below
    the parse, with a copy of it for each use.
    """
    every = {name: read(F.col("v"), F.col("v").isNotNull()) for name, read in DIALECTS.items()}

    def whole(name: str) -> Column:
        known = every[name]
        return F.struct(*[known.get(f, F.lit(None)).cast(kind_).alias(f) for f, kind_ in FACTS.items()])

    facts = F.when(F.col("dialect") == CLAUDE, whole(CLAUDE))
    for name in (CODEX, ANTIGRAVITY, OPENCODE):
        facts = facts.when(F.col("dialect") == name, whole(name))
    return parsed(lines).select("file_path", "line_number", "byte_offset", "dialect", F.inline(F.array(facts)))


def first(c: str) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_number")))


def last(c: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_number")))


def headers(whole: Callable[[Column], Column] = lambda c: c) -> dict[str, Column]:
    """What turns have of their session, from aggregates of a file's lines, each passed through ``whole``."""
    dialect = whole(F.any_value("dialect"))
    constant, model = (F.create_map(*[F.lit(x) for p in d.items() for x in p]) for d in (CONSTANT_IDS, DEFAULT_MODELS))
    return {
        "session_id": F.coalesce(F.try_element_at(constant, dialect), whole(first("first_id")), whole(last("last_id")), F.lit("unknown")),
        "session_model": F.coalesce(whole(last("model")), F.try_element_at(model, dialect)), "service_tier": whole(F.max_by("tier", F.when(F.col("settings"), F.col("line_number")))),
    }


def session_key() -> Column:
    return F.concat_ws(":", "dialect", "session_id", "file_path")


def sessions_of(live: DataFrame) -> DataFrame:
    """One row per file: ids, model, times and usage. Wall time is never below 0, and all of it is active."""
    each = {c: (F.sum(f"added.{c}"), F.max_by(f"latest.{c}", F.when(F.col(f"latest.{c}").isNotNull(), F.col("line_number")))) for c in COUNTERS}
    added, latest = (usage_struct(*[each[c][k] for c in COUNTERS]) for k in (0, 1))
    rows = live.groupBy("file_path").agg(
        F.any_value("dialect").alias("dialect"), *[c.alias(n) for n, c in headers().items()], first("request_id").alias("request_id"), last("cost").alias("provided_cost_usd"),
        first("own_ts").alias("started_at"), last("own_ts").alias("ended_at"), added.alias("added"), latest.alias("latest"),
    )
    wall = F.greatest(F.coalesce(F.unix_millis("ended_at") - F.unix_millis("started_at"), F.lit(0)), F.lit(0))
    usage = F.when(F.col("dialect") == CODEX, F.col("latest")).when(F.col("dialect") != ANTIGRAVITY, F.col("added"))
    return rows.select(
        "file_path", session_key().alias("session_key"), F.col("dialect").alias("provider"), "session_id", F.col("session_model").alias("model"), "service_tier", "request_id", "provided_cost_usd",
        "started_at", "ended_at", wall.alias("wall_duration_ms"), wall.alias("active_duration_ms"), F.lit(0).cast("long").alias("idle_duration_ms"), usage.alias("usage"),
    )


def fifo_pairs(rows: DataFrame) -> DataFrame:
    """Pair results with calls first in, first out.

    ``rows``: file_path, line_number, n_calls, is_result. Adds ``first_call`` (number of the
    row's first call in its file) and ``call_number`` of a result, null if no call was open. With C and R
    the calls and results so far, U = running max(R - C, 0) counts unmatched results; a result is
    unmatched exactly if U grows at it, else it takes call R - U.
    """
    w = line_order().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c", F.sum("n_calls").over(w)).withColumn("r", F.sum(F.col("is_result").cast("long")).over(w))
    rows = rows.withColumn("u", F.greatest(F.max(F.col("r") - F.col("c")).over(w), F.lit(0)))
    grew = F.col("u") > F.coalesce(F.lag("u").over(line_order()), F.lit(0))
    number_ = F.when(F.col("is_result") & ~grew, F.col("r") - F.col("u") - 1)
    return rows.withColumn("first_call", F.col("c") - F.col("n_calls")).withColumn("call_number", number_).drop("c", "r", "u")


def turns_of(live: DataFrame) -> DataFrame:
    """The turns of each file in order, in the common schema: windows over its lines, all in one partitioning."""
    whole, w = Window.partitionBy("file_path"), line_order().rowsBetween(Window.unboundedPreceding, 0)
    rows = live.withColumns(headers(lambda c: c.over(whole)))
    rows = rows.withColumns({
        "ts": F.last("own_ts", ignorenulls=True).over(w), "turn_index": F.count("role").over(w) - 1,
        "n_calls": F.when(F.col("role").isNotNull(), F.size("tool_calls").cast("long")).otherwise(0), "is_result": F.coalesce((F.col("role") == "ToolResult") & (F.size("tool_results") > 0), F.lit(False)),
    })
    rows = fifo_pairs(rows).where("role is not null")
    agy, turn = F.col("dialect") == ANTIGRAVITY, F.col("turn_index")
    named = lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    call = lambda c, i: F.coalesce(c.call_id, F.when(agy, named("agy_call_", F.col("first_call") + i)).otherwise(named("opencode_call_", turn)))
    paired = F.coalesce(named("agy_call_", F.col("call_number")), named("agy_unmatched_result_", turn))
    answered = lambda r: F.coalesce(r.call_id, F.when(agy, paired).otherwise(named("opencode_call_", F.greatest(turn - 1, F.lit(0)))))
    null = lambda kind_: F.lit(None).cast(kind_)
    return rows.select(
        session_key().alias("session_key"), F.col("dialect").alias("provider"), "session_id", null("string").alias("parent_session_id"), null("string").alias("subagent_role"),
        "turn_index", "role", "ts", F.lit(0).cast("long").alias("latency_ms"), "text", F.transform("tool_calls", lambda c, i: c.withField("call_id", call(c, i))).alias("tool_calls"),
        F.transform("tool_results", lambda r: r.withField("call_id", answered(r))).alias("tool_results"), "usage", null(schema.ATTRIBUTION_DDL).alias("attribution"), F.col("session_model").alias("model"), "service_tier",
    )


def parse(lines: DataFrame) -> Parsed:
    """Turns, failures and sessions of lines whose ``dialect`` is known; those of none are left out."""
    facts = facts_of(lines.where(F.col("dialect").isin(*DIALECTS)))
    facts = facts.withColumns({"tool_calls": F.coalesce("tool_calls", F.expr(NO_CALLS)), "tool_results": F.coalesce("tool_results", F.expr(NO_RESULTS))})
    bad = facts.where("error is not null").select("file_path", "line_number", "byte_offset", "error")
    live = facts.where("live")
    return Parsed(turns_of(live), bad, sessions_of(live))


def of(name: str):
    """The adapter of one dialect."""
    return lambda lines: parse(lines.withColumn("dialect", F.lit(name)))


claude, codex, antigravity, opencode = (of(name) for name in (CLAUDE, CODEX, ANTIGRAVITY, OPENCODE))
