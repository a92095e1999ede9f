"""Hash aggregations over turns; one groupBy each, order-free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions.columns import n_items, ratio, total_tokens, trimmed

# Words that approve a step, schema names, classes of API errors.
APPROVALS = ("y", "yes", "ok", "proceed")
SCHEMAS = ("spec@1", "plan@1", "changeset@1", "eval-report@1", "finding-report@1")
RATE_LIMIT, SERVER_ERROR = r"429|overloaded", r"500|503|504"
PR_LINK = r"(?=(github\.com/[^/]+/[^/]+/pull/[0-9]+))"


def calls(turns: DataFrame) -> DataFrame:
    """One row per tool call: session_key, turn_index, call_pos, role, call."""
    return turns.select("session_key", "turn_index", "role", F.posexplode("tool_calls").alias("call_pos", "call"))


def results(turns: DataFrame) -> DataFrame:
    return turns.select("session_key", "turn_index", F.posexplode("tool_results").alias("result_pos", "result"))


def stats(turns: DataFrame) -> DataFrame:
    roles = [F.count_if(F.col("role") == r).alias(f"n_{r.lower()}") for r in ("User", "Assistant", "System", "ToolResult")]
    return turns.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("n_turns"), *roles, F.sum(n_items("tool_calls")).alias("n_calls"), F.sum(n_items("tool_results")).alias("n_results"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("text_bytes"),
    )


def turn_duration(turns: DataFrame) -> DataFrame:
    """p50, p95 and whole mean of positive Assistant latencies, by rank and not interpolated; 0 if none."""
    timed = turns.where("role = 'Assistant' and latency_ms > 0").select("session_key", "latency_ms")
    w = Window.partitionBy("session_key")
    ranked = timed.select("*", F.row_number().over(w.orderBy("latency_ms")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda q: F.least(F.floor(F.col("n") * q), F.col("n") - 1) + 1
    found = ranked.groupBy("session_key").agg(
        F.max(F.when(F.col("k") == at(0.5), F.col("latency_ms"))).alias("p50_ms"), F.max(F.when(F.col("k") == at(0.95), F.col("latency_ms"))).alias("p95_ms"),
        F.expr("sum(latency_ms) div count(1)").alias("mean_ms"),
    )
    return turns.select("session_key").distinct().join(found, "session_key", "left").na.fill(0, ["p50_ms", "p95_ms", "mean_ms"])


def api_health(turns: DataFrame) -> DataFrame:
    """Rate-limit and server errors by class, case-sensitive; the first kind that fits counts."""
    wrong = F.filter("tool_results", lambda r: r.is_error)
    limit = F.size(F.filter(wrong, lambda r: F.coalesce(r.error_class.rlike(RATE_LIMIT), F.lit(False))))
    server = F.size(F.filter(wrong, lambda r: F.coalesce(~r.error_class.rlike(RATE_LIMIT) & r.error_class.rlike(SERVER_ERROR), F.lit(False))))
    out = turns.groupBy("session_key").agg(F.sum(limit).alias("rate_limits"), F.sum(server).alias("server_errors"))
    return out.withColumn("retries", F.col("rate_limits") + F.col("server_errors"))


def mcp_affinity(turns: DataFrame) -> DataFrame:
    kind, raw = lambda c: c.intent.kind, lambda c: F.coalesce(c.intent.raw_name, F.lit(""))
    structured = F.size(F.filter("tool_calls", lambda c: (kind(c) == "McpCall") | ((kind(c) == "Other") & F.contains(raw(c), F.lit("mcp")))))
    shell = F.size(F.filter("tool_calls", lambda c: (kind(c) == "Other") & raw(c).isin("run_command", "Bash")))
    out = turns.groupBy("session_key").agg(F.sum(structured).alias("structured"), F.sum(shell).alias("shell"))
    return out.withColumn("affinity", ratio(F.col("structured"), F.col("structured") + F.col("shell"), 1.0))


def tool_inventory(turns: DataFrame) -> DataFrame:
    return calls(turns).groupBy("session_key", F.col("call.tool_name").alias("tool_name")).agg(F.count(F.lit(1)).alias("n_calls"))


def permission_mode(turns: DataFrame) -> DataFrame:
    manual = F.count_if((F.col("role") == "User") & F.coalesce(trimmed(F.col("text")).isin(*APPROVALS), F.lit(False)))
    auto = F.sum(F.when(F.col("role") != "User", n_items("tool_calls")).otherwise(0))
    out = turns.groupBy("session_key").agg(manual.alias("manual"), auto.alias("auto"))
    return out.withColumn("auto_rate", ratio(F.col("auto"), F.col("auto") + F.col("manual"), 1.0))


def artifacts(turns: DataFrame) -> DataFrame:
    """Distinct non-empty paths read, created and edited, and of all of these."""
    c = calls(turns).select("session_key", F.col("call.intent.kind").alias("kind"), F.col("call.intent.path").alias("path")).where("path <> ''")
    sets = {"n_read": "FileRead", "n_created": "FileCreate", "n_edited": "FileEdit"}
    c = c.where(F.col("kind").isin(*sets.values())).distinct()
    counted = [F.count_if(F.col("kind") == k).alias(n) for n, k in sets.items()]
    found = c.groupBy("session_key").agg(*counted, F.count_distinct("path").alias("n_paths"))
    return turns.select("session_key").distinct().join(found, "session_key", "left").na.fill(0)


def attribution(turns: DataFrame) -> DataFrame:
    """Total tokens by plugin, by skill and unattributed, in long form."""
    kind = F.when(F.col("attribution.kind").isin("Plugin", "Skill"), F.col("attribution.kind")).otherwise("Unattributed")
    name = F.when(kind != "Unattributed", F.col("attribution.name"))
    return turns.where("usage is not null").groupBy("session_key", kind.alias("kind"), name.alias("name")).agg(F.sum(total_tokens()).alias("tokens"))


def attribution_by_subagent(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tokens of child sessions by parent and role (else the child's id); children that share a key add up."""
    children = sessions.where("parent_session_id is not null").select("session_key", "parent_session_id", F.coalesce("subagent_role", "session_id").alias("subagent"))
    used = turns.where("usage is not null").groupBy("session_key").agg(F.sum(total_tokens()).alias("tokens"))
    return children.join(used, "session_key", "left").groupBy("parent_session_id", "subagent").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def hook_activity(lines: DataFrame) -> DataFrame:
    """Calls and duration by hook event over raw lines (session_key, value), with the session's blocked count.

    Blocked lines count even without an event name, so the rate can pass 1.
    """
    at = lambda f: F.get_json_object("value", f"$.{f}")
    rows = lines.select("session_key", at("hookEventName").alias("event"), F.coalesce(at("durationMs").cast("long"), F.lit(0)).alias("ms"), ((at("decision") == "block") | (at("permissionDecision") == "deny")).alias("blocked"))
    rows = rows.where("event is not null or blocked")
    return rows.groupBy("session_key").agg(
        F.count("event").alias("n_hooks"), F.coalesce(F.sum(F.when(F.col("event").isNotNull(), F.col("ms"))), F.lit(0)).alias("total_ms"), F.count_if("blocked").alias("n_blocked"),
    ).withColumn("block_rate", ratio(F.col("n_blocked"), F.col("n_hooks"), 0.0))


def hooks_by_event(lines: DataFrame) -> DataFrame:
    at = lambda f: F.get_json_object("value", f"$.{f}")
    rows = lines.select("session_key", at("hookEventName").alias("event"), F.coalesce(at("durationMs").cast("long"), F.lit(0)).alias("ms"))
    return rows.where("event is not null").groupBy("session_key", "event").agg(F.count(F.lit(1)).alias("n_hooks"), F.sum("ms").alias("total_ms"))


def otel_correlation(sessions: DataFrame) -> DataFrame:
    ids = F.array_compact(F.array("conversation_id"))
    return sessions.select("session_key", ids.alias("conversation_ids"), F.size(ids).cast("long").alias("n_conversations"))


def span_mapping(turns: DataFrame) -> DataFrame:
    """(session_key, call_id, span_id): the last span of each call."""
    r = results(turns).where("result.otel_span_id is not null")
    return r.groupBy("session_key", F.col("result.call_id").alias("call_id")).agg(F.max_by("result.otel_span_id", F.struct("turn_index", "result_pos")).alias("span_id"))


def unmapped_results(turns: DataFrame) -> DataFrame:
    missing = F.size(F.filter("tool_results", lambda r: r.otel_span_id.isNull()))
    return turns.groupBy("session_key").agg(F.sum(missing).alias("n_unmapped"))


def schema_citations(turns: DataFrame) -> DataFrame:
    """One row per schema name in a turn's text; valid if the text shows a JSON block."""
    valid = F.contains("text", F.lit("```json")) | F.contains("text", F.lit('{"$schema"'))
    cited = F.filter(F.array(*map(F.lit, SCHEMAS)), lambda s: F.contains("text", s))
    return turns.where("text is not null").select("session_key", "turn_index", F.explode(cited).alias("schema_id"), valid.alias("valid"))


def named_pull_requests(text: Column) -> Column:
    """Every mention of a pull request as owner/repository#number."""
    parts = lambda url: F.split(url, "/")
    return F.transform(F.regexp_extract_all(text, F.lit(PR_LINK), F.lit(1)), lambda url: F.concat(parts(url)[1], F.lit("/"), parts(url)[2], F.lit("#"), parts(url)[4]))


def pr_mentions(turns: DataFrame) -> DataFrame:
    """(session_key, turn_index, from_vcs, pr): every mention of a pull request in results and texts.

    ``from_vcs`` marks those in the output of a version-control call; such a call is used up by its first result that has an output.
    """
    vcs = calls(turns).where("call.intent.kind = 'VersionControl'").select("session_key", F.col("call.call_id").alias("id"), F.col("turn_index").alias("call_turn"))
    r = results(turns).select("session_key", "turn_index", "result_pos", F.col("result.call_id").alias("id"), F.col("result.truncated_output").alias("said")).where("said is not null")
    first = r.join(vcs, ["session_key", "id"]).where("call_turn <= turn_index").groupBy("session_key", "id", "call_turn").agg(F.min(F.struct("turn_index", "result_pos")).alias("at"))
    used = first.select("session_key", F.col("at.turn_index").alias("turn_index"), F.col("at.result_pos").alias("result_pos")).distinct().withColumn("from_vcs", F.lit(True))
    texts = r.join(used, ["session_key", "turn_index", "result_pos"], "left").select("session_key", "turn_index", "said", F.coalesce("from_vcs", F.lit(False)).alias("from_vcs"))
    texts = texts.unionByName(turns.where("text is not null").select("session_key", "turn_index", F.col("text").alias("said"), F.lit(False).alias("from_vcs")))
    return texts.where(F.contains("said", F.lit("github.com/"))).select("session_key", "turn_index", "from_vcs", F.explode(named_pull_requests(F.col("said"))).alias("pr"))


def pr_links(turns: DataFrame) -> DataFrame:
    """Distinct pull requests of each session: first turn, mentions, mentions in the output of a version-control call."""
    return pr_mentions(turns).groupBy("session_key", "pr").agg(F.min("turn_index").alias("first_turn"), F.count(F.lit(1)).alias("mentions"), F.count_if("from_vcs").alias("vcs_mentions"))


def pr_sessions(turns: DataFrame) -> DataFrame:
    """One row per session: its distinct pull requests in order, the first turn that names one (null: none), mentions linked through a version-control call."""
    found = pr_links(turns).groupBy("session_key").agg(F.array_sort(F.collect_list("pr")).alias("pull_requests"), F.min("first_turn").alias("first_turn"), F.sum("vcs_mentions").alias("linked_via_vcs"))
    every = turns.select("session_key").distinct().join(found, "session_key", "left")
    return every.select("session_key", F.coalesce("pull_requests", F.array().cast("array<string>")).alias("pull_requests"), "first_turn", F.coalesce("linked_via_vcs", F.lit(0)).alias("linked_via_vcs"))


def by_calls(names: Column) -> Column:
    """All (less, name) of a group, most calls first; ``less`` is the negated number of calls."""
    return F.array_sort(F.collect_list(names))


def folded_names(names: str) -> Column:
    """(canonical, name, n) of each of ``by_calls``, in order."""
    close = lambda d, x: (d.canonical == d["name"]) & (F.levenshtein(d.canonical, x["name"]) <= F.when(F.octet_length(x["name"]) < 5, 1).otherwise(2))
    known = lambda done, x: F.get(F.filter(done, lambda d: close(d, x)), F.lit(0)).canonical
    one = lambda done, x: F.struct(F.coalesce(known(done, x), x["name"]).alias("canonical"), x["name"].alias("name"), (-x.less).alias("n"))
    return F.aggregate(names, F.array().cast("array<struct<canonical:string,name:string,n:bigint>>"), lambda done, x: F.concat(done, F.array(one(done, x))))


def fuzzy_tools(turns: DataFrame) -> DataFrame:
    """Clusters of misspelt tool names per session, by one fold over the distinct names.

    (session_key, canonical, n_names, n_calls, typo_calls, variants, typo_rate): ``variants`` are the other
    names with their calls, ``typo_rate`` is the share of all calls of the session that are such.

    Names go by calls descending, then by name; each joins the earliest canonical name within one edit
    (names under five bytes) or two, else it becomes canonical.
    """
    named = tool_inventory(turns).groupBy("session_key").agg(by_calls(F.struct((-F.col("n_calls")).alias("less"), F.col("tool_name").alias("name"))).alias("names"))
    folded = folded_names("names")
    rows = named.select("session_key", F.inline(folded)).withColumn("typo", F.col("name") != F.col("canonical"))
    variants = F.array_sort(F.collect_list(F.when(F.col("typo"), F.struct((-F.col("n")).alias("less"), "name"))))
    clusters = rows.groupBy("session_key", "canonical").agg(
        F.count(F.lit(1)).alias("n_names"), F.sum("n").alias("n_calls"), F.sum(F.when(F.col("typo"), F.col("n")).otherwise(0)).alias("typo_calls"),
        F.transform(variants, lambda v: F.struct(v["name"].alias("name"), (-v.less).alias("n_calls"))).alias("variants"),
    )
    session = Window.partitionBy("session_key")
    return clusters.withColumn("typo_rate", ratio(F.sum("typo_calls").over(session), F.sum("n_calls").over(session), 0.0))
