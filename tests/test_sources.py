"""The four dialects, damaged input, subagents and line numbering, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from turnlens.operators import facts, folds
from turnlens.sources import adapters, lines, sessions


def dump(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in rows).encode())


def claude(kind, content=None, **more):
    message = {"content": content} | more.pop("message", {})
    return {"type": kind, "sessionId": "s1", "parentUuid": None, "message": message} | more


USAGE = {"input_tokens": 3, "output_tokens": 5, "cache_creation_input_tokens": 7, "cache_read_input_tokens": 11}
CLAUDE = [
    claude("user", "hello", timestamp="2025-01-01T00:00:00Z", requestId="r1"),
    claude("assistant", [{"type": "text", "text": "first"}, {"type": "text", "text": "last"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "a.py"}}], message={"model": "claude-opus-4", "usage": USAGE}, timestamp="2025-01-01T00:00:05Z"),
    claude("user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "x\ny\n"}, {"type": "text", "text": "dropped"}]),
    claude("assistant", [{"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "git push"}}], message={"model": "<synthetic>x"}),
    claude("assistant", "hidden", isSidechain=True, message={"model": "gpt-9"}),
    claude("user", "null guarded", costUSD=None),
    claude("assistant", []),
]


@pytest.fixture
def load(spark, tmp_path):
    def go(rows, name="one.jsonl"):
        dump(tmp_path / name, rows)
        return sessions.load(lines.read_lines(spark, f"file://{tmp_path}"))

    return go


def test_claude(load):
    p = load(CLAUDE)
    turns = p.turns.orderBy("turn_index").collect()
    assert [t.role for t in turns] == ["User", "Assistant", "ToolResult", "Assistant"]
    assert [t.text for t in turns] == ["hello", "last", None, None]
    assert turns[1].usage.cache_read_tokens == 11 and turns[1].tool_calls[0].intent.kind == "FileRead" and turns[1].tool_calls[0].intent.path == "a.py"
    r = turns[2].tool_results[0]
    assert (r.call_id, r.output_bytes, r.line_count, r.is_error, r.error_class) == ("t1", 4, 2, True, "ToolError")
    assert turns[3].tool_calls[0].intent.kind == "VersionControl" and turns[3].ts == turns[1].ts
    s = p.sessions.first()
    assert (s.session_id, s.model, s.request_id, s.wall_duration_ms) == ("s1", "claude-opus-4", "r1", 5000)
    assert [(f.line_number, f.error) for f in p.failures.collect()] == [(6, "null in costUSD")]


def test_codex(load):
    event = lambda t, **p: {"timestamp": "2025-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": t} | p}
    rows = [
        event("thread_settings_applied", thread_settings={"model": "gpt-4o-mini", "service_tier": "flex"}),
        event("item_completed", thread_id="th", item={"type": "UserMessage", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}),
        event("item_completed", thread_id="th2", item={"type": "CommandExecution", "command": ["ls", "-l"]}),
        event("item_completed", item={"type": "Other"}),
        event("token_count", info={"total_token_usage": {"input_tokens": 10, "cached_input_tokens": 4}}),
        event("token_count", info={"total_token_usage": {"input_tokens": 30, "output_tokens": 2}}),
        {"type": "response_item"}, {"type": "session_meta"},
        event("thread_settings_applied", thread_settings={"model": None}),
    ]
    p = load(rows)
    assert [(t.role, t.text) for t in p.turns.orderBy("turn_index").collect()] == [("User", "a\nb"), ("ToolResult", "ls -l"), ("System", None)]
    s = p.sessions.first()
    assert (s.session_id, s.model, s.service_tier) == ("th2", "gpt-4o-mini", None)
    assert s.usage.asDict() == {"input_tokens": 30, "output_tokens": 2, "cache_creation_tokens": 0, "cache_read_tokens": 4, "reasoning_tokens": 0}
    assert [f.line_number for f in p.failures.collect()] == [7]


def test_antigravity(load):
    step = lambda i, t, **m: {"step_index": i, "source": "MODEL", "type": t} | m
    rows = [
        step(0, "USER_INPUT", content="go"), step(1, "TOOL_RESULT", content="early"),
        step(2, "PLANNER_RESPONSE", thinking="hm", tool_calls=[{"name": "x", "args": {"a": '{"b":1}', "c": "plain", "d": 3}}, {"name": "y", "args": "no"}]),
        step(3, "TOOL_RESULT", content="one\n", status="ERROR"), step(4, "TOOL_RESULT", content=""), step(5, "TOOL_RESULT"),
    ]
    turns = load(rows).turns.orderBy("turn_index").collect()
    assert [t.role for t in turns] == ["User", "ToolResult", "Assistant", "ToolResult", "ToolResult", "ToolResult"]
    assert [r.call_id for t in turns for r in t.tool_results] == ["agy_unmatched_result_1", "agy_call_0", "agy_call_1", "agy_unmatched_result_5"]
    assert [json.loads(c.raw_arguments) for c in turns[2].tool_calls] == [{"a": {"b": 1}, "c": "plain", "d": 3}, {}]
    assert turns[3].tool_results[0].is_error and turns[3].tool_results[0].line_count == 1


def test_opencode(load):
    rows = [
        {"action": "message", "source": "user", "args": {"content": "hi"}, "usage": {"input_tokens": 4}},
        {"action": "run", "args": {"command": "pytest tests"}, "thought": "t", "metrics": {"input_tokens": 2, "accumulated_cost": 0.5}},
        {"observation": "run", "content": "bad", "error": True},
        {"action": "read", "args": {"path": "p"}, "metrics": {"accumulated_cost": 0.7}},
    ]
    p = load(rows)
    turns = p.turns.orderBy("turn_index").collect()
    assert [(t.role, t.text) for t in turns] == [("User", "hi"), ("Assistant", "t"), ("ToolResult", "Observation (run)"), ("Assistant", None)]
    assert turns[1].tool_calls[0].intent.kind == "TestExecution" and turns[2].tool_results[0].call_id == "opencode_call_1"
    assert [t.usage is not None for t in turns] == [False, True, False, False]
    s = p.sessions.first()
    assert (s.usage.input_tokens, s.provided_cost_usd) == (6, 0.7)


def test_damaged_input(spark, load):
    good = json.dumps(claude("user", "ok"))
    p = load(["﻿" + good, "", good + "\r", '{"type": "user", "mess', json.dumps({"type": "user", "message": None, "sessionId": "x", "parentUuid": 1}), "17", '"text"', "[]", good, json.dumps({"type": "new"})])
    assert p.turns.count() == 3
    assert [f.line_number for f in p.failures.collect()] == [4]
    assert load(["nothing known"], "two.jsonl").failures.where("error = 'unknown dialect'").count() == 1
    assert load([bytes(range(33, 127)).decode(), "\x00\x01", "{}}"], "three.jsonl").turns.count() == 3


def test_line_numbers_and_offsets(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"ab\r\n\n  \nc\xc3\xa9\nlast")
    (tmp_path / "b.txt").write_text("no")
    got = [(r.line_number, r.byte_offset, r.value) for r in lines.read_lines(spark, f"file://{tmp_path}").orderBy("line_number").collect()]
    assert got == [(1, 0, "ab"), (4, 7, "cé"), (5, 11, "last")]


def test_subagents(spark, tmp_path):
    dump(tmp_path / "main.jsonl", CLAUDE[:2])
    dump(tmp_path / "subagents" / "worker.jsonl", [claude("user", "child", sessionId="s2")])
    both = lines.read_lines(spark, f"file://{tmp_path}").unionByName(lines.read_lines(spark, f"file://{tmp_path}/subagents"))
    linked = {r.session_id: (r.parent_session_id, r.subagent_role) for r in sessions.link_subagents(sessions.load(both).sessions).collect()}
    assert linked == {"s1": (None, None), "s2": ("s1", "worker")}


def test_fifo_equals_a_queue(spark):
    import random

    rng = random.Random(7)
    rows, want = [], {}
    for f in range(20):
        queue, n = [], 0
        for k in range(30):
            calls = rng.randint(0, 2) if rng.random() < 0.5 else 0
            result = not calls and rng.random() < 0.7
            rows.append((str(f), k, k, calls, result))
            queue += range(n, n + calls)
            n += calls
            if result:
                want[str(f), k] = queue.pop(0) if queue else None
    got = adapters.fifo_pairs(spark.createDataFrame(rows, "file_path string, line_number long, turn_index long, n_calls long, is_result boolean"))
    assert {(r.file_path, r.line_number): r.call_number for r in got.where("is_result").collect()} == want


def test_trace_and_export(load):
    turns = load(CLAUDE).turns
    assert facts.trace_view(turns).orderBy("turn_index").collect()[1].asDict() | {"session_key": 0} == {"session_key": 0, "turn_index": 1, "role": "Assistant", "calls": "Read(t1)", "tokens": "3/7/11/5"}
    assert json.loads(lines.as_json(turns.where(F.col("turn_index") == 0)).first().value)["text"] == "hello"


def test_blocks_of_a_file_are_numbered_apart(spark, tmp_path):
    """A file of many blocks gets the numbers it has as one, and no window holds the lines of a whole file."""
    rows = [(f"line {k} " + "é" * (k % 50) if k % 9 else "  ") + ("\r" if k % 4 == 0 else "") for k in range(4000)]
    (tmp_path / "long.jsonl").write_bytes("\n".join(rows).encode())
    (tmp_path / "short.jsonl").write_text("one\n\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert lines.text_lines(spark, f"file://{tmp_path}", "*.jsonl").select("file_path", "block").distinct().count() > 10
        found = lines.read_lines(spark, f"file://{tmp_path}")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.line_number, r.byte_offset, r.value) for r in found.where("file_path like '%long%'").collect())
        heads = {r.file_path.rsplit("/", 1)[1]: r.dialect for r in lines.read_fingerprints(spark, f"file://{tmp_path}").collect()}
        assert heads == {r.file_path.rsplit("/", 1)[1]: r.dialect for r in lines.fingerprints(found).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, offset = [], 0
    for k, row in enumerate(rows, 1):
        row = row.removesuffix("\r")
        if row.strip():
            want.append((k, offset, row))
        offset += len(row.encode()) + 1
    assert got == want
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert sum("row_number" in w for w in windows) == 1 and all("block" in w.split("[", 2)[2] for w in windows if "row_number" in w)


def test_dialects_are_read_from_the_first_lines(spark, tmp_path):
    step = json.dumps({"step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE"}, separators=(",", ":"))
    dump(tmp_path / "late.jsonl", ["x" * 1000, "y" * 1000, "z" * 60, *[step] * 5])
    dump(tmp_path / "agy.jsonl", [*[""] * 20, step, *["w" * 500] * 50])
    dump(tmp_path / "claude.jsonl", CLAUDE)
    dump(tmp_path / "one.jsonl", ["q" * 5000 + step])
    found = {r.file_path.rsplit("/", 1)[1]: r.dialect for r in lines.read_fingerprints(spark, f"file://{tmp_path}").collect()}
    assert found == {r.file_path.rsplit("/", 1)[1]: r.dialect for r in lines.fingerprints(lines.read_lines(spark, f"file://{tmp_path}")).collect()}
    assert found == {"late.jsonl": None, "agy.jsonl": "Antigravity", "claude.jsonl": "ClaudeCode", "one.jsonl": None}


def test_pull_requests_of_sessions(spark):
    """Version-control calls are used up by their first result with an output; a call in the turn of its result counts."""
    call = lambda i, kind="VersionControl": F.struct(F.lit(i).alias("call_id"), F.struct(F.lit(kind).alias("kind")).alias("intent"))
    result = lambda i, said: F.struct(F.lit(i).alias("call_id"), F.lit(said).cast("string").alias("truncated_output"))
    said = [
        ("s", 0, [call("a"), call("b")], [], "github.com/o/r/pull/1"), ("s", 1, [], [result("a", None), result("a", "github.com/o/r/pull/2 github.com/o/q/pull/3"), result("a", "github.com/o/r/pull/4")], None),
        ("s", 2, [call("c", "Other")], [result("c", "github.com/o/r/pull/2"), result("b", "github.com/o/r/pull/x")], None), ("t", 5, [call("d")], [result("d", "github.com/o/r/pull/9")], "github.com/o/pull/7"), ("u", 0, [], [], None),
    ]
    kinds = "array<struct<call_id:string,intent:struct<kind:string>>>", "array<struct<call_id:string,truncated_output:string>>"
    one = lambda s, i, c, r, t: spark.range(1).select(F.lit(s).alias("session_key"), F.lit(i).cast("long").alias("turn_index"), F.lit("Assistant").alias("role"), F.array(*c).cast(kinds[0]).alias("tool_calls"), F.array(*r).cast(kinds[1]).alias("tool_results"), F.lit(t).cast("string").alias("text"))
    turns = one(*said[0])
    for row in said[1:]:
        turns = turns.unionByName(one(*row))
    got = {r.session_key: (r.pull_requests, r.first_turn, r.linked_via_vcs) for r in folds.pr_sessions(turns).collect()}
    assert got == {"s": (["o/q#3", "o/r#1", "o/r#2", "o/r#4"], 0, 2), "t": (["o/r#9"], 5, 1), "u": ([], None, 0)}


def test_loading_parses_once(spark, tmp_path):
    """Turns of files in four dialects come from one parse of each line, dealt out by their file once after they are numbered."""
    dump(tmp_path / "one.jsonl", CLAUDE)
    load = sessions.load(lines.read_lines(spark, f"file://{tmp_path}"), lines.read_fingerprints(spark, f"file://{tmp_path}"))
    plan = load.turns._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 2 and plan.count("Union") == 0  # the line, and arguments that are JSON in a string
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = lines.number_lines(spark.createDataFrame([("f", 1, "x")], "file_path string, pos long, value string"), ["pos"])
        plan = sessions.load(numbered).turns._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("Exchange") <= 3
