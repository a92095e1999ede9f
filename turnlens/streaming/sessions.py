"""The folds on Structured Streaming: line stream, running totals, ordered state, loop alerts, idempotent sink."""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from turnlens import schema
from turnlens.functions.columns import has_error, n_items
from turnlens.operators import pricing
from turnlens.operators.facts import latest_by_key
from turnlens.operators.ordered import TRIP
from turnlens.operators.versioned import upsert

LOOP = 3


def line_stream(spark: SparkSession, path: str, names: str = "*.jsonl") -> DataFrame:
    """New files called ``names`` of a directory as lines (file_path, block, value); the query's checkpoint remembers what was read."""
    text = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", names).text(path)
    return text.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), "value")


def delivered_once(rows: DataFrame, key: tuple[str, ...] = ("file_path", "line_number"), time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first delivery of each line; others are left out as long as the watermark remembers it, which is at least ``late``."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


TOTALS_KEY = ("session_key", "kind", "name")
TOTALS = "session_key string, kind string, name string, n_turns long, n_calls long, n_user long, " + ", ".join(f"{c} long" for c in pricing.COUNTERS) + ", c decimal(38,0), b decimal(38,0)"


def running_totals(turns: DataFrame, rates: DataFrame) -> DataFrame:
    """Running totals of each session by what its tokens are attributed to; for update mode.

    The stream joins the rates in force at each turn's time, a table that stands still, so every turn is priced when it comes. Costs
    are whole numbers. Turns without usage count under the kind None. ``session_totals`` and ``attributed`` read them.
    """
    used = F.col("usage").isNotNull()
    known = F.col("attribution.kind").isin("Plugin", "Skill")
    kind = F.when(~used, "None").when(known, F.col("attribution.kind")).otherwise("Unattributed")
    name = F.when(used & known, F.coalesce("attribution.name", F.lit(""))).otherwise("")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return pricing.rated(turns, rates).groupBy("session_key", kind.alias("kind"), name.alias("name")).agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(n_items("tool_calls")).alias("n_calls"), F.count_if(F.col("role") == "User").alias("n_user"),
        *[whole(f"usage.{c}").alias(c) for c in pricing.COUNTERS], whole(pricing.cost_micro()).cast("decimal(38,0)").alias("c"), whole(pricing.baseline_micro()).cast("decimal(38,0)").alias("b"),
    )


def session_totals(totals: DataFrame) -> DataFrame:
    """Counts and economics of each session from its running totals."""
    counts = ("n_turns", "n_calls", "n_user")
    sums = totals.groupBy("session_key").agg(*[F.sum(c).alias(c) for c in (*counts, *pricing.COUNTERS)], *[F.sum(c).cast("decimal(38,0)").alias(c) for c in "cb"])
    return pricing.balance(sums, *counts)


def attributed(totals: DataFrame) -> DataFrame:
    """Tokens by plugin, by skill and unattributed from the running totals."""
    tokens = sum((F.col(c) for c in pricing.COUNTERS[1:4]), F.col(pricing.COUNTERS[0]))
    return totals.where("kind <> 'None'").select("session_key", "kind", F.when(F.col("kind") != "Unattributed", F.col("name")).alias("name"), tokens.alias("tokens"))


def flags(turns: DataFrame) -> DataFrame:
    """What the ordered state needs of each turn, in plain columns; calls as arrays in their order."""
    calls = F.coalesce("tool_calls", F.array().cast(schema.CALLS_DDL))
    kind = lambda c: c.intent.kind
    second = lambda c: F.get(F.split(F.trim(c.intent.action), r"\s+"), F.lit(1))
    mutates = lambda c: kind(c).isin("FileEdit", "FileCreate") | (kind(c) == "VersionControl") & F.coalesce(second(c).isin("commit", "push"), F.lit(False))
    key = lambda c: F.when(kind(c) == "CodeSearch", c.intent["query"]).when(kind(c).isin("FileRead", "FileEdit", "FileCreate"), c.intent.path)
    return turns.select(
        "session_key", "turn_index", "ts", "role", F.unix_millis("ts").alias("ms"), n_items("tool_calls").alias("n_calls"), has_error().alias("wrong"),
        F.coalesce(F.exists("tool_results", lambda r: r.is_error & F.contains(F.lower(r.error_class), F.lit("permission"))), F.lit(False)).alias("broke"),
        F.transform(calls, key).alias("keys"), F.transform(calls, lambda c: F.coalesce(mutates(c), F.lit(False))).alias("mutates"),
        F.transform(F.filter(calls, lambda c: kind(c) == "SubagentSpawn"), lambda c: F.coalesce(c.intent.agent_type, F.lit(""))).alias("spawns"),
    )


COLUMNS = ("session_key", "max_streak", "closed_streak", "current_streak", "flow_longest", "n_idle", "retries", "pivots", "max_run", "stalls", "n_turns")
ORDERED = "session_key string, " + ", ".join(f"{c} long" for c in COLUMNS[1:])
ALERTS = "session_key string, turn_index long, key string"
#: What waits for earlier turns, as plain columns of ``flags``; a fold's state has null for those it does not need.
WAITING = "role string, ms long, n_calls long, wrong boolean, broke boolean, keys array<string>, mutates array<boolean>, spawns array<string>"
FIELDS = [f.split()[0] for f in WAITING.split(", ")]
FOREVER = 1 << 62


class InOrder(StatefulProcessor):
    """Hands the turns of each session to ``advance`` in the order of ``turn_index`` (from 0, without gaps), whatever order they come in.

    Turns that come early wait in the state until those before them are there. If these stay away, a timer of
    event time lets the waiting ones pass once the watermark is beyond the newest of them; what comes after
    that is late and left out. A turn that is delivered again changes nothing.

    The groups are buckets of some sessions (``packed``), since each group costs a few calls between the worker and the state. One value
    has a bucket's timer, the first one its sessions want, and their numbers and waiting turns as JSON; it is read and written once a
    batch, however many turns came, and timers are asked for only where they change.
    """

    start, columns = (), ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "timer long, sessions string")

    def advance(self, key: str, carry: list[Any], turn_index: int, row: list[Any]) -> None:
        """Fold one turn into ``carry``."""
        raise NotImplementedError

    def results(self, key: str, carry: list[Any]) -> list[tuple[Any, ...]]:
        raise NotImplementedError

    def forward(self, key: str, known: list[Any], fresh: dict[int, list[Any]], gaps: bool) -> tuple[list[Any], list[tuple[Any, ...]]]:
        """What a session keeps (next turn, wanted timer, waiting turns, carry) and its results, in ``columns``."""
        at, _, early, carry = known
        held = {k: row for k, *row in early}
        turns = held | {k: v for k, v in fresh.items() if k >= at and k not in held}
        order, done = sorted(turns), 0
        while done < len(order) and (gaps or order[done] == at):
            at = order[done] + 1
            self.advance(key, carry, order[done], turns[order[done]])
            done += 1
        times = [t for k in order[done:] if (t := turns[k][FIELDS.index("ms")]) is not None]
        wanted = max(times, default=FOREVER) if done < len(order) else None
        return [at, wanted, [(k, *turns[k]) for k in order[done:]], carry], self.results(key, carry) if done else []

    def step(self, fresh: dict[str, dict[int, list[Any]]], until: int | None) -> list[tuple[Any, ...]]:
        """The results of one bucket and batch; a timer that fired lets sessions pass whose timers are before ``until``."""
        known = self.state.get()
        timer, sessions = (known[0], {k: kept for k, *kept in json.loads(known[1])}) if known else (None, {})
        gone = {k for k, kept in sessions.items() if until is not None and kept[1] is not None and kept[1] < until}
        out: list[tuple[Any, ...]] = []
        for key in dict.fromkeys((*fresh, *gone)):
            sessions[key], found = self.forward(key, sessions.get(key) or [0, None, [], list(self.start)], fresh.get(key, {}), key in gone)
            out += found
        wanted = min((kept[1] for kept in sessions.values() if kept[1] is not None), default=None)
        if timer is not None and timer != wanted and until is None:  # one that fired is gone
            self.handle.deleteTimer(timer)
        if wanted is not None and (timer != wanted or until is not None):
            self.handle.registerTimer(wanted)
        self.state.update((wanted, json.dumps([(k, *kept) for k, kept in sessions.items()])))
        return out

    def passed(self, key: str, fresh: dict[int, list[Any]], gaps: bool) -> Iterator[pd.DataFrame]:
        """``step`` for one session as a frame, for use outside a stream."""
        if rows := self.step({key: fresh}, FOREVER + 1 if gaps else None):
            yield pd.DataFrame(rows, columns=list(self.columns))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        fresh: dict[str, dict[int, list[Any]]] = {}
        for session_key, turn_index, turn in map(itemgetter("session_key", "turn_index", "turn"), rows):
            turns = fresh.setdefault(session_key, {})
            if turn_index not in turns:
                turns[turn_index] = list(map(json.loads(turn).get, FIELDS))
        yield from map(self.named, self.step(fresh, None))

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        until = max(expiredTimerInfo.getExpiryTimeInMs() + 1, timerValues.getCurrentWatermarkInMs())
        yield from map(self.named, self.step({}, until))

    def named(self, values: tuple[Any, ...]) -> Row:
        return Row(**dict(zip(self.columns, values, strict=True)))

    def close(self) -> None:
        pass


class Fold(InOrder):
    """Streaks, flow, idle gaps, corrections and the circuit breaker, continued from turn to turn."""

    start, columns = (0, 0, 0, 0, 0, 0, 0, -1, False, 0, 0, 0, None, 0, 0, 0), COLUMNS

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def advance(self, key: str, carry: list[Any], turn_index: int, row: list[Any]) -> None:
        streak, longest, own, own_longest, flow, flow_longest, idle, last, was_wrong, retries, pivots, turns, agent, run, max_run, stalls = carry
        role, ms, n_calls, wrong, broke, _, _, spawns = row
        streak = 0 if role == "User" else streak + (role in ("Assistant", "ToolResult"))
        own, own_longest = (own + 1, own_longest) if role == "Assistant" else (0, max(own_longest, own))
        flow = 0 if broke else flow + n_calls
        if ms is not None:
            idle, last = idle + (last >= 0 and ms - last > self.idle_ms), ms
        for spawned in spawns:
            run = run + 1 if spawned == agent else 1
            agent, max_run, stalls = spawned, max(max_run, run), stalls + (run > TRIP)
        if was_wrong and n_calls:
            retries, pivots = retries + (not wrong), pivots + bool(wrong)
        carry[:] = streak, max(longest, streak), own, own_longest, flow, max(flow_longest, flow), int(idle), last, bool(wrong), int(retries), int(pivots), turns + 1, agent, run, max_run, int(stalls)

    def results(self, key: str, carry: list[Any]) -> list[tuple[Any, ...]]:
        _, longest, own, own_longest, _, flow_longest, idle, _, _, retries, pivots, turns, _, _, max_run, stalls = carry
        return [(key, longest, own_longest, own, flow_longest, idle, retries, pivots, max_run, stalls, turns)]


class Alerts(InOrder):
    """The ``trip``-th call in a row on one key without a change in between."""

    start, columns = ("", 0), ("session_key", "turn_index", "key")

    def __init__(self, trip: int) -> None:
        self.trip = trip

    def advance(self, key: str, carry: list[Any], turn_index: int, row: list[Any]) -> None:
        last, n = carry
        for target, mutates in zip(row[FIELDS.index("keys")], row[FIELDS.index("mutates")], strict=True):
            target = target or ""
            n = 0 if mutates or not target else n + 1 if target == last and n else 1
            last = target
            if n == self.trip:
                self.found.append((key, turn_index, target))
        carry[:] = last, n

    def forward(self, key: str, known: list[Any], fresh: dict[int, list[Any]], gaps: bool) -> tuple[list[Any], list[tuple[Any, ...]]]:
        self.found: list[tuple[Any, ...]] = []
        return super().forward(key, known, fresh, gaps)

    def results(self, key: str, carry: list[Any]) -> list[tuple[Any, ...]]:
        return self.found


def packed(rows: DataFrame, needed: tuple[str, ...], late: str, buckets: int | None) -> GroupedData:
    """Turns with the ``needed`` flags as a JSON object (what is null is left out), dealt to ``buckets`` by session; None: a bucket for each session."""
    bucket = F.pmod(F.xxhash64("session_key"), F.lit(buckets)).cast("string") if buckets else F.col("session_key")
    turns = rows.select(bucket.alias("bucket"), "session_key", "turn_index", "ts", F.to_json(F.struct(*needed)).alias("turn"))
    return turns.withWatermark("ts", late).groupBy("bucket")


def ordered_session(spark: SparkSession) -> SparkSession:
    """A session with the state store that ordered folds need; the settings of ``spark`` stay as they are."""
    other = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(name, spark.conf.get(name))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return other


def ordered_state(rows: DataFrame, idle_ms: int = 300_000, late: str = "1 day", buckets: int | None = None) -> DataFrame:
    """Ordered folds continued from batch to batch; one updated row per session and batch.

    ``rows`` come from ``flags``, in any order, in a session like ``ordered_session``. A turn without a time opens no idle gap; the last known
    time stays. ``max_run`` and ``stalls`` are those of the circuit breaker, the closed and the current streak those of Assistant turns.
    ``buckets`` says how many groups the sessions share: a batch reads and writes the state of each bucket that it has turns of, so a few dozen
    sessions a bucket are cheapest where most sessions come in a batch. It must stay as it is while a checkpoint is used.
    """
    groups = packed(rows, ("role", "ms", "n_calls", "wrong", "broke", "spawns"), late, buckets)
    return groups.transformWithState(Fold(idle_ms), ORDERED, "Update", "EventTime")


def loop_alerts(rows: DataFrame, trip: int = LOOP, late: str = "1 day", buckets: int | None = None) -> DataFrame:
    """An alert at the ``trip``-th call in a row on one key without a change in between; all calls of a turn count, in order."""
    return packed(rows, ("ms", "keys", "mutates"), late, buckets).transformWithState(Alerts(trip), ALERTS, "Append", "EventTime")


def idle_sessions(turns: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity spells split at gaps of more than ``gap``; rows later than ``late`` are dropped in a stream."""
    rows = turns.withWatermark("ts", late) if turns.isStreaming else turns
    spell = F.session_window("ts", gap)
    return rows.groupBy("session_key", spell.alias("spell")).agg(F.count(F.lit(1)).alias("n_turns")).select("session_key", F.col("spell.start").alias("started_at"), F.col("spell.end").alias("ended_at"), "n_turns")


def cost_rollup(sessions: DataFrame, late: str = "1 day") -> DataFrame:
    """Cost per week, weeks starting on Monday."""
    rows = sessions.withWatermark("started_at", late) if sessions.isStreaming else sessions
    week = F.window("started_at", "7 days", "7 days", "4 days")
    return rows.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("session_count"), F.sum(F.col("total_cost_usd").cast("decimal(18,2)")).alias("cost")).select(F.to_date("week.start").alias("period_start"), "session_count", F.col("cost").cast("double").alias("total_cost_usd"))


def upsert_sink(path: str, key: tuple[str, ...], partition_by: str):
    """A function for ``foreachBatch``: upserts into the versioned table at ``path``; a batch that is delivered again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = latest_by_key(batch.withColumn("batch_id", F.lit(batch_id)), key).select(*batch.columns).persist()
        try:
            upsert(path, rows, key, partition_by)
        finally:
            rows.unpersist()

    return write
