"""Queries that run streams over the given tables until all is read; input, checkpoint and result lie in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.functions.shared import new_folder, written
from turnlens.operators import facts, pricing, versioned
from turnlens.plans import catalog
from turnlens.sources import lines
from turnlens.streaming import sessions as streams

Query = Callable[[SparkSession, str], DataFrame]
#: Turns before this one come in a first run, the others in a second one that goes on with its state.
FIRST = 40
PARTS = 8
#: Sessions of a bucket of ordered state.
TOGETHER = 32
#: Longer than the given tables, so that no turn is late however it is dealt.
AGES = "3650 days"
#: Of idle spells and of weekly costs, in microseconds.
GAP_US, LATE_US, WEEKS_US = 12 * 3_600_000_000, 24 * 3_600_000_000, 21 * 86_400_000_000


def finish(stream: DataFrame, folder: str, mode: str, write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over what is there: through ``write``, or as Parquet files in ``folder``/out."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer = writer.foreachBatch(write) if write else writer.format("parquet").option("path", f"{folder}/out")
    writer.start().awaitTermination()


def said_files(spark: SparkSession, sf_dir: str) -> str:
    """The texts of documents as files of lines."""
    folder = new_folder(spark, "lines")
    catalog.read(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("value")).write.option("lineSep", "\n").text(f"{folder}/in")
    return folder


def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.read_lines(spark, f"{said_files(spark, sf_dir)}/in", "*.txt")
    return found.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def streamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = said_files(spark, sf_dir)
    finish(streams.line_stream(spark, f"{folder}/in", "*.txt").select("value"), folder, "append")
    return spark.read.schema("value string").parquet(f"{folder}/out").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def in_runs(rows: DataFrame, parts: list[Column], fold: Callable[[DataFrame], DataFrame], mode: str, folder: str, write: Callable[[DataFrame, int], None] | None = None, spark: SparkSession | None = None) -> None:
    """Add each part of ``rows`` to the input and run ``fold`` over it, each run with the state that the one before has left.

    The rows are computed once, not for each part.
    """
    rows = written(rows, "rows")
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        finish(fold((spark or rows.sparkSession).readStream.schema(rows.schema).parquet(f"{folder}/in")), folder, mode, write)


def dealt(n: int) -> list[Column]:
    """Parts that tear every session apart: the turns of one run come before, between and after those of the others."""
    return [F.pmod(F.col("turn_index") * 7 + 5, F.lit(n)) == k for k in range(n)]


def part_of(key: str = "session_key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS))


def buckets(turns: DataFrame) -> int:
    """So many that a bucket of ordered state has about ``TOGETHER`` sessions, whatever the size of the input."""
    return turns.agg(F.approx_count_distinct("session_key")).first()[0] // TOGETHER + 1


def ordered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each session, its turns dealt over three runs out of order; kept by the idempotent sink."""
    folder, other = new_folder(spark, "ordered"), streams.ordered_session(spark)
    sink = streams.upsert_sink(f"{folder}/out", ("session_key",), "part")
    turns = catalog.turns(spark, sf_dir)
    n = buckets(turns)
    fold = lambda rows: streams.ordered_state(rows, catalog.IDLE, AGES, n).withColumn("part", part_of())
    in_runs(streams.flags(turns), dealt(3), fold, "update", folder, sink, other)
    return versioned.load(spark, f"{folder}/out", f"{streams.ORDERED}, part long").drop("part")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, other = new_folder(spark, "alerts"), streams.ordered_session(spark)
    turns = catalog.turns(spark, sf_dir)
    n = buckets(turns)
    in_runs(streams.flags(turns), dealt(2), lambda rows: streams.loop_alerts(rows, late=AGES, buckets=n), "append", folder, spark=other)
    return spark.read.schema(streams.ALERTS).parquet(f"{folder}/out")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals after two runs, the sink's last values."""
    folder = new_folder(spark, "totals")
    sink = streams.upsert_sink(f"{folder}/out", streams.TOTALS_KEY, "part")
    fold = lambda rows: streams.running_totals(rows, pricing.seed_rates(spark)).withColumn("part", part_of())
    rows = catalog.turns(spark, sf_dir)
    in_runs(rows, [F.col("turn_index") < FIRST, F.col("turn_index") >= FIRST], fold, "update", folder, sink)
    return versioned.load(spark, f"{folder}/out", f"{streams.TOTALS}, part long").drop("part")


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.session_totals(totals(spark, sf_dir))
    return found.select("session_key", "n_turns", "n_calls", "n_user", "total_tokens", "cache_hit_pct", "cost_usd", "baseline_usd", "net_savings_usd", "efficiency")


def with_late_rows(rows: DataFrame, time: str, held: Column, late_us: int, gap_us: int, end: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``rows`` and their three parts: the first half of the time, the second half with ``held`` rows of the first, and ``end``.

    Held rows are either newer than the watermark of the first run, or so old that the stream must leave them out; none is so
    near the watermark that its window may be closed in part.
    """
    us = F.unix_micros(time)
    first, last = rows.agg(F.min(us), F.max(us)).first()
    middle = (first + last) // 2
    newest = rows.where((us < middle) & ~held).agg(F.max(us)).first()[0]
    mark = (newest // 1000) * 1000 - late_us
    kept_back = held & (us < middle) & ((us >= mark) | (us < mark - gap_us))
    parted = rows.withColumn("run", F.when((us < middle) & ~kept_back, 0).otherwise(1)).unionByName(end.withColumn("run", F.lit(2)))
    return parted, [F.col("run") == k for k in range(3)]


def idle_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of activity, streamed in three runs with late rows; a row from the far future closes the last spells."""
    folder = new_folder(spark, "idle")
    turns = catalog.turns(spark, sf_dir).select("session_key", "turn_index", "ts")
    end = turns.agg(F.lit("").alias("session_key"), F.lit(0).cast("long").alias("turn_index"), (F.max("ts") + F.expr("interval 30 days")).alias("ts")).where("ts is not null")
    rows, parts = with_late_rows(turns, "ts", F.col("turn_index") % 7 == 3, LATE_US, GAP_US, end)
    in_runs(rows, parts, lambda r: streams.idle_sessions(r, f"{GAP_US} microseconds", f"{LATE_US} microseconds"), "append", folder)
    found = spark.read.schema("session_key string, started_at timestamp, ended_at timestamp, n_turns long").parquet(f"{folder}/out")
    return found.where("session_key <> ''").select("session_key", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n_turns")


def weekly_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per week as a stream that is stopped and goes on, feeding the rollups through the idempotent sink; orders that come after their week is closed are left out."""
    folder = new_folder(spark, "weekly")
    orders = catalog.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_totalprice").alias("total_cost_usd"))
    rows, parts = with_late_rows(orders, "started_at", F.col("o_orderkey") % 9 == 1, WEEKS_US, 7 * 86_400_000_000, orders.limit(0))
    rollup = lambda r: streams.cost_rollup(r, f"{WEEKS_US} microseconds").withColumn("period_type", F.lit("week"))
    in_runs(rows, parts[:2], rollup, "update", folder, streams.upsert_sink(f"{folder}/out", facts.PERIOD_KEY, "period_type"))
    found = versioned.load(spark, f"{folder}/out", "period_start date, session_count long, total_cost_usd double, period_type string")
    return catalog.ms(found, "period_start")


def delivered_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as session facts through the sink, each batch delivered twice."""
    folder = new_folder(spark, "sink")
    orders = catalog.read(spark, sf_dir, "orders")
    orders = orders.select(F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").cast("string").alias("provider_session_id"), F.col("o_totalprice").alias("total_cost_usd"))
    orders.write.parquet(f"{folder}/in")
    rows = spark.readStream.schema(orders.schema).parquet(f"{folder}/in")
    write = streams.upsert_sink(f"{folder}/out", facts.SESSION_KEY, "provider")

    def twice(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        write(batch, batch_id)

    finish(rows, folder, "append", twice)
    return versioned.load(spark, f"{folder}/out", rows.schema)


def lines_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations of which all come in two files of a batch, and half again in a later batch; a plain sink gets each once."""
    folder = new_folder(spark, "once")
    said = catalog.read(spark, sf_dir, "conversations")
    rows = said.select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("file_path"), F.col("turn").cast("long").alias("line_number"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn")).alias("ts"), F.coalesce("text", F.lit("")).alias("value"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).repartition(4, "copy")
    in_runs(twice, [F.col("copy") < 2, (F.col("copy") == 2) & (F.col("line_number") % 2 == 0)], streams.delivered_once, "append", folder)
    return spark.read.schema("file_path string, line_number long, ts timestamp, value string").parquet(f"{folder}/out").select("file_path", "line_number", F.char_length("value").cast("long").alias("n_chars"))


def upserted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session facts upserted into a versioned table in three writes, later order keys replacing earlier ones; then old versions are swept."""
    root = new_folder(spark, "facts")
    rows = catalog.session_facts(spark, sf_dir).select("provider", (F.col("batch_id") % 500).cast("string").alias("provider_session_id"), "total_cost_usd", "status", F.col("provider_session_id").cast("long").alias("batch_id"))
    for low, high in zip((0.0, 0.4, 0.7), (0.4, 0.7, 1.1), strict=True):
        most = F.lit(rows.agg(F.max("batch_id")).first()[0] or 0)
        batch = rows.where((F.col("batch_id") >= most * low) & (F.col("batch_id") < most * high))
        versioned.upsert(root, facts.latest_by_key(batch, facts.SESSION_KEY), facts.SESSION_KEY, "provider")
    versioned.sweep(spark, root, keep=1, older_than_ms=0)
    return versioned.load(spark, root, facts.latest_by_key(rows, facts.SESSION_KEY).schema)


def queries() -> dict[str, Query]:
    return {"a2_directory_scan": scanned_lines, "d1_upsert_table": upserted_table, "i1_line_stream": streamed_lines, "i2_running_totals": running_totals, "i2_running_attribution": lambda s, d: streams.attributed(totals(s, d)),
            "i3_ordered_state": ordered_states, "i4_loop_alerts": alerts, "i5_idle_sessions": idle_spells, "i6_weekly_cost": weekly_costs, "i7_idempotent_sink": delivered_twice, "i7_lines_once": lines_once}


def oracle_sql() -> dict[str, str]:
    said = "WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS v FROM documents)"
    parts = catalog.oracle_sql()
    took = {"f1_autonomy": "max_streak", "f2_timeline": "max_streak AS closed_streak, current_streak, n_idle", "f3_flow": "longest AS flow_longest", "f5_self_correction": "retries, pivots", "f7_circuit_breaker": "max_run, stalls", "e1_stats": "n_turns"}
    folds = [f"SELECT session_key, {columns} FROM ({parts[p]})" for p, columns in took.items()]
    late = lambda time, held, late_us, gap_us: f"""edges AS (SELECT (min(epoch_us({time})) + max(epoch_us({time}))) // 2 AS middle FROM src),
      marks AS (SELECT middle, max(epoch_us({time})) FILTER (epoch_us({time}) < middle AND NOT ({held})) // 1000 * 1000 - {late_us} AS mark FROM src, edges GROUP BY middle),
      came AS (SELECT src.* FROM src, marks WHERE NOT (({held}) AND epoch_us({time}) < middle AND epoch_us({time}) < mark - {gap_us}))"""  # noqa: E731
    return {
        "d1_upsert_table": parts["d1_session_upsert"],
        "i2_running_totals": f"SELECT e.session_key, n_turns, n_calls, n_user, total_tokens, cache_hit_pct, cost_usd, baseline_usd, net_savings_usd, efficiency FROM ({parts['e1_stats']}) s JOIN ({parts['b6_session_economics']}) e USING (session_key)",
        "i2_running_attribution": parts["e8_attribution"],
        "i5_idle_sessions": catalog.over(", src AS (SELECT session_key, turn_index, ts FROM turns), " + late("ts", "turn_index % 7 = 3", LATE_US, GAP_US) + f""",
          gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_key ORDER BY ts) > {GAP_US} THEN 1 ELSE 0 END AS cut FROM came),
          spells AS (SELECT *, sum(cut) OVER (PARTITION BY session_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM gaps)
          SELECT session_key, min(epoch_us(ts)) AS started_us, max(epoch_us(ts)) + {GAP_US} AS ended_us, count(*) AS n_turns FROM spells GROUP BY session_key, spell"""),
        "i6_weekly_cost": "WITH src AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS started_at, o_totalprice FROM orders), " + late("started_at", "o_orderkey % 9 = 1", WEEKS_US, 7 * 86_400_000_000) + """
          SELECT epoch_us(CAST(date_trunc('week', started_at) AS TIMESTAMP)) // 1000 AS period_start, 'week' AS period_type, count(*) AS session_count, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total_cost_usd FROM came GROUP BY ALL""",
        "i7_lines_once": "SELECT 'v' || conv_id AS file_path, turn AS line_number, length(coalesce(text, '')) AS n_chars FROM conversations",
        "a2_directory_scan": f"{said}, s AS (SELECT regexp_replace(v, chr(13) || '$', '') AS value FROM l) SELECT value, count(*) AS n FROM s WHERE NOT regexp_full_match(value, '\\s*') GROUP BY value",
        "i1_line_stream": f"{said} SELECT v AS value, count(*) AS n FROM l GROUP BY v",
        "i3_ordered_state": f"SELECT * FROM ({folds[0]})" + "".join(f" JOIN ({f}) USING (session_key)" for f in folds[1:]),
        "i4_loop_alerts": catalog.over(catalog.NODES_SQL + """, live AS (SELECT session_key, turn_index, key, seq, seq - row_number() OVER (PARTITION BY session_key, key ORDER BY seq) AS run FROM nodes WHERE key IS NOT NULL AND NOT mutates),
          placed AS (SELECT *, row_number() OVER (PARTITION BY session_key, key, run ORDER BY seq) AS n FROM live) SELECT session_key, turn_index, key FROM placed WHERE n = 3"""),
        "i7_idempotent_sink": "SELECT o_orderpriority AS provider, CAST(o_orderkey AS VARCHAR) AS provider_session_id, o_totalprice AS total_cost_usd FROM orders",
    }
