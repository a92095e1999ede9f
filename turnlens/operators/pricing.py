"""Dated rates and token economics. Rates are whole micro-USD per million tokens, so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions.columns import prompt_tokens, ratio

DEFAULT_MODEL = "claude-3-5-sonnet"
KINDS = ("Input", "CacheWrite", "CacheRead", "Output", "Reasoning")
COUNTERS = ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "reasoning_tokens")

# USD per million tokens (input, cache write, cache read, output; reasoning costs as output).
SEED = {
    "claude-3-5-sonnet": (3.00, 3.75, 0.30, 15.00),
    "claude-3-5-haiku": (0.80, 1.00, 0.08, 4.00),
    "qwen-2.5-coder": (0.20, None, 0.05, 0.60),
    "claude-opus": (15.00, 18.75, 1.50, 75.00),
    "gpt-4o": (2.50, 2.50, 1.25, 10.00),
    "deepseek-r1": (0.55, 0.55, 0.14, 2.19),
    "kimi-k1.5": (0.50, 0.50, 0.10, 2.00),
    "glm-4-plus": (1.40, 1.40, 0.20, 1.40),
    "gemini-2.0-flash": (0.10, 0.10, 0.025, 0.40),
    "gemini-2.0-pro": (1.25, 1.25, 0.30, 5.00),
}
SEED_FROM = "2024-01-01 00:00:00"


def seed_rates(spark: SparkSession) -> DataFrame:
    """The seeded dimension: (ord, model, tier, kind, rate_micro, effective_from, effective_until)."""
    rows = []
    for model, (read, write, cached, out) in SEED.items():
        for kind, usd in zip(KINDS, (read, write, cached, out, out), strict=True):
            if usd is not None:
                rows.append(f"({len(rows)}, '{model}', '{kind}', {round(usd * 1e6)}L)")
    values = ", ".join(rows)
    return spark.sql(
        f"SELECT ord, model, CAST(NULL AS string) AS tier, kind, rate_micro, TIMESTAMP'{SEED_FROM}' AS effective_from, "
        f"CAST(NULL AS timestamp) AS effective_until FROM VALUES {values} AS t(ord, model, kind, rate_micro)"
    )


def normalized_models(models: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, key) of each distinct model: the longest dash-delimited prefix that has rates, null if none."""
    known = rates.select(F.col("model").alias("key")).distinct()
    distinct = models.select("model").where("model is not null").distinct()
    parts = F.split("model", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    hits = distinct.select("model", F.posexplode(prefixes).alias("n", "key")).join(known, "key")
    best = hits.groupBy("model").agg(F.max_by("key", "n").alias("key"))
    return distinct.join(best, "model", "left")


def rate_families(rates: DataFrame) -> DataFrame:
    """(head, keys): the models with rates that begin with one dash-delimited word, longest first."""
    key = F.struct((-F.char_length("model")).alias("order"), F.col("model").alias("key"))
    return rates.groupBy(F.split("model", "-")[0].alias("head")).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def rate_intervals(rates: DataFrame) -> DataFrame:
    """(key, tier, since, until, rate_<kind>): for each model and tier, non-overlapping times and the rates in force then.

    Rows of the tier win over rows of none, then the later start, then the later declared one; the last interval is open.
    """
    each = rates.groupBy(F.col("model").alias("key")).agg(F.collect_list(F.struct("tier", "kind", "effective_from", "effective_until", "ord", "rate_micro")).alias("rows"))
    bounds = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform("rows", lambda r: r.effective_from), F.transform("rows", lambda r: r.effective_until)))))
    cut = each.withColumn("bounds", bounds).select("key", "rows", "bounds", F.posexplode("bounds").alias("n", "since"))
    tiers = F.array_distinct(F.concat(F.array(F.lit(None).cast("string")), F.transform("rows", lambda r: r.tier)))
    cut = cut.select("key", "rows", "since", F.get("bounds", F.col("n") + 1).alias("until"), F.explode(tiers).alias("tier"))
    fits = lambda r: (r.tier.isNull() | (r.tier == F.col("tier"))) & (r.effective_from <= F.col("since")) & (r.effective_until.isNull() | (F.col("since") < r.effective_until))
    best = lambda k: F.array_max(F.transform(F.filter("rows", lambda r: fits(r) & (r.kind == k)), lambda r: F.struct(r.tier.isNotNull(), r.effective_from, r.ord, r.rate_micro.alias("rate_micro"))))
    return cut.select("key", "tier", "since", "until", *[best(k).rate_micro.alias(f"rate_{k}") for k in KINDS])


def rated(usage: DataFrame, rates: DataFrame, as_of: str = "ts") -> DataFrame:
    """``usage`` (model, service_tier, a time) with the rate of each kind in micro-USD.

    The rates in force at ``as_of`` for the normalised model (unknown: the default one); an asked tier
    wins over none, then the later start, then the later declared row. Models join the rate table on
    their first word, then on model, tier and time, so usage is read once; Catalyst broadcasts the rate
    table where its size allows it, and then usage is not dealt out either.
    """
    u, families = usage.withColumn("_head", F.split("model", "-")[0]).alias("u"), rate_families(rates).alias("f")
    key = F.get(F.filter("f.keys", lambda m: (F.col("u.model") == m.key) | F.startswith(F.col("u.model"), F.concat(m.key, F.lit("-")))), F.lit(0)).key
    named = u.join(families, F.col("u._head") == F.col("f.head"), "left").select("u.*", F.coalesce(key, F.lit(DEFAULT_MODEL)).alias("_key"))
    tiers = rates.groupBy(F.col("model").alias("_key")).agg(F.collect_set("tier").alias("_tiers"))
    tier = F.when(F.array_contains("_tiers", F.col("service_tier")), F.col("service_tier"))
    named = named.join(tiers, "_key", "left").withColumn("_tier", F.coalesce(tier, F.lit(""))).drop("_head", "_tiers").alias("u")
    times = rate_intervals(rates).withColumn("tier", F.coalesce("tier", F.lit(""))).alias("t")
    during = (F.col(f"u.{as_of}") >= F.col("t.since")) & (F.col("t.until").isNull() | (F.col(f"u.{as_of}") < F.col("t.until")))
    joined = named.join(times, (F.col("u._key") == F.col("t.key")) & (F.col("u._tier") == F.col("t.tier")) & during, "left")
    return joined.select(*[F.col(f"u.{c}") for c in usage.columns], *[F.coalesce(f"t.rate_{k}", F.lit(0)).alias(f"rate_{k}") for k in KINDS])


def exact(tokens: Column, rate: str) -> Column:
    return tokens.cast("decimal(20,0)") * F.col(rate).cast("decimal(18,0)")


def cost_micro() -> Column:
    """Cost of a priced row in 1e-12 USD, exact."""
    return sum((exact(F.col(f"usage.{c}"), f"rate_{k}") for k, c in zip(KINDS[1:], COUNTERS[1:], strict=True)), exact(F.col("usage.input_tokens"), "rate_Input")).cast("decimal(38,0)")


def baseline_micro() -> Column:
    """What the row would cost without a cache: all prompt tokens at the input rate."""
    return (exact(prompt_tokens(), "rate_Input") + exact(F.col("usage.output_tokens"), "rate_Output") + exact(F.col("usage.reasoning_tokens"), "rate_Reasoning")).cast("decimal(38,0)")


#: Counters and rates below these give products and sums of a row that fit in a long.
FEW_TOKENS, FEW_MICRO, HALF = 1 << 33, 1 << 27, 31


def summed_micro(baseline: bool = False) -> Column:
    """The exact sum of the rows' costs (or baselines), an aggregate.

    A row's cost is a long unless its counters are huge; its upper and lower bits are summed apart, also as longs, and
    joined once for a group. Only rows with huge counters are summed as decimals.
    """
    counters = [F.col(f"usage.{c}") for c in COUNTERS]
    small = F.greatest(*counters) < FEW_TOKENS
    small &= (F.least(*counters) >= 0) & (F.greatest(*[F.col(f"rate_{k}") for k in KINDS]) < FEW_MICRO)
    rates = dict(zip(COUNTERS, KINDS, strict=True)) | (dict.fromkeys(COUNTERS[1:3], KINDS[0]) if baseline else {})
    cost = sum((F.col(f"usage.{c}") * F.col(f"rate_{k}") for c, k in list(rates.items())[1:]), counters[0] * F.col(f"rate_{KINDS[0]}"))
    upper, lower = F.sum(F.when(small, F.shiftright(cost, HALF))), F.sum(F.when(small, cost.bitwiseAND(F.lit((1 << HALF) - 1))))
    huge = F.sum(F.when(~F.coalesce(small, F.lit(False)), baseline_micro() if baseline else cost_micro()))
    whole = lambda c: F.coalesce(c.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (whole(upper) * F.lit(1 << HALF).cast("decimal(10,0)") + whole(lower) + F.coalesce(huge, F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)")


def usd(micro: Column) -> Column:
    return micro.cast("double") / F.lit(1e12)


def turn_costs(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost, baseline and their difference per turn that has usage."""
    priced = rated(usage.where("usage is not null"), rates)
    return priced.withColumns({"cost_usd": usd(cost_micro()), "baseline_usd": usd(baseline_micro())})


def session_usage(usage: DataFrame, last_model: bool = True) -> DataFrame:
    """One row of summed usage per session, with the last model, the last tier and the last time."""
    has = usage.where("usage is not null")
    sums = [F.sum(f"usage.{c}").alias(c) for c in COUNTERS]
    out = has.groupBy("session_key").agg(
        *sums, F.max_by("model", "turn_index").alias("model"), F.max_by("service_tier", "turn_index").alias("service_tier"), F.max("ts").alias("ts")
    )
    return out.select("session_key", "model", "service_tier", "ts", F.struct(*COUNTERS).alias("usage"))


def summarised(priced: DataFrame) -> DataFrame:
    cost, base = summed_micro(), summed_micro(baseline=True)
    return balance(priced.groupBy("session_key").agg(*[F.sum(f"usage.{c}").alias(c) for c in COUNTERS], cost.alias("c"), base.alias("b")))


def balance(sums: DataFrame, *kept: str) -> DataFrame:
    """Economics of summed counters with the exact cost ``c`` and baseline ``b``, beside the columns ``kept``."""
    prompt = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return sums.select(
        "session_key", *kept, *COUNTERS, prompt.alias("prompt_tokens"), (prompt + F.col("output_tokens")).alias("total_tokens"),
        (ratio(F.col("cache_read_tokens"), prompt, 0.0) * 100).alias("cache_hit_pct"),
        usd(F.col("c")).alias("cost_usd"), usd(F.col("b")).alias("baseline_usd"),
        usd(F.greatest(F.col("b") - F.col("c"), F.lit(0).cast("decimal(38,0)"))).alias("net_savings_usd"),
        F.when(F.col("c") > 0, F.col("b").cast("double") / F.col("c").cast("double")).otherwise(1.0).alias("efficiency"),
        F.col("cache_creation_tokens").alias("cache_5m_tokens"), F.lit(0).cast("long").alias("cache_1h_tokens"),
    )


def session_economics(usage: DataFrame, rates: DataFrame, grain: str = "turn") -> DataFrame:
    """Token economics per session; grain ``session`` prices the summed counters once at the last time."""
    rows = usage.where("usage is not null") if grain == "turn" else session_usage(usage)
    return summarised(rated(rows, rates))


def per_model(usage: DataFrame, rates: DataFrame, grain: str = "turn") -> DataFrame:
    """(session_key, model, tokens by kind, cost_usd, turns)."""
    rows = usage.where("usage is not null") if grain == "turn" else session_usage(usage)
    return rated(rows, rates).groupBy("session_key", "model").agg(
        *[F.sum(f"usage.{c}").alias(c) for c in COUNTERS], usd(summed_micro()).alias("cost_usd"), F.count(F.lit(1)).alias("turns")
    )


def raw_model_usage(usage: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """Usage of every line, whatever its role, per session and model; each model priced once at ``as_of``."""
    rows = usage.where("usage is not null and not startswith(coalesce(model, ''), '<synthetic>')").withColumn("model", F.coalesce("model", F.lit(DEFAULT_MODEL)))
    sums = rows.groupBy("session_key", "model").agg(*[F.sum(f"usage.{c}").alias(c) for c in COUNTERS])
    fixed = sums.select("session_key", "model", F.lit(None).cast("string").alias("service_tier"), F.lit(as_of).cast("timestamp").alias("ts"), F.struct(*COUNTERS).alias("usage"))
    return summarised(rated(fixed, rates))


def cost_drift(economics: DataFrame, provided: DataFrame) -> DataFrame:
    """Provider-reported cost beside the computed one: provided - computed, null without a report."""
    return economics.join(provided, "session_key", "left").withColumn("drift_usd", F.col("provided_cost_usd") - F.col("cost_usd"))


METRICS = ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "cache_hit_pct", "cost_usd", "baseline_usd", "net_savings_usd", "efficiency")


def audit_report(economics: DataFrame) -> DataFrame:
    """Nine metrics of each session in long form: (session_key, metric, value)."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    return economics.selectExpr("session_key", f"stack({len(METRICS)}, {pairs}) as (metric, value)")


def merge_snapshots(totals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Session totals (session_key, usage, ...) raised to the largest snapshot of each counter; reasoning becomes 0 where one exists."""
    counters = [c for c in COUNTERS if c != "reasoning_tokens"]
    most = snapshots.groupBy("session_key").agg(*[F.max(f"usage.{c}").alias(f"s_{c}") for c in counters])
    joined = totals.join(most, "session_key", "left")
    seen = F.col("s_input_tokens").isNotNull()
    merged = [F.greatest(F.col(f"usage.{c}"), F.coalesce(f"s_{c}", F.col(f"usage.{c}"))).alias(c) for c in counters]
    reasoning = F.when(seen, F.lit(0).cast("long")).otherwise(F.col("usage.reasoning_tokens")).alias("reasoning_tokens")
    tier = F.when(~seen, F.col("service_tier")).alias("service_tier")
    return joined.select("session_key", "model", tier, "ts", F.struct(merged[0], *merged[1:3], merged[3], reasoning).alias("usage"))
