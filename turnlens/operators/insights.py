"""Session classes, workflow clusters and findings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions.columns import ratio
from turnlens.functions.shared import written
from turnlens.operators import graph, ordered, trajectory

ACCELERATION, FEW_SEARCHES, MANY_SEARCHES, MANY_TURNS = 0.60, 2, 6, 15
SIMILAR, CLIQUE = 0.75, 3
#: Size of the smaller set from which on pairs of sets meet by one gram instead of three, 64-bit words of a set's bits, and what rounding of products like 0.7 * 10 may be off.
MANY_GRAMS, WORDS, SLACK = 32, 4, 1e-9
RULE_VERSION = "1"

# Legacy tools and what replaces them.
LEGACY = {"grep": "rg", "egrep": "rg", "find": "fd", "cat": "bat", "cd": "zoxide"}
#: Our own estimates of how much faster the replacement is, and the uses from which on a habit is worth more than a hint.
SPEEDUP = {"grep": 5, "egrep": 5, "find": 4, "cat": 1, "cd": 1}
OFTEN = 10


def bimodal(turns: DataFrame) -> DataFrame:
    """Acceleration, Exploration or Balanced, by the shares of changing calls and searching turns."""
    kind = lambda *k: F.size(F.filter("tool_calls", lambda c: c.intent.kind.isin(*k)))
    out = turns.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.size("tool_calls")).alias("n_calls"), F.sum(kind("FileEdit", "FileCreate")).alias("changes"), F.count_if(kind("CodeSearch", "FileDiscovery") > 0).alias("searches"),
    )
    share = ratio(F.col("changes"), F.col("n_calls"), 0.0)
    label = (
        F.when(F.col("n_calls") == 0, "Balanced")
        .when((share >= ACCELERATION) & (F.col("searches") <= FEW_SEARCHES), "Acceleration")
        .when((F.col("searches") >= MANY_SEARCHES) & (F.col("n_turns") >= MANY_TURNS), "Exploration")
        .otherwise("Balanced")
    )
    return out.select("session_key", "n_turns", "n_calls", "changes", "searches", label.alias("mode"))


def bigrams(turns: DataFrame) -> DataFrame:
    """Distinct pairs of tool names that follow each other in a session."""
    c = turns.select("session_key", "turn_index", F.posexplode("tool_calls").alias("pos", "call"))
    w = Window.partitionBy("session_key").orderBy("turn_index", "pos")
    c = c.select("session_key", F.col("call.tool_name").alias("a"), F.lead("call.tool_name").over(w).alias("b"))
    return c.where("b is not null").select("session_key", F.concat_ws(">", "a", "b").alias("gram")).distinct()


def gram_sets(turns: DataFrame) -> DataFrame:
    """(session_key, g, rep): the bigram set of each session as numbers of its grams, rarest first, and the least session with an equal set."""
    grams = written(bigrams(turns), "bigrams")
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # sorted parts are numbered in order, so the number ascends with (df, gram)
    ids = written(df.orderBy("df", "gram").select("gram", F.monotonically_increasing_id().alias("id")), "gram-ids")
    sets = grams.join(ids, "gram").groupBy("session_key").agg(F.array_sort(F.collect_list("id")).alias("g"))
    reps = sets.groupBy("g").agg(F.min("session_key").alias("rep"))
    return sets.join(reps, "g").select("session_key", "g", "rep")


def shared_most(least: float) -> int:
    """How many grams two different sets of that similarity share at least, up to three: least / (1 - least)."""
    return min(3, max(1, math.ceil(least / (1 - least) - SLACK))) if least < 1 else 3


def shared_keys(n: Column, g: Column, least: float, many: int = MANY_GRAMS) -> Column:
    """Arrays of as many grams of a set as two different similar sets share at least, up to three; one of them is shared by any two such sets.

    Of n grams the k rarest common ones
    are among the n - ceil(least * n) + k rarest. Pairs whose smaller set has over ``many`` grams meet by one gram, so that keys stay few.
    """
    most = shared_most(least)
    first = lambda k: F.slice(g, F.lit(1), F.greatest(n - F.ceil(least * n - SLACK).cast("int") + k, F.lit(0)))
    none = F.lit(-1).cast("long")

    def keys(k: int) -> Column:
        rare = first(k)
        after = lambda i: F.slice(rare, i + 2, F.size(rare))
        if k == 1:
            return F.transform(rare, lambda x: F.array(x, none, none))
        if k == 2:
            return F.flatten(F.transform(rare, lambda x, i: F.transform(after(i), lambda y: F.array(x, y, none))))
        return F.flatten(F.transform(rare, lambda x, i: F.flatten(F.transform(rare, lambda y, j: F.when(j > i, F.transform(after(j), lambda z: F.array(x, y, z))).otherwise(F.array().cast("array<array<bigint>>"))))))

    few, lots = keys(most), keys(1)
    return F.when(n <= many, few).when(least * n - SLACK > many, lots).otherwise(F.concat(few, lots)) if most > 1 else lots


def similar_sets(sets: DataFrame, least: float = SIMILAR, many: int = MANY_GRAMS) -> DataFrame:
    """(a, b, jaccard) of the representatives of different ``sets`` with at least that similarity, each pair once.

    Sets meet by ``shared_keys``. Where two meet, 256 bits of each rule most pairs out: sets of that similarity differ in no more than
    (1 - least) / (1 + least) of their sizes' sum, and bits never differ more than sets. The others are compared exactly, under the key of
    their rarest common grams only, so no pair is listed twice and only similar pairs leave the join. Equal sets are compared once.
    """
    n = F.size("g")
    at = lambda x: F.pmod(x, F.lit(64 * WORDS))
    word = lambda k: F.aggregate("g", F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.when(F.floor(at(x) / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (at(x) % 64).cast("int"))).otherwise(F.lit(0).cast("long"))))
    groups = sets.where(F.col("session_key") == F.col("rep")).select("rep", "g", n.alias("n"), *[word(k).alias(f"w{k}") for k in range(WORDS)])
    keyed = groups.select("rep", "g", "n", *[f"w{k}" for k in range(WORDS)], F.explode(shared_keys(F.col("n"), F.col("g"), least, many)).alias("key"))
    keyed = keyed.select("rep", "g", "n", *[f"w{k}" for k in range(WORDS)], *[F.col("key")[k].alias(f"k{k}") for k in range(3)])
    a, b = keyed.alias("a"), keyed.alias("b")
    bits = sum((F.bit_count(F.col(f"a.w{k}").bitwiseXOR(F.col(f"b.w{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("a.w0").bitwiseXOR(F.col("b.w0"))))
    near = (F.col("a.n") <= F.col("b.n")) & (F.col("a.n") >= least * F.col("b.n") - SLACK) & (bits <= (1 - least) / (1 + least) * (F.col("a.n") + F.col("b.n")) + SLACK)
    once = (F.col("a.n") < F.col("b.n")) | (F.col("a.rep") < F.col("b.rep"))
    common = F.array_intersect("a.g", "b.g")
    both = F.size(common)
    jaccard = both / (F.col("a.n") + F.col("b.n") - both)
    rarest = common[0] == F.col("a.k0")
    for k in (1, 2):
        rarest &= (F.col(f"a.k{k}") < 0) | (F.get(common, F.lit(k)) == F.col(f"a.k{k}"))
    same = [F.col(f"a.k{k}") == F.col(f"b.k{k}") for k in range(3)]
    if shared_most(least) > 1:  # both may have keys of either kind; the smaller set says which counts
        once &= (F.col("a.k1") < 0) == (F.col("a.n") > many)
    # one condition, tested in this order: a filter behind the join would be moved before the cheap tests
    met = a.join(b.hint("merge"), same[0] & same[1] & same[2] & near & once & (jaccard >= least) & rarest)
    return met.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"), jaccard.alias("jaccard"))


def similar_sessions(turns: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, b, jaccard) of class representatives whose bigram sets have at least that similarity; ``session_classes`` has the members."""
    return similar_sets(written(gram_sets(turns), "grams"), least)


def session_classes(turns: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(session_key, class_id, n_links) of every session with two calls or more.

    The class is the least session with an equal bigram set; links are the other sessions of the class and
    all members of similar classes, counted without listing them.
    """
    sets = written(gram_sets(turns), "grams")
    sizes = sets.groupBy(F.col("rep").alias("class_id")).agg(F.count(F.lit(1)).alias("members"))
    pairs = similar_sets(sets, least)
    other = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = other.join(sizes.withColumnsRenamed({"class_id": "b"}), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("members").alias("near"))
    classes = sizes.join(linked, "class_id", "left").select("class_id", (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return sets.select("session_key", F.col("rep").alias("class_id")).join(classes, "class_id").select("session_key", "class_id", "n_links")


def workflow_clusters(turns: DataFrame, least: float = SIMILAR, smallest: int = CLIQUE) -> DataFrame:
    """(session_key, cluster, member_count) of the sessions in a maximal clique of at least ``smallest`` similar sessions.

    Every two sessions of a clique have bigram sets of at least that similarity. A session of several cliques
    goes to the largest, then to the one with the earliest member, then by all members in order; ``member_count`` is the size of the clique.
    Sessions with equal sets move together: a clique of classes is sized by their members, and a class
    alone can be a cluster. A cluster has the name of the least session that it gets.
    """
    sets = written(gram_sets(turns), "grams")
    pairs = written(similar_sets(sets, least), "similar")
    found = graph.maximal_cliques(pairs)
    members = sets.select("session_key", F.col("rep").alias("node")).join(found.twins, "node", "left").select("session_key", F.coalesce("twin", "node").alias("node"))
    units = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("session_key").alias("earliest"))
    alone = units.join(found.twins.select(F.col("twin").alias("node")), "node", "left_anti").select(F.col("node").alias("root"), F.lit(0).cast("long").alias("nth"), "node")
    cliques = found.members.unionByName(alone).join(units, "node")
    sized = cliques.groupBy("root", "nth").agg(F.sum("size").alias("member_count"), F.array_sort(F.collect_list("earliest")).alias("order")).where(F.col("member_count") >= smallest)
    choice = F.min(F.struct((-F.col("member_count")).alias("less"), "order", "root", "nth")).alias("best")
    chosen = cliques.join(sized, ["root", "nth"]).groupBy("node", "earliest").agg(choice)
    named = chosen.withColumn("cluster", F.min("earliest").over(Window.partitionBy("best.root", "best.nth")))
    return members.join(named.select("node", "cluster", (-F.col("best.less")).alias("member_count")), "node").select("session_key", "cluster", "member_count")


def legacy_tools(commands: DataFrame) -> DataFrame:
    """Uses of legacy commands with their replacement."""
    names = F.create_map(*[F.lit(x) for pair in LEGACY.items() for x in pair])
    rows = commands.where(F.col("command_base").isin(*LEGACY))
    return rows.groupBy("session_key", "command_base").agg(F.count(F.lit(1)).alias("n_uses")).withColumn("replacement", names[F.col("command_base")])


def loop_findings(turns: DataFrame) -> DataFrame:
    """Findings from circular loops and from tripped circuit breakers, with evidence as JSON and what to do about them."""
    loops = trajectory.circular_loops(trajectory.grounded(turns)).select(
        "session_key", F.lit("circular-loop").alias("rule_id"), F.when(F.col("size") >= 6, "high").otherwise("medium").alias("severity"),
        F.least(F.lit(1.0), F.col("size") / 10.0).alias("confidence"), F.lit("WrongApproach").alias("friction"),
        F.to_json(F.struct("key", "size")).alias("evidence_json"), F.concat(F.lit("Looped over "), "key").alias("title"),
        F.concat(F.lit("Stop reading "), "key", F.lit(" again; change it or look elsewhere")).alias("recommendation"),
    )
    stalls = ordered.circuit_breaker(turns).where("tripped").select(
        "session_key", F.lit("gate-stall").alias("rule_id"), F.lit("high").alias("severity"), F.least(F.lit(1.0), F.col("max_run") / 5.0).alias("confidence"),
        F.lit("Other").alias("friction"), F.to_json(F.struct("max_run", "stalls")).alias("evidence_json"), F.lit("Spawned one agent again and again").alias("title"),
        F.lit("Do the step without the agent, or ask for help").alias("recommendation"),
    )
    return loops.unionByName(stalls).withColumn("rule_version", F.lit(RULE_VERSION))


def legacy_findings(commands: DataFrame) -> DataFrame:
    """A finding for each legacy tool of a session: low, medium from ten uses on; the estimated speedup is part of the evidence."""
    speedups = F.create_map(*[F.lit(x) for pair in SPEEDUP.items() for x in pair])
    rows = legacy_tools(commands).withColumn("speedup", speedups[F.col("command_base")])
    return rows.select(
        "session_key", F.lit("legacy-tool").alias("rule_id"), F.when(F.col("n_uses") >= OFTEN, "medium").otherwise("low").alias("severity"),
        F.least(F.lit(1.0), F.lit(0.5) + F.col("n_uses") / 20.0).alias("confidence"), F.lit("ProcessHygieneLapse").alias("friction"),
        F.to_json(F.struct(F.col("command_base").alias("command"), "n_uses", "replacement", "speedup")).alias("evidence_json"),
        F.concat(F.lit("Used "), "command_base").alias("title"), F.concat(F.lit("Use "), "replacement", F.lit(" instead of "), "command_base").alias("recommendation"),
        F.lit(RULE_VERSION).alias("rule_version"),
    )


def findings(turns: DataFrame, commands: DataFrame) -> DataFrame:
    """All findings of sessions: loops, stalls and legacy tools."""
    return loop_findings(turns).unionByName(legacy_findings(commands))
