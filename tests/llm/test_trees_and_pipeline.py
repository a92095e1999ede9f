"""Reply trees against a plain walk, and the stages of the pipeline on planted rows."""

import numpy as np

from turnlens.llm import reply_trees
from turnlens.llm.components import components


def test_best_paths_equal_a_plain_walk(spark):
    rng = np.random.default_rng(0)
    rows = []
    for conv in range(6):
        for node in range(1, 30):
            parent = None if node == 1 else int(rng.integers(max(1, node - 4), node))
            rows.append((conv, node, parent, "user" if node % 2 else "assistant", f"t{node} <|im_end|> & &lt;", float(rng.integers(0, 5))))
    rows += [(None, 1, None, None, None, None), (9, 5, 7, "user", "parent above it", 1.0)]
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    want = {}
    for conv in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == conv}
        inner = {r[2] for r in mine.values()}
        best = []
        for leaf in mine:
            if leaf in inner:
                continue
            path, at = [], leaf
            while at in mine:
                path.append(at)
                at = mine[at][2]
            best.append((-sum(mine[n][5] or 0 for n in path), leaf, path[::-1]))
        want[conv] = min(best)[2]
    got = {}
    for r in reply_trees.best_paths(nodes).collect():
        got.setdefault(r.conv_id, []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want
    back = reply_trees.read_back(reply_trees.format_paths(nodes)).collect()
    for r in back:
        mine = {x[1]: x for x in rows if x[0] == r.conv_id}
        assert [(t.role, t.text) for t in r.turns] == [(mine[n][3] or "", mine[n][4] or "") for n in want[r.conv_id]]
        assert r.loss == [mine[n][4] for n in want[r.conv_id] if mine[n][3] == "assistant"]


def test_cycles_repeats_and_unordered_ids(spark):
    rows = [
        (1, 5, 7, "user", "its parent has a greater id", 0.0), (1, 7, None, "assistant", "root", 1.0),
        (2, 1, 3, "a", "cycle", 1.0), (2, 2, 1, "b", "of", 1.0), (2, 3, 2, "c", "three", 1.0), (2, 9, 3, "d", "tail", 5.0), (2, 8, 9, "e", "end", 0.0),
        (3, 4, 4, "a", "its own parent", 1.0), (4, 1, None, "user", "b", 0.0), (4, 1, None, "user", "a", 9.0), (4, 1, 77, "user", "0", 9.0), (5, None, 1, "x", "y", 1.0),
    ]
    nodes = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, node long, parent long, role string, text string, score double, formatted string, depth int")
    got = {}
    for r in reply_trees.best_paths(nodes).orderBy("depth").collect():
        got.setdefault(r.conv_id, []).append(r.node)
    assert got == {1: [7, 5], 2: [1, 2, 3, 9, 8], 3: [4], 4: [1]}
    back = {r.conv_id: [t.text for t in r.turns] for r in reply_trees.read_back(reply_trees.format_paths(nodes)).collect()}
    assert back[4] == ["a"] and back[1] == ["root", "its parent has a greater id"]


def test_linear_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 1, "assistant", "<|im_start|>x"), (1, 0, "user\n&", None), (1, 1, "assistant", "<|im_start|>x"), (2, None, None, ""), (None, 3, "assistant", "b")]
    out = {r.conv_id: r for r in reply_trees.read_back(reply_trees.format_paths(reply_trees.linear_nodes(spark.createDataFrame(rows, schema)))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user\n&", ""), ("assistant", "<|im_start|>x"), ("assistant", "<|im_start|>x")]
    assert out[1].loss == ["<|im_start|>x"] * 2 and out[2].loss == [] and out[None].loss == ["b"]
    assert reply_trees.format_paths(reply_trees.linear_nodes(spark.createDataFrame([], schema))).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (200, 150), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"  # the smaller one has too few labelled toxic rows to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokenize":
            assert out.columns == docs.columns
            out.cache()
        kept[name] = (docs.count(), out.count())
        docs = out
    assert kept["secrets"][0] == kept["secrets"][1] == kept["tokenize"][1]
    assert kept["toxicity"][1] < kept["toxicity"][0] and kept["near_dedup"][1] < kept["near_dedup"][0] and kept["decontamination"][1] < kept["decontamination"][0]
    assert docs.where("n_tokens <> octet_length(ids) / 4").count() == 0


def test_pipeline_stages_equal_brute_force_on_planted_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, repeated rows, ties, near copies, leaks, secrets and toxic words."""
    import re

    import corpus_pipeline

    rng = np.random.default_rng(21)
    words = lambda n: " ".join("".join(rng.choice(list("abcdeghilmnorst"), 6)) for _ in range(n))
    item = words(24) + ". " + words(12) + "."
    clean = [words(60) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(clean)] + [(100 + k, words(60) + " zorkquux") for k in range(40)]
    rows += [(200, clean[0]), (201, clean[1].rsplit(" ", 2)[0]), (None, clean[2]), (None, words(50)), (3, clean[3]), (3, words(40)), (202, None), (203, ""), (None, None), (204, "two words"), (205, "two words")]
    rows += [(300, words(20) + " " + item + " " + words(20)), (None, item.upper()), (301, words(9) + " password = hunter2hunter22 " + words(9)), (302, words(9) + " z0rkquux " + words(9)), (303, words(30_000))]
    docs = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k >= 100)) for k in [*range(40), *range(100, 140)]] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    keep = [(d, t) for d, t in rows if "quux" not in (t or "")]
    out = stages["toxicity"](spark, now, str(tmp_path))
    assert pairs(out) == sorted(keep, key=str)

    def near(a, b):
        sets = []
        for t in (a, b):
            w = (t or "").lower().split()
            sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        return sets[0] == sets[1] or len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8

    kept = []
    for d, t in sorted(set(keep), key=lambda r: (r[0] is None, r[0] or 0)):
        if not any(near(t, u) for _, u in kept):
            kept.append((d, t))
    out.write.parquet(f"{tmp_path}/1")
    out = stages["near_dedup"](spark, spark.read.parquet(f"{tmp_path}/1"), str(tmp_path))
    assert [t for _, t in pairs(out) if t] == [t for _, t in sorted(kept, key=str) if t]
    assert sorted(d for d, _ in pairs(out) if d is not None) == sorted(d for d, _ in kept if d is not None)

    out.write.parquet(f"{tmp_path}/2")
    out = stages["decontamination"](spark, spark.read.parquet(f"{tmp_path}/2"), str(tmp_path))
    left = [(d, t) for d, t in kept if item.lower() not in (t or "").lower()]
    assert len(left) < len(kept) and sorted(str(t) for _, t in pairs(out) if t) == sorted(str(t) for _, t in left if t)

    out.write.parquet(f"{tmp_path}/3")
    out = stages["secrets"](spark, spark.read.parquet(f"{tmp_path}/3"), str(tmp_path))
    hidden = [(d, t and re.sub(r"password = \w+", "[SECRET]", t)) for d, t in left]
    assert sorted(str(t) for _, t in pairs(out) if t) == sorted(str(t) for _, t in hidden if t)
    out.write.parquet(f"{tmp_path}/4")
    ids = stages["tokenize"](spark, spark.read.parquet(f"{tmp_path}/4"), str(tmp_path))
    assert ids.count() == len(left) and ids.where("n_tokens = 0").count() == sum(not t for _, t in left)
    nothing = spark.createDataFrame([], now.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name


def test_pipeline_stages_ignore_clashing_columns(spark):
    """Extra columns, also those named like columns that the stages use inside, change nothing and are left out."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    base = "the cat sat on the mat and looked at the moon while the dog slept near the old stone wall and the bird sang. "
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    texts = [base * 3, base * 3, None, "", f"{base} {leak} {base}", "token = abcdefghijklmnop here", "word " * 60_000]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.select("*", *[F.lit("clash").alias(c) for c in ("key", "spans", "base", "score", "node", "item_id", "ids", "n", "toxic", "root")])
    for name, stage in corpus_pipeline.STAGES[1:]:
        plain, odd = stage(spark, docs, sf), stage(spark, clash, sf)
        assert odd.columns == plain.columns, name
        assert sorted(map(str, odd.collect())) == sorted(map(str, plain.collect())), name


def test_queries_equal_their_sql(spark):
    import duckdb

    from turnlens.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf).toPandas()
        want = con.execute(sql).fetchdf()[list(got.columns)]
        plain = lambda v: "" if str(v) in ("nan", "<NA>", "None") else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
        rows = lambda d: sorted(tuple(map(plain, r)) for r in d.itertuples(index=False))
        assert rows(got) == rows(want), name
