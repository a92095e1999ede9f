"""Document fingerprints by invertible Bloom lookup sketches (DataFrame and SQL functions only).

A text is the set of its paragraphs' digests; a paragraph is a line, long lines in pieces that end
with a sentence. A sketch has three subtables; each digest goes to one cell of each, where counts add
up and digests and check hashes are xored. Two sketches of one size subtract cell by cell, equal
paragraphs vanish, and peeling recovers the rest: a cell with one digest gives it away, and the digest
leaves its other cells.

The fingerprint of a text is one sketch, whole, of a size that its own digests set: a power of two above
their number, ``GROW`` times larger until the sketch peels alone. So a fingerprint gives away all its
digests, and the likeness of two texts is a function of their two strings. Sketches are nested: folding
a larger one gives every smaller one, so two fingerprints are first folded to their smallest size,
subtracted and peeled in their row. Where they differ by more than so few cells hold, the digests
that each gives away go to sketches of one larger size, ``GROW`` times larger until all cells empty.
There subtables take turns, so a digest is never recovered twice, and all cells of a document stay in the
task that holds its id range: the table of digests is bucketed by that range, and cells are grouped below
it, so no cell is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm.common import cut, id_bucket, id_parts, shared_dir, whole_text

#: Ranges of ids, and rows of a part of a range; a task handles whole parts.
RANGES, ROWS = 256, 4_000
#: A paragraph: up to a line end, or to the end of the first sentence after so many characters.
PIECE = r"[^\n]{1,40}[^.!?\n]*[.!?]*"
#: Cells of a subtable in the smallest sketch; a power of two.
CELLS = 4
TABLES, TURNS, GROW = 3, 9, 4


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def position(digest: Column, table: int, cells: Column | int) -> Column:
    """Cell of a digest in a subtable with ``cells`` cells, a power of two; folding a sketch keeps positions."""
    return F.xxhash64(digest, F.lit(table)).bitwiseAND((F.lit(cells) if isinstance(cells, int) else cells) - 1)


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(TABLES))


def sketch(found: Column) -> Column:
    """The smallest sketch of a set of digests: an array of cells (t, pos, n, d, c)."""
    items = F.transform(found, lambda d: F.struct(d.alias("d"), check(d).alias("c"), *[position(d, t, CELLS).alias(f"p{t}") for t in range(TABLES)]))
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("n", "d", "c")])

    def cell(items: Column, t: int, pos: int) -> Column:
        add = lambda s, x: F.struct((s.n + 1).alias("n"), s.d.bitwiseXOR(x.d).alias("d"), s.c.bitwiseXOR(x.c).alias("c"))
        sums = F.aggregate(items, zero, lambda s, x: F.when(x[f"p{t}"] == pos, add(s, x)).otherwise(s))
        return F.transform(F.array(sums), lambda s: F.struct(F.lit(t).alias("t"), F.lit(pos).cast("long").alias("pos"), s.n.alias("n"), s.d.alias("d"), s.c.alias("c")))[0]

    return F.transform(F.array(items), lambda v: F.array(*[cell(v, t, c) for t in range(TABLES) for c in range(CELLS)]))[0]


def written(cells: Column, size: Column) -> Column:
    """A sketch as text: eight hex digits of the cells of a subtable, then per filled cell (at, n, d, c), ascending, eight of its place, four of the count, sixteen each of the xored digests and check hashes."""
    wide = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    return F.lower(F.concat(wide(size, 8), F.array_join(F.transform(F.array_sort(cells), lambda c: F.concat(wide(c["at"], 8), wide(c.n % 65_536, 4), wide(c.d, 16), wide(c.c, 16))), "")))


def subtract(one: Column, two: Column) -> Column:
    """Difference of two sketches of one size."""
    return F.zip_with(one, two, lambda a, b: F.struct(a.t.alias("t"), a.pos.alias("pos"), (a.n - b.n).alias("n"), a.d.bitwiseXOR(b.d).alias("d"), a.c.bitwiseXOR(b.c).alias("c")))


def peel_small(cells: Column) -> Column:
    """Number of digests in which two smallest sketches with the difference ``cells`` differ; null if it does not peel."""
    empty = lambda c: (c.n == 0) & (c.d == 0) & (c.c == 0)

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state.cells, lambda c: (F.abs(c.n) == 1) & (c.c == check(c.d)))
        spots = lambda p: F.array(*[position(p.d, t, CELLS) for t in range(TABLES)])

        def without(found: Column) -> Column:
            at = F.transform(F.array(found), lambda p: F.struct(p.n.alias("n"), p.d.alias("d"), p.c.alias("c"), spots(p).alias("spots")))
            return F.transform(at, lambda p: F.struct(
                F.transform(state.cells, lambda c: F.when(c.pos == p.spots[c.t], F.struct(
                    c.t.alias("t"), c.pos.alias("pos"), (c.n - p.n).alias("n"), c.d.bitwiseXOR(p.d).alias("d"), c.c.bitwiseXOR(p.c).alias("c"),
                )).otherwise(c)).alias("cells"),
                (state.found + 1).alias("found"),
            ))[0]

        return F.transform(F.array(pure), lambda p: F.when(F.size(p) > 0, without(p[0])).otherwise(state))[0]

    steps = F.sequence(F.lit(1), F.lit(TABLES * CELLS))
    start = F.struct(cells.alias("cells"), F.lit(0).cast("long").alias("found"))
    return F.aggregate(steps, start, step, lambda s: F.when(F.forall(s.cells, empty), s.found))


def following(docs: DataFrame, ranges: int = RANGES, part_rows: int = ROWS) -> DataFrame:
    """``docs`` (doc_id, text) with ``range`` and ``next_text``: the text of the next row in descending doc_id, after the last the first.

    Rows with equal ids are ordered by their texts' hashes; null ids come last. ``range`` numbers the
    parts of the id ranges, ascending. A row's successor is in its own part, but for the last row of
    a part: that one joins the first row of the part below.
    """
    bounds, part = id_parts(docs, ranges, part_rows)
    width = 1 << 32
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), (id_bucket(bounds).cast("long") * width + part).alias("range"))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    group = F.shiftright("range", 32)
    lowest = rows.groupBy(group.alias("g")).agg(F.min("range").alias("low")).orderBy(F.desc("g")).collect()  # one row per range
    if not lowest:
        return rows.withColumn("next_text", F.col("text"))
    above = {b.g: a.low for a, b in zip(lowest, lowest[1:], strict=False)} | {lowest[0].g: lowest[-1].low}
    to = F.create_map(*[F.lit(x).cast("long") for pair in above.items() for x in pair])
    heads = rows.withColumn("k", F.row_number().over(order)).where("k = 1")
    higher = F.lag("range").over(Window.partitionBy(group).orderBy(F.desc("range")))
    heads = heads.select(F.coalesce(higher, to[group]).alias("range"), F.col("text").alias("head"))
    led = rows.withColumn("next_text", F.lead("text").over(order)).alias("r")
    h = heads.alias("h")
    joined = led.join(h, (F.col("r.range") == F.col("h.range")) & F.col("r.next_text").isNull(), "left")
    return joined.select("r.doc_id", "r.text", "r.range", F.coalesce("r.next_text", "h.head").alias("next_text"))


def peel(pairs: DataFrame, turns: int = TURNS) -> DataFrame:
    """Peel the differences of sketches.

    ``pairs``: range, rid, cmp, cells and the digest arrays ``one`` and ``two``. Returns range, rid,
    cmp, differing (digests recovered) and left (cells that did not empty); no row where all digests
    cancel at once.
    """
    key = ["range", "rid", "cmp", "cells", "t", "pos"]

    def added(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*key).agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
        return out.where("t = -1 or n <> 0 or d <> 0 or c <> 0")

    entries = F.concat(F.transform("one", lambda d: F.struct(d.alias("d"), F.lit(1).cast("long").alias("n"))), F.transform("two", lambda d: F.struct(d.alias("d"), F.lit(-1).cast("long").alias("n"))))
    each = pairs.select("range", "rid", "cmp", "cells", F.inline(entries))
    spots = F.array(*[F.struct(F.lit(t).alias("t"), position(F.col("d"), t, F.col("cells")).alias("pos")) for t in range(TABLES)])
    cells = added(each.select("range", "rid", "cmp", "cells", "n", "d", check(F.col("d")).alias("c"), F.inline(spots)))
    for turn in range(turns):
        t = turn % TABLES
        pure = (F.col("t") == t) & (F.abs("n") == 1) & (F.col("c") == check(F.col("d")))
        zero = F.lit(0).cast("long")
        cell = lambda t, pos, n, d, c: F.struct(t.alias("t"), pos.alias("pos"), n.alias("n"), d.alias("d"), c.alias("c"))
        gone = [cell(F.lit(o), position(F.col("d"), o, F.col("cells")), -F.col("n"), F.col("d"), F.col("c")) for o in range(TABLES) if o != t]
        seen = cell(F.lit(-1), zero, F.lit(1).cast("long"), zero, zero)
        same = cell(F.col("t"), F.col("pos"), F.col("n"), F.col("d"), F.col("c"))
        moved = cells.select("range", "rid", "cmp", "cells", F.inline(F.when(pure, F.array(*gone, seen)).otherwise(F.array(same))))
        cells = added(moved)
    return cells.groupBy("range", "rid", "cmp").agg(
        F.sum(F.when(F.col("t") == -1, F.col("n")).otherwise(0)).alias("differing"), F.count_if(F.col("t") >= 0).alias("left"),
    )


def power_of_two(n: Column) -> Column:
    """Smallest power of two from 4 on that is at least ``n``."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(4))))).cast("long")


def expected_difference(one: Column, two: Column) -> Column:
    """At most so many digests differ."""
    return F.size(one) + F.size(two)


def first_size(differing: Column) -> Column:
    """Cells of a subtable at first: few filled cells are written or grouped, however many there are."""
    return power_of_two(differing + 2 * CELLS)


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Likeness is the Jaccard share of the digests: (sizes - differing) / (sizes + differing), 1 if
    neither text has a paragraph. Null texts are empty; an only row follows itself; repeated rows and
    null ids each keep their row; an empty table gives no rows; other columns are left out. The table of
    digests stays in the shared folder, since the result reads it.
    """
    spark = docs.sparkSession
    n = F.char_length("text")
    taken = F.expr("char_length(text) div 3").cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - taken), F.substr("next_text", F.lit(1), taken))
    rows = following(docs).select(
        "range", "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"),
        digests(F.col("text")).alias("own"), digests(F.col("next_text")).alias("next"),
    )
    rows = rows.select("range", F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("edit"), "next")
    rows = rows.withColumns({"a": sketch(F.col("own")), "b": sketch(F.col("edit")), "c": sketch(F.col("next"))})
    rows = rows.select(
        "range", "rid", "doc_id", "n_chars", "edited_sha256", "own", "edit", "next",
        peel_small(subtract(F.col("a"), F.col("b"))).alias("d1"), peel_small(subtract(F.col("a"), F.col("c"))).alias("d2"),
    )
    name = f"iblt_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").bucketBy(parts, "range").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    rows = spark.table(name)

    # 1 and 2 compare two texts, where the smallest sketches did not peel; 3 and 4 peel a fingerprint alone
    none = F.array().cast("array<bigint>")
    tried = ((1, "own", F.col("edit"), F.col("d1")), (2, "own", F.col("next"), F.col("d2")), (3, "own", none, F.lit(None)), (4, "edit", none, F.lit(None)))
    each = F.array(*[F.struct(F.lit(k).alias("cmp"), F.col(one).alias("one"), two.alias("two"), d.cast("long").alias("d")) for k, one, two, d in tried])
    pairs = rows.select("range", "rid", F.inline(F.filter(each, lambda x: x.d.isNull())))
    first = first_size(expected_difference(F.col("one"), F.col("two")))
    done, todo, grown = [], pairs, 1
    while todo is not None:
        # where all digests cancel, no cell is left to report: such a comparison differs in nothing
        out = cut(peel(todo.withColumn("cells", first * grown)), "iblt-peeled")
        done.append(out.where("left = 0").select("range", "rid", "cmp", "differing", F.lit(grown).alias("grown")))
        failed = out.where("left > 0").select("range", "rid", "cmp")
        todo = pairs.join(failed, ["range", "rid", "cmp"]) if failed.limit(1).count() else None
        grown *= GROW
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = found.groupBy("range", "rid").agg(
        *[F.max(F.when(F.col("cmp") == k, F.col("differing"))).alias(f"more{k}") for k in (1, 2)],
        *[F.max(F.when(F.col("cmp") == k, F.col("grown"))).alias(f"grown{k}") for k in (3, 4)],
    )

    def share(other: str, k: int) -> Column:
        total, differing = F.size("own") + F.size(other), F.coalesce(f"d{k}", f"more{k}", F.lit(0))
        return F.when(total == 0, F.lit(1.0)).otherwise((total - differing) / (total + differing))

    def size(found: str, k: int) -> Column:
        return first_size(expected_difference(F.col(found), none)) * F.coalesce(f"grown{k}", F.lit(1))

    judged = rows.join(found, ["range", "rid"], "left").select(
        "range", "rid", "own", "edit", size("own", 3).alias("own_cells"), size("edit", 4).alias("edit_cells"),
        F.struct("doc_id", "n_chars", "edited_sha256", share("edit", 1).alias("near_edited"), share("next", 2).alias("near_next"), size("own", 3).alias("own_cells"), size("edit", 4).alias("edit_cells")).alias("head"),
    )
    return with_fingerprints(judged)


def with_fingerprints(judged: DataFrame) -> DataFrame:
    """Both fingerprints of each row, and the columns of its ``head``.

    A row's head goes beside its digests through the grouping of cells (as a part of the key that is
    null for cells), so no fingerprint is joined or shuffled.
    """
    zero = F.lit(0).cast("long")
    nothing = F.lit(None).cast(judged.schema["head"].dataType)
    entry = lambda head, side, cells, d: F.struct(head.alias("head"), F.lit(side).alias("side"), cells.alias("cells"), d.alias("d"))
    of_side = lambda side, name: F.transform(name, lambda d: entry(nothing, side, F.col(f"{name}_cells"), d))
    sides = of_side(1, "own"), of_side(2, "edit")
    entries = judged.select("range", "rid", F.inline(F.concat(F.array(entry(F.col("head"), 0, zero, zero)), *sides)))
    at = lambda t: (F.lit(t) * F.col("cells") + position(F.col("d"), t, F.col("cells"))).alias("at")
    spots = F.when(F.col("side") == 0, F.array(zero)).otherwise(F.array(*[at(t) for t in range(TABLES)]))
    cells = entries.select("range", "rid", "head", "side", "d", check(F.col("d")).alias("c"), F.explode(spots).alias("at"))
    cells = cells.groupBy("range", "rid", "head", "side", "at").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("at", "n", "d", "c")))
    whole = cells.groupBy("range", "rid").agg(F.first("head", ignorenulls=True).alias("head"), of(1).alias("own"), of(2).alias("edit"))
    return whole.select(
        "head.doc_id", "head.n_chars", "head.edited_sha256", written(F.col("own"), F.col("head.own_cells")).alias("fingerprint"),
        written(F.col("edit"), F.col("head.edit_cells")).alias("edited_fingerprint"), "head.near_edited", "head.near_next",
    )
