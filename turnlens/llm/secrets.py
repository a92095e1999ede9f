"""Secret scans with multipart credential linking (DataFrame and SQL functions only).

Base spans are found by three patterns. Weak parts (short access identifiers, long opaque strings,
endpoints) are reported only where complementary parts lie within ``SCOPE`` code points: an interval
join inside the text, of each weak part with the nearest identifier and the nearest secret on either
side. The join is two running folds over the parts in order, so it is linear in the parts, lists no
pairs and shuffles nothing: a text is read once, in its own row.

All patterns are linear: no repeated groups, no look-around, and runs whose end is uncertain have a
bounded length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import whole_text

# The base patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Weak parts: a cut access identifier (a whole run of letters and digits), a run of base64 letters with
#: three kinds of them, an endpoint (a host name has at most 253 characters).
WEAK_ID, CUT_ACCESS = "[A-Za-z0-9]{12,}", "^AKIA[A-Z0-9]{8,13}$"
WEAK_SECRET, CLASSES = "[A-Za-z0-9+/_=-]{20,}", ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"https?://[A-Za-z0-9./:_-]+|[a-z0-9][a-z0-9.-]{0,252}\.(?:com|net|org|io|dev|cloud)[:/][A-Za-z0-9./:_-]*"

#: Code points from the end of one part of a credential to the start of the next.
SCOPE = 300
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Items that a running fold copies at most at once.
FOLD = 128


def none() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """State after each of ``items``: a fold that keeps what it passes, block by block so that no long array is copied at each item."""
    last = lambda a: F.element_at(a, F.lit(-1))
    all_ = lambda a, n: F.slice(a, F.lit(2), n)

    def fold(items: Column) -> Column:
        def block(done: Column, k: Column) -> Column:
            some = F.slice(items, k * FOLD + 1, F.lit(FOLD))
            states = F.aggregate(some, F.array(last(last(done))), lambda out, x: F.concat(out, F.array(step(last(out), x))), lambda out: all_(out, F.lit(FOLD)))
            return F.concat(done, F.array(states))

        blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int"))
        folded = F.aggregate(blocks, F.array(F.array(zero)), block, lambda done: F.flatten(all_(done, F.size(done))))
        return F.when(F.size(items) > 0, folded)

    return let(items, fold)


def matches(text: Column, pattern: str, kind: int, size: Callable[[Column], Column] | None = None, least: int = 0, values: Column | None = None, worth: Column | None = None) -> Column:
    """Spans (start, kind, end) in code points of the leftmost non-overlapping matches.

    The pieces between the matches and the matches themselves are measured. ``size`` of the match (or of
    its one of ``values``) must reach ``least``; ``worth`` says whether the text need be searched at all.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), (F.array() if values is None else values).alias("value"))
    # behind the last match there is a piece without one
    keep = lambda x: x.found.isNotNull() & (F.lit(True) if size is None else size(x.found if values is None else x.value) >= least)
    pieces = F.transform(zipped, lambda x: F.struct(F.char_length(x.gap).alias("gap"), F.coalesce(F.char_length(x.found), F.lit(0)).alias("len"), keep(x).alias("keep")))
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("keep"))
    spans = running(pieces, zero, lambda at, p: F.struct((at.end + p.gap).alias("start"), (at.end + p.gap + p.len).alias("end"), p.keep.alias("keep")))
    spans = F.transform(F.filter(spans, lambda s: s.keep), lambda s: F.struct(s.start, F.lit(kind).alias("kind"), s.end))
    hit = text.rlike(pattern) if worth is None else worth & text.rlike(pattern)
    return F.when(hit, spans).otherwise(none())


def nearest(parts: Column, groups: dict[str, tuple[int, ...]]) -> Column:
    """Structs of the sorted ``parts``: ``part``, and of each group the parts that end last and start first, on either side.

    ``<name>_left`` is of the parts up to this one in order, ``<name>_right`` of those from it on; null where there is none.
    """
    span = "struct<start:int,kind:int,end:int>"
    empty = F.struct(*[F.lit(None).cast(span).alias(name) for name in groups])

    def step(better: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        return lambda state, x: F.struct(*[
            F.when(x.kind.isin(*kinds) & (state[name].isNull() | better(x, state[name])), x).otherwise(state[name]).alias(name) for name, kinds in groups.items()
        ])

    left = running(parts, empty, step(lambda x, y: x.end > y.end))
    right = F.reverse(running(F.reverse(parts), empty, step(lambda x, y: x.start <= y.start)))
    return F.transform(F.arrays_zip(parts.alias("part"), left.alias("left"), right.alias("right")), lambda x: F.struct(
        x.part.alias("part"), *[y for name in groups for y in (x.left[name].alias(f"{name}_left"), x.right[name].alias(f"{name}_right"))],
    ))


def partner(x: Column, name: str, scope: int) -> Column:
    """The nearer of the two parts of a group, if it is within ``scope``; the left one in a tie."""
    left, right = x[f"{name}_left"], x[f"{name}_right"]
    a, b = F.greatest(x.part.start - left.end, F.lit(0)), F.greatest(right.start - x.part.end, F.lit(0))
    # greatest skips nulls, so a missing part needs a test of its own
    a, b = F.when(left.isNotNull(), a), F.when(right.isNotNull(), b)
    return F.when((a <= scope) & (b.isNull() | (a <= b)), left).when(b <= scope, right)


def linked(base: Column, weak: Column, scope: int) -> Column:
    """(start, kind, end, id, secret) of the ``weak`` parts outside ``base`` spans that have what their kind needs within ``scope``."""
    near_base = let(F.array_sort(F.concat(base, weak)), lambda parts: nearest(parts, {"base": (0, 1, 2)}))
    inside = lambda x: F.coalesce(x.base_left.end > x.part.start, F.lit(False)) | F.coalesce(x.base_right.start < x.part.end, F.lit(False))
    parts = F.transform(F.filter(near_base, lambda x: (x.part.kind < 3) | ~inside(x)), lambda x: x.part)
    near = let(parts, lambda parts: nearest(parts, {"id": (1, 3), "secret": (0, 2, 4)}))
    found = F.transform(near, lambda x: F.struct(
        x.part.start.alias("start"), x.part.kind.alias("kind"), x.part.end.alias("end"),
        F.when(x.part.kind != 3, partner(x, "id", scope)).alias("id"), F.when(x.part.kind != 4, partner(x, "secret", scope)).alias("secret"),
    ))
    has_all = lambda x: (x.kind == 3) & x.secret.isNotNull() | (x.kind == 4) & x.id.isNotNull() | (x.kind == 5) & x.id.isNotNull() & x.secret.isNotNull()
    return F.filter(found, has_all)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``base``, ``spans`` and ``credentials``, which replace columns of these names.

    ``base`` and ``spans`` are arrays of (start, kind, end), kind being an index of ``KINDS``;
    ``credentials`` holds each reported weak part with the identifier and the secret that it belongs to:
    (start, kind, end, id, secret). A weak identifier needs a secret in scope, a weak secret an
    identifier, an endpoint both; weak parts that overlap a base span are left out. Null texts are
    empty; a text without secrets has empty arrays; every row is scanned by itself, so null ids and
    repeated rows keep their row; an empty table gives no rows.
    """
    text = whole_text()
    access = text.contains("AKIA")  # without an identifier no weak part is reported
    base = F.array_sort(F.concat(
        matches(text, ASSIGN, 0, F.char_length, LEAST["assign"], F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))),
        # a run of the class is one match, so its least length can stand in the pattern
        matches(text, rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 1, worth=access),
        matches(text, rf"[0-9a-f]{{{LEAST['hex']},}}", 2),
    ))
    kinds = lambda x: sum(x.rlike(c).cast("int") for c in CLASSES)
    cut = lambda x: x.rlike(CUT_ACCESS).cast("int")
    weak = F.concat(matches(text, WEAK_ID, 3, cut, 1, worth=access), matches(text, WEAK_SECRET, 4, kinds, 3, worth=access), matches(text, ENDPOINT, 5, worth=access))
    span = "struct<start:int,kind:int,end:int>"
    nothing = F.array().cast(f"array<struct<start:int,kind:int,end:int,id:{span},secret:{span}>>")
    found = let(F.struct(base.alias("base"), F.when(access, weak).otherwise(none()).alias("weak")), lambda x: F.struct(
        x.base.alias("base"), F.when(F.size(x.weak) > 0, linked(x.base, x.weak, scope)).otherwise(nothing).alias("credentials"),
    ))
    done = docs.drop("base", "spans", "credentials").withColumn("_found", found)
    spans = F.array_sort(F.concat("_found.base", F.transform("_found.credentials", lambda c: F.struct(c.start, c.kind, c.end))))
    return done.withColumns({"base": F.col("_found.base"), "spans": spans, "credentials": F.col("_found.credentials")}).drop("_found")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every run of overlapping spans (in order) replaced by a mark; null stays null."""
    mark = "[SECRET]"

    def pieces(spans: Column) -> Column:
        """(from, to, reach): the text in front of each span and how far the spans have come with it; from > to inside a run."""
        zero = F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(0).alias("reach"))
        return running(spans, zero, lambda at, s: F.struct(at.reach.alias("from"), s.start.alias("to"), F.greatest(at.reach, s.end).alias("reach")))

    def written(pieces: Column) -> Column:
        # a block's stretch of the text is taken out first, since every substring counts from the start
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / FOLD).cast("int"))
        slices = F.transform(numbers, lambda k: F.slice(pieces, k * FOLD + 1, F.lit(FOLD)))
        first, last = (lambda b: b[0]["from"]), (lambda b: F.element_at(b, F.lit(-1)).reach)
        stretches = F.transform(slices, lambda b: F.struct(b.alias("pieces"), F.substr(text, first(b) + 1, last(b) - first(b)).alias("text")))
        one = lambda x, p: F.concat(F.substr(x.text, p["from"] - first(x.pieces) + 1, p.to - p["from"]), F.lit(mark))
        joined = F.transform(stretches, lambda x: F.array_join(F.transform(x.pieces, lambda p: F.when(p["from"] <= p.to, one(x, p)).otherwise("")), ""))
        return F.concat(F.array_join(joined, ""), F.substr(text, last(pieces) + 1))

    return F.when(F.size(spans) > 0, let(pieces(spans), written)).otherwise(text)
