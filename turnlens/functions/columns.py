"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def in_order() -> WindowSpec:
    """The turns of a session in order; every ordered operator uses this one partitioning."""
    return Window.partitionBy("session_key").orderBy("turn_index")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def prompt_tokens(usage: str = "usage") -> Column:
    return F.col(f"{usage}.input_tokens") + F.col(f"{usage}.cache_creation_tokens") + F.col(f"{usage}.cache_read_tokens")


def total_tokens(usage: str = "usage") -> Column:
    """Prompt and output tokens; reasoning tokens are not part of it."""
    return prompt_tokens(usage) + F.col(f"{usage}.output_tokens")


def has_error(results: str = "tool_results") -> Column:
    return F.coalesce(F.exists(results, lambda r: r.is_error), F.lit(False))


def n_items(array: str) -> Column:
    return F.coalesce(F.size(array), F.lit(0)).cast("long")


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole as double; ``empty`` where there is no whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(empty)).otherwise(part.cast("double") / whole.cast("double"))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def redacted(command: Column) -> Column:
    """The binary and the flags of a command line; other words are masked."""
    words = F.split(trimmed(command), r"\s+")
    masked = F.transform(words, lambda w, i: F.when((i == 0) | w.startswith("-"), F.regexp_replace(w, "=.*$", "=[REDACTED]")).otherwise(F.lit("[REDACTED]")))
    return F.array_join(masked, " ")


def salted_hash(identity: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), identity), 256)


def line_count(text: Column) -> Column:
    """Number of lines; a final line feed opens none."""
    feeds = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")
