"""Reading JSON lines as VARIANT: a value counts only if it has the type asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def string(v: Column, path: str) -> Column:
    """The string there; null for values of other types."""
    return F.when(kind(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def number(v: Column, path: str) -> Column:
    """The whole number of at least 0 there."""
    n = F.when(kind(at(v, path)) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.when(n >= 0, n)


def boolean(v: Column, path: str) -> Column:
    return F.coalesce(F.when(kind(at(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


def items(v: Column, path: str) -> Column:
    """The array there; empty if there is none."""
    return F.coalesce(F.when(kind(at(v, path)).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))


def time(v: Column, path: str) -> Column:
    """An RFC 3339 time; null for anything else."""
    text = string(v, path)
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` with ``v``; null: malformed."""
    return lines.withColumn("v", F.try_parse_json(F.regexp_replace("value", r"(?U)^\ufeff|^\s+|\s+$", "")))


def line_order() -> Window:
    return Window.partitionBy("file_path").orderBy("line_number")
