"""Loading sessions of any dialect, and linking child sessions to their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.sources.adapters import Parsed, parse
from turnlens.sources.lines import fingerprints

SUBAGENT = r"^(.*)/subagents/([^/]+)\.jsonl$"


def load(lines: DataFrame, dialects: DataFrame | None = None) -> Parsed:
    """Turns, failures and sessions of all files; a file of no known dialect becomes one failure at line 0.

    ``dialects`` (file_path, dialect) may come from ``read_fingerprints``; else the numbered lines tell them.
    """
    marked = lines.join(fingerprints(lines) if dialects is None else dialects, "file_path")
    known = parse(marked)
    zero = F.lit(0).cast("long")
    unknown = marked.where("dialect is null").groupBy("file_path").agg(zero.alias("line_number"), zero.alias("byte_offset"), F.lit("unknown dialect").alias("error"))
    return Parsed(known.turns, known.failures.unionByName(unknown), known.sessions)


def link_subagents(sessions: DataFrame) -> DataFrame:
    """``sessions`` with parent_session_id and subagent_role of files in ``subagents`` beside a parent file."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]+$", 1)
    child = sessions.withColumn("parent_dir", F.nullif(F.regexp_extract("file_path", SUBAGENT, 1), F.lit(""))).withColumn("subagent_role", F.nullif(F.regexp_extract("file_path", SUBAGENT, 2), F.lit("")))
    parents = child.where("parent_dir is null").groupBy(folder(F.col("file_path")).alias("parent_dir")).agg(F.min_by("session_id", "file_path").alias("parent_session_id"))
    return child.join(parents, "parent_dir", "left").drop("parent_dir")
