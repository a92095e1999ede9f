"""Line source of session logs: numbered lines, dialect of each file, JSON export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER_BYTES = 2048

# Marks of the dialects, in order; the first rule that fits wins.
CLAUDE, ANTIGRAVITY, CODEX, OPENCODE = "ClaudeCode", "Antigravity", "Codex", "OpenCode"
RULES = (
    (CLAUDE, ('"sessionId"', '"parentUuid"'), ()),
    (ANTIGRAVITY, ('"step_index"',), ('"source":"USER_EXPLICIT"', '"source":"MODEL"', '"PLANNER_RESPONSE"')),
    (CODEX, (), ('"type":"event_msg"', '"type":"response_item"', '"type":"session_meta"')),
    (OPENCODE, (), ('"action":"run"', '"action": "run"', '"observation":', '"action":"message"')),
)


BLANK = r"(?U)^\s*$"


def number_lines(rows: DataFrame, order: list[str], block: str | None = None) -> DataFrame:
    """(file_path, line_number, byte_offset, value) of ``rows`` (file_path, value, order columns).

    Offsets add up bytes and one line feed per earlier line, so a carriage return at a line's end,
    which is stripped, is not counted. Blank lines are numbered and then left out. With ``block``, a column that
    grows along a file, lines are numbered inside their block only, and the lines and bytes of
    the blocks before, summed in a pass of their own, are added: a file of any size is spread over its blocks.
    """
    rows = rows.withColumn("value", F.regexp_replace("value", r"\r$", ""))
    size = F.octet_length("value") + 1
    key = ["file_path"] if block is None else ["file_path", block]
    w = Window.partitionBy(*key).orderBy(*order)
    number, offset = F.row_number().over(w).cast("long"), F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = rows.select(*key, number.alias("line_number"), offset.alias("byte_offset"), "value").where(~F.col("value").rlike(BLANK))
    if block is None:
        return placed
    totals = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    earlier = Window.partitionBy("file_path").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # of a file's blocks, not lines
    before = totals.select(*key, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")])
    found = placed.join(before, key)
    return found.select("file_path", (F.col("line_number") + F.col("n_before")).alias("line_number"), (F.col("byte_offset") + F.col("bytes_before")).alias("byte_offset"), "value")


def text_lines(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(file_path, block, id, value): lines as read; ``id`` ascends inside a block, which is what one task reads of a file."""
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", names).text(path)
    return text.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def read_lines(spark: SparkSession, path: str, names: str = "*.jsonl") -> DataFrame:
    """Lines of a file or of the files called ``names`` directly in a directory, in file order."""
    return number_lines(text_lines(spark, path, names), ["id"], "block")


def read_fingerprints(spark: SparkSession, path: str, names: str = "*.jsonl") -> DataFrame:
    """(file_path, dialect) of the files of a directory without numbering them: of each, the first lines of the first block are kept.

    A line has one byte at least, so no more than ``HEADER_BYTES`` lines can begin in the header.
    """
    first = Window.partitionBy("file_path").orderBy("id")
    rows = text_lines(spark, path, names).where("block = 0").select("file_path", "id", F.substr(F.regexp_replace("value", r"\r$", ""), F.lit(1), F.lit(HEADER_BYTES)).alias("value"))
    rows = rows.withColumn("line_number", F.row_number().over(first)).where(F.col("line_number") <= HEADER_BYTES)
    earlier = first.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("value") + 1).over(earlier), F.lit(0)))
    return fingerprints(rows.where(~F.col("value").rlike(BLANK)))


def dialect(header: Column) -> Column:
    out = None
    for name, every, some in RULES:
        fits = [F.contains(header, F.lit(m)) for m in every]
        if some:
            any_of = F.contains(header, F.lit(some[0]))
            for m in some[1:]:
                any_of |= F.contains(header, F.lit(m))
            fits.append(any_of)
        whole = fits[0]
        for f in fits[1:]:
            whole &= f
        out = F.when(whole, name) if out is None else out.when(whole, name)
    return out


def fingerprints(lines: DataFrame) -> DataFrame:
    """(file_path, dialect) from the first ``HEADER_BYTES`` bytes of each file; null if no rule fits."""
    head = lines.where(F.col("byte_offset") < HEADER_BYTES).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line_number", F.substr("value", F.lit(1), F.lit(HEADER_BYTES)).alias("value")))).alias("h"))
    text = F.array_join(F.transform("h", lambda x: x["value"]), "\n")
    cut = F.try_validate_utf8(F.substr(text.cast("binary"), F.lit(1), F.lit(HEADER_BYTES)).cast("string"))
    return head.select("file_path", dialect(F.coalesce(cut, F.substr(text, F.lit(1), F.lit(HEADER_BYTES)))).alias("dialect"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document per row, for export."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
