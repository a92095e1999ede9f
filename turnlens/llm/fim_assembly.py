"""Fill-in-the-middle transformation by secondary sort.

Each text is cut into lines and these into prefix, middle and suffix at two seeded borders. The sections
leave as pieces of a bounded number of bytes, each keyed by its row and its place in the output; one
exchange on the row with a sort inside partitions on (row, place) brings them into output order, where they
stream through an incremental digest. Restoration reads the same stream as a reader of the output would:
the marker pieces and the form tell the section of each piece; a second sort inside the partitions on (row,
section, place) brings the text into its first order, and another incremental digest reads that. No task
puts a whole text together again: it holds one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import pieces

#: Bytes of a piece: bounds what the digests hold of a text.
PIECE = 64 << 10
PREFIX, MIDDLE, SUFFIX = range(3)
#: What stands before each section.
MARKS = (b"<P>", b"<M>", b"<S>")
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
FIELDS = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
#: ``lead`` is the place of a row's first piece in either order, which carries the facts of the row.
PIECES = f"row long, place long, section int, {HEAD}, bytes binary"
ASSEMBLED = f"row long, section int, place long, {HEAD}, output_sha256 string, bytes binary"
RESTORED = f"{HEAD}, output_sha256 string, restored_sha256 string"


def code_points(part: np.ndarray) -> int:
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def sections(text: bytes, draw: list[int], fim_rate: int, spm_rate: int) -> tuple[int, str, tuple[int, int]]:
    """Number of lines, form, and the bytes where middle and suffix begin (both 0 in the plain form)."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if len(text) and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    n = len(ends)
    if not n or any(m in text for m in MARKS) or draw[2] % 100 >= fim_rate:
        return n, "plain", (0, 0)
    at = [0, *ends.tolist()] if n < 64 else np.concatenate([[0], ends])
    low, high = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    return n, "spm" if draw[3] % 100 < spm_rate else "psm", (int(at[low]), int(at[high]))


def emit(docs: DataFrame, seed: int, fim_rate: int, spm_rate: int) -> DataFrame:
    """The pieces of every row, markers among them; a row without bytes has one empty piece."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in pieces(batches, 64):
            out: dict[str, list] = {c: [] for c in ("row", "place", "section", *FIELDS, "bytes")}
            for row, doc_id, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, form, (low, high) = sections(text, [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)], fim_rate, spm_rate)
                spans = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, len(text))}
                chars = [None, None] if form == "plain" else [code_points(np.frombuffer(text[slice(*spans[s])], np.uint8)) for s in (PREFIX, MIDDLE)]
                parts: list[tuple[int, bytes]] = []
                for s in ORDERS.get(form, (PREFIX,)):
                    start, end = (0, len(text)) if form == "plain" else spans[s]
                    if form != "plain":
                        parts.append((-1, MARKS[s]))
                    parts += [(s, text[k : min(k + PIECE, end)]) for k in range(start, end, PIECE)]
                for place, (s, data) in enumerate(parts or [(PREFIX, b"")]):
                    first = (doc_id, n, form, *chars) if not place else (None,) * len(FIELDS)
                    for c, v in zip(out, (row, place, s, *first, data), strict=True):
                        out[c].append(v)
            schema = schema or pa.schema([("row", pa.int64()), ("place", pa.int64()), ("section", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("bytes", pa.binary())])
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return rows.mapInArrow(run, PIECES)


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order: the digest of each output, and its pieces with the section that the markers give them.

    The sections found here come from the bytes and the form alone, not from what the emitting side knew.
    """
    schema = pa.schema([("row", pa.int64()), ("section", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("bytes", pa.binary())])
    now, head, digest, section = None, None, None, PREFIX
    for b in pieces(batches, 1024):
        out: dict[str, list] = {f.name: [] for f in schema}

        def add(*values) -> None:
            for c, v in zip(out, values, strict=True):  # noqa: B023
                out[c].append(v)  # noqa: B023

        for row, place, _, *facts, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row != now:
                if now is not None:
                    add(now, -1, 0, *head, digest.hexdigest(), b"")
                now, head, digest, section = row, facts, hashlib.sha256(), PREFIX
            digest.update(data)
            if head[2] != "plain" and data in MARKS:
                section = MARKS.index(data)
            else:
                add(row, section, place, *(None,) * 5, None, data)
        yield pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)
    if now is not None:
        yield pa.record_batch([pa.array([v], f.type) for f, v in zip(schema, (now, -1, 0, *head, digest.hexdigest(), b""), strict=True)], schema=schema)


def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the text, the facts of each row first: one row with both digests for each."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    now, head, digest = None, None, None
    for b in pieces(batches, 1024):
        done = []
        for row, section, _, *facts, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row != now:
                if now is not None:
                    done.append((*head, digest.hexdigest()))
                now, digest = row, hashlib.sha256()
            if section < 0:
                head = facts
            digest.update(data)
        yield pa.record_batch([pa.array([r[k] for r in done], f.type) for k, f in enumerate(schema)], schema=schema)
    if now is not None:
        yield pa.record_batch([pa.array([v], f.type) for f, v in zip(schema, (*head, digest.hexdigest()), strict=True)], schema=schema)


def in_order(docs: DataFrame, seed: int, fim_rate: int, spm_rate: int) -> DataFrame:
    """The pieces of the output of every row, in order inside their partitions: the output itself, as a stream of bytes."""
    return emit(docs, seed, fim_rate, spm_rate).repartition("row").sortWithinPartitions("row", "place")


def outputs(docs: DataFrame, seed: int = 7, fim_rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(row, doc_id, form, place, bytes): the transformed texts in pieces of at most ``PIECE`` bytes, ready to be written in their order."""
    return in_order(docs, seed, fim_rate, spm_rate).select("row", "doc_id", "form", "place", "bytes")


def transform(docs: DataFrame, seed: int = 7, fim_rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of ``docs`` (doc_id, text, others ignored).

    Null texts count as empty and are plain; null ids draw from the seed alone; repeated rows each
    keep their own row; an empty table gives none. A text of any length is cut into pieces when it is read.
    Lines end after a line feed only. The two character counts are null in the plain form.
    """
    out = in_order(docs, seed, fim_rate, spm_rate).mapInArrow(assembled, ASSEMBLED)
    return out.sortWithinPartitions("row", "section", "place").mapInArrow(restored, RESTORED)
