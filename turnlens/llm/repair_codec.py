"""Token-id files with Re-Pair grammar compression.

Documents go to ``BUCKETS`` id ranges with parts of about ``ROWS`` rows, sorted by doc_id; each part is
written as segments of about ``SEGMENT`` ids, in order. A segment is one shard of the grammar: in rounds, until no
pair of neighbouring symbols stands ``LEAST`` times, such pairs become nonterminals and replace their
occurrences, the more frequent of overlapping pairs first. Stored are the rules, the expansion length of every
rule, the remaining symbols and where each document starts, so any document can be decoded without the others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm.common import cut, id_bucket, id_parts

BUCKETS, ROWS, SEGMENT = 128, 4_000, 1_000_000
#: A pair becomes a rule from so many occurrences in a segment on.
LEAST = 24
MAGIC = 0x52455031
#: Bytes of text whose distinct words a task encodes at once.
BLOCK = 32_000_000
#: A word of Latin letters that needs no normalizing but for its case, and marks behind it.
PLAIN = "^(?P<stem>[a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+)(?P<marks>[.,!?;:#*%$&@]*)$"


def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k stands for the nonterminal ``first + k`` and holds two earlier symbols."""
    s = ids.astype(np.int64)
    at = np.arange(max(0, len(s) - 1))  # places whose pair may be frequent: at first all
    rules: list[np.ndarray] = []
    total = 0
    while len(at):
        back, pair = pd.factorize(s[at] << 32 | s[at + 1])
        n = np.bincount(back)
        good = n[back] >= LEAST
        at, back = at[good], back[good]
        open_ = at
        # of overlapping pairs that are equally frequent, every second one is replaced
        new_run = np.ones(len(at), bool)
        new_run[1:] = (at[1:] != at[:-1] + 1) | (n[back[1:]] != n[back[:-1]])
        place = np.arange(len(at))
        second = (place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0
        at, back = at[second], back[second]
        # of others the more frequent one goes first; what is left comes back in the next round
        touch = at[1:] == at[:-1] + 1
        mine = n[back]
        take = np.ones(len(at), bool)
        take[1:] &= ~touch | (mine[1:] > mine[:-1])
        take[:-1] &= ~touch | (mine[:-1] >= mine[1:])
        at, back = at[take], back[take]
        used = np.bincount(back, minlength=len(pair))
        worth = used >= LEAST // 2
        at, back = at[worth[back]], back[worth[back]]
        if not len(at):
            break
        s[at] = first + total + (np.cumsum(worth) - 1)[back]
        rules.append(np.stack([pair[worth] >> 32, pair[worth] & 0xFFFFFFFF], axis=1))
        total += int(worth.sum())
        # only the touched neighbours and the frequent pairs not replaced yet can be frequent in the next round
        next_, keep = np.zeros(len(s), bool), np.ones(len(s), bool)
        next_[open_] = next_[at] = next_[np.maximum(at - 1, 0)] = True
        keep[at + 1] = False
        s, next_ = s[keep], next_[keep]
        at = np.flatnonzero(next_[:-1])
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)).astype("<u4"), s.astype("<u4")


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to."""
    out = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def pack(docs: list[int], counts: list[int], ids: np.ndarray, first: int) -> bytes:
    """Header, doc_ids and id counts of the documents, expansion lengths of the rules, rules, symbols."""
    rules, symbols = compress(ids, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    head = np.array([MAGIC, first, len(docs), len(rules), len(symbols), width], "<i8")
    short = [x.astype(f"<u{width}") for x in (rules, symbols)]
    return b"".join(x.tobytes() for x in (head, np.array(docs, "<i8"), np.array(counts, "<i8"), lengths(rules, first).astype("<i8"), *short))


class Segment:
    """Reader of one packed segment."""

    def __init__(self, blob: bytes) -> None:
        magic, self.first, n_docs, n_rules, n_symbols, width = np.frombuffer(blob, "<i8", 6).tolist()
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = 48
        self.docs, self.counts, self.lengths = (np.frombuffer(blob, "<i8", n, at + 8 * k) for k, n in ((0, n_docs), (n_docs, n_docs), (2 * n_docs, n_rules)))
        at += 8 * (2 * n_docs + n_rules)
        self.rules = np.frombuffer(blob, f"<u{width}", 2 * n_rules, at).reshape(-1, 2).astype("<u4")
        self.symbols = np.frombuffer(blob, f"<u{width}", n_symbols, at + 2 * width * n_rules).astype("<u4")
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        size = np.ones(n_symbols, np.int64)
        rule = self.symbols >= self.first
        size[rule] = self.lengths[self.symbols[rule] - self.first]
        self.ends = np.cumsum(size)
        self.known: list[np.ndarray] | None = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self.known is None:
            self.known = []
            for pair in self.rules.tolist():
                self.known.append(np.concatenate([self.known[x - self.first] if x >= self.first else np.array([x], "<u4") for x in pair]))
            self.flat = np.concatenate(self.known) if self.known else np.zeros(0, "<u4")
            self.begin = np.concatenate([[0], np.cumsum(self.lengths)])
        rule = symbols >= self.first
        size, source = np.ones(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        which = symbols[rule] - self.first
        size[rule], source[rule] = self.lengths[which], self.begin[which]
        out = np.repeat(symbols, size)
        within = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
        from_rule = np.repeat(rule, size)
        out[from_rule] = self.flat[(np.repeat(source, size) + within)[from_rule]]
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document alone."""
        lo, hi = int(self.starts[k]), int(self.starts[k + 1])
        if lo == hi:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(self.ends, lo, "right"), np.searchsorted(self.ends, hi, "left") + 1
        skip = lo - (int(self.ends[a - 1]) if a else 0)
        return self.expand(self.symbols[a:b])[skip : skip + hi - lo]

    def all(self) -> list[np.ndarray]:
        return np.split(self.expand(self.symbols), self.starts[1:-1]) if len(self.docs) else []


class WordEncoder:
    """Ids of words between blanks, each distinct word encoded once.

    The tokenizer must lower-case, end every token at a blank and drop it. Words of Latin letters with
    marks behind them are what its normalizer leaves alone but for case, and its splitter cuts where the
    marks begin: their letters go to the library's merge model, all other words whole to its encoder.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        if any(x.content.split() != [x.content] for x in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens with blanks would be cut apart")
        as_bytes = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [c for c in map(chr, [*range(97, 123), *range(0xDF, 0x100)]) if c != "÷"]
        spelled = {c: as_bytes(c)[0][0] for c in letters}
        self.spelled = str.maketrans(spelled | {c.upper(): x for c, x in spelled.items() if c not in "ßÿ"})

    def ids(self, stems: list[str], plain: list[bool], kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stems end to end, number of ids of each)."""
        merge, spelled = self.tokenizer.model.tokenize, self.spelled
        flat: list[int] = []
        sizes = []
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(stems, plain, strict=True) if not p], add_special_tokens=False))
        for w, p in zip(stems, plain, strict=True):
            some = [t.id for t in merge(w.translate(spelled))] if p else next(rest).ids
            flat += some
            sizes.append(len(some))
        return np.array(flat, kind), np.array(sizes, np.int64)

    def documents(self, texts: pa.Array, end_id: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ``texts`` end to end with ``end_id`` behind each, number of ids of each)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        in_text = np.diff(np.asarray(words.offsets))
        coded = words.flatten().dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, PLAIN)
        stems = pc.coalesce(pc.struct_field(cut, "stem"), coded.dictionary).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(cut, "marks"), "").dictionary_encode()
        plain = pc.match_substring_regex(stems.dictionary, PLAIN).to_pylist()
        a, many_a = self.ids(stems.dictionary.to_pylist(), plain, kind)
        b, many_b = self.ids(marks.dictionary.to_pylist(), [False] * len(marks.dictionary), kind)
        # the words of the dictionary out of stems and marks, then the texts out of these words
        two = np.stack([stems.indices.to_numpy(), marks.indices.to_numpy() + len(many_a)], axis=1).ravel()
        flat, many = gather(np.concatenate([a, b]), np.concatenate([many_a, many_b]), two)
        many = many.reshape(-1, 2).sum(axis=1)
        index = coded.indices.to_numpy()
        text = np.repeat(np.arange(len(in_text)), in_text)
        out = np.full(int(many[index].sum()) + len(in_text), end_id, kind)
        done = 0
        for k in range(0, len(index), 1_000_000):
            some, sizes = gather(flat, many, index[k : k + 1_000_000])
            out[done + np.arange(len(some)) + np.repeat(text[k : k + 1_000_000], sizes)] = some
            done += len(some)
        return out, np.bincount(text, many[index], len(in_text)).astype(np.int64) + 1


def gather(flat: np.ndarray, many: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``index`` of ``flat``, which holds pieces of ``many`` items each; and their sizes."""
    sizes = many[index]
    ends = np.cumsum(sizes)
    start = (np.cumsum(many) - many)[index]
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - sizes), sizes) + np.arange(total)], sizes


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, width: int = 4) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text), ``end_id`` appended; little-endian unsigned ids of ``width`` bytes.

    See ``WordEncoder`` for what the tokenizer must be like. Null and empty texts hold the end id alone.
    """
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)

        def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, many = encoder.documents(pa.chunked_array(whole.column(1)).combine_chunks(), end_id, kind)
            ends = np.concatenate([[0], np.cumsum(many) * width]).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            return pa.record_batch([pa.chunked_array(whole.column(0)).combine_chunks(), coded], names=["doc_id", "ids"])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= BLOCK:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def write(docs: DataFrame, tokenizer_path: str, end_id: int, first: int, rows: int = ROWS) -> DataFrame:
    """Write the id files of ``docs`` in ascending doc_id order; returns their segments (bucket, part, seq, n_ids, blob).

    ``first`` is above every id of the vocabulary. Null texts hold the end id alone; null doc_ids come
    first; repeated rows are all kept; an empty table writes no segment.
    """
    bounds, part = id_parts(docs, BUCKETS, rows)
    width = 2 if first <= 1 << 16 else 4
    coded = encode(docs, tokenizer_path, end_id, width).select(id_bucket(bounds).alias("bucket"), part.alias("part"), "doc_id", "ids")
    dealt = coded.repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segment(bucket: int, part: int, seq: int, held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), f"<u{width}")
            # a null doc_id is stored as the smallest long
            blob = pack([-(2**63) if d is None else d for d, _ in held], [len(x) // width for _, x in held], ids, first)
            return pa.record_batch([*(pa.array([v], pa.int32()) for v in (bucket, part, seq)), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "part", "seq", "n_ids", "blob"])

        now, seq, held, size = None, 0, [], 0
        for b in batches:
            for bucket, part, d, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and ((bucket, part) != now or size >= SEGMENT):
                    yield segment(*now, seq, held)
                    held, size, seq = [], 0, seq + 1
                if (bucket, part) != now:
                    now, seq = (bucket, part), 0
                held.append((d, x))
                size += len(x) // width
        if held:
            yield segment(*now, seq, held)

    return cut(dealt.mapInArrow(run, "bucket int, part int, seq int, n_ids long, blob binary"), "token-ids")


def read(segments: DataFrame) -> DataFrame:
    """(doc_id, start, ids) decoded from the segments; ``start`` counts the ids of all documents before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, part, seq, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Segment(blob)
                n = len(s.docs)
                docs = [None if d == -(2**63) else d for d in s.docs.tolist()]
                yield pa.record_batch([
                    *(pa.array([v] * n, pa.int32()) for v in (bucket, part, seq)), pa.array(docs, pa.int64()),
                    pa.array(s.starts[:-1]), pa.array([x.tobytes() for x in s.all()], pa.binary()),
                ], names=["bucket", "part", "seq", "doc_id", "within", "ids"])

    return segments.select("bucket", "part", "seq", "blob").mapInArrow(run, "bucket int, part int, seq int, doc_id long, within long, ids binary")


def offsets(segments: DataFrame) -> DataFrame:
    """(bucket, part, seq, base): ids before each segment; only totals of the at most ``BUCKETS`` + 1 ranges meet in one task."""
    sizes = segments.select("bucket", "part", "seq", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("n_ids"))
    ranges = ranges.select("bucket", before(Window.orderBy("bucket")).alias("low"))
    inside = sizes.select("bucket", "part", "seq", before(Window.partitionBy("bucket").orderBy("part", "seq")).alias("high"))
    return inside.join(ranges, "bucket").select("bucket", "part", "seq", (F.col("low") + F.col("high")).alias("base"))
