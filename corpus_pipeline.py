"""Corpus pipeline over ``documents``: stages that call the training-data operators in turn.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents (other
columns are left out); the last returns the token ids. An empty table passes every stage as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.llm import bpe_replay, decontam, secrets, simhash, toxicity
from turnlens.llm.common import cut, table
from turnlens.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def row_key() -> Column:
    """Equal for rows with equal id and text only, whether the id is null or not."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64(F.coalesce("text", F.lit("")))))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; null ids and repeated rows are scored like others, empty and null texts stay."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8) the row with the smallest doc_id stays.

    Null ids come after all others; of rows with equal id and text one stays; empty and null texts are one group.
    """
    kept = simhash.representatives(docs.select("doc_id", row_key().alias("key"), "text")).select("key")
    return docs.withColumn("key", row_key()).join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their id; null and empty texts stay."""
    leaked = decontam.leaks(docs.select(row_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return docs.withColumn("key", row_key()).join(leaked.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null texts as they are."""
    found = secrets.scan(docs.select(*COLUMNS))
    clean = secrets.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", clean).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit) of every document left; none for empty and null texts."""
    import public_tokenizers

    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    coded = bpe_replay.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_dedup", without_copies),
    ("decontamination", without_leaks),
    ("secrets", without_secrets),
    ("tokenize", token_ids),
]

#: Learned scores and fingerprints are beyond SQL; the tests hold the stages against brute force on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
