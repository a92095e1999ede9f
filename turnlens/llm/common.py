"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all tasks run in the driver's machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a frame from ``cut`` that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, since what a task makes of a batch may be several times its size."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def id_bounds(docs: DataFrame, buckets: int = 256, key: str = "doc_id") -> list[int]:
    """At most ``buckets - 1`` increasing ids that cut the rows into near equal ranges (reads the id column only)."""
    at = [k / buckets for k in range(1, buckets)]
    row = docs.select(F.percentile_approx(F.col(key), at, 20_000).alias("q")).first()
    return sorted(set(row.q or []))


def id_parts(docs: DataFrame, buckets: int, rows: int, key: str = "doc_id") -> tuple[list[int], Column]:
    """Bounds of ``buckets`` ranges, and the part of a row inside its range: equal steps of ids, as many as give about ``rows`` rows each.

    (range, part) ascends with the id; the number of parts grows with the table, that of ranges does not.
    """
    bounds = id_bounds(docs, buckets, key)
    n, least, most = docs.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    parts = -(-n // (buckets * rows))
    if parts <= 1 or least is None:
        return bounds, F.lit(0)
    low, high = [least, *[b + 1 for b in bounds]], [*bounds, most]
    at = id_bucket(bounds, key)
    edge = lambda values: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in values]), F.greatest(at, F.lit(0)) + 1)
    share = (F.col(key).cast("double") - edge(low)) / (edge(high).cast("double") - edge(low) + 1)
    return bounds, F.coalesce(F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int"), F.lit(0))


def id_bucket(bounds: list[int], key: str = "doc_id") -> Column:
    """Number of bounds below the id: ascending with it; null ids go to bucket -1."""
    if not bounds:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    array = F.array(*[F.lit(int(x)).cast("long") for x in bounds])
    return F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(array, lambda b: b < F.col(key))))
