"""Helpers shared by the corpus operators: tables, the work folder, row slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlake.session import checkpoint_root, ship_package, work_dir

__all__ = ["checkpoint_root", "id_text", "read_table", "save", "ship_package", "slices", "work_dir"]

#: Text bytes that one vectorised step works on at a time; a longer text forms a step of its own.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` with null as empty, and the columns named; nothing else of
    the table is read, so extra columns can't clash with an operator's own names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a fresh table in the shared checkpoint folder and read it back.

    The lineage ends there: a lost executor costs a reread, and rows that several later steps
    use are computed once.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES,
           column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of at most ``limit`` text bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i in range(n):
            if held and held + sizes[i] > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(sizes[i]) + 1
        yield batch.slice(at, n - at)
