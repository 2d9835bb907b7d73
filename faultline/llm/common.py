"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"      # the contract's white space
WHITE_RE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/faultline-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs only the tasks it ran, never the passes before.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 size of a text column: one aggregate, one number to the driver."""
    n = df.select(F.sum(F.octet_length(F.col(col))).alias("n")).first()["n"]
    return int(n or 0)


def hex_sha256(col: Column | str) -> Column:
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of ``column``.

    Every row is passed on once and whole; a single longer row is a batch of its own.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def row_key_of(id_col: str, text_col: str) -> Column:
    """A key that rows share only if their ids and their texts are equal (nulls equal nulls)."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\n"),
                                   F.coalesce(F.concat(F.lit("+"), F.col(text_col)), F.lit(""))), 256))
