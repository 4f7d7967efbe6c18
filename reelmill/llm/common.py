"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (sessions of one process without one) a new temporary
    folder. Sessions on a cluster must name it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later stages start from files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/reelmill-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: empty) and the n+1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_pieces(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of about `most` bytes of a text column (a longer text is a piece of its own)."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def text_of(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
