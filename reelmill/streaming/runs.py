"""Runs a streaming operator over a table: the table's rows arrive in ordered pieces, the results are read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.sources.files import new_folder, write_timeline_stream


def replay(df: DataFrame, operator: Callable[[DataFrame], DataFrame], key: str, order: str, pieces: int = 3, files: int = 4) -> DataFrame:
    """df as a stream whose files come in rising order, put through operator; what it appended.

    df is evaluated once. Pieces are ranges of `order` (a numeric column; nulls come first), written one after the other,
    of at least `files` files and more with a larger table; in a piece a key's rows share a file, so a key sees its rows
    in order whichever file of a piece comes first. Files, sink and checkpoint lie in the shared
    folder, so a lost executor costs a retry only.
    """
    spark = df.sparkSession
    whole, source, sink, marks = (new_folder(spark, x) for x in ("rows", "replay", "sink", "marks"))
    # evaluated once: the pieces are cut from what was written
    df.write.parquet(whole)
    rows = spark.read.schema(df.schema).parquet(whole)
    files = max(files, len(rows.inputFiles()) // pieces)
    bounds = [None, *sorted(set(rows.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.05))), None]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = rows if low is None else rows.filter(F.col(order) > low)
        part = part if high is None else part.filter((F.col(order) <= high) | (F.col(order).isNull() if low is None else F.lit(False)))
        part.repartition(files, key).sortWithinPartitions(key, order).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(source)
    made = operator(stream)
    query = write_timeline_stream(made, sink, marks)
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(sink)
