"""Container sample tables: runs to samples, chunk offsets, presentation times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.scalars import quotient
from reelmill.operators.rows import merged

KEYS = ("file", "track")


def expand_runs(runs: DataFrame, value: str = "delta", keys: tuple[str, ...] = KEYS, order: str = "run_no", running: str | None = "dts") -> DataFrame:
    """One row a sample of (count, value) runs: sample_no from 0, the value, and with `running` the sum of the values of
    all samples before it. Runs are cut natively; a run of any length is spread by explode."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumns({"_base": F.coalesce(F.sum("count").over(before), F.lit(0)), "_sum": F.coalesce(F.sum(F.col("count") * F.col(value)).over(before), F.lit(0))}).filter("count > 0")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count").cast("long") - 1)))
    out = [F.col(k) for k in keys] + [(F.col("_base") + F.col("_i")).alias("sample_no"), F.col(value)]
    return rows.select(*out, *([(F.col("_sum") + F.col("_i") * F.col(value)).alias(running)] if running else []))


def chunk_samples(chunk_runs: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """chunks (keys, chunk_no from 1, chunk_offset) with samples_per_chunk of the run that holds them."""
    # as-of: a run reaches up to the next one's first chunk
    r = chunk_runs.select(*keys, F.col("first_chunk").alias("chunk_no"), F.lit(0).alias("kind"), "samples_per_chunk", F.lit(None).cast("long").alias("chunk_offset"))
    c = chunks.select(*keys, "chunk_no", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("samples_per_chunk"), "chunk_offset")
    w = Window.partitionBy(*keys).orderBy("chunk_no", "kind")
    return merged([r, c], *keys).withColumn("samples_per_chunk", F.last("samples_per_chunk", ignorenulls=True).over(w)).filter("kind = 1").drop("kind")


def sample_offsets(samples: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = KEYS, file_bytes: str | None = None) -> DataFrame:
    """samples (keys, sample_no from 0, size) with chunk_no and offset: the chunk's offset and the sizes before it there.

    violation: missing_chunk for samples beyond the last chunk, outside_file where a file size is given.
    """
    before = Window.partitionBy(*keys).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    spread = chunks.withColumn("_base", F.coalesce(F.sum("samples_per_chunk").over(before), F.lit(0))).filter("samples_per_chunk > 0")
    spread = spread.select(*keys, "chunk_no", "chunk_offset", F.explode(F.sequence(F.col("_base").cast("long"), (F.col("_base") + F.col("samples_per_chunk") - 1).cast("long"))).alias("sample_no"))
    met = samples.join(spread, [*keys, "sample_no"], "left")
    inside = Window.partitionBy(*keys, "chunk_no").orderBy("sample_no").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("offset", F.col("chunk_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    code = F.when(F.col("chunk_no").isNull(), "missing_chunk")
    if file_bytes:
        code = code.when(F.col("offset") + F.col("size") > F.col(file_bytes), "outside_file")
    return met.withColumn("violation", code).drop("chunk_offset")


def edit_offsets(edits: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, edit_offset (track ticks), violation: leading empty edits, scaled, less the first real edit's media time.

    edits: edit_no, segment_duration (movie ticks), media_time (-1: empty), rate, movie_scale, track_scale.
    """
    w = Window.partitionBy(*keys).orderBy("edit_no")
    real = F.col("media_time") != -1
    rows = edits.withColumn("_seen", F.coalesce(F.sum(F.when(real, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("_seen = 0")
    ticks = quotient(F.col("segment_duration") * F.col("track_scale") + quotient(F.col("movie_scale"), F.lit(2)), F.col("movie_scale"))
    return rows.groupBy(*keys).agg((F.coalesce(F.sum(F.when(~real, ticks)), F.lit(0)) - F.coalesce(F.max(F.when(real, F.col("media_time"))), F.lit(0))).alias("edit_offset"), F.when(F.bool_or(F.col("rate") != 1), "unsupported_edit_rate").alias("violation"))


def presentation_times(samples: DataFrame, edits: DataFrame | None = None, keys: tuple[str, ...] = KEYS, timescale: str = "timescale") -> DataFrame:
    """Adds pts (dts + ctts + edit offset) and pts_ms (truncated)."""
    # a row a track is small beside its samples, which need no sort then
    met = samples if edits is None else samples.join(edits.select(*keys, "edit_offset").hint("shuffle_hash"), list(keys), "left")
    shift = F.lit(0) if edits is None else F.coalesce("edit_offset", F.lit(0))
    met = met.withColumn("pts", F.col("dts") + F.coalesce("ctts", F.lit(0)) + shift)
    return met.withColumn("pts_ms", quotient(F.col("pts") * 1000, F.col(timescale)))
