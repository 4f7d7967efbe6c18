"""Joins of points with intervals, dealt by key and bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_spans(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The spans of each key with those that overlap or touch put together: key, start, end. Empty and null ones go."""
    w = Window.partitionBy(key).orderBy(start, end)
    rows = spans.filter(F.col(start) < F.col(end)).select(key, start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def binned(spans: DataFrame, start: str, end: str, width: int, out: str = "_bin") -> DataFrame:
    """Each span once for every bin of `width` that it touches; empty and null spans give nothing."""
    there = spans.filter(F.col(start) < F.col(end))
    return there.withColumn(out, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the spans of their key that hold them: start (inclusive) to end (exclusive), whole numbers.

    Spans are dealt to the bins they touch and points to the one they lie in, so the join is an equality of key and bin
    and a hot key is as many tasks as it has bins. width should be about a span's length: a span of n widths is n + 1
    rows. how: inner, or left, where points that no span holds have nulls.
    """
    p = points.withColumn("_bin", F.floor(F.col(at) / width)).alias("p")
    s = binned(spans, start, end, width).alias("s")
    held = F.expr(f"p.`{key}` = s.`{key}` and p._bin = s._bin and p.`{at}` >= s.`{start}` and p.`{at}` < s.`{end}`")
    rest = [c for c in spans.columns if c != key]
    return p.join(s, held, how).select(*[F.col(f"p.`{c}`") for c in points.columns], *[F.col(f"s.`{c}`") for c in rest])
