"""Running values of ordered streams, in one window or in two levels.

A running value is a small monoid: a sum, a maximum, the latest value, the latest two, a sum since the last reset. With a
block (a column that cuts a stream into consecutive pieces) each piece is scanned by itself, one summary row a piece goes
through a window over the stream's pieces, and what came before a piece is joined back: rows are dealt by (key, piece)
once, however many values are added, and a stream of any length is many tasks. Without a block it is one window a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    """A running value of `value`; before leaves the row itself out, ahead runs from the last row to the first."""

    kind: str
    value: Column
    before: bool = False
    ahead: bool = False
    reset: Column | None = None


def total(value: Column, before: bool = False, ahead: bool = False) -> Run:
    """Sum of the values that are not null; null as long as there is none."""
    return Run("total", value, before, ahead)


def peak(value: Column, before: bool = False, ahead: bool = False) -> Run:
    return Run("peak", value, before, ahead)


def latest(value: Column, before: bool = False, ahead: bool = False) -> Run:
    """The last value that is not null; of structs for one that may be (see `lagged`)."""
    return Run("latest", value, before, ahead)


def lagged(**values: Column) -> Run:
    """The previous row's values as a struct, null on the first row."""
    return Run("latest", F.struct(*[v.alias(k) for k, v in values.items()]), True)


def latest_two(value: Column) -> Run:
    """Struct (last, prev) of the last two values that are not null."""
    return Run("two", value)


def since(value: Column, reset: Column, before: bool = False) -> Run:
    """Sum of the values from the last row with reset (that row included), 0 without any."""
    return Run("since", F.coalesce(value, F.lit(0)), before, False, F.coalesce(reset, F.lit(False)))


def bins(at: str, width: int | None) -> Column | None:
    """Pieces of `width` of the values in `at`, for tables that meet in one order; None for one window a key."""
    return None if width is None else F.floor(F.col(at) / width)


class Scan:
    """A table whose rows get running values along `order` (unique in a key, several columns: compared in turn)."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: str | Sequence[str], block: str | Column | None = None) -> None:
        self.order = [order] if isinstance(order, str) else list(order)
        self.keys, self.two_level = list(keys), block is not None
        self.df = df
        if self.two_level:
            # structs compare their null fields as equal, so that rows with a null key or piece find their summary
            key = F.struct(*[F.col(k) for k in self.keys]) if self.keys else F.struct(F.lit(0))
            self.df = df.withColumn("_rm_piece", F.struct(key.alias("k"), (F.col(block) if isinstance(block, str) else block).alias("b")))

    def _within(self, ahead: bool, by: Sequence[str] = ()):
        part = ["_rm_piece"] if self.two_level else self.keys
        return Window.partitionBy(*part, *by).orderBy(*[F.col(c).desc() if ahead else F.col(c).asc() for c in self.order])

    def within(self, by: Sequence[str] = ()):
        """A running window that by parts further."""
        return self._within(False, by).rowsBetween(Window.unboundedPreceding, 0)

    def add(self, **runs: Run) -> Scan:
        """Adds the values under their names. Those of one call are found together; a value that builds on another one
        needs a call of its own."""
        first, second, names = {}, {}, list(runs)
        for name, r in runs.items():
            w = self._within(r.ahead)
            upto, upto_before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
            if r.kind == "two":
                first[f"_rm_p_{name}"] = F.last(r.value, ignorenulls=True).over(upto_before)
            if r.kind == "since":
                first[f"_rm_p_{name}"] = F.sum(r.reset.cast("int")).over(upto)
        rows = self.df.withColumns(first) if first else self.df
        for name, r in runs.items():
            w = self._within(r.ahead).rowsBetween(Window.unboundedPreceding, -1 if r.before else 0)
            p = f"_rm_p_{name}"
            if r.kind == "total":
                second[name] = F.sum(r.value).over(w)
            elif r.kind == "peak":
                second[name] = F.max(r.value).over(w)
            elif r.kind == "latest":
                second[name] = F.last(r.value, ignorenulls=True).over(w)
            elif r.kind == "two":
                second[name] = F.last(F.when(r.value.isNotNull(), F.struct(r.value.alias("last"), F.col(p).alias("prev"))), ignorenulls=True).over(w)
            else:
                second[name] = F.sum(r.value).over(self._within(False, [p]).rowsBetween(Window.unboundedPreceding, 0))
        inner = rows.withColumns({f"_rm_{n}": c for n, c in second.items()})
        if self.two_level:
            inner = self._joined(inner, runs)
        out = {}
        for name, r in runs.items():
            own, was = F.col(f"_rm_{name}"), F.col(f"_rm_w_{name}") if self.two_level else F.lit(None)
            if r.kind == "since":
                own = F.when(F.col(f"_rm_p_{name}") > 0, own).otherwise(F.coalesce(was, F.lit(0)) + own) if self.two_level else own
                out[name] = own - r.value if r.before else own
            elif not self.two_level:
                out[name] = own
            elif r.kind == "total":
                out[name] = F.coalesce(was + own, was, own)
            elif r.kind == "peak":
                out[name] = F.greatest(was, own)
            elif r.kind == "latest":
                out[name] = F.coalesce(own, was)
            else:
                out[name] = F.when(own.isNull(), was).otherwise(F.struct(own["last"].alias("last"), F.coalesce(own["prev"], was["last"]).alias("prev")))
        self.df = inner.withColumns(out).drop(*[f"_rm_{x}{n}" for n in names for x in ("", "p_", "w_")])
        return self

    def _joined(self, inner: DataFrame, runs: dict[str, Run]) -> DataFrame:
        """inner with _rm_w_<name>: each value as it stands before the row's piece."""
        ord_ = F.struct(*self.order)
        aggs = []
        for name, r in runs.items():
            edge = F.min_by if r.ahead else F.max_by
            if r.kind == "total":
                a = F.sum(r.value)
            elif r.kind == "peak":
                a = F.max(r.value)
            elif r.kind == "latest":
                a = edge(r.value, F.when(r.value.isNotNull(), ord_))
            elif r.kind == "two":
                a = edge(F.col(f"_rm_{name}"), ord_)
            else:
                a = F.struct(F.max(r.reset.cast("int")).alias("reset"), edge(F.col(f"_rm_{name}"), ord_).alias("sum"))
            aggs.append(a.alias(f"_rm_a_{name}"))
        pieces = inner.groupBy("_rm_piece").agg(*aggs)
        pieces = pieces.select(F.col("_rm_piece").alias("_rm_of"), F.col("_rm_piece.k").alias("_rm_k"), F.col("_rm_piece.b").alias("_rm_b"), *[f"_rm_a_{n}" for n in runs])
        first, second, last = {}, {}, {}
        for name, r in runs.items():
            a = F.col(f"_rm_a_{name}")
            w = Window.partitionBy("_rm_k").orderBy(F.desc("_rm_b") if r.ahead else F.asc("_rm_b"))
            excl = w.rowsBetween(Window.unboundedPreceding, -1)
            if r.kind == "two":
                first[f"_rm_x_{name}"] = F.last(a["last"], ignorenulls=True).over(excl)
                second[f"_rm_y_{name}"] = F.when(a.isNotNull(), F.struct(a["last"].alias("last"), F.coalesce(a["prev"], F.col(f"_rm_x_{name}")).alias("prev")))
                last[f"_rm_w_{name}"] = F.last(f"_rm_y_{name}", ignorenulls=True).over(excl)
            elif r.kind == "since":
                first[f"_rm_x_{name}"] = F.sum(a["reset"]).over(w)
                second[f"_rm_y_{name}"] = F.sum(a["sum"]).over(Window.partitionBy("_rm_k", f"_rm_x_{name}").orderBy("_rm_b"))
                last[f"_rm_w_{name}"] = F.lag(f"_rm_y_{name}").over(w)
            else:
                fold = {"total": F.sum(a), "peak": F.max(a), "latest": F.last(a, ignorenulls=True)}[r.kind]
                last[f"_rm_w_{name}"] = fold.over(excl)
        for stage in (first, second, last):
            pieces = pieces.withColumns(stage) if stage else pieces
        told = pieces.select("_rm_of", *[f"_rm_w_{n}" for n in runs])
        return inner.join(told, F.col("_rm_piece") == F.col("_rm_of"), "left").drop("_rm_of")

    def done(self) -> DataFrame:
        return self.df.drop("_rm_piece")
