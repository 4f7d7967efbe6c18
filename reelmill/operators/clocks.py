"""Clock operators: unwrapping of modular counters, epochs, anchors and interpolation.

The window forms put a stream into one task. Where one stream may hold a large share of the rows, pass `block`, a column
that cuts a stream into ordered pieces (its segment number, say): a piece is handled by itself, one summary row a piece
goes through the window, and the pieces' offsets are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.scalars import quotient, wrap_delta
from reelmill.functions.strict import validating
from reelmill.operators.prefix import Scan, bins, latest, latest_two, total
from reelmill.operators.rows import merged
from reelmill.streaming.steps import fold

MS_ALIGNMENT_TICKS = 45_000


def unwrap_clock(df: DataFrame, raw: str = "raw90k", keys: tuple[str, ...] = ("stream_id",), order: str = "ord", bits: int = 33, out: str = "unwrapped90k", block: str | None = None) -> DataFrame:
    """Adds the counter continued over its wraps: each step is the nearest signed difference."""
    if block is None:
        w = Window.partitionBy(*keys).orderBy(order)
        step = df.withColumn("_step", F.coalesce(wrap_delta(F.lag(raw).over(w), F.col(raw), bits), F.col(raw)))
        return step.withColumn(out, F.sum("_step").over(w)).drop("_step")
    w = Window.partitionBy(*keys, block).orderBy(order)
    inner = df.withColumn("_step", F.coalesce(wrap_delta(F.lag(raw).over(w), F.col(raw), bits), F.lit(0))).withColumn("_rel", F.sum("_step").over(w))
    pieces = inner.groupBy(*keys, block).agg(F.min_by(raw, order).alias("_first"), F.max_by(F.struct(F.col(raw).alias("raw"), F.col("_rel").alias("rel")), order).alias("_last"))
    over = Window.partitionBy(*keys).orderBy(block)
    to = pieces.withColumn("_jump", F.coalesce(F.lag("_last.rel").over(over) + wrap_delta(F.lag("_last.raw").over(over), F.col("_first"), bits), F.col("_first")))
    offsets = to.withColumn("_base", F.sum("_jump").over(over)).select(*keys, block, "_base")
    return inner.join(offsets, [*keys, block]).withColumn(out, F.col("_base") + F.col("_rel")).drop("_step", "_rel", "_base")


class EpochStep:
    """The epochs of one stream in order: where each starts, in plain values. See epoch_table."""

    def __init__(self) -> None:
        self.first = self.last = self.cadence = None

    def take(self, x) -> Iterator[tuple]:
        known = lambda v: None if v is None or v != v else int(v)
        elapsed, own = known(x.elapsed), known(x.cadence)
        start = int(x.src_first)
        if self.last is None:
            self.first, jump = start, None
        else:
            floor = self.last + (self.cadence or 1)
            start = floor if elapsed is None else max(floor, self.first + elapsed)
            jump = start - self.last
        self.cadence = own or jump or self.cadence
        self.last = start + int(x.src_last) - int(x.src_first)
        yield x[1], int(x.src_first), start


def epoch_table(df: DataFrame, src: str = "src90k", key: str = "stream_id", epoch: str = "epoch", order: str = "ord", elapsed: str | None = None) -> DataFrame:
    """key, epoch, src_first, timeline_start: where each epoch of a stream starts on its continuous timeline.

    The first epoch keeps its clock. A later one starts at the later of (timeline's first value + declared elapsed
    ticks) and (last value + cadence); the cadence is the last positive step so far, 1 without one, and the step onto an
    epoch counts. With D the sum of the lengths and cadences before an epoch and S its scheduled start, an epoch starts at
    D + max(S - D) over the epochs so far: a sum and a maximum that run over one row an epoch. Only where an epoch
    without a positive step of its own has a schedule does the cadence depend on the result; such streams are folded.
    """
    w = Window.partitionBy(key, epoch).orderBy(order)
    step = F.col(src) - F.lag(src).over(w)
    rows = df.withColumn("_step", F.when(step > 0, step))
    each = rows.groupBy(key, epoch).agg(
        F.min_by(src, order).cast("long").alias("src_first"), F.max_by(src, order).cast("long").alias("src_last"),
        F.max_by("_step", F.when(F.col("_step").isNotNull(), F.col(order))).cast("long").alias("cadence"),
        (F.min(elapsed) if elapsed else F.lit(None)).cast("long").alias("elapsed"),
    )
    by_epoch = Window.partitionBy(key).orderBy(epoch)
    before = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"_first": F.first("src_first").over(by_epoch), "_k": F.row_number().over(by_epoch), "_known": F.coalesce(F.last("cadence", ignorenulls=True).over(by_epoch), F.lit(1))})
    each = each.withColumns({
        "_d": F.coalesce(F.sum(F.col("src_last") - F.col("src_first") + F.col("_known")).over(before), F.lit(0)),
        "_s": F.when(F.col("_k") == 1, F.col("src_first")).otherwise(F.col("_first") + F.col("elapsed")),
    })
    at = F.col("_d") + F.max(F.col("_s") - F.col("_d")).over(by_epoch)
    if elapsed is None:
        return each.select(key, epoch, "src_first", at.alias("timeline_start"))
    odd = F.max((F.col("_k") > 1) & F.col("cadence").isNull() & F.col("elapsed").isNotNull()).over(Window.partitionBy(key))
    told = each.withColumns({"timeline_start": at, "_odd": odd})
    plain = told.filter(~F.col("_odd")).select(key, epoch, "src_first", "timeline_start")
    kind = df.schema[epoch].dataType.simpleString()
    folded = fold(told.filter("_odd").select(key, epoch, "src_first", "src_last", "cadence", "elapsed"), EpochStep, key, epoch, f"{epoch} {kind}, src_first long, timeline_start long")
    return plain.unionByName(folded)


def rebase_epochs(df: DataFrame, src: str = "src90k", key: str = "stream_id", epoch: str = "epoch", order: str = "ord", elapsed: str | None = None, out: str = "timeline90k") -> DataFrame:
    """Adds the continuous timeline over declared discontinuities. src is unwrapped inside its epoch."""
    table = epoch_table(df, src, key, epoch, order, elapsed)
    return df.join(table, [key, epoch]).withColumn(out, F.col("timeline_start") + F.col(src) - F.col("src_first")).drop("src_first", "timeline_start")


@validating
def shared_epoch(audio: DataFrame, video_epochs: DataFrame, raw: str = "raw90k", key: str = "stream_id", epoch: str = "epoch", order: str = "ord", bits: int = 33) -> DataFrame:
    """Audio on the video's epochs, unwrapped from the video's start: timeline90k, and violation epoch_regression on
    the first unit of an epoch that falls before the unit ahead of it plus its cadence."""
    w = Window.partitionBy(key, epoch).orderBy(order)
    met = audio.join(video_epochs, [key, epoch])
    first = F.pmod(F.col("src_first"), F.lit(1 << bits))
    step = F.coalesce(wrap_delta(F.lag(raw).over(w), F.col(raw), bits), wrap_delta(first, F.col(raw), bits))
    met = met.withColumn("_step", step).withColumn("timeline90k", F.col("timeline_start") + F.sum("_step").over(w))
    all_rows = Window.partitionBy(key).orderBy(epoch, order)
    last = F.lag("timeline90k").over(all_rows)
    gap = F.col("timeline90k") - last
    before = all_rows.rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_gap", F.when(gap > 0, gap)).withColumn("_cadence", F.coalesce(F.last("_gap", ignorenulls=True).over(before), F.lit(1)))
    bad = (F.row_number().over(w) == 1) & (F.col("timeline90k") < last + F.col("_cadence"))
    return met.withColumn("violation", F.when(bad, "epoch_regression")).drop("_step", "_gap", "_cadence", "src_first", "timeline_start")


def anchor_to_unit(anchors: DataFrame, units: DataFrame, key: str = "stream_id", width: int | None = None, order: str | None = None) -> DataFrame:
    """key, au_no, pts90k: each timestamp (offset, pts90k) goes to the first unit whose first slice starts at or after
    it; the latest of several wins, those past the last unit are dropped. Of timestamps at one offset the one that came
    last by `order` (a column of anchors) wins, without one the greatest; a null timestamp gives way to any other. width:
    pieces of so many bytes are handled by themselves (see operators.prefix)."""
    came = F.col(order) if order else F.lit(None).cast("long")
    a = anchors.select(key, F.col("offset").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("au_no"), F.col("pts90k").cast("long").alias("pts90k"), came.alias("came"))
    u = units.select(key, F.col("first_vcl_offset").alias("at"), F.lit(1).alias("kind"), F.col("au_no").cast("long").alias("au_no"), F.lit(None).cast("long").alias("pts90k"))
    met = Scan(merged([a, u], key), [key], ("at", "kind", "au_no"), bins("at", width)).add(to=latest(F.col("au_no"), ahead=True)).done().filter("kind = 0 and to is not null")
    return met.groupBy(key, F.col("to").alias("au_no")).agg(F.max_by("pts90k", F.when(F.col("pts90k").isNotNull(), F.struct("at", "came", "pts90k"))).alias("pts90k"))


def interpolate_pts(units: DataFrame, key: str = "stream_id", pts: str = "anchor90k", order: str = "au_no", out: str = "pts90k", base: str | None = None, block: str | None = None) -> DataFrame:
    """Adds timestamps between anchors by linear interpolation (rounded half away from zero).

    Units before the first anchor take its value, those after the last go on with the cadence of the last two anchors (0
    with one). base is the value of the first unit if it has no anchor, and of all units if there is none (else 0).
    block: see operators.prefix.
    """
    scan = Scan(units, [key], order, block)
    scan.add(_i=total(F.lit(1)))
    known = F.col(pts) if base is None else F.when(F.col(pts).isNull() & (F.col("_i") == 1), F.col(base)).otherwise(F.col(pts))
    scan.df = scan.df.withColumn("_known", known).withColumn("_at", F.when(F.col("_known").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_known").alias("v"))))
    rows = scan.add(_two=latest_two(F.col("_at")), _r=latest(F.col("_at"), ahead=True)).done()
    left, before = F.col("_two.last"), F.col("_two.prev")
    span = F.col("_r.i") - left["i"]
    inside = left["v"] + F.round((F.col("_r.v") - left["v"]) * (F.col("_i") - left["i"]) / span).cast("long")
    cadence = F.coalesce(F.round((left["v"] - before["v"]) / (left["i"] - before["i"])).cast("long"), F.lit(0))
    value = (
        F.when(F.col("_known").isNotNull(), F.col("_known"))
        .when(left.isNull() & F.col("_r").isNull(), F.lit(0))
        .when(left.isNull(), F.col("_r.v"))
        .when(F.col("_r").isNull(), left["v"] + cadence * (F.col("_i") - left["i"]))
        .otherwise(inside)
    )
    return rows.withColumn(out, value.cast("long")).drop("_i", "_known", "_at", "_two", "_r")


def normalize_ms(df: DataFrame, pts: str = "pts90k", key: str = "stream_id", order: str = "ord", out: str = "pts_ms") -> DataFrame:
    """Adds milliseconds since the stream's first timestamp; 0 at or before it."""
    first = F.first(pts).over(Window.partitionBy(key).orderBy(order))
    ticks = F.col(pts) - first
    return df.withColumn(out, F.when(ticks <= 0, F.lit(0)).otherwise(F.round(ticks / 90)).cast("long"))


def frame_clock(units: DataFrame, key: str = "stream_id", anchor: str = "anchor90k", samples: str = "sample_count", rate: str = "sampling_frequency", order: str = "unit_no", out: str = "pts90k") -> DataFrame:
    """Adds the time of each audio unit: an anchor's own, else the last anchor plus the samples since, without drift.
    Units before the first anchor have none."""
    w = Window.partitionBy(key).orderBy(order)
    rows = units.withColumn("_island", F.count(anchor).over(w))
    inside = Window.partitionBy(key, "_island").orderBy(order)
    since = F.coalesce(F.sum(samples).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(out, (F.first(anchor).over(inside) + quotient(since * 90_000, F.col(rate))).cast("long")).drop("_island")


@validating
def av_alignment(video: DataFrame, audio: DataFrame, key: str = "stream_id", pts: str = "raw90k", order: str = "ord", tolerance: int = MS_ALIGNMENT_TICKS) -> DataFrame:
    """key, delta90k (audio minus video of the first timestamps, nearest in 33 bits), violation av_misaligned."""
    v = video.groupBy(key).agg(F.min_by(pts, order).alias("v"))
    a = audio.groupBy(key).agg(F.min_by(pts, order).alias("a"))
    met = v.join(a, key).withColumn("delta90k", wrap_delta("v", "a"))
    return met.select(key, "delta90k", F.when(F.abs("delta90k") > tolerance, "av_misaligned").alias("violation"))
