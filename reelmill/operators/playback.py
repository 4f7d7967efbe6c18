"""Playback-health operators: throughput, rebuffering, streaks, presentation, PCM placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.strict import validating
from reelmill.operators.prefix import Scan, bins, latest, peak, since, total
from reelmill.operators.ranges import merged_spans, range_join
from reelmill.operators.rows import merged


#: Averages restart from the last value in stretches of so many fetches; what lies further back weighs less than 0.8^STRETCH.
STRETCH = 512


def throughput_estimate(fetches: DataFrame, key: str = "session_id", order: str = "ord", block: str | None = None) -> DataFrame:
    """Adds fast_bps, slow_bps, estimate_bps: averages that halve (fast) and keep four fifths (slow) at each fetch; the
    first one is its own average.

    An average is a linear recurrence. In a stretch it is keep^m times a running sum of the samples over keep^j, so that
    every row is read once; what the stretch before has reached is carried into it. block: see operators.prefix.
    """
    rates = {"fast_bps": 0.5, "slow_bps": 0.8}
    sample = F.col("n_bytes") * 8.0 * 1e6 / F.greatest(F.col("elapsed_us"), F.lit(1))
    rows = Scan(fetches.withColumn("_s", sample), [key], order, block).add(_i=total(F.lit(1))).done()
    rows = rows.withColumns({"_m": F.pmod(F.col("_i") - 1, F.lit(STRETCH)), "_stretch": F.floor((F.col("_i") - 1) / STRETCH)})
    scan = Scan(rows, [key], order, None if block is None else "_stretch")
    for name, keep in rates.items():
        weight = F.when(F.col("_i") == 1, 1.0).otherwise(1.0 - keep)
        summed = F.sum(F.col("_s") * weight * F.pow(F.lit(keep), -F.col("_m"))).over(scan.within(["_stretch"]))
        scan.df = scan.df.withColumn(f"_{name}", F.pow(F.lit(keep), F.col("_m")) * summed)
    scan.add(_was=latest(F.when(F.col("_m") == STRETCH - 1, F.struct(*[F.col(f"_{n}").alias(n) for n in rates])), before=True))
    made = {n: F.col(f"_{n}") + F.coalesce(F.pow(F.lit(keep), F.col("_m") + 1) * F.col(f"_was.{n}"), F.lit(0.0)) for n, keep in rates.items()}
    return scan.done().withColumns(made).withColumn("estimate_bps", F.least("fast_bps", "slow_bps")).drop("_s", "_i", "_m", "_stretch", "_was", *[f"_{n}" for n in rates])


def rebuffer_episodes(events: DataFrame, key: str = "session_id", order: str = "ord", kind: str = "kind", at: str = "media_ms") -> DataFrame:
    """key, episode, start_ms, end_ms, rebuffer_ms, starvations, underruns of each episode.

    An episode runs from the first video_starved or audio_underrun to the next buffer_recovered. Repeated starvation
    counts once, every underrun counts; an open episode has no end and no length.
    """
    w = Window.partitionBy(key).orderBy(order)
    recovered = F.col(kind) == "buffer_recovered"
    rows = events.withColumn("episode", F.coalesce(F.sum(F.when(recovered, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stops = F.col(kind).isin("video_starved", "audio_underrun")
    each = rows.groupBy(key, "episode").agg(
        F.min_by(at, F.when(stops, F.col(order))).alias("start_ms"), F.min_by(at, F.when(recovered, F.col(order))).alias("end_ms"),
        F.max(F.when(F.col(kind) == "video_starved", 1).otherwise(0)).cast("long").alias("starvations"), F.count_if(F.col(kind) == "audio_underrun").alias("underruns"),
    )
    return each.filter("start_ms is not null").withColumn("rebuffer_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))


def qoe_summary(events: DataFrame, key: str = "session_id", order: str = "ord", kind: str = "kind", at: str = "media_ms") -> DataFrame:
    """Rebuffer count and ms, recoveries, switches, presentation updates and peak resident units of each session."""
    episodes = rebuffer_episodes(events, key, order, kind, at).groupBy(key).agg((F.sum("starvations") + F.sum("underruns")).alias("rebuffer_count"), F.coalesce(F.sum("rebuffer_ms"), F.lit(0)).alias("rebuffer_ms"), F.count("end_ms").alias("recoveries"))
    peak = [F.max("resident_units").alias("peak_resident_units")] if "resident_units" in events.columns else []
    rest = events.groupBy(key).agg(F.count_if(F.col(kind) == "quality_switched").alias("switches"), F.count_if(F.col(kind) == "presented").alias("presentation_updates"), *peak)
    return rest.join(episodes, key, "left").na.fill(0, ["rebuffer_count", "rebuffer_ms", "recoveries"])


def consecutive_runs(df: DataFrame, condition: Column, key: str = "session_id", order: str = "ord", out: str = "run", block: str | None = None) -> DataFrame:
    """Adds the length of the current run of rows that meet the condition; 0 where it fails. block: see operators.prefix."""
    rows = df.withColumn("_ok", F.coalesce(condition, F.lit(False)))
    return Scan(rows, [key], order, block).add(**{out: since(F.when(F.col("_ok"), 1).otherwise(0), ~F.col("_ok"))}).done().drop("_ok")


def buffer_ahead(units: DataFrame, now: str = "now_ms", pts: str = "pts_ms", key: str = "session_id", order: str = "ord", audio: str | None = None) -> DataFrame:
    """Adds video_ahead_ms, the greatest remaining time past now, and ahead_ms, the smaller of it and the audio's."""
    w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    video = F.greatest(F.max(pts).over(w) - F.col(now), F.lit(0))
    rows = units.withColumn("video_ahead_ms", video)
    return rows.withColumn("ahead_ms", F.least("video_ahead_ms", audio) if audio else F.col("video_ahead_ms"))


def quality_at(points: DataFrame, boundaries: DataFrame, key: str = "session_id", at: str = "pts_ms", quality: str = "rendition", width: int | None = None) -> DataFrame:
    """points with the rendition in force: that of the last boundary at or before them. width: pieces of so many
    milliseconds are handled by themselves (see operators.prefix)."""
    p = points.withColumns({"_kind": F.lit(1), "_q": F.lit(None).cast(boundaries.schema[quality].dataType)})
    b = boundaries.select(key, at, F.lit(0).alias("_kind"), F.col(quality).alias("_q"))
    met = Scan(merged([p, b], key), [key], (at, "_kind"), bins(at, width)).add(_rm_quality=latest(F.col("_q"))).done()
    return met.filter("_kind = 1").withColumn(quality, F.col("_rm_quality")).drop("_kind", "_q", "_rm_quality")


def present_latest(ticks: DataFrame, frames: DataFrame, key: str = "session_id", clock: str = "clock_ms", pts: str = "pts_ms") -> DataFrame:
    """key, clock_ms, shown_pts, due, coalesced, lateness_ms: at each tick the greatest due time is shown if it exceeds
    all shown before; the other frames that came due since the last tick are coalesced."""
    t = ticks.select(key, F.col(clock).alias("t"), F.lit(1).alias("kind"))
    f = frames.select(key, F.col(pts).alias("t"), F.lit(0).alias("kind"))
    w = Window.partitionBy(key).orderBy("t", "kind")
    met = merged([t, f], key).withColumns({"best": F.max(F.when(F.col("kind") == 0, F.col("t"))).over(w), "seen": F.count_if(F.col("kind") == 0).over(w)}).filter("kind = 1")
    over = Window.partitionBy(key).orderBy("t")
    met = met.withColumns({"due": F.col("seen") - F.coalesce(F.lag("seen").over(over), F.lit(0)), "was": F.max("best").over(over.rowsBetween(Window.unboundedPreceding, -1))})
    new = F.col("best").isNotNull() & (F.col("was").isNull() | (F.col("best") > F.col("was")))
    shown = F.when(new, F.col("best"))
    return met.select(key, F.col("t").alias(clock), shown.alias("shown_pts"), "due", F.when(new, F.col("due") - 1).otherwise(F.col("due")).alias("coalesced"), F.when(new, F.greatest(F.lit(0), F.col("t") - F.col("best"))).alias("lateness_ms"))


@validating
def place_blocks(blocks: DataFrame, key: str = "stream_id", order: str = "unit_no", max_gap: int | None = None, block: str | None = None) -> DataFrame:
    """Adds gap, written, end_frame to PCM blocks (start_frame, valid_frames) put on one timeline in order.

    What lies before frame 0 or before the end reached so far is trimmed; a gap is silence, and the violation
    gap_too_long beyond max_gap frames. block: see operators.prefix.
    """
    start, end = F.greatest(F.col("start_frame"), F.lit(0)), F.greatest(F.col("start_frame") + F.col("valid_frames"), F.col("start_frame"), F.lit(0))
    scan = Scan(blocks, [key], order, block).add(_end=peak(end, before=True))
    rows = scan.done().withColumn("_prev", F.coalesce("_end", F.lit(0))).drop("_end")
    stop = F.col("start_frame") + F.col("valid_frames")
    rows = rows.withColumns({"gap": F.greatest(start - F.col("_prev"), F.lit(0)), "written": F.greatest(F.lit(0), stop - F.greatest(F.col("_prev"), start)), "end_frame": F.greatest(F.col("_prev"), end)})
    return rows.withColumn("violation", F.when(F.col("gap") > max_gap, "gap_too_long") if max_gap is not None else F.lit(None).cast("string")).drop("_prev")


def retained_window(placed: DataFrame, rate: int, max_seconds: float, max_bytes: int, frame_bytes: int, key: str = "stream_id") -> DataFrame:
    """key, end_frame, first_available, available: what a bounded buffer still holds at the end."""
    capacity = min(int(max_seconds * rate), max_bytes // frame_bytes)
    return placed.groupBy(key).agg(F.max("end_frame").alias("end_frame")).withColumn("first_available", F.greatest(F.lit(0), F.col("end_frame") - capacity)).withColumn("available", F.col("end_frame") - F.col("first_available"))


def read_status(reads: DataFrame, window: DataFrame, key: str = "stream_id", at: str = "start_frame") -> DataFrame:
    """reads with status: evicted before the first frame that its stream's window (retained_window) still holds, pending
    from its end on, negative below frame 0, else available; unknown_stream without a window."""
    met = reads.join(window.select(key, F.col("first_available").alias("_first"), F.col("end_frame").alias("_end")), key, "left")
    code = F.when(F.col("_end").isNull(), "unknown_stream").when(F.col(at) < 0, "negative").when(F.col(at) < F.col("_first"), "evicted").when(F.col(at) >= F.col("_end"), "pending")
    return met.withColumn("status", F.coalesce(code, F.lit("available"))).drop("_first", "_end")


def audio_covers(points: DataFrame, ranges: DataFrame, key: str = "stream_id", at: str = "media_ms", width: int = 60_000) -> DataFrame:
    """points with covered: whether a range of their stream holds them, start_ms (inclusive) to end_ms (exclusive).
    Ranges that overlap count as one; points are dealt by stream and stretches of `width` (see operators.ranges)."""
    spans = merged_spans(ranges, key, "start_ms", "end_ms").withColumnsRenamed({"start_ms": "_rm_start", "end_ms": "_rm_end"})
    met = range_join(points, spans, key, at, "_rm_start", "_rm_end", width, "left")
    return met.withColumn("covered", F.col("_rm_start").isNotNull()).drop("_rm_start", "_rm_end")


@validating
def first_stable_audio_config(units: DataFrame, key: str = "stream_id", order: str = "unit_no") -> DataFrame:
    """key, config (the first unit's struct object_type, sampling_frequency, channel_config), configs (how many there
    are), violation: unsupported_object_type for any but 2, config_changed if they differ."""
    each = units.groupBy(key).agg(F.min_by("config", order).alias("config"), F.count_distinct("config").alias("configs"), F.bool_or(F.col("config.object_type") != 2).alias("_odd"))
    return each.withColumn("violation", F.when(F.col("_odd"), "unsupported_object_type").when(F.col("configs") > 1, "config_changed")).drop("_odd")
