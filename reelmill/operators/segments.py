"""Segment operators: pairing of renditions, snapshots of live playlists, timelines and window checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.strict import validating

TICKS = 90_000


def _first_code(**codes):
    """The first code whose condition holds, null if none does."""
    out = None
    for name, cond in codes.items():
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def segment_timeline(segments: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """Adds duration90k, start90k (running sum of rounded durations before the segment) and start_s."""
    before = Window.partitionBy(key).orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    ticks = segments.withColumn("duration90k", F.round(F.col("duration") * TICKS).cast("long"))
    return ticks.withColumn("start90k", F.coalesce(F.sum("duration90k").over(before), F.lit(0))).withColumn("start_s", F.col("start90k") / TICKS)


def playlist_summary(segments: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """segment_count, first and last sequence and duration in ms of each playlist."""
    ticks = F.round(F.col("duration") * TICKS).cast("long")
    return segments.groupBy(key).agg(F.count("*").alias("segment_count"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.round(F.sum(ticks) / 90).cast("long").alias("duration_ms"))


def single_epoch(segments: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """is_single and the first sequence whose discontinuity epoch differs from the playlist's first one."""
    first = F.first("discontinuity_sequence").over(Window.partitionBy(key).orderBy("sequence"))
    off = segments.withColumn("off", F.when(F.col("discontinuity_sequence") != first, F.col("sequence")))
    return off.groupBy(key).agg(F.min("off").alias("first_offending")).withColumn("is_single", F.col("first_offending").isNull())


@validating
def pair_renditions(video: DataFrame, audio: DataFrame, key: str = "playlist_uri", duration_tolerance: float = 0.5, drift_tolerance: float = 0.5, limit: int | None = None) -> DataFrame:
    """Each video segment with its audio sibling, and the first failed check: missing_sequence, discontinuity_mismatch,
    duration_mismatch, boundary_drift (of the durations summed so far, in whole nanoseconds, so that no order of addition shows)."""
    other = audio.select(key, "sequence", F.col("duration").alias("audio_duration"), F.col("discontinuity_sequence").alias("audio_discontinuity"))
    w = Window.partitionBy(key).orderBy("sequence")
    met = video.join(other, [key, "sequence"], "left")
    if limit is not None:
        met = met.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")
    nanos = F.round((F.col("duration") - F.coalesce("audio_duration", F.lit(0.0))) * 1e9).cast("long")
    met = met.withColumn("drift", F.sum(nanos).over(w) / 1e9)
    return met.withColumn("violation", _first_code(
        missing_sequence=F.col("audio_duration").isNull(),
        discontinuity_mismatch=F.col("discontinuity_sequence") != F.col("audio_discontinuity"),
        duration_mismatch=F.round(F.abs(F.col("duration") - F.col("audio_duration")), 9) > duration_tolerance,
        boundary_drift=F.abs(F.col("drift")) > drift_tolerance,
    ))


def resolve_rendition(requests: DataFrame, canonical: DataFrame, selected: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """Requested URIs of the canonical list as the same sequence of the selected list; other URIs pass through."""
    seq = canonical.select(key, F.col("segment_uri").alias("requested_uri"), "sequence")
    to = selected.select(key, "sequence", F.col("segment_uri").alias("selected_uri"))
    return requests.join(seq, [key, "requested_uri"], "left").join(to, [key, "sequence"], "left").withColumn("resolved_uri", F.coalesce("selected_uri", "requested_uri"))


@validating
def ordered_segments(segments: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """Adds ordinal by sequence and the violation duplicate_sequence."""
    return segments.withColumns({"ordinal": F.row_number().over(Window.partitionBy(key).orderBy("sequence")) - 1, "violation": F.when(F.count("*").over(Window.partitionBy(key, "sequence")) > 1, "duplicate_sequence")})


def probe_sample(segments: DataFrame, n: int = 2, key: str = "playlist_uri") -> DataFrame:
    """The first n segments of a finalized playlist, the last n of another (is_end_list)."""
    up = F.row_number().over(Window.partitionBy(key).orderBy("sequence"))
    down = F.row_number().over(Window.partitionBy(key).orderBy(F.col("sequence").desc()))
    return segments.withColumns({"_up": up, "_down": down}).filter(F.when(F.col("is_end_list"), F.col("_up")).otherwise(F.col("_down")) <= n).drop("_up", "_down")


@validating
def contiguous_window(segments: DataFrame, key: str = "playlist_uri", max_window: int = 256) -> DataFrame:
    """The first violation of each snapshot (key, snapshot_no), null if none: sequences run from media_sequence without
    gaps, durations are positive and finite, the target duration is positive, nothing is negative, the window is bounded."""
    w = Window.partitionBy(key, "snapshot_no").orderBy("ordinal")
    code = _first_code(
        bad_target_duration=F.col("target_duration") <= 0,
        negative_sequence=(F.col("media_sequence") < 0) | (F.col("discontinuity_sequence") < 0),
        window_too_large=F.count("*").over(Window.partitionBy(key, "snapshot_no")) > max_window,
        sequence_gap=F.col("sequence") != F.col("media_sequence") + F.row_number().over(w) - 1,
        bad_duration=~((F.col("duration") > 0) & (F.col("duration") < float("inf"))),
    )
    told = segments.withColumn("code", code)
    at = F.when(F.col("code").isNotNull(), F.col("ordinal"))
    return told.groupBy(key, "snapshot_no").agg(F.min_by("code", at).alias("violation"), F.min_by("sequence", at).alias("violation_sequence"))


def merge_snapshots(snapshots: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """The first seen version of each sequence over all snapshots, with the snapshot it came in."""
    return snapshots.groupBy(key, "sequence").agg(F.min_by(F.struct("segment_uri", "duration", "discontinuity_sequence"), "snapshot_no").alias("_kept"), F.min("snapshot_no").alias("first_snapshot")).select(key, "sequence", "first_snapshot", "_kept.*")


def new_segments(snapshots: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """The rows of each snapshot whose sequence no earlier snapshot has."""
    first = F.min("snapshot_no").over(Window.partitionBy(key, "sequence"))
    return snapshots.withColumn("_first", first).filter("snapshot_no = _first").drop("_first")


def mutations(snapshots: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """Rows whose sequence was seen before with another URI, duration or discontinuity."""
    held = F.struct("segment_uri", "duration", "discontinuity_sequence")
    first = F.first(held).over(Window.partitionBy(key, "sequence").orderBy("snapshot_no"))
    return snapshots.withColumn("was", first).filter(held != F.col("was"))


def live_edge(snapshots: DataFrame, hold_back: int | None = 3, key: str = "playlist_uri") -> DataFrame:
    """The newest hold_back segments of the first non-empty snapshot (all for None), with the number skipped."""
    first = snapshots.withColumn("_s", F.min("snapshot_no").over(Window.partitionBy(key))).filter("snapshot_no = _s")
    n = F.count("*").over(Window.partitionBy(key))
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.col("sequence").desc()))
    keep = F.lit(2**31 - 1) if hold_back is None else F.lit(hold_back)
    return first.withColumns({"_k": k, "skipped": F.greatest(n - keep, F.lit(0))}).filter(F.col("_k") <= keep).drop("_k", "_s")


def snapshot_windows(snapshots: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """One row a snapshot: first and last sequence, count, media_sequence and discontinuity_sequence of its window."""
    return snapshots.groupBy(key, "snapshot_no").agg(F.min("media_sequence").alias("media_sequence"), F.min("sequence").alias("window_first"), F.max("sequence").alias("window_last"), F.count("*").alias("window_count"), F.min("window_discontinuity").alias("discontinuity_sequence"), F.min("target_duration").alias("target_duration"))


#: The most segments a window may hold, and the segments of a playlist that are remembered.
MAX_WINDOW = 256

#: What ends a live playlist, by the first rule that holds: a window by itself, then against the one before it (was_), the
#: last sequence emitted so far and whether it changes a known segment. For columns and for plain values alike.
LIVE_RULES: dict[str, Callable] = {
    "bad_target_duration": lambda x: x.target_duration <= 0,
    "target_duration_changed": lambda x: x.target_duration != x.was_target,
    "negative_sequence": lambda x: (x.media_sequence < 0) | (x.discontinuity_sequence < 0),
    "window_too_large": lambda x: x.window_count > MAX_WINDOW,
    "sequence_gap": lambda x: x.has_gap,
    "bad_duration": lambda x: x.has_bad_duration,
    "rewind": lambda x: (x.media_sequence < x.was_first) | (x.window_last < x.was_last),
    "discontinuity_rewind": lambda x: x.discontinuity_sequence < x.was_gap,
    "expired_gap": lambda x: x.media_sequence > x.emitted + 1,
    "mutation": lambda x: x.changes_known,
}


class _Columns:
    """The columns that rules name, as attributes."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


@validating
def live_violations(snapshots: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """The terminal violation of each playlist, null if none: the first snapshot that breaks a rule of LIVE_RULES.
    Snapshots after it are not looked at. A null target duration, sequence or duration is a bad one."""
    w = Window.partitionBy(key).orderBy("snapshot_no")
    in_window = Window.partitionBy(key, "snapshot_no").orderBy("sequence")
    steps = snapshots.withColumns({
        "_gap": ~(F.col("sequence") - F.col("media_sequence")).eqNullSafe((F.row_number().over(in_window) - 1).cast("long")),
        "_bad": ~F.coalesce((F.col("duration") > 0) & (F.col("duration") < float("inf")), F.lit(False)),
    })
    windows = steps.groupBy(key, "snapshot_no").agg(
        F.coalesce(F.min("media_sequence"), F.lit(-1)).alias("media_sequence"), F.max("sequence").alias("window_last"), F.count("*").alias("window_count"), F.coalesce(F.min("window_discontinuity"), F.lit(-1)).alias("discontinuity_sequence"),
        F.coalesce(F.min("target_duration"), F.lit(-1)).alias("target_duration"), F.max("_gap").alias("has_gap"), F.max("_bad").alias("has_bad_duration"),
    )
    changed = mutations(snapshots, key).groupBy(key, "snapshot_no").agg(F.min("sequence").alias("mutated"))
    told = windows.join(changed, [key, "snapshot_no"], "left").withColumns({
        "was_first": F.lag("media_sequence").over(w), "was_last": F.lag("window_last").over(w), "was_gap": F.lag("discontinuity_sequence").over(w), "was_target": F.lag("target_duration").over(w),
        "emitted": F.max("window_last").over(w.rowsBetween(Window.unboundedPreceding, -1)), "changes_known": F.col("mutated").isNotNull(),
    })
    code = _first_code(**{name: rule(_Columns()) for name, rule in LIVE_RULES.items()})
    told = told.withColumn("code", code)
    at = F.when(F.col("code").isNotNull(), F.col("snapshot_no"))
    return told.groupBy(key).agg(F.min_by("code", at).alias("violation"), F.min(at).alias("violation_snapshot"), F.count("*").alias("snapshots"))


def snapshot_changes(snapshots: DataFrame, key: str = "playlist_uri") -> DataFrame:
    """Adds `changed` to the windows: the first snapshot, or one whose window fields differ from those before."""
    w = Window.partitionBy(key).orderBy("snapshot_no")
    fields = F.struct("media_sequence", "window_last", "window_count", "discontinuity_sequence")
    return snapshot_windows(snapshots, key).withColumn("changed", ~F.lag(fields).over(w).eqNullSafe(fields))


def load_progress(segments: DataFrame, key: str = "playlist_uri", loaded: str = "loaded") -> DataFrame:
    """Loaded share of each playlist, in 0..1; a playlist without segments counts as loaded."""
    return segments.groupBy(key).agg(F.count_if(F.col(loaded)).alias("n_loaded"), F.count("sequence").alias("n_total")).withColumn("fraction", F.when(F.col("n_total") == 0, 1.0).otherwise(F.least(F.greatest(F.col("n_loaded") / F.col("n_total"), F.lit(0.0)), F.lit(1.0))))
