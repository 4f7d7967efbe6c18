"""Picture operators: access units, disposable pictures, picture order, keyframe navigation and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.strict import validating
from reelmill.operators.prefix import Scan, bins, lagged, latest, peak, since, total
from reelmill.operators.rows import merged

LATE_MS, LARGE_PIXELS = 100, 1280 * 720


def assemble_access_units(nals: DataFrame, key: str = "stream_id", order: str = "nal_no", block: str | None = None) -> DataFrame:
    """Adds au_no to NAL units (nal_type, first_mb for slices): types 6-9 and 12-18 close the open picture and belong to
    the next; a slice of type 1, 2 or 5 with first_mb 0 or unreadable opens a new one; 10 and 11 close their own. Units
    after the last picture that belong to no other are left out. block: see operators.prefix."""
    t = F.col("nal_type")
    vcl = t.between(1, 5)
    closes_before = t.between(6, 9) | t.between(12, 18)
    scan = Scan(nals, [key], order, block).add(_open=latest(F.when(vcl, 1).when(t.between(6, 18), 0), before=True))
    is_open = F.coalesce("_open", F.lit(0))
    starts = vcl & ((is_open == 0) | (t.isin(1, 2, 5) & F.coalesce(F.col("first_mb") == 0, F.lit(True))))
    scan.df = scan.df.withColumn("_starts", F.when(starts, 1).otherwise(0))
    rows = scan.add(_n=total(F.col("_starts")), _more=peak(F.col("_starts"), before=True, ahead=True)).done()
    mine = vcl | ((is_open == 1) & ~closes_before)
    au = F.when(mine, F.col("_n") - 1).otherwise(F.col("_n"))
    return rows.filter(mine | (F.col("_more") == 1)).withColumn("au_no", au).drop("_open", "_starts", "_n", "_more")


def access_units(nals: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, au_no, is_idr, nal_count, disposable of NALs with au_no.

    disposable: every slice is of type 1 with reference 0, is a B slice and names one parameter set; no unit is empty,
    forbidden or a parameter set.
    """
    t, vcl = F.col("nal_type"), F.col("nal_type").between(1, 5)
    return nals.groupBy(key, "au_no").agg(
        F.bool_or(t == 5).alias("is_idr"), F.count("*").alias("nal_count"),
        (F.coalesce(F.bool_and(F.when(vcl, F.coalesce((t == 1) & (F.col("nal_ref_idc") == 0) & (F.col("slice_type") % 5 == 1), F.lit(False)))), F.lit(False))
         & (F.count_distinct(F.when(vcl, F.col("pps_id"))) == 1) & ~F.bool_or(t.isin(7, 8))).alias("disposable"),
    )


def nal_histogram(nals: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, counts by type (map) and a summary in type order."""
    names = {1: "nonIDR", 5: "IDR", 6: "SEI", 7: "SPS", 8: "PPS", 9: "AUD"}
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("nal_type")], F.concat(F.lit("type"), F.col("nal_type").cast("string")))
    each = nals.groupBy(key, "nal_type").agg(F.count("*").alias("n"))
    listed = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("nal_type", "n", label.alias("label")))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: F.concat(x["label"], F.lit("="), x["n"].cast("string"))), ", ").alias("summary"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("nals"))


def skip_when_late(units: DataFrame, late: Column | str = "lateness_ms", pixels: Column | str = "pixels", rule: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds skip: a disposable picture that is late (by 100 ms; at once from 1280x720 on). rule replaces the test."""
    late = F.col(late) if isinstance(late, str) else late
    pixels = F.col(pixels) if isinstance(pixels, str) else pixels
    limit = F.when(pixels >= LARGE_PIXELS, 0).otherwise(LATE_MS)
    return units.withColumn("skip", F.col("disposable") & (rule(late) if rule else late >= limit))


def safe_switch_boundary(units: DataFrame, keys: tuple[str, ...] = ("stream_id", "segment_seq")) -> DataFrame:
    """Whether each segment starts with an instantaneous refresh."""
    return units.groupBy(*keys).agg(F.min_by("is_idr", "au_no").alias("safe"))


def gate_on_keyframe(units: DataFrame, damage: str = "damaged", key: str = "stream_id", order: str = "au_no", block: str | None = None) -> DataFrame:
    """Adds emitted: after the start and after damage units wait for the next refresh (a damaged one counts).
    block: see operators.prefix."""
    at = F.col(order)
    rows = Scan(units, [key], order, block).add(_idr=peak(F.when(F.col("is_idr"), at)), _damage=peak(F.when(F.col(damage), at))).done()
    open_ = F.col("_idr").isNotNull() & (F.col("_damage").isNull() | (F.col("_idr") >= F.col("_damage")))
    return rows.withColumn("emitted", open_).drop("_idr", "_damage")


def picture_order_count(pictures: DataFrame, key: str = "stream_id", order: str = "au_no", block: str | None = None) -> DataFrame:
    """Adds poc (type 0) from lsb, max_lsb, is_idr, is_reference, and, if present, delta_bottom and op5.

    The high part steps at reference pictures whose low part turns over by half the range or more downwards, more than
    half upwards. An IDR starts anew. A picture with op5 counts from itself: its own order is that of its fields less
    the top's, and what follows it refers to its remaining top. block: see operators.prefix.
    """
    have = set(pictures.columns)
    rows = pictures.withColumns({"_db": F.coalesce("delta_bottom", F.lit(0)) if "delta_bottom" in have else F.lit(0), "_op5": F.coalesce("op5", F.lit(False)) if "op5" in have else F.lit(False)})
    scan = Scan(rows, [key], order, block)
    idr, reference = F.coalesce("is_idr", F.lit(False)), F.coalesce("is_reference", F.lit(False))
    starts, left = idr, F.lit(0)
    if "op5" in have:
        # the picture after an op5 one starts anew, from what that one leaves as the low part: its top, once it counts from the smaller of its fields
        scan.add(_was=lagged(op5=F.col("_op5"), left=F.greatest(F.lit(0), -F.col("_db"))))
        after = F.coalesce(F.col("_was.op5"), F.lit(False))
        starts, left = idr | after, F.when(after, F.col("_was.left")).otherwise(0)
    scan.df = scan.df.withColumns({"_starts": starts, "_left": left})
    at = F.col(order)
    scan.add(_from=latest(F.when(F.col("_starts"), F.struct(at.alias("at"), F.col("_left").alias("lsb")))), _ref=latest(F.when(reference, F.struct(at.alias("at"), F.col("lsb").alias("lsb"))), before=True))
    known = F.col("_ref").isNotNull() & (F.col("_from").isNull() | (F.col("_ref.at") >= F.col("_from.at")))
    scan.df = scan.df.withColumn("_prev", F.when(idr, 0).when(known, F.col("_ref.lsb")).otherwise(F.coalesce("_from.lsb", F.lit(0))))
    half = F.col("max_lsb") / 2
    turn = F.when((F.col("lsb") < F.col("_prev")) & (F.col("_prev") - F.col("lsb") >= half), F.col("max_lsb")).when((F.col("lsb") > F.col("_prev")) & (F.col("lsb") - F.col("_prev") > half), -F.col("max_lsb")).otherwise(0)
    scan.df = scan.df.withColumn("_turn", turn)
    rows = scan.add(_held=since(F.when(reference, F.col("_turn")), F.col("_starts"), before=True)).done()
    rows = rows.withColumn("_top", F.col("_held") + F.col("_turn") + F.col("lsb"))
    own = F.least(F.col("_top"), F.col("_top") + F.col("_db"))
    return rows.withColumn("poc", F.when(F.col("_op5"), 0).otherwise(own).cast("long")).drop("_db", "_op5", "_was", "_starts", "_left", "_from", "_ref", "_prev", "_turn", "_held", "_top")


def keyframe_navigation(units: DataFrame, key: str = "stream_id", order: str = "au_no", block: str | None = None) -> DataFrame:
    """Adds preceding_idr (at or before a unit) and next_idr (at or after it). block: see operators.prefix."""
    at = F.when(F.col("is_idr"), F.col(order))
    return Scan(units, [key], order, block).add(preceding_idr=latest(at), next_idr=latest(at, ahead=True)).done()


def previous_idr(positions: DataFrame, units: DataFrame, back_off: int = 2, key: str = "stream_id", next_no: str = "next_no", now: str = "now_ms", order: str = "au_no", pts: str = "pts_ms", width: int | None = None) -> DataFrame:
    """positions (key, next_no, now_ms) with previous_idr: the last refresh at least back_off units before the next one
    (unit 0 counts for the first ones) whose time is before now; null if there is none.

    A refresh closes the order of times: later refreshes have later times. So it is the earlier one of two as-of matches,
    by number and by time. positions with equal values are one row. width: pieces of so many numbers or milliseconds are
    handled by themselves (see operators.prefix).
    """
    idr = units.filter("is_idr").select(key, F.col(order).cast("long").alias("_no"), F.col(pts).cast("long").alias("_ms"))
    asked = positions.select(key, next_no, now).distinct()

    def as_of(at: Column, place: str, upto: bool) -> DataFrame:
        """The last refresh whose place is at most (upto) or less than `at`."""
        a = asked.withColumns({"_at": at.cast("long"), "_k": F.lit(1 if upto else -1), "_no": F.lit(None).cast("long")})
        r = idr.select(key, F.col(place).alias("_at"), F.lit(0).alias("_k"), "_no")
        met = Scan(merged([a, r], key), [key], ("_at", "_k", "_no"), bins("_at", width)).add(_found=peak(F.col("_no"))).done()
        return met.filter("_k != 0").select(key, next_no, now, "_found")

    by_number = as_of(F.greatest(F.col(next_no) - back_off, F.lit(0)), "_no", True).withColumnRenamed("_found", "_by_number")
    by_time = as_of(F.col(now), "_ms", False).withColumnRenamed("_found", "_by_time")
    both = F.when(F.col("_by_number").isNotNull() & F.col("_by_time").isNotNull(), F.least("_by_number", "_by_time"))
    return by_number.join(by_time, [key, next_no, now]).select(key, next_no, now, both.alias("previous_idr"))


def unit_at_or_before(targets: DataFrame, units: DataFrame, key: str = "stream_id", at: str = "target_ms", pts: str = "pts_ms", width: int | None = None) -> DataFrame:
    """The unit with the greatest time at or before each target (ties: the later one), else the first refresh. width:
    pieces of so many milliseconds are handled by themselves (see operators.prefix)."""
    t = targets.select(key, F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("au_no"))
    u = units.select(key, F.col(pts).alias("t"), F.lit(0).alias("kind"), F.col("au_no").cast("long").alias("au_no"))
    first = units.filter("is_idr").groupBy(key).agg(F.min("au_no").alias("first_idr"))
    met = Scan(merged([t, u], key), [key], ("t", "kind", "au_no"), bins("t", width)).add(found=latest(F.col("au_no"))).done().filter("kind = 1")
    return met.join(first, key, "left").select(key, F.col("t").alias(at), F.coalesce("found", "first_idr").alias("au_no"))


@validating
def dependency_window(units: DataFrame, max_window: int = 1200, key: str = "stream_id", order: str = "au_no", boundary: Column | None = None) -> DataFrame:
    """Adds distance from the last refresh before a unit and violation: a boundary at max_window or beyond, another unit
    at max_window - 1 or beyond, or a unit before the first refresh. boundary defaults to is_idr."""
    w = Window.partitionBy(key).orderBy(order)
    edge = F.col("is_idr") if boundary is None else boundary
    i = F.row_number().over(w) - 1
    rows = units.withColumns({"_i": i, "_b": edge})
    last = F.last(F.when(F.col("_b"), F.col("_i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("distance", F.col("_i") - last)
    code = F.when(~F.col("_b") & F.col("distance").isNull(), "before_first_refresh").when(F.col("_b") & (F.col("distance") >= max_window), "window_exceeded").when(~F.col("_b") & (F.col("distance") >= max_window - 1), "window_exceeded")
    return rows.withColumn("violation", code).drop("_i", "_b")


def retention_start(units: DataFrame, next_no: str = "next_no", keep: int = 90, key: str = "stream_id", order: str = "au_no") -> DataFrame:
    """key, next_no, retain_from: rows from the earlier of (next - keep) and the latest refresh at or before next stay;
    all do without one. units carries next_no, the unit to be decoded next."""
    last = F.max(F.when(F.col("is_idr") & (F.col(order) <= F.col(next_no)), F.col(order)))
    return units.groupBy(key, next_no).agg(last.alias("idr")).select(key, next_no, F.when(F.col("idr").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.col(next_no) - keep, F.col("idr")))).alias("retain_from"))


def concat_batches(batches: list[DataFrame], segment: str = "segment_seq", key: str = "stream_id", identity: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of incremental batches (the final tail is one too) as one table, with batch_no: the place of a row's
    segment in its stream. Order is columns, so batches may come in any order. identity names the columns that tell rows
    apart: of rows that agree in them, as when a batch comes twice, one stays; without it all rows stay, equal ones too."""
    whole = merged(batches, key)
    return (whole.dropDuplicates(list(identity)) if identity else whole).withColumn("batch_no", F.dense_rank().over(Window.partitionBy(key).orderBy(segment)) - 1)
