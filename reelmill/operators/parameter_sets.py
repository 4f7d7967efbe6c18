"""Parameter-set operators: inventory, resolution by id, the sets in force at a refresh, compatibility rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.bytefields import exp_golomb, nal_type, rbsp_bits, uint
from reelmill.functions.strict import validating
from reelmill.operators.rows import merged


def inventory(nals: DataFrame, key: str = "stream_id", data: str = "bytes", order: str = "nal_no") -> DataFrame:
    """Distinct SPS and PPS of each stream: digest, first and last NAL, uses, profile, constraints, level, set_id, refers_to."""
    kind = nal_type(data)
    sets = nals.withColumn("kind", F.when(kind == 7, "sps").when(kind == 8, "pps")).filter("kind is not null").withColumn("digest", F.sha2(data, 256))
    each = sets.groupBy(key, "kind", "digest").agg(F.min(order).alias("first_nal"), F.max(order).alias("last_nal"), F.count("*").alias("uses"), F.min_by(data, order).alias("_b"))
    sps = F.col("kind") == "sps"
    own = exp_golomb(rbsp_bits("_b"), F.when(sps, 24).otherwise(0))
    other = exp_golomb(rbsp_bits("_b"), own["next"])
    return each.select(
        key, "kind", "digest", "first_nal", "last_nal", "uses", F.when(sps, uint("_b", 1)).alias("profile_idc"), F.when(sps, uint("_b", 2)).alias("constraint_flags"),
        F.when(sps, uint("_b", 3)).alias("level_idc"), own["value"].alias("set_id"), F.when(~sps, other["value"]).alias("refers_to"),
    )


def shared_sets(found: DataFrame, key: str = "stream_id") -> DataFrame:
    """digest, kind, streams: how many streams use each parameter set."""
    return found.groupBy("digest", "kind").agg(F.count_distinct(key).alias("streams"), F.sum("uses").alias("uses"))


def _version(sets: DataFrame, keys: list[str], order: str) -> Column:
    """A set as a struct that compares by its version: by `order`, where sets has that column, then by all others."""
    rest = [c for c in sets.columns if c not in keys]
    return F.struct(*([order] if order in rest else []), *[c for c in rest if c != order])


def last_version(sets: DataFrame, keys: list[str], order: str = "nal_no") -> DataFrame:
    """One row for each id: its last version by `order`; where sets has no such column, the greatest version."""
    rest = [c for c in sets.columns if c not in keys]
    return sets.groupBy(*keys).agg(F.max(_version(sets, keys, order)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


@validating
def resolve(slices: DataFrame, pps: DataFrame, sps: DataFrame, key: str = "stream_id", order: str = "nal_no") -> DataFrame:
    """slices with sps_id of their PPS and has_sps; violation missing_pps or missing_sps. A slice is one row, however many
    versions an id has: if slices and pps carry `order`, the last version before the slice counts (a set that came later
    is none), else the last one (see last_version)."""
    kept = [key, "pps_id", "sps_id", *[c for c in (order,) if c in pps.columns]]
    if order in slices.columns and order in pps.columns:
        versions = pps.select(*kept).withColumns({"_k": F.lit(0), "_f": F.struct("sps_id")}).drop("sps_id")
        w = Window.partitionBy(key, "pps_id").orderBy(order, "_k").rowsBetween(Window.unboundedPreceding, -1)
        met = merged([slices.withColumn("_k", F.lit(1)), versions], key).withColumn("_f", F.last("_f", ignorenulls=True).over(w)).filter("_k = 1").withColumn("sps_id", F.col("_f.sps_id")).drop("_k", "_f")
    else:
        met = slices.join(last_version(pps.select(*kept), [key, "pps_id"], order).select(key, "pps_id", "sps_id"), [key, "pps_id"], "left")
    s = sps.select(key, "sps_id", F.lit(True).alias("has_sps")).distinct()
    met = met.join(s, [key, "sps_id"], "left")
    return met.withColumn("violation", F.when(F.col("sps_id").isNull(), "missing_pps").when(F.col("has_sps").isNull(), "missing_sps")).drop("has_sps")


def active_sets(units: DataFrame, sets: DataFrame, key: str = "stream_id") -> DataFrame:
    """For each unit (nal_no, pps_id): pps_nal, the latest earlier PPS with its id (else the latest of any id), and
    sps_nal, the latest earlier SPS that the PPS names (else the latest). Never a later one.

    sets: key, nal_no, kind, set_id, refers_to.
    """
    kinds = "long"

    def as_of(left: DataFrame, right: DataFrame, by: list[str], found: str, also: list[str]) -> DataFrame:
        r = right.select(key, *by, "nal_no", F.lit(0).alias("_k"), F.struct(F.col("nal_no").alias("n"), *[F.col(c).cast(kinds).alias(c) for c in also]).alias("_f"))
        both = merged([left.withColumn("_k", F.lit(1)), r], key)
        w = Window.partitionBy(key, *by).orderBy("nal_no", "_k").rowsBetween(Window.unboundedPreceding, -1)
        return both.withColumn(found, F.last("_f", ignorenulls=True).over(w)).filter("_k = 1").drop("_k", "_f")

    pps = sets.filter("kind = 'pps'").select(key, "nal_no", F.col("set_id").alias("pps_id"), "refers_to")
    sps = sets.filter("kind = 'sps'").select(key, "nal_no", F.col("set_id").alias("sps_id"))
    met = as_of(units, pps, ["pps_id"], "_own", ["refers_to"])
    met = as_of(met, pps, [], "_any", ["refers_to"])
    met = met.withColumn("_pps", F.coalesce("_own", "_any")).withColumn("sps_id", F.col("_pps.refers_to"))
    met = as_of(met, sps, ["sps_id"], "_mine", [])
    met = as_of(met, sps, [], "_last", [])
    return met.withColumns({"pps_nal": F.col("_pps.n"), "sps_nal": F.coalesce("_mine.n", "_last.n")}).drop("_own", "_any", "_pps", "_mine", "_last")


def compatibility_audit(slices: DataFrame, rules: dict[str, Column], key: str = "variant_uri") -> DataFrame:
    """key, reasons (the sorted names of the rules that some row breaks) and compatible. A rule is a condition over
    slices joined with their sets; null counts as not broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    named = slices.groupBy(key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(broken)))).alias("reasons"))
    return named.withColumn("compatible", F.size("reasons") == 0)


def _facts() -> tuple[dict[str, Column], dict[str, Column]]:
    """What a probe looks for in slice headers: in all of them, and in those that name a set."""
    readable, t = F.col("pps_id").isNotNull(), F.col("slice_type")
    p, b = ~F.col("is_idr") & (t == 0), ~F.col("is_idr") & (t == 1)
    seen = {"idr": F.col("is_idr"), "readable": readable, "p": (t == 0) & readable, "b": (t == 1) & readable}
    heads = {
        "not_pbi": (t != 2) & ~p & ~b,
        "not_pi": ~t.isin(0, 2),
        "p": p,
        "b": b,
        "p_not_reference": p & (F.col("nal_ref_idc") == 0),
        "cabac_init": (p | b) & (F.col("cabac_init_idc") != 0),
        "p_without_table": p & ~F.col("weight_table"),
        "b_modified_lists": b & F.col("modified_lists"),
        "b_without_order": b & F.col("poc_lsb").isNull(),
        "b_list1": b & (F.col("l1_active") > 2),
        "redundant_picture": F.col("redundant_pic_cnt") > 0,
        "long_term_reference": F.col("long_term_reference"),
        "references": ((t == 0) | b) & (F.col("l0_active") > 32) | b & (F.col("l1_active") > 32),
        "marking": F.col("adaptive_marking") & ((F.size("marking_ops") <= 0) | F.exists("marking_ops", lambda o: o != 1)),
    }
    return seen, heads


def _mask(conditions: dict[str, Column]) -> Column:
    """The conditions that hold (null: does not) as bits of a long."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(conditions.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _bits(mask: Column, names: Iterable[str]) -> dict[str, Column]:
    return {n: F.coalesce(mask, F.lit(0)).bitwiseAND(F.lit(1 << i).cast("long")) != 0 for i, n in enumerate(names)}


def _rules(p: Column, s: Column, h: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column], dict[str, Column]]:
    """The decoder's rules on a picture set p, its sequence set s (null: not found) and the facts h that its slices show: those
    on the sets, those on sets where the variant has P slices or B slices, and those on slice headers. A rule of two
    parts holds where both are true, so what slices show can be put together before it meets the sets."""
    cabac = p["cabac"]
    plain = (s["chroma_format"] == 1) & ~s["separate_planes"] & (s["bit_depth_luma"] == 8) & (s["bit_depth_chroma"] == 8) & s["frame_mbs_only"]
    flat = ~s["sps_scaling"]
    sets = {
        "missing_pps": p.isNull(),
        "missing_sps": p.isNotNull() & s.isNull(),
        "cabac_profile": cabac & ~((s["profile_idc"] == 100) & plain & flat & ~p["pps_scaling"]),
        "profile": ~cabac & ~(s["profile_idc"].isin(66, 77, 88) & plain & flat),
        "weighted_prediction": ~cabac & (p["weighted_pred"] | (p["weighted_bipred_idc"] != 0)),
        "transform_or_scaling": ~cabac & (p["transform_8x8"] | p["pps_scaling"]),
        "slice_groups": p["slice_groups"] > 1,
    }
    with_p = {"cabac_p_unweighted": cabac & ~p["weighted_pred"]}
    with_b = {
        "cabac_b_direct": cabac & ~s["direct_8x8"],
        "cabac_b_order": cabac & (s["poc_type"] != 0),
        "cabac_b_bipred": cabac & (p["weighted_bipred_idc"] != 2),
        "b_pictures": ~cabac,
    }
    heads = {
        "slice_type": F.when(cabac, h["not_pbi"]).when(~cabac, h["not_pi"]),
        "p_not_reference": cabac & h["p_not_reference"],
        "cabac_init": cabac & h["cabac_init"],
        "p_without_weights": cabac & (~p["weighted_pred"] & h["p"] | h["p_without_table"]),
        "b_modified_lists": cabac & h["b_modified_lists"],
        "b_order": cabac & ((s["poc_type"] != 0) & h["b"] | h["b_without_order"]),
        "b_list1": cabac & h["b_list1"],
        "redundant_picture": h["redundant_picture"],
        "long_term_reference": h["long_term_reference"],
        "references": h["references"],
        "marking": h["marking"],
    }
    return sets, with_p, with_b, heads


def probe_audit(segments: DataFrame, slices: DataFrame, pps: DataFrame, sps: DataFrame, key: str = "variant_uri", tasks: int | None = None) -> DataFrame:
    """key, reasons (sorted), compatible, pending of every variant in segments, by the decoder's rules.

    segments: the probed segments (key, is_end_list, has_segment, has_pat, has_pmt, has_h264). pps: key, pps_id, sps_id,
    cabac, weighted_pred, weighted_bipred_idc, transform_8x8, pps_scaling, slice_groups (how many). sps: key, sps_id,
    profile_idc, chroma_format, separate_planes, bit_depth_luma, bit_depth_chroma, frame_mbs_only, sps_scaling,
    direct_8x8, poc_type. slices: key, pps_id (null if unreadable), is_idr, slice_type (0 P, 1 B, 2 I, 3 SP, 4 SI),
    nal_ref_idc, cabac_init_idc, weight_table, modified_lists, poc_lsb, l0_active, l1_active, redundant_pic_cnt,
    long_term_reference, adaptive_marking, marking_ops. Of an id's versions the last by nal_no counts, if the tables have
    that column. Sets are judged if a readable slice names them (all of them if
    none is readable); slice headers where the probe has a refresh. An empty live window is pending and compatible, an
    empty finished one is not. Null flags break no rule.

    Each table is read once: slices travel as two masks, and slices and sets of a variant share one exchange by key, in
    `tasks` partitions if given.
    """
    in_all, in_readable = _facts()
    kind, own_id, of = F.col("_kind"), F.col("_id"), F.col("_of")
    rows = merged([
        slices.select(key, F.lit(0).alias("_kind"), F.col("pps_id").cast("long").alias("_id"), _mask(in_all).alias("_seen"), F.when(F.col("pps_id").isNotNull(), _mask(in_readable)).alias("_heads")),
        pps.select(key, F.lit(0).alias("_kind"), F.col("pps_id").cast("long").alias("_id"), _version(pps, [key, "pps_id"], "nal_no").alias("_p")),
        sps.select(key, F.lit(1).alias("_kind"), F.col("sps_id").cast("long").alias("_id"), _version(sps, [key, "sps_id"], "nal_no").alias("_s")),
    ], key)
    dealt = rows.repartition(tasks, key) if tasks else rows.repartition(key)
    each = dealt.groupBy(key, "_kind", "_id").agg(F.bit_or("_seen").alias("_seen"), F.bit_or("_heads").alias("_heads"), F.max("_p").alias("_p"), F.max("_s").alias("_s"))
    # a set without an id is there, but found by no one; a sequence set comes before the picture sets that name it
    met = each.withColumn("_there", F.col("_p").isNotNull()).withColumn("_p", F.when(own_id.isNotNull(), F.col("_p"))).withColumn("_of", F.when(kind == 1, own_id).otherwise(F.col("_p.sps_id").cast("long")))
    named_by = Window.partitionBy(key, "_of").orderBy(F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_s", F.when(of.isNotNull(), F.last("_s", ignorenulls=True).over(named_by))).filter(kind == 0)
    sets, with_p, with_b, heads = _rules(F.col("_p"), F.col("_s"), _bits(F.col("_heads"), in_readable))
    on_sets, named, there = sets | with_p | with_b, F.col("_heads").isNotNull(), F.col("_there")
    told = met.select(key, "_seen", F.when(named, _mask(heads)).alias("_heads"), F.when(named | there, _mask(on_sets)).alias("_sets"), named.alias("_named"), "_there")
    told = told.groupBy(key).agg(F.bit_or("_seen").alias("_seen"), F.bit_or("_heads").alias("_heads"), F.bit_or(F.when(F.col("_named"), F.col("_sets"))).alias("_named"), F.bit_or(F.when(F.col("_there"), F.col("_sets"))).alias("_all"), F.bool_or("_there").alias("_has"))

    whole = segments.groupBy(key).agg(F.bool_or("has_segment").alias("_some"), F.bool_and("is_end_list").alias("_ended"), *[F.bool_and(F.coalesce(F.col(c), F.lit(False)) | ~F.col("has_segment")).alias(c) for c in ("has_pat", "has_pmt", "has_h264")]).join(told, key, "left")
    own = F.when(~F.col("_some"), F.when(F.col("_ended"), "empty_media")).when(~F.col("has_pat"), "missing_pat").when(~F.col("has_pmt"), "missing_pmt").when(~F.col("has_h264"), "no_h264").when(~F.coalesce("_has", F.lit(False)), "no_pps")
    seen = _bits(F.col("_seen"), in_all)
    broken = _bits(F.when(seen["readable"], F.col("_named")).otherwise(F.col("_all")), on_sets)
    broken = {n: c & (seen["p"] if n in with_p else seen["b"] if n in with_b else F.lit(True)) for n, c in broken.items()}
    broken |= {n: c & seen["idr"] for n, c in _bits(F.col("_heads"), heads).items()}
    reasons = F.sort_array(F.array_compact(F.array(own, *[F.when(c, n) for n, c in broken.items()])))
    return whole.select(key, reasons.alias("reasons"), (~F.col("_some") & ~F.col("_ended")).alias("pending")).select(key, "reasons", (F.size("reasons") == 0).alias("compatible"), "pending")
