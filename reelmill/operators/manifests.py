"""Manifest and ladder operators: playlist kinds, variants, segments, tag checks, ranking and selection.

Every operator takes and gives DataFrames. Bad rows are reported in `violation`; functions.strict.raising ends a job at one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.scalars import rendition_label, resolution_pixels

UNKNOWN_BANDWIDTH = 2147483647
KEYS = ("uri", "snapshot_no")


def lines(manifests: DataFrame, keys: tuple[str, ...] = KEYS, text: str = "text") -> DataFrame:
    """keys, pos, line: the trimmed non-empty lines of each manifest in order."""
    split = manifests.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return split.withColumn("line", F.trim(F.regexp_replace("line", r"[\r\t]", " "))).filter("line != ''")


def _order(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("pos")


def playlist_kind(text) -> Column:
    return F.when(F.contains(text, F.lit("#EXT-X-STREAM-INF")), "master").otherwise("media")


def parse_attributes(text) -> Column:
    """Map of an attribute list; commas inside quotes do not part, quotes are dropped, the last of equal keys wins."""
    pattern = r'([^=,]+)=("[^"]*"|[^,]*)'
    keys = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda k: F.trim(k))
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.trim(F.regexp_replace(F.trim(v), '^"|"$', "")))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["k"] != "")
    rest = lambda i: F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1)))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(rest(i), lambda q: q["k"] == p["k"])))


def variants(manifests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, ordinal, uri, bandwidth, resolution, codecs, attrs of each STREAM-INF tag whose next line is a URI."""
    w = _order(keys)
    tags = lines(manifests, keys).withColumn("next", F.lead("line").over(w)).filter(F.col("line").startswith("#EXT-X-STREAM-INF:") & ~F.col("next").startswith("#"))
    attrs = tags.withColumn("attrs", parse_attributes(F.substring_index("line", "#EXT-X-STREAM-INF:", -1)))
    return attrs.select(
        *keys, (F.row_number().over(w) - 1).alias("ordinal"), F.col("next").alias("uri"), F.col("attrs")["BANDWIDTH"].try_cast("long").alias("bandwidth"),
        F.col("attrs")["RESOLUTION"].alias("resolution"), F.col("attrs")["CODECS"].alias("codecs"), "attrs",
    )


def segments(manifests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, ordinal, sequence, segment_uri, duration, discontinuity_sequence of each URI line of a media playlist.

    EXTINF holds for the next URI only (0.0 without one); the sequence restarts at a MEDIA-SEQUENCE tag and the
    discontinuity counter at a DISCONTINUITY-SEQUENCE tag.
    """
    w = _order(keys)
    line = F.col("line")

    def tag(name: str) -> Column:
        return F.when(line.startswith(name + ":"), F.trim(F.substring_index(line, ":", -1)))

    base = lines(manifests, keys).withColumns({"is_uri": ~line.startswith("#"), "extinf": F.trim(F.split(tag("#EXTINF"), ",")[0]).try_cast("double"), "ms": tag("#EXT-X-MEDIA-SEQUENCE").try_cast("long"), "ds": tag("#EXT-X-DISCONTINUITY-SEQUENCE").try_cast("long")})
    # only what the windows look at is sorted
    told = base.filter(F.col("is_uri") | F.col("extinf").isNotNull() | F.col("ms").isNotNull() | F.col("ds").isNotNull() | (line == "#EXT-X-DISCONTINUITY")).select(*keys, "pos", F.when(F.col("is_uri"), line).alias("line"), "extinf", "ms", "ds", "is_uri", (line == "#EXT-X-DISCONTINUITY").alias("gap"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = told.withColumns({"uris": F.coalesce(F.count_if("is_uri").over(before), F.lit(0)), "gaps": F.count_if("gap").over(w)})
    # all in one order, so that it is sorted once: an EXTINF holds if no URI came since
    held = counted.withColumns({name: F.last(F.when(F.col(of).isNotNull(), F.struct(of, count)), ignorenulls=True).over(w) for name, of, count in (("e", "extinf", "uris"), ("m", "ms", "uris"), ("d", "ds", "gaps"))})
    held = held.withColumn("duration", F.when(F.col("e.uris") == F.col("uris"), F.col("e.extinf")))
    return held.filter("is_uri").select(
        *keys, F.col("uris").alias("ordinal"), (F.coalesce("m.ms", F.lit(0)) + F.col("uris") - F.coalesce("m.uris", F.lit(0))).alias("sequence"), line.alias("segment_uri"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"), (F.coalesce("d.ds", F.lit(0)) + F.col("gaps") - F.coalesce("d.gaps", F.lit(0))).alias("discontinuity_sequence"),
    )


def audit(manifests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, kind, is_end_list, unsupported: the first tag of a playlist that the pipeline cannot take, else null.

    A master playlist is tested for encryption alone. ENDLIST counts only as the whole line.
    """
    line = F.col("line")
    encrypted = line.rlike("^#EXT-X-(SESSION-)?KEY:") & (F.upper(F.coalesce(parse_attributes(F.regexp_replace(line, "^[^:]*:", ""))["METHOD"], F.lit(""))) != "NONE")
    reason = F.when(encrypted, "encrypted")
    for name, why in (("#EXT-X-MAP", "initialization_map"), ("#EXT-X-BYTERANGE", "byte_range"), ("#EXT-X-GAP", "gap"), ("#EXT-X-I-FRAMES-ONLY", "i_frames_only")):
        reason = reason.when((F.col("kind") == "media") & ((line == name) | line.startswith(name + ":")), why)
    told = lines(manifests.withColumn("kind", playlist_kind(F.col("text"))), (*keys, "kind")).withColumn("reason", reason)
    return told.groupBy(*keys, "kind").agg(F.bool_or(line == "#EXT-X-ENDLIST").alias("is_end_list"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("unsupported"))


def codec_ids(codecs) -> Column:
    return F.filter(F.transform(F.split(codecs, ","), lambda c: F.trim(F.replace(F.trim(c), F.lit('"'), F.lit("")))), lambda c: c != "")


def advertises(codecs, *wanted: str) -> Column:
    """Whether one of the codec ids is listed, whatever its case; false for unknown codecs."""
    return F.coalesce(F.exists(codec_ids(codecs), lambda c: F.lower(c).isin(*wanted)), F.lit(False))


def advertises_aac_lc(codecs) -> Column:
    return advertises(codecs, "mp4a.40.2")


def advertises_he_aac(codecs) -> Column:
    return advertises(codecs, "mp4a.40.5", "mp4a.40.29")


#: Prefixes of video codec ids.
VIDEO_PREFIXES = "avc1 avc2 avc3 avc4 hev1 hvc1 dvh1 dvhe vp08 vp8 vp09 vp9 av01 mp4v".split()


def unsupported_video_codec(codecs) -> Column:
    """Why a variant's video cannot be taken; null if no video id is listed or all are avc1/avc3."""
    video = F.filter(codec_ids(codecs), lambda c: F.substring_index(F.lower(c), ".", 1).isin(*VIDEO_PREFIXES))
    bad = F.filter(video, lambda c: ~F.substring_index(F.lower(c), ".", 1).isin("avc1", "avc3"))
    return F.when(F.size(bad) > 0, F.concat(F.lit("unsupported advertised video codec "), F.array_join(bad, ", ")))


def rank_ladder(found: DataFrame, master: str = "master_uri") -> DataFrame:
    """Adds ladder_index (by bandwidth, unknown last, then URI), pixels, label and violation duplicate_uri."""
    rate = F.when(F.col("bandwidth") > 0, F.col("bandwidth")).otherwise(UNKNOWN_BANDWIDTH)
    w = Window.partitionBy(master).orderBy(rate, "uri")
    return found.withColumns({
        "ladder_index": F.row_number().over(w) - 1,
        "pixels": resolution_pixels("resolution"),
        "label": rendition_label("resolution", "bandwidth"),
        "violation": F.when(F.count("*").over(Window.partitionBy(master, "uri")) > 1, "duplicate_uri"),
    })


def pick_audio(found: DataFrame, preferred: Column, master: str = "master_uri") -> DataFrame:
    """The AAC-LC variant of each master: the preferred one, else the cheapest."""
    rate = F.when(F.col("bandwidth") > 0, F.col("bandwidth")).otherwise(UNKNOWN_BANDWIDTH)
    w = Window.partitionBy(master).orderBy(F.when(preferred, 0).otherwise(1), rate, "uri")
    return found.filter(advertises_aac_lc(F.col("codecs"))).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def automatic_ceiling(ladder: DataFrame, max_pixels: int | None = None, max_bandwidth: int | None = None, master: str = "master_uri") -> DataFrame:
    """The highest ladder index within the caps, 0 if none: unknown rates pass their cap, unknown pixels fail theirs."""
    ok = F.lit(True)
    if max_pixels is not None:
        ok = ok & F.coalesce(F.col("pixels") <= max_pixels, F.lit(False))
    if max_bandwidth is not None:
        ok = ok & (F.coalesce("bandwidth", F.lit(0)) <= max_bandwidth)
    return ladder.groupBy(master).agg(F.coalesce(F.max(F.when(ok, F.col("ladder_index"))), F.lit(0)).alias("ceiling_index"))


def rejection_reasons(found: DataFrame, master: str = "master_uri") -> DataFrame:
    """The distinct reasons for which variants of a master are rejected, sorted."""
    return found.withColumn("reason", unsupported_video_codec(F.col("codecs"))).groupBy(master).agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def baseline_first(found: DataFrame, master: str = "master_uri") -> DataFrame:
    """Adds probe_order: candidates with a constrained-baseline id first, otherwise in their order."""
    base = F.coalesce(F.exists(codec_ids(F.col("codecs")), lambda c: F.lower(c).startswith("avc1.42")), F.lit(False))
    return found.withColumn("probe_order", F.row_number().over(Window.partitionBy(master).orderBy(F.when(base, 0).otherwise(1), "ordinal")) - 1)


def initial_selection(ladder: DataFrame, requests: DataFrame, master: str = "master_uri") -> DataFrame:
    """One row a request (master, requested_uri): the requested variant if it is in the ladder, else the cheapest, with fell_back."""
    met = requests.join(ladder, master)
    w = Window.partitionBy(master, "requested_uri").orderBy(F.when(F.col("uri") == F.col("requested_uri"), 0).otherwise(1), "ladder_index")
    top = met.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return top.select(master, "requested_uri", "uri", "ladder_index", (~F.coalesce(F.col("uri") == F.col("requested_uri"), F.lit(False))).alias("fell_back"))


def retryable(status, error_kind, rule: Callable[[Column, Column], Column] | None = None) -> Column:
    """Whether a failed fetch is tried again; rule, a function of status and error_kind, replaces the policy."""
    if rule is not None:
        return F.coalesce(rule(status, error_kind), F.lit(False))
    final = F.coalesce(error_kind.isin("too_large", "cancelled", "disposed"), F.lit(False))
    return F.when(final, False).when(status.isNull(), True).otherwise(status.isin(408, 429) | (status >= 500))
