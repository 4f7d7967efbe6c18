"""Column functions: clocks, ladders, retry and refresh policies, PCM scaling and reference resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MPEG_BITS = 33


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wrap_delta(a, b, bits: int = MPEG_BITS) -> Column:
    """b - a as the nearest signed difference of two counters of this many bits (strictly beyond half a turn wraps)."""
    d, turn = _col(b) - _col(a), 1 << bits
    return F.when(d > turn // 2, d - turn).when(d < -(turn // 2), d + turn).otherwise(d)


def scale_ticks(v, from_scale, to_scale) -> Column:
    """v ticks of one time scale in another, rounded half away from zero, in integers."""
    v = _col(v).cast("long")
    a, b = ((F.lit(x) if isinstance(x, int) else _col(x)).cast("long") for x in (from_scale, to_scale))
    return (F.signum(v).cast("long") * quotient(F.abs(v) * b + quotient(a, F.lit(2)), a)).cast("long")


def quotient(a: Column, b: Column) -> Column:
    """Integer division, truncated towards zero."""
    return F.call_function("div", a, b)


def nearest_epoch_offset(first, origin, bits: int = MPEG_BITS) -> Column:
    """The multiple of 2^bits that brings a series that starts at first next to origin."""
    turn = 1 << bits
    d = _col(origin) - _col(first)
    return (F.signum(d).cast("long") * F.shiftright(F.abs(d) + turn // 2, bits) * turn).cast("long")


def resolution_pixels(resolution) -> Column:
    """Pixels of 'WxH'; null unless both are positive integers."""
    r = _col(resolution)
    w = F.regexp_extract(r, r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$", 1).try_cast("long")
    h = F.regexp_extract(r, r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$", 2).try_cast("long")
    return F.when((w > 0) & (h > 0), w * h)


def rendition_label(resolution, bandwidth) -> Column:
    """'WxH · N kbps', with '? kbps' where the bandwidth is unknown, and the rate alone where the resolution is."""
    bw = _col(bandwidth)
    rate = F.when(bw > 0, F.concat(F.round(bw / 1000).cast("long").cast("string"), F.lit(" kbps"))).otherwise(F.lit("? kbps"))
    return F.when(_col(resolution).isNotNull() & (_col(resolution) != ""), F.concat(_col(resolution), F.lit(" · "), rate)).otherwise(rate)


def retry_backoff_ms(attempt) -> Column:
    """250 ms doubled with each further attempt, at most 4 s."""
    n = F.least(F.greatest(_col(attempt) - 1, F.lit(0)), F.lit(4))
    return (F.lit(250) * F.pow(F.lit(2), n)).cast("long")


def refresh_delay_us(target_us, changed, elapsed_us) -> Column:
    """Wait before the next refresh: the target duration, or half of it if nothing changed, less the time spent."""
    full = F.when(_col(changed), _col(target_us)).otherwise(F.floor(_col(target_us) / 2))
    return F.when(_col(elapsed_us) <= 0, full).otherwise(F.greatest(F.lit(0), full - _col(elapsed_us))).cast("long")


def float_to_pcm16(x) -> Column:
    """Sample in -1..1 as 16-bit PCM: not finite is 0, otherwise round(x * 32768) within the range."""
    x = _col(x).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, F.least(F.greatest(F.round(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 32768), F.lit(-32768.0)), F.lit(32767.0))).otherwise(F.lit(0.0)).cast("int")


def frame_to_us(frame, rate: int, base_us=0) -> Column:
    """Media time of a frame."""
    return (F.lit(base_us) + F.floor(F.greatest(_col(frame), F.lit(0)) * 1_000_000 / F.lit(rate))).cast("long")


def us_to_frame(us, rate: int, base_us=0, frames=None) -> Column:
    """The frame that plays at a media time, clamped to 0 (and to frames)."""
    at = F.floor(F.greatest(_col(us) - F.lit(base_us), F.lit(0)) * F.lit(rate) / 1_000_000).cast("long")
    return at if frames is None else F.least(at, _col(frames))


def resolve_uri(base, ref) -> Column:
    """ref resolved against an absolute base URI: absolute, //host, /root, ?query, #fragment and relative references."""
    b, r = _col(base), _col(ref)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole_path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_replace(whole_path, r"[^/]*$", "")
    path = F.regexp_extract(r, r"^([^?#]*)", 1)
    rest = F.regexp_extract(r, r"^[^?#]*(.*)$", 1)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    # segments in order; '..' drops the last kept one, '.' is nothing
    parts = F.filter(F.split(joined, "/"), lambda x, i: i > 0)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array().cast("array<string>"))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    last = F.element_at(parts, -1)
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    normal = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return (
        F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
        .when(r.startswith("//"), F.concat(scheme, r))
        .when(r == "", F.regexp_replace(b, "#.*$", ""))
        .when(r.startswith("#"), F.concat(origin, whole_path, query, r))
        .when(r.startswith("?"), F.concat(origin, whole_path, r))
        .otherwise(F.concat(origin, normal, rest))
    )


def clock_column(audio_ms, wall_ms) -> Column:
    """The playback clock: the audio position where there is one, else wall time."""
    return F.coalesce(_col(audio_ms), _col(wall_ms))
