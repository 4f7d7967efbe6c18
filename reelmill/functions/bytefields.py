"""Header fields of transport packets, PES, ADTS and NAL units as column expressions over binary columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sampling frequencies by ADTS index.
ADTS_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it (expressions are trees: each naming copies)."""
    return F.get(F.transform(F.array(value), use), 0)


def uint(b, at, n: int = 1) -> Column:
    """n bytes at a 0-based offset as an unsigned long; null past the end."""
    b = _col(b)
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(b) >= at + n, F.conv(F.hex(F.substring(b, at + 1, F.lit(n))), 16, 10).cast("long"))


def ts_header(b) -> Column:
    """Struct of a 188-byte transport packet; `valid` is false for a bad sync byte, a transport error, adaptation control
    0 or an adaptation field that leaves the packet. payload_start is 0-based; has_payload tells whether there is one."""
    return let(_col(b), lambda b: let(F.conv(F.rpad(F.hex(F.substring(b, F.lit(1), F.lit(4))), 8, "0"), 16, 10).cast("long"), lambda w: _ts_fields(b, w)))


def _ts_fields(b: Column, word: Column) -> Column:
    """word: the first four bytes, with zeros past the end; they are read once, and no field past the end is told."""
    n = F.octet_length(b)

    def told(at: int, size: int = 1) -> Column:
        return F.when(n >= at + size, F.shiftright(word, 8 * (4 - at - size)).bitwiseAND((1 << 8 * size) - 1))

    b1, b3 = told(1), told(3)
    control = F.shiftright(b3, 4).bitwiseAND(3)
    extra = F.when(control.isin(2, 3), uint(b, 4) + 1).otherwise(F.lit(0))
    start = (extra + 4).cast("int")
    has = control.isin(1, 3) & (start < 188)
    valid = (n == 188) & (told(0) == 0x47) & (b1.bitwiseAND(0x80) == 0) & (control != 0) & (start <= 188)
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("valid"),
        told(1, 2).bitwiseAND(0x1FFF).cast("int").alias("pid"),
        (b1.bitwiseAND(0x40) != 0).alias("payload_unit_start"),
        F.shiftright(b3, 6).cast("int").alias("scrambling"),
        control.cast("int").alias("adaptation_control"),
        b3.bitwiseAND(15).cast("int").alias("continuity_counter"),
        F.when(control.isin(2, 3) & (extra > 1), uint(b, 5).bitwiseAND(0x80) != 0).otherwise(F.lit(False)).alias("discontinuity_indicator"),
        has.alias("has_payload"),
        F.when(has, start).alias("payload_start"),
    )


def _clock(b: Column, at: int, prefix: int) -> Column:
    """A 33-bit PTS or DTS of five bytes with its prefix and three marker bits; null if one is wrong."""
    x = [uint(b, at + i) for i in range(5)]
    ok = (F.shiftright(x[0], 4) == prefix) & (x[0].bitwiseAND(1) == 1) & (x[2].bitwiseAND(1) == 1) & (x[4].bitwiseAND(1) == 1)
    value = F.shiftleft(F.shiftright(x[0], 1).bitwiseAND(7), 30) + F.shiftleft(x[1], 22) + F.shiftleft(F.shiftright(x[2], 1), 15) + F.shiftleft(x[3], 7) + F.shiftright(x[4], 1)
    return F.when(ok, value)


def pes_header(b) -> Column:
    """Struct of a PES packet (stream id, length, pts90k, dts90k, payload_start, payload_end, 0-based); null if it is
    malformed: no start code, no optional header, a header or declared length beyond the bytes, or a damaged clock."""
    b = _col(b)
    n = F.octet_length(b)
    flags = F.shiftright(uint(b, 7), 6)
    start = uint(b, 8) + 9
    declared = uint(b, 4, 2)
    end = F.when(declared == 0, n).otherwise(declared + 6)
    pts = F.when(flags == 2, _clock(b, 9, 2)).when(flags == 3, _clock(b, 9, 3))
    dts = F.when(flags == 3, _clock(b, 14, 1))
    ok = (uint(b, 0, 3) == 1) & (F.shiftright(uint(b, 6), 6) == 2) & (start <= n) & (end <= n) & (start <= end) & (flags != 1) & ((flags == 0) | pts.isNotNull()) & ((flags != 3) | dts.isNotNull()) & (uint(b, 8) >= F.when(flags == 2, 5).when(flags == 3, 10).otherwise(0))
    return F.when(ok, F.struct(uint(b, 3).cast("int").alias("stream_id_byte"), declared.alias("packet_length"), pts.alias("pts90k"), dts.alias("dts90k"), start.cast("int").alias("payload_start"), end.cast("int").alias("payload_end")))


def adts_header(b) -> Column:
    """Struct of an ADTS header (first 7 bytes); null on a bad sync word, layer, rate index or length."""
    b = _col(b)
    b1, b2, b3 = uint(b, 1), uint(b, 2), uint(b, 3)
    index = F.shiftright(b2, 2).bitwiseAND(15)
    header = F.when(b1.bitwiseAND(1) == 1, 7).otherwise(9)
    blocks = uint(b, 6).bitwiseAND(3) + 1
    # with a checksum, several blocks have a position each between header and data
    header = (header + F.when((header == 9) & (blocks > 1), (blocks - 1) * 2).otherwise(0)).cast("int")
    frame = F.shiftleft(b3.bitwiseAND(3), 11) + F.shiftleft(uint(b, 4), 3) + F.shiftright(uint(b, 5), 5)
    ok = (F.shiftleft(uint(b, 0), 4) + F.shiftright(b1, 4) == 0xFFF) & (b1.bitwiseAND(6) == 0) & (index < len(ADTS_RATES)) & (frame >= header)
    return F.when(
        ok,
        F.struct(
            F.shiftright(b1, 3).bitwiseAND(1).cast("int").alias("version"),
            (F.shiftright(b2, 6) + 1).cast("int").alias("object_type"),
            F.element_at(F.array(*map(F.lit, ADTS_RATES)), (index + 1).cast("int")).alias("sampling_frequency"),
            (F.shiftleft(b2.bitwiseAND(1), 2) + F.shiftright(b3, 6)).cast("int").alias("channel_config"),
            frame.cast("int").alias("frame_length"),
            header.alias("header_length"),
            blocks.cast("int").alias("blocks"),
            (blocks * 1024).cast("int").alias("sample_count"),
        ),
    )


def nal_type(b) -> Column:
    return uint(b, 0).bitwiseAND(31).cast("int")


def nal_ref_idc(b) -> Column:
    return F.shiftright(uint(b, 0), 5).bitwiseAND(3).cast("int")


#: Three Exp-Golomb codes of at most 63 bits take 24 bytes, and 36 with an emulation byte after every two.
PROBE_BYTES = 40
#: Zeros ahead of the format's longest code.
UE_ZEROS = 31


def rbsp_bits(b, max_bytes: int = PROBE_BYTES) -> Column:
    """The first bytes after the NAL header, without emulation prevention, as a string of 0 and 1."""
    raw = F.decode(F.substring(_col(b), 2, max_bytes), "ISO-8859-1")
    plain = F.encode(F.regexp_replace(raw, "\\x00\\x00\\x03(?=[\\x00-\\x03])", "\u0000\u0000"), "ISO-8859-1")
    digits = F.split(F.hex(plain), "")
    nibbles = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0"))
    return F.array_join(nibbles, "")


def exp_golomb(bits: Column, at: Column, zeros_most: int = UE_ZEROS) -> Column:
    """Struct (value, next) of the unsigned Exp-Golomb code at a 0-based bit; null if it is cut off or has more than
    zeros_most zeros ahead (62 at most: values are longs)."""

    def read(zeros: Column) -> Column:
        stop = at + 2 * zeros + 1
        ok = (zeros >= 0) & (zeros <= zeros_most) & (stop <= F.length(bits))
        code = F.conv(F.substr(bits, at + zeros + 1, zeros + 1), 2, 10).cast("long") - 1
        return F.when(ok, F.struct(code.alias("value"), stop.cast("int").alias("next")))

    return let(F.instr(F.substr(bits, at + 1), "1") - 1, read)


def slice_probe(b, zeros_most: int = UE_ZEROS) -> Column:
    """Struct (first_mb, slice_type modulo 5, pps_id) of a slice NAL; null if it is too short or malformed. zeros_most: of
    the first code, see exp_golomb."""

    def made(first: Column, kind: Column, pps: Column) -> Column:
        return F.when(pps.isNotNull() & (kind["value"] < 10), F.struct(first["value"].alias("first_mb"), (kind["value"] % 5).cast("int").alias("slice_type"), pps["value"].alias("pps_id")))

    def third(bits: Column, first: Column, kind: Column) -> Column:
        return let(exp_golomb(bits, kind["next"]), lambda pps: made(first, kind, pps))

    def second(bits: Column, first: Column) -> Column:
        return let(exp_golomb(bits, first["next"]), lambda kind: third(bits, first, kind))

    # 31 zeros more in the first code are 62 bits more, with emulation bytes 12 bytes
    n = PROBE_BYTES if zeros_most <= UE_ZEROS else PROBE_BYTES + 12
    return let(rbsp_bits(b, n), lambda bits: let(exp_golomb(bits, F.lit(0), zeros_most), lambda first: second(bits, first)))


def sps_geometry(width_mbs, height_map_units, frame_mbs_only, chroma_format, crop_left, crop_right, crop_top, crop_bottom) -> Column:
    """Struct of coded and display size of a sequence parameter set; crop counts units of the chroma format."""
    frame_only = _col(frame_mbs_only)
    w = _col(width_mbs) * 16
    h = _col(height_map_units) * 16 * F.when(frame_only, 1).otherwise(2)
    c = _col(chroma_format)
    unit_x = F.when(c.isin(1, 2), 2).otherwise(1)
    unit_y = F.when(c == 1, 2).otherwise(1) * F.when(frame_only, 1).otherwise(2)
    return F.struct(
        w.cast("int").alias("coded_width"), h.cast("int").alias("coded_height"),
        (w - unit_x * (_col(crop_left) + _col(crop_right))).cast("int").alias("display_width"),
        (h - unit_y * (_col(crop_top) + _col(crop_bottom))).cast("int").alias("display_height"),
    )
