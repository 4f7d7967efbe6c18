"""Transport-stream operators: continuity, PES assembly, program tables and diagnostics.

Payloads stay out of the windows: sequences are judged on keys and header fields, bytes are joined at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.bytefields import pes_header, ts_header, uint
from reelmill.functions.strict import validating
from reelmill.operators.prefix import Scan, lagged, total

STREAM_TYPES = {"h264": 0x1B, "adts": 0x0F, "latm": 0x11}


def packet_fields(packets: DataFrame, data: str = "bytes") -> DataFrame:
    """Adds the header fields of 188-byte packets, and rejected for those that are not valid.

    Each packet is read once: a filter on fields stays behind `inline`, while one on a struct's fields would move below
    and read the packet, and make its bytes, again for each field it names."""
    return packets.select("*", F.inline(F.array(ts_header(data)))).withColumn("rejected", ~F.col("valid")).drop("valid")


#: What is told of a payload packet, in this order, each by name for the ones after it; for columns and plain values alike.
#: new_segment: it is its pid's first payload packet of a segment; declared: its segment follows a declared
#: discontinuity; previous: the counter before it, counted whether there is one.
PACKET_RULES: dict[str, Callable] = {
    "clear": lambda x: x.scrambling == 0,
    "forgets": lambda x: x.clear & (x.discontinuity_indicator | (x.new_segment & x.declared)),
    "restarts": lambda x: x.new_segment & x.payload_unit_start,
    "told": lambda x: x.clear & x.counted & (x.forgets == False) & (x.restarts == False),  # noqa: E712
    "duplicate": lambda x: x.told & (x.continuity_counter == x.previous),
    "continuity_error": lambda x: x.told & (x.continuity_counter != x.previous) & (x.continuity_counter != (x.previous + 1) % 16),
    "damaged": lambda x: (x.clear == False) | x.forgets | x.continuity_error,  # noqa: E712
    "fresh": lambda x: x.clear & x.payload_unit_start & (x.duplicate == False),  # noqa: E712
}


def continuity_check(packets: DataFrame, keys: tuple[str, ...] = ("stream_id", "pid"), order: str = "packet_no", segment: str | None = None, declared: str | None = None, block: str | None = None) -> DataFrame:
    """Adds duplicate, continuity_error, damaged, fresh and island to the payload packets of each pid, by PACKET_RULES.

    A counter must follow its predecessor modulo 16; an equal one is a duplicate. A discontinuity flag forgets the
    predecessor. A scrambled packet is damage. With `segment`, the counter may restart in the first payload packet of a
    segment that also starts a unit; declared names a column that is true in segments that a declared discontinuity
    opens, whose first packet forgets the predecessor too. An island is a stretch from one unit start or damage to the
    next; fresh marks packets that start a unit. block: see operators.prefix.
    """
    rows = packets.filter(F.col("has_payload") & ~F.coalesce(F.col("rejected"), F.lit(False)) if "rejected" in packets.columns else F.col("has_payload"))
    scan = Scan(rows, keys, order, block).add(_was=lagged(counter=F.col("continuity_counter"), segment=F.col(segment) if segment else F.lit(None)))
    counter = F.col("_was.counter")
    known = {
        "new_segment": F.lit(False) if segment is None else F.col("_was").isNull() | ~F.col(segment).eqNullSafe(F.col("_was.segment")),
        "declared": F.lit(False) if declared is None else F.coalesce(declared, F.lit(False)),
        "previous": F.coalesce(counter, F.lit(-1)), "counted": counter.isNotNull(),
    }
    told = SimpleNamespace(**{c: F.col(c) for c in ("scrambling", "discontinuity_indicator", "payload_unit_start", "continuity_counter")}, **{n: F.col(f"_{n}") for n in known})
    scan.df = scan.df.withColumns({f"_{n}": c for n, c in known.items()})
    for name, rule in PACKET_RULES.items():
        shown = name if name in ("duplicate", "continuity_error", "damaged", "fresh") else f"_{name}"
        scan.df = scan.df.withColumn(shown, rule(told))
        setattr(told, name, F.col(shown))
    opens = (F.col("fresh") | F.col("damaged")) & ~F.col("duplicate")
    return scan.add(island=total(F.when(opens, 1).otherwise(0))).done().drop("_was", *[f"_{n}" for n in (*known, *PACKET_RULES)])


def assemble_pes(checked: DataFrame, keys: tuple[str, ...] = ("stream_id", "pid"), order: str = "packet_no", flush: bool = True) -> DataFrame:
    """keys, pes_no, first_packet, n_packets, payload: units from one start to the next.

    A unit is kept if it begins with the start code 00 00 01 and damage did not cut it; the last one of a pid only with
    flush. checked is the result of continuity_check with a `payload` column.
    """
    there = ~F.col("duplicate")
    part = F.when(F.col("scrambling") == 0, F.struct(F.col(order).alias("o"), "payload"))
    islands = checked.filter(there).groupBy(*keys, "island").agg(
        F.min(order).alias("first_packet"), F.bool_or("fresh").alias("starts"), F.min_by("damaged", order).alias("by_damage"), F.count(part).alias("n_packets"), F.sort_array(F.collect_list(part)).alias("parts"),
    )
    # one exchange: what cuts a unit is how the next island of its pid begins
    whole = F.coalesce(~F.lead("by_damage").over(Window.partitionBy(*keys).orderBy("island")), F.lit(flush))
    kept = islands.withColumn("whole", whole).filter("starts and whole and n_packets > 0")
    bytes_of = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), ""))
    made = kept.select(*keys, "first_packet", "n_packets", bytes_of.alias("payload")).filter(uint("payload", 0, 3) == 1)
    return made.withColumn("pes_no", F.row_number().over(Window.partitionBy(*keys).orderBy("first_packet")) - 1)


def _tables(packets: DataFrame, payload: str) -> DataFrame:
    """Packets that start a table: _at (after the pointer field), _id and _len of it."""
    psi = packets.filter(F.col("payload_unit_start") & F.col("has_payload"))
    at = (uint(payload, 0) + 1).cast("int")
    return psi.withColumn("_at", at).withColumns({"_id": uint(F.col(payload), F.col("_at")), "_len": uint(F.col(payload), F.col("_at") + 1, 2).bitwiseAND(0xFFF)})


def association_tables(packets: DataFrame, key: str = "stream_id", segment: str = "segment_seq", payload: str = "payload") -> DataFrame:
    """key, segment, program_number, pmt_pid from the association tables (pid 0) of each segment; a table must lie in one
    packet."""
    pat = _tables(packets, payload).filter("pid = 0 and _id = 0 and _len >= 9").withColumn("_n", ((F.col("_len") - 9) / 4).cast("int")).filter("_n > 0")
    entries = pat.select(key, segment, payload, "_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    place = (F.col("_at") + 8 + 4 * F.col("_i")).cast("int")
    return entries.select(key, segment, uint(F.col(payload), place, 2).alias("program_number"), uint(F.col(payload), place + 2, 2).bitwiseAND(0x1FFF).cast("int").alias("pmt_pid")).filter("program_number != 0").distinct()


def _byte(b: Column, at: Column, n: int = 1) -> Column:
    return F.conv(F.hex(F.substring(b, at + 1, F.lit(n))), 16, 10).cast("int")


def program_streams(packets: DataFrame, key: str = "stream_id", segment: str = "segment_seq", order: str = "packet_no", payload: str = "payload") -> DataFrame:
    """key, segment, program_number, pmt_pid, pid, stream_type from the map tables of each segment, on the pids that the
    segment's association table names, or the latest earlier one. A table must lie in one packet. If packets has
    `discontinuity`, true in the segments that a declared discontinuity opens, no table from before one is used."""
    own = association_tables(packets, key, segment, payload).groupBy(key, segment).agg(F.collect_set(F.struct("program_number", "pmt_pid")).alias("_own"))
    held = _islands(packets, key, segment).join(own, [key, segment], "left")
    held = held.withColumn("_p", F.last("_own", ignorenulls=True).over(Window.partitionBy(key, "_island").orderBy(segment)))
    programs = held.select(key, segment, F.explode("_p").alias("_e")).select(key, segment, "_e.*")
    pmt = _tables(packets, payload).filter("_id = 2").withColumnRenamed("pid", "pmt_pid").join(programs, [key, segment, "pmt_pid"])
    first = pmt.groupBy(key, segment, "program_number", "pmt_pid").agg(F.min_by(F.struct(payload, "_at", "_len"), order).alias("t"))
    body = F.col(f"t.{payload}")
    start = (F.col("t._at") + 12 + uint(body, F.col("t._at") + 10, 2).bitwiseAND(0xFFF)).cast("int")
    end = (F.col("t._at") + 3 + F.col("t._len") - 4).cast("int")

    def walk(acc: Column, _: Column) -> Column:
        """The next entry; entries have their own length, so this is folded over the most that fit."""
        entry = F.struct(_byte(acc["b"], acc["at"]).alias("stream_type"), _byte(acc["b"], acc["at"] + 1, 2).bitwiseAND(0x1FFF).alias("pid"))
        after = acc["at"] + 5 + _byte(acc["b"], acc["at"] + 3, 2).bitwiseAND(0xFFF)
        return F.when(acc["at"] + 5 <= acc["end"], F.struct(after.alias("at"), acc["end"].alias("end"), acc["b"].alias("b"), F.concat(acc["made"], F.array(entry)).alias("made"))).otherwise(acc)

    init = F.struct(start.alias("at"), end.alias("end"), body.alias("b"), F.array().cast("array<struct<stream_type:int,pid:int>>").alias("made"))
    walked = first.withColumn("m", F.aggregate(F.sequence(F.lit(1), F.lit(36)), init, walk)["made"])
    return walked.select(key, segment, "program_number", "pmt_pid", F.explode("m").alias("e")).select(key, segment, "program_number", "pmt_pid", "e.pid", "e.stream_type")


def _islands(rows: DataFrame, key: str, segment: str) -> DataFrame:
    """key, segment, _declared and _island, one row a segment: an island begins where `discontinuity` (if rows has it)
    is true."""
    declared = F.coalesce(F.bool_or("discontinuity"), F.lit(False)) if "discontinuity" in rows.columns else F.lit(False)
    each = rows.groupBy(key, segment).agg(F.first(F.lit(True)).alias("_seen"), declared.alias("_declared")) if "discontinuity" in rows.columns else rows.select(key, segment).distinct().withColumn("_declared", declared)
    return each.withColumn("_island", F.sum(F.col("_declared").cast("int")).over(Window.partitionBy(key).orderBy(segment))).drop("_seen")


@validating
def carry_streams(segments: DataFrame, streams: DataFrame, key: str = "stream_id", segment: str = "segment_seq") -> DataFrame:
    """The stream table in force in each segment: its own, else that of the latest earlier one, but none from before a
    declared discontinuity (`discontinuity` of segments). missing_psi marks segments without their own, pid_changed those
    whose table differs from the one before. violation: latm_unsupported for a table with LATM audio; audio_pid_changed
    where the first ADTS pid is another one than in the table before; missing_adts where the table in force has no ADTS
    audio but an earlier one of its island had."""
    table = streams.groupBy(key, segment).agg(F.sort_array(F.collect_set(F.struct("program_number", "pid", "stream_type"))).alias("own"))
    w = Window.partitionBy(key, "_island").orderBy(segment)
    met = _islands(segments, key, segment).join(table, [key, segment], "left").withColumn("streams", F.last("own", ignorenulls=True).over(w))
    adts = F.get(F.filter("streams", lambda s: s["stream_type"] == STREAM_TYPES["adts"]), 0)["pid"]
    latm = F.exists("streams", lambda s: s["stream_type"] == STREAM_TYPES["latm"])
    met = met.withColumn("_adts", adts).withColumn("_had", F.last("_adts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    code = F.when(latm, "latm_unsupported").when(F.col("_had") != F.col("_adts"), "audio_pid_changed").when(F.col("_had").isNotNull() & F.col("_adts").isNull(), "missing_adts")
    return met.select(key, segment, "streams", F.col("own").isNull().alias("missing_psi"), F.coalesce(F.lag("streams").over(w) != F.col("streams"), F.lit(False)).alias("pid_changed"), code.alias("violation"))


def segment_report(packets: DataFrame, segments: DataFrame, key: str = "stream_id", segment: str = "segment_seq") -> DataFrame:
    """key, segment, packets, rejected, trailing_bytes of every segment in segments (key, segment, n_bytes): its valid and
    invalid packets (of packet_fields), and the bytes after the last whole one."""
    found = packets.groupBy(key, segment).agg(F.count_if(~F.col("rejected")).alias("packets"), F.count_if("rejected").alias("rejected"))
    return segments.select(key, segment, (F.col("n_bytes") % 188).alias("trailing_bytes")).join(found, [key, segment], "left").na.fill(0, ["packets", "rejected"])


def demux_diagnostics(packets: DataFrame, checked: DataFrame, segments: DataFrame, tables: DataFrame, streams: DataFrame, pes: DataFrame, units: DataFrame, epochs: DataFrame, key: str = "stream_id", segment: str = "segment_seq") -> DataFrame:
    """The counters of each stream of packets (packet_fields); a stream that another table lacks has 0 there.

    packets, rejected: valid and invalid packets. scrambled, duplicates, continuity_errors, flagged (discontinuity
    flags) and unit_starts come from checked (continuity_check). declared: segments that a declared discontinuity opens
    (`discontinuity` of segments, if it is there); discontinuities: these and the packets that cut units (scrambled,
    flagged or out of order), so checked is made without its `declared`. segments, trailing_bytes: from segments (key, segment, n_bytes). segments_without_pat: no row in
    tables (association_tables); segments_without_pmt: no H.264 stream in streams (program_streams); video_pid_changes:
    of the pid in force, not over a declared discontinuity. malformed_pes: units of pes (assemble_pes) without a valid header. discarded_pictures,
    dropped_dependents, emitted_units: units (damaged, emitted) that damage cut, that wait for a refresh, and the rest.
    epochs: the distinct ones of epochs (key, epoch).
    """
    def count(cond: Column | str, name: str) -> Column:
        return F.count_if(cond if isinstance(cond, Column) else F.col(cond)).alias(name)

    w = Window.partitionBy(key, "_island").orderBy(segment)
    video = streams.filter(F.col("stream_type") == STREAM_TYPES["h264"]).groupBy(key, segment).agg(F.min_by("pid", F.struct("program_number", "pid")).alias("_video"))
    seg = segments.drop("discontinuity").join(_islands(segments, key, segment), [key, segment]).join(tables.select(key, segment, F.lit(True).alias("_pat")).distinct(), [key, segment], "left").join(video, [key, segment], "left")
    seg = seg.withColumn("_held", F.last("_video", ignorenulls=True).over(w)).withColumn("_moved", F.lag("_held").over(w) != F.col("_held"))
    parts = [
        checked.groupBy(key).agg(count(F.col("scrambling") != 0, "scrambled"), count("duplicate", "duplicates"), count("continuity_error", "continuity_errors"), count("discontinuity_indicator", "flagged"), count("damaged", "discontinuities"), count("fresh", "unit_starts")),
        seg.groupBy(key).agg(F.count("*").alias("segments"), F.sum(F.col("n_bytes") % 188).alias("trailing_bytes"), count(F.col("_pat").isNull(), "segments_without_pat"), count(F.col("_video").isNull(), "segments_without_pmt"), count("_moved", "video_pid_changes"), count("_declared", "declared")),
        pes.groupBy(key).agg(count(pes_header("payload").isNull(), "malformed_pes")),
        units.groupBy(key).agg(count("damaged", "discarded_pictures"), count(~F.col("damaged") & ~F.col("emitted"), "dropped_dependents"), count(~F.col("damaged") & F.col("emitted"), "emitted_units")),
        epochs.groupBy(key).agg(F.count_distinct("epoch").alias("epochs")),
    ]
    found = packets.groupBy(key).agg(count(~F.col("rejected"), "packets"), count("rejected", "rejected"))
    for part in parts:
        found = found.join(part, key, "left")
    found = found.na.fill(0)
    return found.withColumn("discontinuities", F.col("discontinuities") + F.col("declared"))
