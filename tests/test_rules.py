"""Rules over bad rows: none ends a job, each is told, and strict mode raises it inside the plan."""

import re
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelmill.functions import bytefields as B
from reelmill.operators import abr, clocks, containers, manifests, parameter_sets, pictures, playback, segments, transport
from reelmill.plans import queries as media
from reelmill.sources import scans
from reelmill.sources.files import SealedTimeline, new_folder
from reelmill.streaming import folds

SNAP = "playlist_uri long, snapshot_no long, media_sequence long, window_discontinuity long, target_duration long, sequence long, duration double, segment_uri string, discontinuity_sequence long"


def window(key, no, first=0, n=3, target=5, gap=0, **change):
    made = [[key, no, first, gap, target, first + i, 2.0, f"u{first + i}", 0] for i in range(n)]
    for name, (i, v) in change.items():
        made[i][SNAP.split(", ").index(next(c for c in SNAP.split(", ") if c.startswith(name + " ")))] = v
    return [tuple(r) for r in made]


CASES = {
    1: (window(1, 0, sequence=(1, 7)), "sequence_gap"), 2: (window(2, 0, target=-1), "bad_target_duration"), 3: (window(3, 0, duration=(2, 0.0)), "bad_duration"),
    4: (window(4, 0, duration=(0, None)), "bad_duration"), 5: (window(5, 0, target=None), "bad_target_duration"), 6: (window(6, 0, first=-2), "negative_sequence"), 7: (window(7, 0, n=257), "window_too_large"),
    8: (window(8, 0) + window(8, 1, 1, target=6), "target_duration_changed"), 9: (window(9, 0, 4) + window(9, 1, 2), "rewind"), 10: (window(10, 0, gap=1) + window(10, 1, 1), "discontinuity_rewind"),
    11: (window(11, 0) + window(11, 1, 9), "expired_gap"), 12: (window(12, 0) + window(12, 1, 1, segment_uri=(0, "other")), "mutation"), 13: (window(13, 0) + window(13, 1, 1), None), 14: (window(14, 0, sequence=(0, None)), "sequence_gap"),
}


def test_live_rules_in_batch_and_in_order(spark):
    df = spark.createDataFrame([r for rows, _ in CASES.values() for r in rows], SNAP).repartition(3)
    assert {r.playlist_uri: r.violation for r in segments.live_violations(df).collect()} == {k: v for k, (_, v) in CASES.items()}
    whole = df.groupBy("playlist_uri", "snapshot_no").agg(
        *[F.min(c).alias(c) for c in ("media_sequence", "window_discontinuity", "target_duration")],
        F.expr("collect_list(struct(sequence, segment_uri, duration, discontinuity_sequence)) as segments"),
    ).selectExpr("*", "false as is_end_list")
    failed = {r.playlist_uri: r.violation for r in folds.fold(whole, folds.LiveSegments, "playlist_uri", "snapshot_no", folds.SEGMENTS_OUT).filter("kind = 'failed'").collect()}
    assert failed == {k: v for k, (_, v) in CASES.items() if v}


def test_strict_mode_raises_inside_the_plan(spark):
    df = spark.createDataFrame([r for rows, v in CASES.values() if v in (None, "mutation") for r in rows], SNAP)
    lazy = segments.live_violations(df, strict=True)
    with pytest.raises(Exception, match="mutation at playlist_uri=12"):
        lazy.select("snapshots").collect()
    good = df.filter("playlist_uri = 13")
    assert segments.live_violations(good, strict=True).collect() == segments.live_violations(good).collect()
    with pytest.raises(Exception, match="box_cut_off"):
        scans.scan_mp4_boxes(spark.createDataFrame([(1, b"\0\0\0\x40moov")], "file long, content binary"), strict=True).collect()


def test_no_table_survives_a_declared_discontinuity(spark):
    seg = spark.createDataFrame([(0, i, i == 2) for i in range(5)], "stream_id long, segment_seq long, discontinuity boolean")
    streams = spark.createDataFrame([(0, 0, 1, 256, 27), (0, 0, 1, 257, 15), (0, 3, 1, 300, 27)], "stream_id long, segment_seq long, program_number long, pid int, stream_type int")
    found = {r.segment_seq: (None if r.streams is None else [s.pid for s in r.streams], r.pid_changed, r.violation) for r in transport.carry_streams(seg, streams).collect()}
    assert found == {0: ([256, 257], False, None), 1: ([256, 257], False, None), 2: (None, False, None), 3: ([300], False, None), 4: ([300], False, None)}
    kept = {r.segment_seq: (r.streams[0].pid, r.pid_changed, r.violation) for r in transport.carry_streams(seg.drop("discontinuity"), streams).collect()}
    assert kept[2] == (256, False, None) and kept[3] == (300, True, "missing_adts")


def test_equal_rows_of_a_batch_stay(spark):
    rows = spark.createDataFrame([(0, 1, 5), (0, 1, 5), (0, 2, 6)], "stream_id long, segment_seq long, au_no long")
    assert sorted(tuple(r) for r in pictures.concat_batches([rows]).collect()) == [(0, 1, 5, 0), (0, 1, 5, 0), (0, 2, 6, 1)]
    assert pictures.concat_batches([rows, rows], identity=("stream_id", "segment_seq", "au_no")).count() == 2


def test_versions_of_a_set_id(spark):
    pps = spark.createDataFrame([(0, 0, 10, 0), (0, 0, 11, 4)], "stream_id long, pps_id long, sps_id long, nal_no long")
    sps = spark.createDataFrame([(0, 10), (0, 11), (0, 11)], "stream_id long, sps_id long")
    slices = spark.createDataFrame([(0, 0, 1), (0, 0, 9), (0, 5, 9)], "stream_id long, pps_id long, nal_no long")
    asof = sorted((r.nal_no, r.pps_id, r.sps_id, r.violation or "") for r in parameter_sets.resolve(slices, pps, sps).collect())
    assert asof == [(1, 0, 10, ""), (9, 0, 11, ""), (9, 5, None, "missing_pps")]
    late = spark.createDataFrame([(0, 0, -1)], "stream_id long, pps_id long, nal_no long")
    assert parameter_sets.resolve(late, pps, sps).first().violation == "missing_pps"
    last = sorted((r.pps_id, r.sps_id) for r in parameter_sets.resolve(slices.drop("nal_no"), pps, sps).filter("sps_id is not null").collect())
    assert last == [(0, 11), (0, 11)]
    assert parameter_sets.last_version(pps, ["stream_id", "pps_id"]).first().sps_id == 11


def test_reads_of_evicted_frames(spark):
    held = playback.retained_window(spark.createDataFrame([("s", 100)], "stream_id string, end_frame long"), 10, 4.0, 1 << 20, 2)
    reads = spark.createDataFrame([("s", f) for f in (-1, 0, 59, 60, 99, 100)] + [("t", 5)], "stream_id string, start_frame long")
    assert [r.status for r in playback.read_status(reads, held).orderBy("stream_id", "start_frame").collect()] == ["negative", "evicted", "evicted", "available", "available", "pending", "unknown_stream"]


SAMPLE = "session_id long, ord long, kind string, n_bytes long, elapsed_us long, segment_us long, video_ms long, audio_ms long, playing boolean, starved boolean, lateness_ms long, rung long"


def sample(i, kind, **fields):
    names = [c.split()[0] for c in SAMPLE.split(", ")]
    return tuple({"session_id": 1, "ord": i, "kind": kind, **fields}.get(n) for n in names)


def test_manual_rungs_and_lacking_fields(spark):
    rows = [sample(0, "selection", rung=2), sample(1, "buffer", video_ms=0, starved=True), sample(2, "selection", rung=9), sample(3, "selection"), sample(4, "download", n_bytes=None, elapsed_us=1), sample(5, "buffer"), sample(6, "playback"), sample(7, "what"), sample(8, None), sample(9, "selection", rung=1), sample(10, "failure")]
    df = spark.createDataFrame(rows, SAMPLE)
    moves = [(r.ord, r.from_index, r.to_index, r.reason) for r in abr.abr_decisions(df, [100, 200, 300]).orderBy("ord").collect()]
    assert moves == [(0, 0, 2, "manual"), (3, 2, 0, "automatic"), (9, 0, 1, "manual")]
    told = {r.ord: r.violation for r in abr.sample_violations(df).filter("violation is not null").collect()}
    assert told == {4: "missing_n_bytes", 5: "missing_video_ms", 6: "missing_lateness_ms", 7: "unknown_kind", 8: "unknown_kind"}
    step, was = abr.Abr([100, 200, 300]), None
    step.restore(step.state())
    assert step.state() == abr.Abr([100, 200, 300]).state() and was is None


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_broken_containers_are_rows(spark):
    deep = b""
    for _ in range(1500):
        deep = box(b"udta", deep)
    cases = {
        "short": box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", b"")))), "deep": deep, "cut": box(b"free", b"") + struct.pack(">I4s", 4000, b"moov") + b"xx",
        "claims": box(b"stbl", box(b"stts", struct.pack(">IIII", 0, 9, 1, 2))), "sizes": box(b"stbl", box(b"stsz", struct.pack(">III", 0, 7, 60_000))), "empty": b"", "none": None,
    }
    df = spark.createDataFrame(list(cases.items()), "file string, content binary")
    rows = scans.scan_sample_tables(df).collect()
    assert {(r.file, r.table, r.violation) for r in rows if r.violation} == {("short", "mdhd", "box_too_short"), ("deep", "udta", "nested_too_deep"), ("cut", "moov", "box_cut_off"), ("claims", "stts", "entries_cut_off")}
    assert sum(r.file == "sizes" and r.v0 == 7 for r in rows) == 60_000
    assert scans.scan_mp4_boxes(df).filter("violation is null").groupBy("file").count().count() == 5


def test_sealed_timeline(spark):
    schema = "playlist_uri long, kind string, sequence long"
    at = SealedTimeline(new_folder(spark, "timeline"))
    put = lambda rows, n: at.commit(spark.createDataFrame(rows, schema), n)
    assert at.rows(spark, schema).count() == 0
    put([(1, "segment", 0), (2, "segment", 0), (1, "sealed", None)], 0)
    put([(1, "segment", 1), (2, "segment", 1), (2, "failed", None)], 1)
    put([(1, "segment", 1), (2, "segment", 1), (2, "failed", None)], 1)  # a replay
    put([(1, "segment", 0), (2, "segment", 0), (1, "sealed", None)], 0)
    put([(2, "segment", 9), (3, "segment", 0)], 2)
    assert sorted((r.playlist_uri, r.kind, r.sequence or 0, r.batch, r.seal or "open") for r in at.rows(spark, schema).collect()) == [(1, "sealed", 0, 0, "sealed"), (1, "segment", 0, 0, "sealed"), (2, "failed", 0, 1, "failed"), (2, "segment", 0, 0, "failed"), (2, "segment", 1, 1, "failed"), (3, "segment", 0, 2, "open")]
    assert sorted((r.playlist_uri, r.sequence, r.batch, r.violation_of_seal) for r in at.refused(spark, schema).collect()) == [(1, 1, 1, "write_after_seal"), (2, 9, 2, "write_after_seal")]


def test_a_stream_into_a_sealed_timeline(spark):
    schema = "playlist_uri long, kind string, sequence long"
    source, marks, at = new_folder(spark, "source"), new_folder(spark, "marks"), SealedTimeline(new_folder(spark, "timeline"))
    for rows in ([(1, "segment", 0), (1, "sealed", None)], [(1, "segment", 1), (2, "segment", 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        at.write_stream(spark.readStream.schema(schema).parquet(source), marks).awaitTermination(60)
    assert {(r.playlist_uri, r.batch) for r in at.rows(spark, schema).collect()} == {(1, 0), (2, 1)}
    assert [r.playlist_uri for r in at.refused(spark, schema).collect()] == [1]


def test_of_anchors_at_one_offset_the_last_to_come_wins(spark):
    units = spark.createDataFrame([(1, 20, 0), (1, 40, 1), (1, 60, 2)], "stream_id long, first_vcl_offset long, au_no long")
    anchors = spark.createDataFrame([(1, 10, 5, 2), (1, 10, 9, 1), (1, 30, 7, 3), (1, 30, 8, 4), (1, 50, 3, 5), (1, 55, None, 6)], "stream_id long, offset long, pts90k long, came long")
    got = lambda **how: {r.au_no: r.pts90k for r in clocks.anchor_to_unit(anchors, units, **how).collect()}
    assert got(order="came") == got(order="came", width=16) == {0: 5, 1: 8, 2: 3}
    assert got() == {0: 9, 1: 8, 2: 3}


def test_probe_reads_codes_beyond_the_format_where_asked(spark):
    ue = lambda v: "0" * ((v + 1).bit_length() - 1) + f"{v + 1:b}"
    for first in ((1 << 32) - 2, (1 << 32) - 1, 5_999_999_000, (1 << 62) + 5):
        bits = ue(first) + ue(7) + ue(3) + "1"
        bits += "0" * (-len(bits) % 8)
        data = bytearray(b"\x41" + re.sub(rb"\0\0(?=[\0-\3])", b"\0\0\3", int(bits, 2).to_bytes(len(bits) // 8, "big")))
        r = spark.range(1).select(B.slice_probe(F.lit(data)).alias("format"), B.slice_probe(F.lit(data), 62).alias("wide")).first()
        assert tuple(r.wide) == (first, 2, 3)
        assert (r.format is None) == (first > (1 << 32) - 2)


def test_rows_of_many_small_files_leave_together():
    free, names, kinds = b"\0\0\0\x08free", ["file", "path", "start"], [pa.string(), pa.int64()]
    found = lambda data: ((path, start) for path, start, *_ in scans.boxes(data))
    batch = pa.RecordBatch.from_arrays([pa.array([*range(3000), None]), pa.array([free * (k % 3) if k % 5 else None for k in range(3001)], pa.binary())], ["file", "_content"])
    made = list(scans.batches_of([batch], ["file"], found, names, kinds))
    assert len(made) == 1
    want = [(None if k == 3000 else k, "/free", 8 * i) for k in range(3001) if k % 5 for i in range(k % 3)]
    assert [tuple(r.values()) for r in made[0].to_pylist()] == want
    large = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([free * (scans.OUT_ROWS + 1), free], pa.binary())], ["file", "_content"])
    assert [len(b) for b in scans.batches_of([large], ["file"], found, names, kinds)] == [scans.OUT_ROWS, 2]


def test_segments_are_sorted_once_and_extinf_holds_for_the_next_uri_only(spark):
    text = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXTINF:1.5,\n#EXT-X-DISCONTINUITY\n#EXTINF:bad,\na\n\nb\n#EXTINF:2,\n#EXTINF:3,\n# note\nc\n#EXT-X-MEDIA-SEQUENCE:20\n#EXT-X-DISCONTINUITY-SEQUENCE:9\nd\n"
    found = manifests.segments(spark.createDataFrame([("m", 0, text)], "uri string, snapshot_no int, text string"))
    rows = [(r.ordinal, r.sequence, r.segment_uri, r.duration, r.discontinuity_sequence) for r in found.orderBy("ordinal").collect()]
    assert rows == [(0, 7, "a", 1.5, 1), (1, 8, "b", 0.0, 1), (2, 9, "c", 3.0, 1), (3, 20, "d", 0.0, 9)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window ") == 2
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


@pytest.mark.parametrize("name", ["parse_segments", "manifest_audit", "presentation_times"])
def test_a_large_table_is_dealt_to_more_tasks(spark, sf_dir, monkeypatch, name):
    whole = sorted(tuple(r) for r in media.QUERIES[name](spark, sf_dir).collect())
    monkeypatch.setattr(media.V, "TASK_ROWS", 250)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert media.V.table(spark, sf_dir, "lineitem", True).rdd.getNumPartitions() == rows // 250 > 8
    assert media.V.table(spark, sf_dir, "lineitem").rdd.getNumPartitions() < 8
    made = media.QUERIES[name](spark, sf_dir)
    assert f"{rows // 250}), REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in made.collect()) == whole


def test_samples_are_not_sorted_for_their_edits(spark):
    samples = spark.createDataFrame([(1, 1, 0, 0, 44_100), (1, 1, 1, 441, 44_100), (2, 1, 0, 5, 44_100)], "file long, track long, sample_no long, dts long, timescale long").withColumn("ctts", F.lit(0))
    made = containers.presentation_times(samples, spark.createDataFrame([(1, 1, 10)], "file long, track long, edit_offset long"))
    assert sorted((r.file, r.sample_no, r.pts) for r in made.collect()) == [(1, 0, 10), (1, 1, 451), (2, 0, 5)]
    assert "ShuffledHashJoin" in made._jdf.queryExecution().executedPlan().toString()


def test_probe_tables_are_read_once_and_rules_see_the_last_version(spark):
    from reelmill.plans import media_queries  # noqa: F401

    plan = media.QUERIES["compatibility_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 6  # the views hold two tables twice
    assert plan.count("Join") == 1
    flags = "pps_id long, is_idr boolean, slice_type long, nal_ref_idc long, cabac_init_idc long, weight_table boolean, modified_lists boolean, poc_lsb long, l0_active long, l1_active long, redundant_pic_cnt long, long_term_reference boolean, adaptive_marking boolean, marking_ops array<int>"
    slices = spark.createDataFrame([(v, i, d, t, 1, 0, w, None, 1, 1, 1, 0, None, False, []) for v, i, d, t, w in [(1, 0, True, 2, None), (1, 0, False, 0, False), (1, 5, False, 1, None), (2, None, True, 2, None), (3, 0, False, 1, None)]], f"variant_uri long, {flags}")
    pps = spark.createDataFrame([(v, i, n, s, c, True, 2, False, None, 1) for v, i, n, s, c in [(1, 0, 1, 7, False), (1, 0, 9, 0, True), (2, 0, 1, 3, True), (3, 0, 1, None, None)]], "variant_uri long, pps_id long, nal_no long, sps_id long, cabac boolean, weighted_pred boolean, weighted_bipred_idc long, transform_8x8 boolean, pps_scaling boolean, slice_groups long")
    sps = spark.createDataFrame([(v, i, 100, 1, False, 8, 8, True, False, True, 0) for v, i in [(1, 0), (3, None)]], "variant_uri long, sps_id long, profile_idc long, chroma_format long, separate_planes boolean, bit_depth_luma long, bit_depth_chroma long, frame_mbs_only boolean, sps_scaling boolean, direct_8x8 boolean, poc_type long")
    segments = spark.createDataFrame([(v, v != 5, v < 5, True, True, True) for v in (1, 2, 3, 4, 5, 6)], "variant_uri long, is_end_list boolean, has_segment boolean, has_pat boolean, has_pmt boolean, has_h264 boolean")
    got = {r.variant_uri: (r.reasons, r.compatible, r.pending) for r in parameter_sets.probe_audit(segments, slices, pps, sps).collect()}
    assert got == {
        1: (["missing_pps", "p_without_weights"], False, False), 2: (["missing_sps"], False, False), 3: (["missing_sps"], False, False),
        4: (["no_pps"], False, False), 5: ([], True, True), 6: (["empty_media"], False, False),
    }


def test_packets_are_made_and_read_once(spark):
    made = F.unhex(F.concat(F.lit("470100"), F.lpad(F.hex(16 + F.col("id") % 16), 2, "0"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 5), F.lit("FF" * 24)))
    packets = transport.packet_fields(spark.range(40).select(F.lit(0).alias("stream_id"), F.col("id").alias("packet_no"), made.alias("bytes")))
    checked = transport.continuity_check(packets)
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    assert checked.filter("not damaged and continuity_counter = packet_no % 16").count() == 40
    for data in (b"", b"\x47", b"\x47\x41", b"\x47\x41\x05", None):  # what lies beyond the end is not told
        r = spark.range(1).select(B.ts_header(F.lit(data).cast("binary")).alias("h")).first().h
        assert (r.valid, r.pid, r.payload_unit_start, r.has_payload) == (False, 0x105 if data and len(data) == 3 else None, True if data and len(data) > 1 else None, None)
