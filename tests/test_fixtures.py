"""Frozen inputs and values of the operators' reference behaviour."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelmill.functions import bytefields as B
from reelmill.functions import scalars as S
from reelmill.operators import abr, clocks, containers, manifests, pictures, playback, segments, transport
from reelmill.sources import files, scans

M = 1 << 33


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_manifests(spark):
    master = '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1800000,AVERAGE-BANDWIDTH=1650000,RESOLUTION=854x480,FRAME-RATE=29.970,CODECS="avc1.42C01F,mp4a.40.2"\nmedia.m3u8\n'
    media = "#EXTM3U\n#EXT-X-TARGETDURATION:2\n#EXT-X-MEDIA-SEQUENCE:0\n" + "".join(f"#EXTINF:{d},\ns{i}.ts\n" for i, d in enumerate(("2.002", "2.002", "2.002", "1.534867"))) + "#EXT-X-ENDLIST\n"
    df = spark.createDataFrame([("m", 0, master), ("v", 0, media), ("x", 0, media.replace("ENDLIST", "ENDLIST-NOT-REAL")), ("k", 0, "#EXT-X-KEY:METHOD=NONE\n" + media), ("g", 0, media + "#EXT-X-GAP\n"), ("e", 0, '#EXT-X-KEY:METHOD=AES-128,URI="a,b"\n' + media)], "uri string, snapshot_no int, text string")
    v = manifests.variants(df).first()
    assert (v.bandwidth, v.resolution, v.codecs, v.attrs["FRAME-RATE"]) == (1800000, "854x480", "avc1.42C01F,mp4a.40.2", "29.970")
    seg = manifests.segments(df.filter("uri = 'v'")).orderBy("sequence").collect()
    assert [s.sequence for s in seg] == [0, 1, 2, 3] and abs(sum(s.duration for s in seg) - 7.540867) < 1e-9
    told = {r.uri: (r.kind, r.is_end_list, r.unsupported) for r in manifests.audit(df).collect()}
    assert told == {"m": ("master", False, None), "v": ("media", True, None), "x": ("media", False, None), "k": ("media", True, None), "g": ("media", True, "gap"), "e": ("media", True, "encrypted")}


def test_attributes_keep_the_last_key(spark):
    got = one(spark, a=manifests.parse_attributes(F.lit('A=1, B="x,y" ,A=2,=9')))
    assert got.a == {"A": "2", "B": "x,y"}


def test_audio_selection(spark):
    df = spark.createDataFrame([("m", "low", 246440, "mp4a.40.5,avc1.42000d"), ("m", "high", 2149280, "mp4a.40.2,avc1.64001f"), ("m", "medium", 836280, "avc1.64001f, MP4A.40.2")], "master_uri string, uri string, bandwidth long, codecs string")
    c = F.col("codecs")
    assert {r.uri: (r.lc, r.he) for r in df.select("uri", manifests.advertises_aac_lc(c).alias("lc"), manifests.advertises_he_aac(c).alias("he")).collect()} == {"low": (False, True), "high": (True, False), "medium": (True, False)}
    for preferred, want in (("low", "medium"), ("high", "high")):
        assert manifests.pick_audio(df, F.col("uri") == preferred).first().uri == want


def test_segment_pairs(spark):
    def pair(video, audio, gaps=(3, 3), **options):
        make = lambda rows, g: spark.createDataFrame([("p", s, float(d), g) for s, d in rows], "playlist_uri string, sequence long, duration double, discontinuity_sequence long")
        return [r.violation for r in segments.pair_renditions(make(video, gaps[0]), make(audio, gaps[1]), **options).orderBy("sequence").collect()]

    ten = [(42, 10), (43, 10), (44, 10)]
    assert pair(ten, [(42, 10), (43, 9.95), (44, 10)], limit=2) == [None, None]
    drift = [(7, 10), (8, 10), (9, 10)], [(7, 9.7), (8, 9.7), (9, 9.7)]
    assert pair(*drift)[:2] == [None, "boundary_drift"] and pair(*drift, drift_tolerance=1) == [None] * 3
    assert pair([(1, 10)], [(1, 10)], gaps=(3, 4)) == ["discontinuity_mismatch"] and pair([(1, 10)], [(2, 10)]) == ["missing_sequence"]


def clock(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "stream_id string, ord long, raw90k long, epoch long, elapsed long")


def timeline(spark, rows):
    df = clock(spark, rows)
    src = clocks.unwrap_clock(df, keys=("stream_id", "epoch"), out="src90k")
    return [r.timeline90k for r in clocks.rebase_epochs(src, elapsed="elapsed").orderBy("ord").collect()]


def test_clocks(spark):
    for block in (None, "epoch"):
        got = clocks.unwrap_clock(clock(spark, [(M - 1800, 0, None), (1800, 1, None)]), block=block).orderBy("ord").collect()
        assert [r.unwrapped90k for r in got] == [M - 1800, M + 1800]
    assert timeline(spark, [(90000, 0, None), (93600, 0, None), (0, 1, 180000), (3600, 1, 180000)]) == [90000, 93600, 270000, 273600]
    assert timeline(spark, [(10000, 0, None), (13600, 0, None), (0, 1, 1)]) == [10000, 13600, 17200]
    assert timeline(spark, [(1000, 0, None), (M - 1000, 1, 90000), (1000, 1, 90000)])[1:] == [91000, 93000]
    video = clocks.unwrap_clock(clock(spark, [(90000, 0, None), (93600, 0, None), (50, 1, 90000)]), keys=("stream_id", "epoch"), out="src90k")
    audio = clock(spark, [(90900, 0, None), (94500, 0, None), (950, 1, None)])
    got = clocks.shared_epoch(audio, clocks.epoch_table(video, elapsed="elapsed")).orderBy("ord").collect()
    assert [(r.timeline90k, r.violation) for r in got] == [(90900, None), (94500, None), (180900, None)]
    for v, a, d in ((900000, 900909, 909), (M - 100, 50, 150), (50, M - 100, -150)):
        assert one(spark, d=S.wrap_delta(F.lit(v), F.lit(a))).d == d
    far = clocks.av_alignment(clock(spark, [(100000, 0, None)]), clock(spark, [(145001, 0, None)])).first()
    assert far.delta90k == 45001 and far.violation == "av_misaligned"


def test_two_level_clock_equals_the_window(spark):
    df = spark.range(3000).selectExpr("id % 2 as stream_id", "id as ord", "pmod(id * 1234567891, 8589934592) as raw90k", "floor(id / 100) as piece")
    plain = clocks.unwrap_clock(df).select("ord", "unwrapped90k").collect()
    assert sorted(plain) == sorted(clocks.unwrap_clock(df, block="piece").select("ord", "unwrapped90k").collect())


def test_interpolation_and_audio_clock(spark):
    df = spark.createDataFrame([("s", 0, 0), ("s", 1, None), ("s", 2, 7200), ("s", 3, None)], "stream_id string, au_no long, anchor90k long")
    got = clocks.normalize_ms(clocks.interpolate_pts(df), order="au_no").orderBy("au_no").collect()
    assert [r.pts90k for r in got] == [0, 3600, 7200, 10800] and [r.pts_ms for r in got] == [0, 40, 80, 120]
    none = clocks.interpolate_pts(spark.createDataFrame([("s", 0, None, 7), ("s", 1, None, 7)], "stream_id string, au_no long, anchor90k long, b long"), base="b").collect()
    assert [r.pts90k for r in none] == [7, 7]
    units = spark.createDataFrame([("s", i, 90000 if i == 0 else None, 1024, 44100) for i in range(3)], "stream_id string, unit_no long, anchor90k long, sample_count long, sampling_frequency long")
    assert [r.pts90k for r in clocks.frame_clock(units).orderBy("unit_no").collect()] == [90000, 92089, 94179]


def test_packets_and_pes(spark):
    h = one(spark, h=B.ts_header(F.unhex(F.rpad(F.lit("474123350180000"[:12] + "00"), 376, "F")))).h
    assert (h.valid, h.pid, h.payload_unit_start, h.continuity_counter, h.discontinuity_indicator, h.has_payload) == (True, 0x123, True, 5, True, True)
    clock33 = lambda p, prefix: bytes([prefix << 4 | (p >> 30 & 7) << 1 | 1, p >> 22 & 255, (p >> 15 & 127) << 1 | 1, p >> 7 & 255, (p & 127) << 1 | 1])
    pes = b"\0\0\1\xe0" + (8 + 3).to_bytes(2, "big") + b"\x80\x80\x05" + clock33(456, 2) + b"\1\2\3"
    got = spark.createDataFrame([(pes + b"\xff\xff",), (pes[:-1],), (b"\0\0\2" + pes[3:],), (b"",)], "b binary").select(B.pes_header("b").alias("h")).collect()
    assert got[0].h.pts90k == 456 and (pes + b"\xff\xff")[got[0].h.payload_start : got[0].h.payload_end] == b"\1\2\3"
    assert [r.h for r in got[1:]] == [None] * 3
    rows = spark.createDataFrame([("s", 1, k, cc, True, False, 0, u) for k, (cc, u) in enumerate([(0, True), (0, True), (1, False), (3, False), (4, True)])], "stream_id string, pid int, packet_no long, continuity_counter int, has_payload boolean, discontinuity_indicator boolean, scrambling int, payload_unit_start boolean")
    flags = transport.continuity_check(rows).orderBy("packet_no").collect()
    assert [r.duplicate for r in flags] == [False, True, False, False, False] and [r.continuity_error for r in flags] == [False, False, False, True, False]


def test_nal_scan_and_probe(spark):
    blocks = spark.createDataFrame([(1, bytes.fromhex("0000000001674200000168ce0000")), (2, bytes.fromhex("0000010000016580")), (3, b""), (4, b"\0\0\1")], "stream_id long, content binary")
    got = [(r.stream_id, r.start_offset, r.payload_offset, bytes(r.bytes).hex()) for r in scans.scan_annexb_nals(blocks).collect()]
    assert got == [(1, 0, 5, "6742"), (1, 7, 10, "68ce"), (2, 3, 6, "6580")]
    p = one(spark, p=B.slice_probe(F.lit(bytearray.fromhex("4188ff")))).p  # 1 000 1 000: first_mb 0, slice type 7
    assert (p.first_mb, p.slice_type) == (0, 2)


def au_numbers(spark, units):
    df = spark.createDataFrame([("s", i, t, m) for i, (t, m) in enumerate(units)], "stream_id string, nal_no long, nal_type int, first_mb long")
    out = {}
    for r in pictures.assemble_access_units(df).orderBy("nal_no").collect():
        out.setdefault(r.au_no, []).append(r.nal_type)
    return [out[k] for k in sorted(out)]


def test_access_units(spark):
    n = None
    assert au_numbers(spark, [(7, n), (8, n), (9, n), (6, n), (5, 0), (5, 1), (9, n), (1, 0), (1, 2), (7, n), (8, n), (6, n), (1, 0)]) == [[7, 8, 9, 6, 5, 5], [9, 1, 1], [7, 8, 6, 1]]
    assert au_numbers(spark, [(1, 0), (1, 1), (1, 0), (1, 2)]) == [[1, 1], [1, 1]]
    assert au_numbers(spark, [(1, n), (1, n)]) == [[1], [1]]
    assert au_numbers(spark, [(1, 0), (12, n), (10, n)]) == [[1]]


def poc(spark, rows):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "stream_id string, au_no long, lsb int, max_lsb int, is_idr boolean, is_reference boolean, delta_bottom int, op5 boolean")
    return [r.poc for r in pictures.picture_order_count(df).orderBy("au_no").collect()]


def test_picture_order(spark):
    assert poc(spark, [(0, 16, True, True, 0, False), (8, 16, False, True, 0, False), (0, 16, False, True, 0, False)]) == [0, 8, 16]
    t = (True, 0, False)
    assert poc(spark, [(0, 64, True, *t), (28, 64, False, *t), (60, 64, False, *t), (2, 64, False, False, 0, False), (4, 64, False, False, 0, False), (6, 64, False, *t)]) == [0, 28, 60, 66, 68, 70]
    assert poc(spark, [(0, 16, True, *t), (4, 16, False, True, -2, True), (3, 16, False, *t)]) == [0, 0, 3]


def adts(n, blocks=1, crc=False, rate=4, layer=0, sync=0xFFF):
    size = n + (9 + 2 * (blocks - 1) if crc else 7)
    return bytes([sync >> 4, (sync & 15) << 4 | layer << 1 | (not crc), 1 << 6 | rate << 2, 2 << 6 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 31, 0xFC | blocks - 1])


def test_audio_frames(spark):
    heads = [adts(4), adts(4, 2, True), adts(4, sync=0xFFE), adts(4, layer=1), adts(4, rate=13), adts(4)[:3] + b"\0\0\0\0"]
    got = [r.h for r in spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, b binary").orderBy("i").select(B.adts_header("b").alias("h")).collect()]
    assert (got[0].sampling_frequency, got[0].header_length, got[0].frame_length, got[0].sample_count, got[0].channel_config, got[0].object_type) == (44100, 7, 11, 1024, 2, 2)
    assert (got[1].header_length, got[1].sample_count) == (11, 2048) and got[2:] == [None] * 4
    blocks = spark.createDataFrame([(1, b"\xaa\xbb" + adts(4) + b"abcd" + adts(4) + b"efgh" + adts(4) + b"x")], "stream_id long, content binary")
    assert [(r.byte_offset, r.frame_length) for r in scans.scan_adts_frames(blocks).collect()] == [(2, 11), (13, 11)]


def test_container_tables(spark):
    word = lambda *x: b"".join((v & 0xFFFFFFFF).to_bytes(4, "big") for v in x)
    box = lambda kind, body: word(len(body) + 8) + kind.encode() + body
    stbl = box("stbl", box("stts", word(0, 1, 2, 1024)) + box("ctts", word(1 << 24, 2, 1, -10, 1, 5)) + box("stsc", word(0, 1, 1, 2, 1)) + box("stsz", word(0, 0, 2, 3, 4)) + box("stco", word(0, 1, 777)))
    movie = box("ftyp", b"isom") + box("moov", box("trak", box("mdia", box("mdhd", word(0, 0, 0, 44100, 0)) + box("minf", stbl))))
    tables = scans.scan_sample_tables(spark.createDataFrame([("f", movie)], "file string, content binary")).cache()
    pick = lambda t: tables.filter(F.col("table") == t)
    assert pick("mdhd").first().v0 == 44100
    runs = lambda t, v: pick(t).select("file", "track", F.col("row_no").alias("run_no"), F.col("v0").alias("count"), F.col("v1").alias(v))
    dts = containers.expand_runs(runs("stts", "delta"))
    ctts = containers.expand_runs(runs("ctts", "ctts"), "ctts", running=None)
    sizes = pick("stsz").select("file", "track", F.col("row_no").alias("sample_no"), F.col("v0").alias("size"))
    chunks = pick("stco").select("file", "track", (F.col("row_no") + 1).alias("chunk_no"), F.col("v0").alias("chunk_offset"))
    steps = pick("stsc").select("file", "track", F.col("v0").alias("first_chunk"), F.col("v1").cast("int").alias("samples_per_chunk"))
    offsets = containers.sample_offsets(sizes, containers.chunk_samples(steps, chunks))
    got = containers.presentation_times(dts.join(ctts, ["file", "track", "sample_no"]).withColumn("timescale", F.lit(44100))).join(offsets, ["file", "track", "sample_no"]).orderBy("sample_no").collect()
    assert [(r.size, r.offset, r.dts, r.pts, r.violation) for r in got] == [(3, 777, 0, -10, None), (4, 780, 1024, 1029, None)]


def test_pcm(spark):
    place = lambda rows, **o: playback.place_blocks(spark.createDataFrame([("s", i, a, v) for i, (a, v) in enumerate(rows)], "stream_id string, unit_no long, start_frame long, valid_frames long"), **o).orderBy("unit_no").collect()
    got = place([(0, 2), (4, 2), (5, 2)])
    assert [r.gap for r in got] == [0, 2, 0] and [r.written for r in got] == [2, 2, 1] and got[-1].end_frame == 7
    assert place([(-2, 4), (2, 2)])[-1].end_frame == 4
    assert place([(0, 2), (100, 2)], max_gap=50)[1].violation == "gap_too_long"
    window = playback.retained_window(spark.createDataFrame([("s", 6)], "stream_id string, end_frame long"), 10, 0.6, 8, 2).first()
    assert (window.first_available, window.available) == (2, 4)
    assert one(spark, t=S.frame_to_us(F.lit(2), 10, 500000)).t == 700000
    values = spark.createDataFrame([(float(x),) for x in (-2, -1, 0, 1, 2, "nan")], "x double").select(S.float_to_pcm16("x").alias("y")).collect()
    assert [r.y for r in values] == [-32768, -32768, 0, 32767, 32767, 0]


def snapshots(spark, rows, start=0):
    made = []
    for n, (first, count, *rest) in enumerate(rows, start):
        change = dict(rest[0]) if rest else {}
        for s in range(first, first + count):
            made.append(("p", n, first, change.get("gap", 0), change.get("target", 4), s, s - first, change.get("uri", f"s{s}"), 4.0, 0))
    return spark.createDataFrame(made, "playlist_uri string, snapshot_no long, media_sequence long, window_discontinuity long, target_duration long, sequence long, ordinal long, segment_uri string, duration double, discontinuity_sequence long")


@pytest.mark.parametrize(("rows", "violation"), [
    ([(100, 6), (101, 6, {"target": 5})], "target_duration_changed"),
    ([(100, 6), (103, 5)], None), ([(100, 6), (110, 3)], "expired_gap"), ([(100, 6), (99, 6)], "rewind"), ([(100, 6), (101, 3)], "rewind"),
    ([(100, 6, {"gap": 2}), (101, 6, {"gap": 1})], "discontinuity_rewind"), ([(100, 6), (101, 6, {"uri": "other"})], "mutation"),
])
def test_live_snapshots(spark, rows, violation):
    from reelmill.streaming import folds

    df = snapshots(spark, rows)
    assert segments.live_violations(df).first().violation == violation
    held = F.struct("sequence", "segment_uri", "duration", "discontinuity_sequence")
    whole = df.groupBy("playlist_uri", "snapshot_no").agg(F.min("media_sequence").alias("media_sequence"), F.min("window_discontinuity").alias("window_discontinuity"), F.min("target_duration").alias("target_duration"), F.sort_array(F.collect_list(held)).alias("segments"), F.lit(False).alias("is_end_list"))
    out = folds.fold(whole, folds.LiveSegments, "playlist_uri", "snapshot_no", folds.SEGMENTS_OUT).collect()
    assert [r.sequence for r in out if r.kind == "segment"][:3] == [103, 104, 105]
    assert [r.violation for r in out if r.kind == "failed"] == ([violation] if violation else [])
    if violation is None:
        assert [r.sequence for r in out] == [103, 104, 105, 106, 107]


def test_contiguous_window(spark):
    assert segments.contiguous_window(snapshots(spark, [(0, 3)])).first().violation is None
    assert segments.contiguous_window(snapshots(spark, [(0, 3, {"target": 0})])).first().violation == "bad_target_duration"
    assert segments.contiguous_window(snapshots(spark, [(0, 300)])).first().violation == "window_too_large"
    assert segments.contiguous_window(snapshots(spark, [(0, 3)]).filter("sequence != 1")).first().violation == "sequence_gap"


def sample(kind, **values):
    from types import SimpleNamespace

    return SimpleNamespace(**{"kind": kind, "n_bytes": 0, "elapsed_us": 1, "segment_us": None, "video_ms": 0, "audio_ms": None, "playing": True, "starved": False, "lateness_ms": 0} | values)


def test_controller():
    buffer, late = (lambda v, a=None, starved=False: sample("buffer", video_ms=v, audio_ms=a, starved=starved)), (lambda ms: sample("playback", lateness_ms=ms))
    fetch = lambda n, us, d=None: sample("download", n_bytes=n, elapsed_us=us, segment_us=d)
    c = abr.Controller([250_000, 500_000, 1_500_000], 2)
    c.step(buffer(12_000, 11_000))
    moves = [c.step(fetch(200_000, 100_000, 2_000_000)) for _ in range(8)]
    assert [m[1] if m else None for m in moves] == [None, None, None, 1, None, None, None, 2]
    assert c.step(late(220))[1] == 1
    assert [c.step(late(240)) for _ in range(2)] == [None, None] and c.step(late(240))[1] == 0
    d = abr.Controller([250_000, 500_000, 1_500_000], 2, index=2)
    assert d.step(buffer(0, starved=True))[1] == 0
    assert all(d.step(fetch(200_000, 100_000)) is None for _ in range(8))
    assert all(d.step(buffer(12_000)) is None for _ in range(8)) and not d.constrained
    assert [d.step(fetch(200_000, 100_000)) for _ in range(4)][-1][1] == 1
    e = abr.Controller([250_000, 500_000, 1_500_000], 1)
    e.step(buffer(12_000))
    assert {m[1] for m in (e.step(fetch(900_000, 100_000)) for _ in range(20)) if m} == {1}


def test_qoe(spark):
    rows = [("video_starved", 1000), ("video_starved", 1100), ("buffer_recovered", 1750), ("audio_underrun", 2000), ("buffer_recovered", 2300), ("buffer_recovered", 2400), ("presented", 2500)]
    df = spark.createDataFrame([("s", i, k, m, r) for i, ((k, m), r) in enumerate(zip(rows, (1, 12, 9, 3, 2, 1, 0), strict=True))], "session_id string, ord long, kind string, media_ms long, resident_units long")
    got = playback.rebuffer_episodes(df).orderBy("episode").collect()
    assert [(r.rebuffer_ms, r.starvations, r.underruns) for r in got] == [(750, 1, 0), (300, 0, 1)]
    total = playback.qoe_summary(df).first()
    assert (total.rebuffer_count, total.rebuffer_ms, total.recoveries, total.peak_resident_units, total.presentation_updates) == (2, 1050, 2, 12, 1)


def test_batch_equals_incremental(spark):
    """A step object fed in many pieces gives what it gives at once."""
    import pickle
    import random

    from reelmill.streaming import folds

    rng = random.Random(6)
    kinds = ["video_starved", "audio_underrun", "buffer_recovered", "presented"]
    frame = pd.DataFrame([{"ord": i, "kind": rng.choice(kinds), "media_ms": 100 * i + rng.randrange(90)} for i in range(500)])
    for make in (folds.Episodes, folds.Throttle):
        whole = list(_run(make(), frame))
        step, parts = make(), []
        at = 0
        while at < len(frame):
            n = rng.randint(1, 40)
            parts += list(_run(step, frame.iloc[at : at + n]))
            step, at = pickle.loads(pickle.dumps(step)), at + n
        assert parts == whole and whole


def _run(step, frame):
    for x in frame.itertuples(index=False):
        yield from step.take(x)


def test_byte_caps(spark, tmp_path):
    (tmp_path / "a.m3u8").write_bytes(b"#EXTM3U\n")
    (tmp_path / "b.m3u8").write_bytes(b"#" * 100)
    got = {r.uri.rsplit("/", 1)[1]: (r.text, r.violation) for r in files.read_manifests(spark, str(tmp_path), max_bytes=50).collect()}
    assert got == {"a.m3u8": ("#EXTM3U\n", None), "b.m3u8": (None, "playlist_too_large")}
    assert {r.violation for r in files.read_segments(spark, str(tmp_path), 50).collect()} == {None, "segment_too_large"}
    files.write_timeline(spark.range(3).withColumn("sealed", F.col("id") == 2), f"{tmp_path}/out", ("sealed",))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_small_scalars(spark):
    got = one(spark, s=S.scale_ticks(F.lit(-3), 2, 1), t=S.scale_ticks(F.lit(90001), 90000, 44100), e=S.nearest_epoch_offset(F.lit(100), F.lit(M + 50)), f=S.nearest_epoch_offset(F.lit(M - 5), F.lit(3)), r=S.retry_backoff_ms(F.lit(9)), d=S.refresh_delay_us(F.lit(4), F.lit(False), F.lit(5)))
    assert (got.s, got.t, got.e, got.f, got.r, got.d) == (-2, 44100, M, -M, 4000, 0)


def test_byte_tails_do_not_depend_on_cuts():
    """Units found block by block, wherever the blocks are cut, are those of the whole stream."""
    import random

    from reelmill.sources import scans
    from reelmill.streaming import folds

    rng = random.Random(3)
    nals = b"".join(rng.choice([b"\0\0\1", b"\0\0\0\1", b"\0\0\0\0\1"]) + bytes(rng.choice([0, 1, 3, 65, 200]) for _ in range(rng.randrange(6))) for _ in range(60))
    adts = b""
    for _ in range(40):
        n = 7 + rng.randrange(30)
        adts += bytes(rng.choice([0xFF, 0xF1, 7]) for _ in range(rng.randrange(4))) + bytes([0xFF, 0xF1, 0x50, 0x80 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 31, 0xFC]) + bytes(rng.choice([0xFF, 0xF1, 1]) for _ in range(n - 7))
    for data, make, whole in (
        (nals, folds.NalCarry, [(s, nals[p:e]) for s, p, e in scans.nal_offsets(nals)]),
        (adts, folds.AdtsCarry, [(p, adts[p : p + n]) for p, n in scans.adts_frames(adts)[0]]),
    ):
        for _ in range(40):
            cuts = sorted(rng.sample(range(len(data)), rng.randrange(1, 30)))
            step, got = make(), []
            for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
                got += step.take(sample("", content=data[a:b], last=b == len(data)))
            assert [(s, u) for _, s, u in got] == whole and [k for k, *_ in got] == list(range(len(whole)))


def test_a_declared_discontinuity_drops_the_tail():
    from reelmill.streaming import folds

    step = folds.NalCarry()
    assert list(step.take(sample("", content=b"\0\0\1Aa\0\0\1Ab"))) == [(0, 0, b"Aa")]
    assert list(step.take(sample("", content=b"cc\0\0\1Ad", discontinuity=True, last=True))) == [(1, 12, b"Ad")]


def test_picture_tails_equal_the_batch_form(spark):
    import random

    from reelmill.streaming import folds

    rng = random.Random(9)
    rows = [(0, i, rng.choice([1, 1, 1, 2, 5, 6, 7, 8, 9, 10, 12, 3, 19]), rng.choice([0, 0, 3, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "stream_id long, nal_no long, nal_type long, first_mb long")
    want = pictures.assemble_access_units(df).groupBy("au_no").agg(F.min("nal_no").alias("a"), F.count("*").alias("n"), F.bool_or(F.col("nal_type") == 5).alias("idr"))
    step, got = folds.PictureCarry(), []
    for _, i, t, m in rows:
        got += step.take(sample("", nal_no=i, nal_type=t, first_mb=m, last=i == 399))
    assert got == sorted((r.au_no, r.a, r.n, r.idr) for r in want.collect())


def test_long_units_are_not_dropped():
    from reelmill.streaming import folds

    step = folds.PesCarry()
    packet = lambda k, data, start=False, last=False: sample("", packet_no=k, payload=data, payload_unit_start=start, continuity_counter=k % 16, discontinuity_indicator=False, scrambling=0, last=last)
    out = list(step.take(packet(0, b"\0\0\1" + bytes(1 << 20), True)))
    for k in range(1, 36):
        out += step.take(packet(k, bytes(1 << 20), last=k == 35))
    assert [(f, n, len(data)) for f, n, data in out] == [(0, 36, 3 + 36 * (1 << 20))]


def test_demux_counters(spark):
    from reelmill.operators import transport

    head = lambda n, scr, cc: bytes([0x47, 0x41 if n == 0 else 0x01, 0x00, scr << 6 | 0x10 | cc]) + b"\0\0\1\xe0" + bytes(180)
    data = [(0, 0, head(0, 0, 0)), (0, 1, head(1, 2, 1)), (0, 2, head(2, 0, 2)), (0, 3, head(3, 0, 9)), (0, 4, b"\x48" + head(4, 0, 10)[1:])]
    packets = transport.packet_fields(spark.createDataFrame(data, "stream_id long, packet_no long, bytes binary"))
    checked = transport.continuity_check(packets)
    seg = spark.createDataFrame([(0, 0, 941), (0, 1, 188), (0, 2, 188)], "stream_id long, segment_seq long, n_bytes long")
    tables = spark.createDataFrame([(0, 0, 1, 4096), (0, 2, 1, 4096)], "stream_id long, segment_seq long, program_number long, pmt_pid int")
    streams = spark.createDataFrame([(0, 0, 1, 256, 0x1B), (0, 2, 1, 258, 0x1B), (0, 2, 1, 259, 0x0F)], "stream_id long, segment_seq long, program_number long, pid int, stream_type int")
    units = spark.createDataFrame([(0, True, False), (0, False, False), (0, False, True), (0, False, True)], "stream_id long, damaged boolean, emitted boolean")
    epochs = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "stream_id long, epoch long")
    pes = spark.createDataFrame([(0, b"\0\0\1\xe0\0\0\0\0\0")], "stream_id long, payload binary")
    got = transport.demux_diagnostics(packets, checked, seg, tables, streams, pes, units, epochs).first().asDict()
    assert got == {"stream_id": 0, "packets": 4, "rejected": 1, "scrambled": 1, "duplicates": 0, "continuity_errors": 1, "flagged": 0, "discontinuities": 2, "unit_starts": 1, "segments": 3, "trailing_bytes": 1, "segments_without_pat": 1, "segments_without_pmt": 1, "video_pid_changes": 1, "declared": 0, "malformed_pes": 1, "discarded_pictures": 1, "dropped_dependents": 1, "emitted_units": 2, "epochs": 2}
    found = transport.carry_streams(seg, streams.union(spark.createDataFrame([(0, 1, 1, 300, 0x11)], streams.schema))).orderBy("segment_seq").collect()
    assert [r.violation for r in found] == [None, "latm_unsupported", None]


def test_pictures_of_a_finished_stream_stay_linear():
    """No window looks to the end of its partition from each row."""
    import pathlib

    for path in pathlib.Path(pictures.__file__).parent.glob("*.py"):
        assert "unboundedFollowing" not in path.read_text(), path


def test_merged_rows_of_a_key_are_together(spark):
    """Also where both sides are dealt by the key already and have been coalesced in different ways."""
    from pyspark.sql import Window

    from reelmill.operators.rows import merged

    dealt = lambda n: spark.range(n).withColumn("key", F.col("id") % 7).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    both = merged([dealt(5000), dealt(50).filter("k > 3")], "key").withColumn("n", F.count("*").over(Window.partitionBy("key")))
    want = {k: sum(1 for i in range(5000) if i % 7 == k) + sum(1 for i in range(50) if i % 7 == k) - 3 for k in range(7)}
    assert {(r.key, r.n) for r in both.select("key", "n").distinct().collect()} == set(want.items())
