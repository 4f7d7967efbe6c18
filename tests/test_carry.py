"""Tails and resets of a transport stream over segments, whole and cut anywhere, and the state between triggers."""

import json
import random
from collections import namedtuple
from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelmill.operators import transport
from reelmill.sources.files import new_folder
from reelmill.streaming import folds
from reelmill.streaming.steps import fold_stream


def row(no, counter, start=False, payload=b"", segment=0, **more):
    return SimpleNamespace(packet_no=no, continuity_counter=counter, payload_unit_start=start, payload=payload, segment_seq=segment, scrambling=more.pop("scrambling", 0), discontinuity_indicator=more.pop("flag", False), **more)


def run(make, rows):
    step, out = make(), []
    for x in rows:
        out += list(step.take(x))
    return out


def run_in_pieces(make, rows):
    """A new step object for every row, with the state of the last one."""
    out, was = [], make().state()
    for x in rows:
        step = make()
        step.restore(was)
        out += list(step.take(x))
        was = step.state()
    return out


PES = b"\0\0\1"


def test_counters_may_restart_with_a_segment():
    rows = [row(0, 0, True, PES + b"a", 0), row(1, 1, False, b"b", 0), row(2, 0, True, PES + b"c", 1), row(3, 1, False, b"d", 1, last=True)]
    assert [(f, n, p[3:]) for f, n, p in run(folds.PesCarry, rows)] == [(0, 2, b"ab"), (2, 2, b"cd")]
    # the same counters inside a segment, or without a unit at its start, are damage
    rows[2].payload_unit_start = False
    assert run(folds.PesCarry, rows) == []
    for x in rows:
        x.segment_seq = 0
    rows[2].payload_unit_start = True
    assert [p[3:] for *_, p in run(folds.PesCarry, rows)] == [b"cd"]


def test_a_declared_discontinuity_cuts_the_open_unit():
    rows = [row(0, 0, True, PES + b"a", 0), row(1, 1, True, PES + b"c", 1, discontinuity=True), row(2, 2, False, b"d", 1, discontinuity=True, last=True)]
    assert [p[3:] for *_, p in run(folds.PesCarry, rows)] == [b"cd"]


def packets(seed):
    rng = random.Random(seed)
    counter, made = 0, []
    for i in range(700):
        segment = i // 40
        counter = rng.choice([0, 7]) if i % 40 == 0 and rng.random() < 0.5 else (counter + rng.choice([1] * 12 + [0, 3])) % 16
        start = rng.random() < 0.3 or i % 40 == 0 and rng.random() < 0.8
        made.append((0, 256, i, segment, counter, start, rng.choice([0] * 25 + [1]), rng.random() < 0.03, segment % 5 == 3, True, (PES if start and rng.random() < 0.9 else b"") + bytes([i % 256]), i == 699))
    return made


NAMES = "stream_id pid packet_no segment_seq continuity_counter payload_unit_start scrambling discontinuity_indicator discontinuity has_payload payload last".split()


@pytest.mark.parametrize("seed", range(4))
def test_carried_units_equal_the_batch_form(spark, seed):
    made = packets(seed)
    df = spark.createDataFrame(made, "stream_id long, pid long, packet_no long, segment_seq long, continuity_counter int, payload_unit_start boolean, scrambling int, discontinuity_indicator boolean, discontinuity boolean, has_payload boolean, payload binary, last boolean").repartition(3)
    checked = transport.continuity_check(df, segment="segment_seq", declared="discontinuity", block="segment_seq")
    batch = {(r.first_packet, r.n_packets, bytes(r.payload)) for r in transport.assemble_pes(checked).collect()}
    rows = [SimpleNamespace(**dict(zip(NAMES, r, strict=True))) for r in made]
    whole = run(folds.PesCarry, rows)
    assert set(whole) == batch and len(whole) == len(batch) > 30
    assert run_in_pieces(folds.PesCarry, rows) == whole


def pts_bytes(v):
    return bytes([0x21 | v >> 29 & 14, v >> 22 & 255, v >> 14 & 254 | 1, v >> 7 & 255, v << 1 & 254 | 1])


def ts_rows(units, segments, damage=(), declared=(), per=11):
    """Packets of PES units (elementary bytes, pts), some in each segment; counters restart in every segment."""
    made, no = [], 0
    for k, (content, pts) in enumerate(units):
        body = PES + b"\xe0\0\0\x80" + (b"\x80\5" + pts_bytes(pts) if pts is not None else b"\0\0") + content
        for i in range(0, len(body), per):
            segment = segments[k]
            first = not made or made[-1].segment_seq != segment
            counter = 0 if first else (made[-1].continuity_counter + 1) % 16
            made.append(row(no, counter, i == 0, body[i : i + per], segment, discontinuity=segment in declared, unit=k))
            no += 1
    made = [x for x in made if x.packet_no not in damage]
    made[-1].last = True
    return made


SPS, PPS, AUD, IDR, P = (b"\0\0\1" + x for x in (b"\x67\x64\0\x1f\xe0", b"\x68\xe0", b"\x09\x10", b"\x65\x88\x11\x22", b"\x41\x9a\x33"))


def test_pictures_with_resets_of_every_kind():
    gop = [AUD + SPS + PPS + IDR, AUD + P, AUD + P + P[:3] + b"\x41\x4a\x55"]
    units = [(g, 1000 * i) for i, g in enumerate(gop * 4)]
    plain = run(folds.ElementaryCarry, ts_rows(units, [i // 3 for i in range(12)]))
    assert [(p[0], p[3], p[5], p[6]) for p in plain] == [(i, i % 3 == 0, True, 1000 * i) for i in range(12)]
    assert [p[2] for p in plain] == [4, 2, 3] * 4 and all(p[4] for p in plain)

    # a lost packet in the second picture of the second group: it goes, the rest waits for the refresh, sets stay
    rows = ts_rows(units, [i // 3 for i in range(12)])
    lost = [x.packet_no for x in rows if x.unit == 4][1]
    cut = run(folds.ElementaryCarry, ts_rows(units, [i // 3 for i in range(12)], damage={lost}))
    times = {p[6]: p for p in cut}
    assert 4000 not in times and not times[5000][5] and times[5000][4] and times[6000][5] and times[6000][4]

    # a declared discontinuity in front of a group without sets: pictures from there on know no sets
    bare = [(g.replace(SPS, b"").replace(PPS, b"") if i >= 6 else g, t) for i, (g, t) in enumerate(units)]
    assert all(p[4] for p in run(folds.ElementaryCarry, ts_rows(bare, [i // 3 for i in range(12)])))
    told = run(folds.ElementaryCarry, ts_rows(bare, [i // 3 for i in range(12)], declared={2}))
    # the unit that is open at the break goes, and the picture whose last NAL unit it would have closed
    assert [(p[6], p[4], p[5]) for p in told] == [(t, t < 6000, True) for t in range(0, 12000, 1000) if t not in (4000, 5000)]


@pytest.mark.parametrize("per", [5, 11, 184])
def test_pictures_do_not_depend_on_the_cuts(per):
    rng = random.Random(per)
    whole = b"".join(rng.choice([AUD + SPS + PPS + IDR, AUD + P, P, AUD + IDR, b"\0\0\0\1\x06\x01" + P]) for _ in range(60))
    at, units = 0, []
    while at < len(whole):
        n = rng.randrange(1, 30)
        units.append((whole[at : at + n], rng.choice([None, at * 90])))
        at += n
    rows = ts_rows(units, [i // 7 for i in range(len(units))], damage={30, 31, 90}, declared={3}, per=per)
    want = run(folds.ElementaryCarry, rows)
    assert run_in_pieces(folds.ElementaryCarry, rows) == want and len(want) > 20


def test_a_malformed_unit_is_damage():
    units = [(AUD + SPS + PPS + IDR, 0), (AUD + P, 1000), (AUD + P, 2000), (AUD + IDR, 3000)]
    rows = ts_rows(units, [0] * 4, per=184)
    rows[1].payload = rows[1].payload[:6] + b"\0" + rows[1].payload[7:]
    assert [(p[6], p[5]) for p in run(folds.ElementaryCarry, rows)] == [(2000, False), (3000, True)]


def test_steps_survive_their_own_state(spark):
    rng = random.Random(3)
    snap = [SimpleNamespace(snapshot_no=i, media_sequence=i, window_discontinuity=0, target_duration=5, is_end_list=i == 30, segments=[{"sequence": i + k, "segment_uri": f"u{i + k}", "duration": 2.0, "discontinuity_sequence": 0} for k in range(4)]) for i in range(31)]
    assert run_in_pieces(folds.LiveSegments, snap) == run(folds.LiveSegments, snap) and run(folds.LiveSegments, snap)[-1][1] == "sealed"
    for field in ("target_duration", "media_sequence"):
        bad = SimpleNamespace(**{**vars(snap[0]), field: None})
        assert run(folds.LiveSegments, [bad])[-1][1] == "failed"
    events = [SimpleNamespace(ord=i, media_ms=i * 100 if rng.random() < 0.9 else None, kind=rng.choice(["video_starved", "audio_underrun", "buffer_recovered", "x"])) for i in range(200)]
    for make in (folds.Throttle, folds.Episodes):
        some = [e for e in events if e.media_ms is not None] if make is folds.Episodes else events
        assert run_in_pieces(make, some) == run(make, some)


def test_only_touched_keys_are_written_and_a_restart_goes_on(spark):
    """Two runs over one checkpoint; the second touches one key of 400."""
    rows = lambda keys, no: spark.createDataFrame([(k, no, "buffer_recovered" if no % 2 else "video_starved", no * 10) for k in keys], "session_id long, ord long, kind string, media_ms long").coalesce(1)
    source, sink, marks = (new_folder(spark, n) for n in ("source", "sink", "marks"))

    def once():
        stream = spark.readStream.schema("session_id long, ord long, kind string, media_ms long").parquet(source)
        q = fold_stream(stream, folds.Episodes, "session_id", "ord", folds.EPISODES_OUT, lanes=4).writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(sink)
        q.awaitTermination(100)
        return [s for p in q.recentProgress for s in json.loads(p.json)["stateOperators"]]

    rows(range(400), 0).write.mode("append").parquet(source)
    first = once()[0]["numRowsUpdated"]
    rows([7], 1).write.mode("append").parquet(source)
    second = sum(s["numRowsUpdated"] for s in once())
    assert first >= 400 and second <= 2
    assert [(r.session_id, r.start_ms, r.end_ms) for r in spark.read.parquet(sink).collect()] == [(7, 0, 10)]


def test_a_silent_playlist_is_cancelled(spark):
    source, sink, marks = (new_folder(spark, n) for n in ("source", "sink", "marks"))
    schema = "playlist_uri long, snapshot_no long, media_sequence long, window_discontinuity long, target_duration long, is_end_list boolean, segments array<struct<sequence: long, segment_uri: string, duration: double, discontinuity_sequence: long>>"
    spark.createDataFrame([(1, 0, 0, 0, 5, False, [(0, "a", 1.0, 0)]), (2, 0, 0, 0, 5, True, [(0, "b", 1.0, 0)])], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    made = fold_stream(stream, folds.LiveSegments, "playlist_uri", "snapshot_no", folds.SEGMENTS_OUT, lanes=1, idle_ms=1500)
    q = made.writeStream.format("parquet").option("checkpointLocation", marks).trigger(processingTime="500 milliseconds").start(sink)
    try:
        for _ in range(60):
            q.awaitTermination(1)
            state = [s["numRowsTotal"] for p in q.recentProgress for s in json.loads(p.json)["stateOperators"]]
            got = sorted((r.playlist_uri, r.kind, r.violation or "") for r in spark.read.schema(made.schema).parquet(sink).collect()) if state else []
            if len(got) >= 4 and state[-1] == 0:
                break
    finally:
        q.stop()
    assert got == [(1, "cancelled", "idle"), (1, "segment", ""), (2, "sealed", ""), (2, "segment", "")]
    assert state[-1] == 0


def test_start_decision_equals_the_batch_functions(spark):
    rng = random.Random(6)
    made = []
    for stream in range(30):
        for i in range(25):
            made.append((stream, i, rng.random() < 0.3, rng.random() < 0.2, rng.random() < 0.2, stream % 4 != 0, rng.choice([None, 1]) if stream % 5 == 0 else None, rng.random() < 0.03))
    df = spark.createDataFrame(made, "stream_id long, ord long, new_segment boolean, is_idr boolean, audio_ready boolean, has_audio boolean, total_segments long, audio_failed boolean").repartition(3)
    df = df.withColumn("total_segments", F.max("total_segments").over(Window.partitionBy("stream_id")))
    want = {r.stream_id: r for r in folds.audio_decision(df, folds.readiness(df)).collect()}
    rows = {}
    for r in sorted(df.collect(), key=lambda r: (r.stream_id, r.ord)):
        rows.setdefault(r.stream_id, []).append(namedtuple("X", r.asDict())(**r.asDict()))
    for k, w in want.items():
        got = run(folds.StartDecision, rows[k])
        if w.ready_at is None and w.failed_at is None:
            assert not got
            continue
        last = got[-1]
        if w.decision == "failed":
            assert last[1:] == ("failed", w.ready_at, w.failed_at) and sum(g[1] == "failed" for g in got) == 1
        else:
            assert last[1] == w.decision and last[2] == w.ready_at
        assert run_in_pieces(folds.StartDecision, rows[k]) == got


class FakeMap(dict):
    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = tuple(value)

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class FakeHandle:
    def __init__(self):
        self.map = FakeMap()

    def getMapState(self, *_):
        return self.map

    def listTimers(self):
        return iter([1])

    def registerTimer(self, _):
        pass


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_a_shelf_is_read_and_written_once_and_keeps_its_other_keys():
    import pandas as pd

    from reelmill.streaming.steps import SHELF, _Steps

    steps, handle = _Steps(lambda: folds.Throttle(1000), "session_id", "long", "ord", ["session_id", "ord", "media_ms"], 50), FakeHandle()
    steps.init(handle)

    def trigger(now, *rows):
        frame = pd.DataFrame([(*r, r[0] % 2) for r in rows], columns=["session_id", "ord", "media_ms", SHELF])
        return [tuple(r) for f in steps.handleInputRows((0,), iter([frame]), At(now)) for r in f.itertuples(index=False)]

    assert len(trigger(10, *[(k, 1, 0) for k in range(100)])) == 100
    assert handle.map.calls == 4
    assert trigger(40, (3, 2, 999), (4, 2, 1000)) == [(4, 2, 1000)]
    assert sorted(e[0] for shelf in handle.map.values() for e in shelf[0]) == list(range(100))
    assert [e[1] for shelf in handle.map.values() for e in shelf[0] if e[0] in (3, 4, 5)].count(40) == 2
    list(steps.handleExpiredTimer((0,), At(70), None))
    assert sorted(e[0] for shelf in handle.map.values() for e in shelf[0]) == [3, 4]
    list(steps.handleExpiredTimer((0,), At(100), None))
    assert not handle.map
