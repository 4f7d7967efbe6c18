"""Running values in two levels against one window, and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from reelmill.operators import clocks, pictures, playback, transport
from reelmill.operators.prefix import Scan, lagged, latest, latest_two, peak, since, total

SCHEMA = "k long, at long, block long, x long, hit boolean"


def rows(seed=5, n=400):
    rng = random.Random(seed)
    made, block = [], {}
    for i in range(n):
        k = rng.choice([1, 1, 1, 2, 3, None])
        block[k] = block.get(k, 0) + rng.choice([0, 0, 0, 0, 1, 3])
        made.append((k, i * 2, block[k], rng.choice([None, *range(-9, 10)]), rng.random() < 0.1))
    return made


def plain(data):
    out = {}
    for k in {r[0] for r in data}:
        mine = sorted(r for r in data if r[0] == k) if k is not None else sorted((r[1:] for r in data if r[0] is None))
        mine = [r[-4:] for r in mine]
        tot = top = last = None
        two, run, prev = [None, None], 0, None
        for at, _, x, hit in mine:
            before = tot, top, last, run
            if hit:
                run = 0
                before = (*before[:3], 0)
            if x is not None:
                tot, top, last, run = (tot or 0) + x, x if top is None else max(top, x), x, run + x
                two = [x, two[0]]
            out[k, at] = (tot, top, last, two[0], two[1], run, *before, prev)
            prev = (x,)
        ahead = None
        for at, _, x, _ in reversed(mine):
            ahead = x if x is not None else ahead
            out[k, at] += (ahead,)
    return out


@pytest.mark.parametrize("block", [None, "block", "at"])
def test_every_kind(spark, block):
    data = rows()
    x = F.col("x")
    scan = Scan(spark.createDataFrame(data, SCHEMA).repartition(5), ["k"], "at", block)
    scan.add(a=total(x), b=peak(x), c=latest(x), d=latest_two(x), e=since(x, F.col("hit")))
    found = scan.add(f=total(x, before=True), g=peak(x, before=True), h=latest(x, before=True), i=since(x, F.col("hit"), before=True), j=lagged(x=x), l=latest(x, ahead=True)).done()
    assert found.columns == ["k", "at", "block", "x", "hit", *"abcdefghijl"]
    want = plain(data)
    assert found.count() == len(data)
    for r in found.collect():
        two = r.d or (None, None)
        assert (r.a, r.b, r.c, two[0], two[1], r.e, r.f, r.g, r.h, r.i, r.j if r.j is None else tuple(r.j), r.l) == want[r.k, r["at"]], r


def same(one, two):
    assert one.columns == two.columns
    a, b = (sorted(map(repr, x.collect())) for x in (one, two))
    assert a == b and a


UNITS = "stream_id long, au_no long, block long, is_idr boolean, damaged boolean, anchor90k long, base90k long, lsb long, max_lsb long, is_reference boolean, delta_bottom long, op5 boolean, start_frame long, valid_frames long, pts_ms long"


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(8)
    made, lsb = [], 0
    for i in range(600):
        lsb = (lsb + rng.choice([1, 2, 3, -1, 7])) % 16
        made.append((rng.choice([0, 0, 0, 1, 2]), i, i // rng.choice([37, 40]), rng.random() < 0.05, rng.random() < 0.05, rng.choice([None, None, i * 3003 + rng.randrange(50)]), 5, lsb, 16, rng.random() < 0.6, rng.choice([-2, 0, 3]), rng.random() < 0.04, i * 100 + rng.randrange(-90, 90), rng.randrange(0, 150), i * 40))
    made = [(*r[:2], i // 37, *r[3:]) for i, r in enumerate(made)]
    return spark.createDataFrame(made, UNITS).repartition(4)


def test_units(spark, units):
    for one, two in [
        (pictures.gate_on_keyframe(units), pictures.gate_on_keyframe(units, block="block")),
        (pictures.picture_order_count(units), pictures.picture_order_count(units, block="block")),
        (pictures.picture_order_count(units.drop("op5", "delta_bottom")), pictures.picture_order_count(units.drop("op5", "delta_bottom"), block="block")),
        (pictures.keyframe_navigation(units), pictures.keyframe_navigation(units, block="block")),
        (clocks.interpolate_pts(units), clocks.interpolate_pts(units, block="block")),
        (clocks.interpolate_pts(units, base="base90k"), clocks.interpolate_pts(units, base="base90k", block="block")),
        (clocks.interpolate_pts(units.withColumn("anchor90k", F.lit(None).cast("long")), base="base90k"), clocks.interpolate_pts(units.withColumn("anchor90k", F.lit(None).cast("long")), base="base90k", block="block")),
        (playback.place_blocks(units, order="au_no", max_gap=50), playback.place_blocks(units, order="au_no", max_gap=50, block="block")),
        (playback.consecutive_runs(units, F.col("is_reference"), "stream_id", "au_no"), playback.consecutive_runs(units, F.col("is_reference"), "stream_id", "au_no", block="block")),
    ]:
        same(one, two)


def test_packets_and_nals(spark):
    rng = random.Random(2)
    counters, made = {}, []
    for i in range(900):
        pid = rng.choice([256, 256, 257])
        counters[pid] = (counters.get(pid, 0) + rng.choice([1, 1, 1, 1, 1, 1, 0, 5])) % 16
        made.append((0, pid, i, i // 90, i // 31, counters[pid], rng.random() < 0.2, rng.choice([0] * 20 + [1]), rng.random() < 0.03, True))
    packets = spark.createDataFrame(made, "stream_id long, pid long, packet_no long, segment_seq long, block long, continuity_counter long, payload_unit_start boolean, scrambling long, discontinuity_indicator boolean, has_payload boolean").repartition(3)
    for segment in (None, "segment_seq"):
        same(transport.continuity_check(packets, segment=segment), transport.continuity_check(packets, segment=segment, block="block"))
    nals = spark.createDataFrame([(rng.choice([1, 2]), i, i // 23, rng.choice([1, 1, 1, 5, 6, 7, 9, 10, 12]), rng.choice([0, 0, 3, None])) for i in range(500)], "stream_id long, nal_no long, block long, nal_type int, first_mb long")
    same(pictures.assemble_access_units(nals), pictures.assemble_access_units(nals, block="block"))


def test_as_of_in_bins(spark, units):
    rng = random.Random(4)
    asked = spark.createDataFrame([(rng.choice([0, 1, 2, 9]), rng.randrange(-500, 30_000), rng.randrange(0, 700)) for _ in range(300)], "stream_id long, target_ms long, next_no long")
    same(pictures.unit_at_or_before(asked, units), pictures.unit_at_or_before(asked, units, width=900))
    places = asked.withColumn("now_ms", F.col("target_ms"))
    same(pictures.previous_idr(places, units), pictures.previous_idr(places, units, width=50))
    anchors = asked.select("stream_id", (F.col("target_ms") * 2).alias("offset"), F.col("next_no").alias("pts90k"))
    placed = units.withColumn("first_vcl_offset", F.col("pts_ms") * 2)
    same(clocks.anchor_to_unit(anchors, placed), clocks.anchor_to_unit(anchors, placed, width=1000))
    bounds = units.filter("is_idr").select("stream_id", "pts_ms", F.col("au_no").cast("string").alias("rendition"))
    points = asked.withColumnRenamed("target_ms", "pts_ms")
    same(playback.quality_at(points, bounds, "stream_id"), playback.quality_at(points, bounds, "stream_id", width=777))


def test_one_long_stream_is_many_tasks(spark):
    """No task holds more than a few pieces of a stream of 400 000 units."""
    n = 400_000
    long = spark.range(n).select(F.lit(1).alias("stream_id"), F.col("id").alias("au_no"), F.floor(F.col("id") / 5000).alias("block"), (F.col("id") % 997 == 0).alias("is_idr"), (F.col("id") % 1009 == 5).alias("damaged"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = pictures.gate_on_keyframe(long, block="block")
        per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) == 4 and max(per_task) < 0.6 * n
        assert found.filter("emitted").count() == pictures.gate_on_keyframe(long).filter("emitted").count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def fold_epochs(each):
    """[(first, last, cadence, elapsed)] -> starts, from the rules of the timeline."""
    starts, first, last, cadence = [], None, None, None
    for a, b, own, elapsed in each:
        if last is None:
            at, jump = a, None
            first = at
        else:
            at = last + (cadence or 1)
            if elapsed is not None:
                at = max(at, first + elapsed)
            jump = at - last
        cadence = own or jump or cadence
        last = at + b - a
        starts.append(at)
    return starts


@pytest.mark.parametrize("scheduled", ["none", "some", "all"])
def test_epoch_starts_against_a_fold(spark, scheduled):
    rng = random.Random(scheduled)
    made, want, ord_ = [], {}, 0
    for stream in range(12):
        each, at = [], 0
        for epoch in range(40):
            n = rng.choice([1, 1, 2, 5]) if stream % 2 else rng.choice([2, 3])
            ticks, t = [], rng.randrange(1 << 20)
            for _ in range(n):
                ticks.append(t)
                t += rng.choice([1500, 3003, -700]) if stream % 3 else 3003
            at += rng.randrange(30_000)
            elapsed = at if scheduled == "all" or scheduled == "some" and rng.random() < 0.3 else None
            for t in ticks:
                made.append((stream, epoch, ord_, t, elapsed))
                ord_ += 1
            steps = [b - a for a, b in zip(ticks, ticks[1:], strict=False) if b > a]
            each.append((ticks[0], ticks[-1], steps[-1] if steps else None, elapsed))
        want |= {(stream, e): s for e, s in enumerate(fold_epochs(each))}
    df = spark.createDataFrame(made, "stream_id long, epoch long, ord long, src90k long, elapsed long").repartition(3)
    found = clocks.epoch_table(df, elapsed="elapsed" if scheduled != "none" else None)
    assert {(r.stream_id, r.epoch): r.timeline_start for r in found.collect()} == want


def test_a_million_epochs_of_one_stream(spark):
    n = 1_000_000
    df = spark.range(2 * n).select(F.lit(1).alias("stream_id"), F.floor(F.col("id") / 2).alias("epoch"), F.col("id").alias("ord"), ((F.col("id") % 2) * 3003).alias("src90k"), (F.floor(F.col("id") / 2) * 6000).alias("elapsed"))
    last = clocks.epoch_table(df, elapsed="elapsed").orderBy(F.desc("epoch")).first()
    assert last.timeline_start == 6006 * (n - 1)


@pytest.mark.parametrize("block", [None, "block"])
def test_throughput_against_the_recurrence(spark, block):
    rng = random.Random(9)
    made, want = [], {}
    for session, n in ((1, 1700), (2, 512), (3, 513), (4, 1)):
        fast = slow = None
        for i in range(n):
            n_bytes, us = rng.choice([0, 10, 10**6, 10**9]), rng.choice([0, 1, 10**6])
            s = n_bytes * 8.0 * 1e6 / max(us, 1)
            fast, slow = (s, s) if fast is None else (0.5 * fast + 0.5 * s, 0.8 * slow + 0.2 * s)
            made.append((session, i, i // 100, n_bytes, us))
            want[session, i] = fast, slow
    df = spark.createDataFrame(made, "session_id long, ord long, block long, n_bytes long, elapsed_us long").repartition(3)
    for r in playback.throughput_estimate(df, block=block).collect():
        assert (r.fast_bps, r.slow_bps) == pytest.approx(want[r.session_id, r.ord], rel=1e-12, abs=1e-12)
        assert r.estimate_bps == min(r.fast_bps, r.slow_bps)
