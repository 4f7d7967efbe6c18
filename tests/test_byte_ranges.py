import struct

import pytest
from pyspark.sql import functions as F

from reelmill.operators import playback, ranges
from reelmill.sources import byte_ranges, scans

GB = 1 << 30


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def movie(n):
    stts = box(b"stts", struct.pack(">II", 0, n) + b"".join(struct.pack(">II", 1 + i % 3, 1000 + i) for i in range(n)))
    return box(b"moov", box(b"mvhd", bytes(12) + struct.pack(">I", 600) + bytes(8)) + box(b"trak", box(b"mdia", box(b"mdhd", bytes(12) + struct.pack(">I", 90_000) + bytes(4)) + box(b"minf", box(b"stbl", stts)))))


@pytest.fixture(scope="module")
def media(tmp_path_factory):
    """A sparse movie of 5 GB whose tables lie behind its media data, a cut one, and a sparse transport stream of 5 GB."""
    at = tmp_path_factory.mktemp("media")
    with open(at / "big.mp4", "wb") as f:
        f.write(struct.pack(">I4sQ", 1, b"mdat", 5 * GB))
        f.seek(5 * GB)
        f.write(movie(40_000))
    (at / "cut.mp4").write_bytes(movie(10)[:-5])
    (at / "_hidden").write_bytes(b"x")
    ts = tmp_path_factory.mktemp("ts")
    with open(ts / "big.ts", "wb") as f:
        f.write(b"\x47" + bytes(186) + b"\x01")
        f.seek(188 * 28_000_000)
        f.write(b"\x47" + bytes(186) + b"\x02tail")
    return at, ts


def test_tables_of_a_container_larger_than_memory(spark, media):
    spark.dataSource.register(byte_ranges.ContainerTables)
    found = spark.read.format("reelmill_container").load(f"file://{media[0]}").withColumn("file", F.substring_index("file", "/", -1))
    assert {(r.file, r["table"], r.n) for r in found.filter("violation is null").groupBy("file", "table").agg(F.count("*").alias("n")).collect()} == {("big.mp4", "mvhd", 1), ("big.mp4", "mdhd", 1), ("big.mp4", "stts", 40_000)}
    assert [(r.row_no, r.v0, r.v1) for r in found.filter("table = 'stts' and row_no in (0, 39999)").orderBy("row_no").collect()] == [(0, 1, 1000), (39_999, 1, 40_999)]
    assert [(r.file, r.violation) for r in found.filter("violation is not null").collect()] == [("cut.mp4", "box_cut_off")]


def test_only_headers_and_tables_are_read():
    whole, asked = box(b"mdat", bytes(10_000_000)) + movie(5), []

    def read(at, n):
        asked.append(n)
        return whole[at : at + n]

    assert len(list(scans.sample_tables_at(read, len(whole)))) == 7
    assert sum(asked) < 600


def test_packets_by_ranges(spark, media):
    spark.dataSource.register(byte_ranges.TsRanges)
    whole = spark.read.format("reelmill_ts").option("range_packets", 7_000_000).load(f"file://{media[1]}")
    assert whole.rdd.getNumPartitions() == 5
    ends = byte_ranges._TsReader(f"file://{media[1]}", 28_000_000)
    parts = ends.partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 28_000_000), (28_000_000, 28_000_001)]
    last = next(ends.read(parts[1]))
    assert last.num_rows == 1 and last.column(2)[0].as_py()[-1] == 2 and last.column(1)[0].as_py() == 28_000_000
    first = next(ends.read(parts[0]))
    assert first.num_rows == 10_000 and first.column(2)[0].as_py()[-1] == 1 and first.column(2)[1].as_py() == bytes(188)


def test_ranges_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    points = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, *range(-30, 400)])) for i in range(400)]
    spans = [(rng.choice(["a", "a", "b"]), a := rng.randrange(-40, 390), a + rng.choice([0, 1, 7, 60, 300]), i) for i in range(60)]
    spans.append(("a", None, 5, 99))
    p = spark.createDataFrame(points, "stream_id string, id long, media_ms long").repartition(3)
    r = spark.createDataFrame(spans, "stream_id string, start_ms long, end_ms long, span long")
    pairs = {(i, s) for k, i, at in points for q, a, b, s in spans if k == q and at is not None and a is not None and a <= at < b}
    for width in (1, 16, 1000):
        assert {(x.id, x.span) for x in ranges.range_join(p, r, "stream_id", "media_ms", "start_ms", "end_ms", width).collect()} == pairs
        got = playback.audio_covers(p, r.drop("span"), width=width).collect()
        assert len(got) == len(points) and {x.id for x in got if x.covered} == {i for i, _ in pairs}
    plan = ranges.range_join(p, r, "stream_id", "media_ms", "start_ms", "end_ms", 16)._jdf.queryExecution().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
