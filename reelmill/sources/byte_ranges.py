"""Data sources that read files by byte ranges: sample tables of containers and packets of transport streams larger than
memory.

spark.dataSource.register(ContainerTables) and spark.read.format("reelmill_container").load(path) give the sample tables
of every file under path; only box headers and the tables are read, in blocks, and media data is passed over. TsRanges
(reelmill_ts) plans ranges of whole packets as partitions. Paths may be in any store that pyarrow reads (local, s3, gs,
hdfs); a path names a file or a folder, whose files are all read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reelmill.sources.scans import OUT_ROWS, PACKET, sample_tables_at


def _files(path: str) -> list[tuple[str, int]]:
    """(place, size) of the files that path names, by name; hidden ones are left out."""
    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")


class _Range(InputPartition):
    def __init__(self, source: str, place: str, start: int, stop: int) -> None:
        self.source, self.place, self.start, self.stop = source, place, start, stop

    def open(self):
        store = fs.FileSystem.from_uri(self.source)[0] if "://" in self.source or self.source.startswith("file:") else fs.LocalFileSystem()
        return store.open_input_file(self.place)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield made()
            held = []
    if held:
        yield made()


class ContainerTables(DataSource):
    """file, track, table, row_no, v0, v1, v2, violation as sources.scans.scan_sample_tables gives them, a file a task."""

    @classmethod
    def name(cls) -> str:
        return "reelmill_container"

    def schema(self) -> str:
        return "file string, track int, table string, row_no long, v0 long, v1 long, v2 long, violation string"

    def reader(self, schema) -> DataSourceReader:
        return _ContainerReader(self.options["path"])


class _ContainerReader(DataSourceReader):
    SCHEMA = pa.schema([("file", pa.string()), ("track", pa.int32()), ("table", pa.string()), *[(c, pa.int64()) for c in ("row_no", "v0", "v1", "v2")], ("violation", pa.string())])

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Range]:
        return [_Range(self.path, place, 0, size) for place, size in _files(self.path)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with part.open() as f:
            rows = sample_tables_at(lambda at, n: f.read_at(n, at), part.stop)
            yield from _batches(((part.place, *row) for row in rows), self.SCHEMA)


class TsRanges(DataSource):
    """file, packet_no, bytes of the 188-byte packets of every file; option range_packets: packets a task (about 64 MB
    unless it is given). The bytes after the last whole packet are left out (see transport.segment_report)."""

    RANGE_PACKETS = 350_000

    @classmethod
    def name(cls) -> str:
        return "reelmill_ts"

    def schema(self) -> str:
        return "file string, packet_no long, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _TsReader(self.options["path"], int(self.options.get("range_packets", self.RANGE_PACKETS)))


class _TsReader(DataSourceReader):
    SCHEMA = pa.schema([("file", pa.string()), ("packet_no", pa.int64()), ("bytes", pa.binary())])
    #: Packets that are read at once.
    STEP = 10_000

    def __init__(self, path: str, packets: int) -> None:
        self.path, self.packets = path, max(1, packets)

    def partitions(self) -> list[_Range]:
        return [_Range(self.path, place, a, min(a + self.packets, size // PACKET)) for place, size in _files(self.path) for a in range(0, size // PACKET, self.packets)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with part.open() as f:
            for a in range(part.start, part.stop, self.STEP):
                n = min(self.STEP, part.stop - a)
                data = f.read_at(n * PACKET, a * PACKET)
                packets = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PACKET), n, [None, pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part.place), n), pa.array(range(a, a + n), pa.int64()), packets], schema=self.SCHEMA)
