"""Byte scans of media files: transport packets, NAL units, audio frames, container boxes.

Arrow tasks only find offsets; fields are column expressions of reelmill.functions.bytefields over the found bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.functions.strict import validating

PACKET = 188
OUT_ROWS = 20_000
#: Bytes of contents after which their rows leave.
OUT_BYTES = 1 << 24
#: Boxes that hold boxes.
CONTAINERS = {"moov", "trak", "mdia", "minf", "stbl", "edts", "dinf", "moof", "traf", "udta"}
TABLES = ("stts", "ctts", "stsc", "stco")


def batches_of(batches: Iterable[pa.RecordBatch], keys: list[str], found: Callable[[bytes], Iterator[tuple]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The keys and what `found` yields of the content that follows them; rows of many small contents leave together."""
    for batch in batches:
        contents, place = batch.column(len(keys)), batch.select(keys)
        of: list[int] = []  # the content of each row
        rows: list[tuple] = []
        read = 0

        def leave() -> pa.RecordBatch:
            same = place.take(pa.array(of, pa.int32())).columns
            made = pa.RecordBatch.from_arrays(same + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            of.clear()
            rows.clear()
            return made

        for i in range(len(batch)):
            data = contents[i].as_py()
            for row in found(data) if data else ():
                of.append(i)
                rows.append(row)
                if len(rows) == OUT_ROWS:
                    yield leave()
            read += len(data or b"")
            if rows and read >= OUT_BYTES:
                yield leave()
                read = 0
        if rows:
            yield leave()


def _scan(files: DataFrame, keys: list[str], content: str, found: Callable[[bytes], Iterator[tuple]], columns: str) -> DataFrame:
    """keys and what `found` yields of each content; null contents give nothing. Rows leave in bounded batches."""
    chosen = files.select(*keys, F.col(content).alias("_content"))
    schema = ", ".join([f"{k} {chosen.schema[k].dataType.simpleString()}" for k in keys] + [columns])
    names = keys + [c.split()[0] for c in columns.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]
    return chosen.mapInArrow(lambda batches: batches_of(batches, keys, found, names, kinds), schema)


def scan_ts_packets(segments: DataFrame, keys: tuple[str, ...] = ("stream_id", "segment_seq"), content: str = "content") -> DataFrame:
    """keys, packet_no, bytes: the 188-byte records of each segment. Trailing bytes: length modulo 188."""

    def found(data: bytes) -> Iterator[tuple]:
        for k in range(len(data) // PACKET):
            yield k, data[k * PACKET : (k + 1) * PACKET]

    return _scan(segments, list(keys), content, found, "packet_no long, bytes binary")


def nal_offsets(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, payload, end) of Annex-B units: start codes of two or more zeros and a one; trailing zeros belong to no
    unit, empty units are dropped."""
    b = np.frombuffer(data, np.uint8)
    ones = np.flatnonzero((b[2:] == 1) & (b[1:-1] == 0) & (b[:-2] == 0)) + 2 if len(b) > 2 else np.zeros(0, np.int64)
    last = np.maximum.accumulate(np.where(b != 0, np.arange(len(b)), -1)) if len(b) else b
    starts = last[ones - 1] + 1 if len(ones) else ones
    ends = np.append(starts[1:], last[-1] + 1 if len(b) else 0)
    for s, one, e in zip(starts.tolist(), ones.tolist(), ends.tolist(), strict=False):
        if e > one + 1:
            yield s, one + 1, e


def nal_open(data: bytes) -> int:
    """Where the unit begins that no later start code has closed; without a start code, where one may have begun."""
    at = data.rfind(b"\0\0\1")
    if at < 0:
        return len(data.rstrip(b"\0"))
    while at > 0 and data[at - 1] == 0:
        at -= 1
    return at


def scan_annexb_nals(blocks: DataFrame, keys: tuple[str, ...] = ("stream_id",), content: str = "content") -> DataFrame:
    """keys, nal_no, start_offset, payload_offset, end_offset, bytes of the units of each elementary stream."""
    return _scan(blocks, list(keys), content, lambda data: ((k, s, p, e, data[p:e]) for k, (s, p, e) in enumerate(nal_offsets(data))), "nal_no long, start_offset long, payload_offset long, end_offset long, bytes binary")


def adts_frames(data: bytes, final: bool = True) -> tuple[list[tuple[int, int]], int]:
    """(offset, frame length) of whole ADTS frames; what is no valid header is skipped up to the next sync word. Then
    where the rest begins: a frame that goes on after data is skipped if data is final, else it is the rest."""
    b = np.frombuffer(data, np.uint8)
    sync = np.flatnonzero((b[:-1] == 0xFF) & (b[1:] & 0xF6 == 0xF0)) if len(b) > 1 else np.zeros(0, np.int64)
    found, at, k = [], 0, 0
    while k < len(sync):
        p = int(sync[k])
        if p < at:
            k = int(np.searchsorted(sync, at))
            continue
        if p + 7 > len(data):
            if not final:
                return found, p
            break
        n = (data[p + 3] & 3) << 11 | data[p + 4] << 3 | data[p + 5] >> 5
        if n >= (7 if data[p + 1] & 1 else 9) and (data[p + 2] >> 2 & 15) < 13:
            if p + n <= len(data):
                found.append((p, n))
                at = p + n
            elif not final:
                return found, p
        k += 1
    # a last byte may be half a sync word
    return found, len(data) if final or not data or data[-1] != 0xFF or at == len(data) else len(data) - 1


def scan_adts_frames(blocks: DataFrame, keys: tuple[str, ...] = ("stream_id",), content: str = "content") -> DataFrame:
    """keys, unit_no, byte_offset, frame_length, header (7 bytes) of the audio frames of each elementary stream."""
    return _scan(blocks, list(keys), content, lambda data: ((k, p, n, data[p : p + 7]) for k, (p, n) in enumerate(adts_frames(data)[0])), "unit_no long, byte_offset long, frame_length long, header binary")


#: Boxes lie at most so deep.
MAX_DEPTH = 32


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int, int, str | None]]:
    """(path, start, body, end, violation) of all boxes of data; see boxes_at."""
    return boxes_at(lambda at, n: data[at : at + n], start, len(data) if end is None else end)


def boxes_at(read: Callable[[int, int], bytes], start: int, end: int, only: frozenset[str] = frozenset(CONTAINERS)) -> Iterator[tuple[str, int, int, int, str | None]]:
    """(path, start, body, end, violation) of all boxes between two offsets, from their headers alone: read(at, n) gives n
    bytes. Size 1 has 64 bits, size 0 reaches to the end. A box that leaves its parent (box_cut_off) ends its level; what
    lies deeper than MAX_DEPTH is not looked into (nested_too_deep). only: the boxes whose inside is walked."""
    levels = [(start, end, "")]
    while levels:
        start, end, path = levels.pop()
        if start + 8 > end:
            continue
        head = read(start, min(16, end - start))
        n, kind = struct.unpack_from(">I4s", head)
        name, body = f"{path}/{kind.decode('latin-1')}", start + 8
        if n == 1 and len(head) == 16:
            n, body = struct.unpack_from(">Q", head, 8)[0], start + 16
        stop = end if n == 0 else start + n
        if stop > end or stop < body:
            yield name, start, body, end, "box_cut_off"
            continue
        inside = kind.decode("latin-1") in only
        deep = inside and len(levels) + 1 >= MAX_DEPTH
        yield name, start, body, stop, "nested_too_deep" if deep else None
        levels.append((stop, end, path))
        if inside and not deep:
            levels.append((body, stop, name))


@validating
def scan_mp4_boxes(files: DataFrame, keys: tuple[str, ...] = ("file",), content: str = "content") -> DataFrame:
    """keys, path, box_start, body_start, box_end, violation of every box."""
    return _scan(files, list(keys), content, boxes, "path string, box_start long, body_start long, box_end long, violation string")


#: Entries of a table that are read at once.
ENTRIES = 1 << 14


def _table_rows(read: Callable[[int, int], bytes], track: int, kind: str, body: int, end: int) -> Iterator[tuple]:
    """The rows of one table box: (track, table, row_no, v0, v1, v2, violation)."""
    bad = lambda code: (track, kind, None, None, None, None, code)
    head = read(body, min(40, end - body))
    if len(head) < 8:
        yield bad("box_too_short")
        return
    version = head[0]
    if kind in ("mdhd", "mvhd"):
        at = 20 if version == 1 else 12
        yield (track, kind, 0, struct.unpack_from(">I", head, at)[0], None, None, None) if at + 4 <= len(head) else bad("box_too_short")
        return
    form, at, count = {"stts": ">II", "ctts": ">Ii" if version else ">II", "stsc": ">III", "stco": ">I", "co64": ">Q", "stsz": ">I", "elst": ">Qqi" if version == 1 else ">Iii"}[kind], body + 8, struct.unpack_from(">I", head, 4)[0]
    if kind == "stsz":
        if len(head) < 12:
            yield bad("box_too_short")
            return
        fixed, count, at = count, struct.unpack_from(">I", head, 8)[0], body + 12
        if fixed:
            # equal sizes are claimed, not stored: they cost no bytes, and rows leave in batches
            yield from ((track, kind, k, fixed, None, None, None) for k in range(count))
            return
    step = struct.calcsize(form)
    there = min(count, (end - at) // step)
    for first in range(0, there, ENTRIES):
        block = read(at + step * first, step * min(ENTRIES, there - first))
        for k, v in enumerate(struct.iter_unpack(form, block), first):
            v = (*v[:2], v[2] >> 16) if kind == "elst" else v
            yield (track, "stco" if kind == "co64" else kind, k, *v, *[None] * (3 - len(v)), None)
    if there < count:
        yield bad("entries_cut_off")


def sample_tables(data: bytes) -> Iterator[tuple]:
    """(track, table, row_no, v0, v1, v2, violation) of the sample tables of data; see sample_tables_at."""
    return sample_tables_at(lambda at, n: data[at : at + n], len(data))


def sample_tables_at(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple]:
    """(track, table, row_no, v0, v1, v2, violation) of the sample tables; track counts trak boxes from 1, 0 is the movie.
    A broken box gives a row with a violation, and the walk goes on behind it. Media data is passed over unread."""
    track = 0
    for path, _, body, end, violation in boxes_at(read, 0, size):
        kind = path.rsplit("/", 1)[1]
        track += kind == "trak"
        if violation:
            yield track, kind, None, None, None, None, violation
        elif kind in ("mdhd", "stsz", "co64", "elst", *TABLES):
            yield from _table_rows(read, track, kind, body, end)
        elif kind == "mvhd":
            yield from _table_rows(read, 0, kind, body, end)


@validating
def scan_sample_tables(files: DataFrame, keys: tuple[str, ...] = ("file",), content: str = "content") -> DataFrame:
    """keys, track, table, row_no, v0, v1, v2, violation: stts (count, delta), ctts (count, offset), stsc (first chunk,
    samples, description), stsz (size), stco (offset), elst (duration, media time, rate), mdhd and mvhd (time scale). A
    broken box is a row with a violation (box_too_short, entries_cut_off, box_cut_off, nested_too_deep)."""
    return _scan(files, list(keys), content, sample_tables, "track int, table string, row_no long, v0 long, v1 long, v2 long, violation string")
