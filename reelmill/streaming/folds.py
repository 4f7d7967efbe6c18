"""Stateful operators of ordered streams: one pure step object each, shared by the batch and the streaming form.

A step object takes the rows of its key in order and yields output rows; reelmill.streaming.steps runs it over tables and
streams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.operators.abr import DECISIONS, Abr  # noqa: F401  the controller as a step object
from reelmill.operators.segments import LIVE_RULES, MAX_WINDOW
from reelmill.operators.transport import PACKET_RULES
from reelmill.sources.scans import adts_frames, nal_offsets, nal_open
from reelmill.streaming.steps import fold, fold_stream  # noqa: F401


def _flag(x, name: str) -> bool:
    """A column that may be absent or null, as a plain truth."""
    v = getattr(x, name, False)
    return False if pd.isna(v) else bool(v)


def _whole(v, missing: int | None = None) -> int | None:
    return missing if pd.isna(v) else int(v)


class Step:
    """A step object whose state is the attributes that STATE names, in their order."""

    STATE = ""

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.STATE.split(", ")]

    def state(self) -> tuple:
        return tuple(getattr(self, n) for n in self._names())

    def restore(self, was: tuple) -> None:
        for name, v in zip(self._names(), was, strict=True):
            setattr(self, name, v)

    def expire(self) -> Iterator[tuple]:
        """What a key gives when it has been silent for too long."""
        return iter(())


SEGMENTS_OUT = "snapshot_no long, kind string, sequence long, segment_uri string, violation string"


class LiveSegments(Step):
    """Snapshots of a live playlist -> each sequence once, in order, then one terminal row (sealed, failed or, after
    silence, cancelled).

    A row is a snapshot: snapshot_no, media_sequence, window_discontinuity, target_duration, is_end_list and segments (a
    list of structs sequence, segment_uri, duration, discontinuity_sequence). The first snapshot with segments gives its
    newest hold_back ones. Nothing follows a terminal row. The last MAX_WINDOW segments are remembered. A null target
    duration, sequence or duration is a bad one and fails the playlist.
    """

    STATE = "ended boolean, emitted long, window array<long>, known array<struct<sequence: long, segment_uri: string, duration: double, discontinuity_sequence: long>>"

    def __init__(self, hold_back: int | None = 3) -> None:
        self.hold_back, self.ended = hold_back, False
        self.was: tuple | None = None  # target, first, last and discontinuity of the last window
        self.emitted: int | None = None
        self.known: dict[int, tuple] = {}

    def state(self) -> tuple:
        return self.ended, self.emitted, None if self.was is None else list(self.was), [] if self.ended else [(k, *v) for k, v in self.known.items()]

    def restore(self, was: tuple) -> None:
        self.ended, self.emitted = bool(was[0]), _whole(was[1]) if was[1] is not None else None
        self.was = None if was[2] is None else tuple(int(x) for x in was[2])
        self.known = {int(r[0]): (r[1], r[2], r[3]) for r in (was[3] if was[3] is not None else [])}

    def expire(self) -> Iterator[tuple]:
        if not self.ended:
            yield None, "cancelled", None, None, "idle"

    def _window(self, x) -> SimpleNamespace:
        """The snapshot as the rules see it; without a window before, it is compared with itself."""
        segments = sorted((s for s in (x.segments if x.segments is not None else [])), key=lambda s: _whole(s["sequence"], -1))
        held = {_whole(s["sequence"], -1): (s["segment_uri"], None if s["duration"] is None else float(s["duration"]), _whole(s["discontinuity_sequence"])) for s in segments}
        first, order = _whole(x.media_sequence, -1), [_whole(s["sequence"], -1) for s in segments]
        now = SimpleNamespace(
            target_duration=_whole(x.target_duration, -1), media_sequence=first, discontinuity_sequence=_whole(x.window_discontinuity, -1), held=held, window_count=len(order), window_last=order[-1] if order else first - 1,
            has_gap=order != list(range(first, first + len(order))), has_bad_duration=not all(v[1] is not None and 0 < v[1] < float("inf") for v in held.values()),
            changes_known=any(self.known.get(k, v) != v for k, v in held.items()), emitted=first if self.emitted is None else self.emitted,
        )
        now.as_was = now.target_duration, now.media_sequence, now.window_last, now.discontinuity_sequence
        now.was_target, now.was_first, now.was_last, now.was_gap = self.was or now.as_was
        return now

    def take(self, x) -> Iterator[tuple]:
        if self.ended:
            return
        now = self._window(x)
        broken = next((name for name, holds in LIVE_RULES.items() if holds(now)), None)
        if broken is None:
            fresh = [k for k in sorted(now.held) if self.emitted is None or k > self.emitted]
            if self.emitted is None and self.hold_back is not None:
                fresh = fresh[-self.hold_back :]
            for k in fresh:
                yield x.snapshot_no, "segment", k, now.held[k][0], None
            self.emitted = fresh[-1] if fresh else self.emitted
            self.known = dict(sorted((now.held | self.known).items())[-MAX_WINDOW:])
            self.was = now.as_was
        self.ended = broken is not None or _flag(x, "is_end_list")
        if self.ended:
            yield x.snapshot_no, "failed" if broken else "sealed", None, None, broken


EPISODES_OUT = "episode long, start_ms long, end_ms long, rebuffer_ms long, starvations long, underruns long"


class Episodes(Step):
    """Rebuffer episodes as they end; the streaming form of operators.playback.rebuffer_episodes."""

    STATE = "episode long, start long, starved long, underruns long"

    def __init__(self) -> None:
        self.episode, self.start, self.starved, self.underruns = 0, None, 0, 0

    def take(self, x) -> Iterator[tuple]:
        if x.kind in ("video_starved", "audio_underrun"):
            self.start = int(x.media_ms) if self.start is None else self.start
            self.starved = max(self.starved, int(x.kind == "video_starved"))
            self.underruns += int(x.kind == "audio_underrun")
        elif x.kind == "buffer_recovered":
            if self.start is not None:
                yield self.episode, self.start, x.media_ms, max(0, x.media_ms - self.start), self.starved, self.underruns
            self.episode, self.start, self.starved, self.underruns = self.episode + 1, None, 0, 0


SAMPLES_OUT = "ord long, media_ms long"


class Throttle(Step):
    """At most one health sample in every 500 ms; forced ones always pass (and start the interval anew). A sample
    without a time passes only if it is forced, and starts nothing."""

    STATE = "last long"

    def __init__(self, every_ms: int = 500) -> None:
        self.every, self.last = every_ms, None

    def take(self, x) -> Iterator[tuple]:
        at, forced = _whole(x.media_ms), _flag(x, "forced")
        if forced or at is not None and (self.last is None or at - self.last >= self.every):
            self.last = self.last if at is None else at
            yield x.ord, at


ABR_OUT = DECISIONS
PES_OUT = "first_packet long, n_packets long, payload binary"


class PesCarry(Step):
    """PES units of one (stream, pid) that go on over segments: packet rows in, whole units out.

    Rows: packet_no, payload, payload_unit_start, continuity_counter, discontinuity_indicator, scrambling and, if they
    are there, segment_seq (counters may restart with a unit at a segment's start), `discontinuity` (true in segments
    that a declared one opens: the open unit and the counter go) and `last` (true on the stream's final packet, which
    flushes). A packet is judged by operators.transport.PACKET_RULES, and units are those of continuity_check and
    assemble_pes. The open unit is the state, whatever its length.
    """

    STATE = "counter int, segment long, begun boolean, tail binary, first long, n long"

    def __init__(self) -> None:
        self.counter = self.segment = self.tail = self.first = None
        self.begun, self.n = False, 0
        self.cut = False  # whether the last packet was damage

    def judged(self, x) -> SimpleNamespace:
        """What PACKET_RULES tell of the row; the next row's predecessor is this one."""
        segment = _whole(getattr(x, "segment_seq", None))
        told = SimpleNamespace(
            scrambling=int(x.scrambling), discontinuity_indicator=_flag(x, "discontinuity_indicator"), payload_unit_start=_flag(x, "payload_unit_start"), continuity_counter=int(x.continuity_counter), declared=_flag(x, "discontinuity"),
            new_segment=hasattr(x, "segment_seq") and (not self.begun or segment != self.segment), previous=-1 if self.counter is None else self.counter, counted=self.counter is not None,
        )
        for name, rule in PACKET_RULES.items():
            setattr(told, name, bool(rule(told)))
        self.counter, self.segment, self.begun = told.continuity_counter, segment, True
        return told

    def _close(self) -> Iterator[tuple]:
        if self.tail is not None and self.tail[:3] == b"\0\0\1":
            yield self.first, self.n, bytes(self.tail)
        self.tail = None

    def take(self, x) -> Iterator[tuple]:
        told = self.judged(x)
        self.cut = told.damaged
        if told.damaged:
            self.tail = None
        if told.fresh:
            yield from self._close()
            self.tail, self.first, self.n = bytes(x.payload), int(x.packet_no), 1
        elif told.clear and not told.duplicate and self.tail is not None:
            self.tail, self.n = self.tail + bytes(x.payload), self.n + 1
        if _flag(x, "last"):
            yield from self._close()


UNITS_OUT = "unit_no long, start_offset long, bytes binary"


class _ByteCarry(Step):
    """Blocks of one elementary stream in, units that may lie in several blocks out.

    Rows: content, and if present `discontinuity` (a declared one or damage: what is open is dropped) and `last` (true on
    the final block, which flushes). Offsets count all bytes of the stream. What follows the last whole unit is the state.
    """

    STATE = "tail binary, at long, units long"

    def __init__(self) -> None:
        self.tail, self.at, self.units = b"", 0, 0

    def _found(self, data: bytes, final: bool) -> tuple[list[tuple[int, int, int]], int]:
        """(start, from, to) of the whole units in data, and where the rest begins."""
        raise NotImplementedError

    def drop_tail(self) -> None:
        self.at += len(self.tail)
        self.tail = b""

    def take(self, x) -> Iterator[tuple]:
        if _flag(x, "discontinuity"):
            self.drop_tail()
        data = bytes(self.tail) + bytes(x.content or b"")
        whole, rest = self._found(data, _flag(x, "last"))
        for start, a, b in whole:
            yield self.units, self.at + start, data[a:b]
            self.units += 1
        self.tail, self.at = data[rest:], self.at + rest


class NalCarry(_ByteCarry):
    """NAL units over block boundaries; a unit is whole once the next start code is seen."""

    def _found(self, data: bytes, final: bool) -> tuple[list[tuple[int, int, int]], int]:
        units = list(nal_offsets(data))
        if final:
            return units, len(data)
        # zeros at the end may belong to the next start code
        open_at = nal_open(data)
        return [u for u in units if u[0] < open_at], open_at


class AdtsCarry(_ByteCarry):
    """Audio frames over block boundaries."""

    def _found(self, data: bytes, final: bool) -> tuple[list[tuple[int, int, int]], int]:
        frames, rest = adts_frames(data, final)
        return [(p, p, p + n) for p, n in frames], rest


PICTURES_OUT = "au_no long, first_nal long, nal_count long, is_idr boolean"


class PictureCarry(Step):
    """Access units over segments: NAL rows (nal_no, nal_type, first_mb) in, whole pictures out, as
    operators.pictures.assemble_access_units groups them. `discontinuity` drops the open picture; `last` flushes."""

    STATE = "held array<struct<nal_no: long, nal_type: int>>, sliced boolean, pictures long"

    def __init__(self) -> None:
        self.held: list[tuple[int, int]] = []
        self.sliced, self.pictures = False, 0

    def state(self) -> tuple:
        return list(self.held), self.sliced, self.pictures

    def restore(self, was: tuple) -> None:
        self.held, self.sliced, self.pictures = [tuple(r) for r in was[0]], bool(was[1]), int(was[2])

    def _close(self) -> Iterator[tuple]:
        """Gives out what is held if it has a slice."""
        if self.sliced:
            yield self.pictures, self.held[0][0], len(self.held), any(t == 5 for _, t in self.held)
            self.pictures += 1
        self.held, self.sliced = ([], False) if self.sliced else (self.held, False)

    def drop_open(self) -> bool:
        """Forgets what is held; whether that was part of a picture."""
        was, self.held, self.sliced = bool(self.held), [], False
        return was

    def take(self, x) -> Iterator[tuple]:
        t = int(x.nal_type)
        if _flag(x, "discontinuity"):
            self.drop_open()
        vcl = 1 <= t <= 5
        first = t in (1, 2, 5) and (pd.isna(x.first_mb) or x.first_mb == 0)
        if self.sliced and (first if vcl else 6 <= t <= 9 or 12 <= t <= 18):
            yield from self._close()
        self.held.append((int(x.nal_no), t))
        self.sliced = self.sliced or vcl
        if t in (10, 11) or _flag(x, "last"):
            yield from self._close()


def pes_head(payload: bytes) -> tuple[int, int, int | None] | None:
    """(start, end, pts90k) of a PES unit's elementary bytes, by the rules of functions.bytefields.pes_header."""
    if len(payload) < 9 or payload[:3] != b"\0\0\1" or payload[6] >> 6 != 2:
        return None
    flags, start, declared = payload[7] >> 6, payload[8] + 9, payload[4] << 8 | payload[5]
    end = declared + 6 if declared else len(payload)
    if flags == 1 or not start <= end <= len(payload) or payload[8] < (0, 0, 5, 10)[flags]:
        return None

    def clock(at: int, prefix: int) -> int | None:
        x = payload[at : at + 5]
        if x[0] >> 4 != prefix or not x[0] & x[2] & x[4] & 1:
            return None
        return (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1

    pts = clock(9, flags) if flags else None
    if flags and (pts is None or flags == 3 and clock(14, 1) is None):
        return None
    return start, end, pts


def first_mb(nal: bytes) -> int | None:
    """The first Exp-Golomb code of a slice; null if it is cut off."""
    plain = re.sub(rb"\x00\x00\x03(?=[\x00-\x03])", b"\x00\x00", nal[1:24])
    bits = "".join(f"{b:08b}" for b in plain)
    zeros = bits.find("1")
    return None if zeros < 0 or zeros >= 32 or 2 * zeros + 1 > len(bits) else int(bits[zeros : 2 * zeros + 1], 2) - 1


ELEMENTARY_OUT = "au_no long, first_nal long, nal_count long, is_idr boolean, has_sets boolean, emitted boolean, pts90k long"


class ElementaryCarry(Step):
    """Packets of one video pid in, pictures out: PES units, NAL units and pictures carried one inside the other, with
    resets that reach as far as their kind does.

    Rows: those of PesCarry. Damage (a lost, scrambled or flagged packet) and a malformed unit drop the open PES unit,
    the NAL tail and the open picture, and pictures wait for the next refresh; parameter sets stay. A declared
    discontinuity drops the sets too. Counters may restart with a segment, which drops nothing. pts90k is the latest
    timestamp that came at or before the picture's first slice and after the picture before; null without one. emitted: the picture is, or follows, a refresh that no damage cut; has_sets: a sequence and a
    picture set are known.
    """

    STATE = "pes struct<counter: int, segment: long, begun: boolean, tail: binary, first: long, n: long>, nal struct<tail: binary, at: long, units: long>, open struct<held: array<struct<nal_no: long, nal_type: int>>, sliced: boolean, pictures: long>, sets array<int>, waits boolean, stamps array<struct<at: long, pts90k: long>>, starts array<struct<nal_no: long, at: long>>"

    def __init__(self) -> None:
        self.pes, self.nal, self.picture = PesCarry(), NalCarry(), PictureCarry()
        self.sets: set[int] = set()
        self.waits = True
        self.stamps: list[tuple[int, int]] = []  # (offset in the elementary stream, time) of units not yet used
        self.starts: dict[int, int] = {}  # where the slices that are held begin

    def state(self) -> tuple:
        return self.pes.state(), self.nal.state(), self.picture.state(), sorted(self.sets), self.waits, list(self.stamps), list(self.starts.items())

    def restore(self, was: tuple) -> None:
        for part, held in zip((self.pes, self.nal, self.picture), was, strict=False):
            part.restore(tuple(held))
        self.sets, self.waits = set(was[3]), bool(was[4])
        self.stamps, self.starts = [tuple(r) for r in was[5]], dict(tuple(r) for r in was[6])

    def _cut(self, sets_too: bool) -> None:
        self.nal.drop_tail()
        self.picture.drop_open()
        self.waits, self.stamps, self.starts = True, [], {}
        if sets_too:
            self.sets = set()

    def _pictures(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        for au, first, n, idr in rows:
            at = min((p for k, p in self.starts.items() if first <= k < first + n), default=None)
            due = [] if at is None else [s for s in self.stamps if s[0] <= at]
            self.stamps = self.stamps[len(due) :]
            self.starts = {k: p for k, p in self.starts.items() if k >= first + n}
            self.waits = self.waits and not idr
            yield au, first, n, idr, self.sets >= {7, 8}, not self.waits, due[-1][1] if due else None

    def _unit(self, payload: bytes, final: bool) -> Iterator[tuple]:
        head = pes_head(payload)
        if head is None:
            self._cut(False)
            return
        start, end, pts = head
        if pts is not None:
            self.stamps.append((self.nal.at + len(self.nal.tail), pts))
        yield from self._bytes(payload[start:end], final)

    def _bytes(self, content: bytes, final: bool) -> Iterator[tuple]:
        for no, at, data in self.nal.take(SimpleNamespace(content=content, last=final)):
            t = data[0] & 31
            if 1 <= t <= 5:
                self.starts[no] = at
            closed = list(self.picture.take(SimpleNamespace(nal_no=no, nal_type=t, first_mb=first_mb(data) if 1 <= t <= 5 else None)))
            yield from self._pictures(iter(closed))
            self.sets |= {t} & {7, 8}

    def take(self, x) -> Iterator[tuple]:
        before = self.pes.segment, self.pes.begun
        units = list(self.pes.take(x))
        declared = _flag(x, "discontinuity") and (not before[1] or self.pes.segment != before[0])
        cut = self.pes.cut or declared
        # a unit that this packet closes ended before it, unless the packet's damage took it
        for _, _, payload in units if not _flag(x, "last") else units[:-1]:
            yield from self._unit(payload, False)
        if cut:
            self._cut(declared)
        if _flag(x, "last"):
            for _, _, payload in units[-1:]:
                yield from self._unit(payload, False)
            yield from self._bytes(b"", True)
            yield from self._pictures(self.picture._close())


def latest_wins(batch: DataFrame, key: str = "session_id", order: str = "ord") -> DataFrame:
    """The newest row of each key in a micro-batch and the number it supersedes; for use in foreachBatch."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"), (F.count("*") - 1).alias("superseded")).select(key, "_r.*", "superseded")


def readiness(rows: DataFrame, key: str = "stream_id", order: str = "ord", need: int = 2) -> DataFrame:
    """key, ready_at: the first row by which `need` segments (or all of a shorter finite list), a refresh and - where a
    stream has audio - its config and alignment are known. Rows carry new_segment, is_idr, audio_ready, has_audio and
    total_segments (null while unknown)."""
    w = Window.partitionBy(key).orderBy(order)
    seen = F.count_if("new_segment").over(w) >= F.least(F.lit(need), F.coalesce("total_segments", F.lit(need)))
    ok = seen & F.bool_or("is_idr").over(w) & (~F.col("has_audio") | F.bool_or("audio_ready").over(w))
    return rows.withColumn("_ok", ok).groupBy(key).agg(F.min(F.when(F.col("_ok"), F.col(order))).alias("ready_at"))


def audio_decision(rows: DataFrame, ready: DataFrame, key: str = "stream_id", order: str = "ord") -> DataFrame:
    """key, decision: disabled without audio, downgraded if it failed before the stream was ready, failed if after,
    active once ready, else pending. rows carries has_audio and audio_failed."""
    each = rows.groupBy(key).agg(F.bool_or("has_audio").alias("has"), F.min(F.when(F.col("audio_failed"), F.col(order))).alias("failed_at")).join(ready, key, "left")
    lost = F.col("failed_at").isNotNull()
    decision = F.when(~F.col("has"), "disabled").when(lost & (F.col("ready_at").isNull() | (F.col("failed_at") < F.col("ready_at"))), "downgraded").when(lost, "failed").when(F.col("ready_at").isNotNull(), "active").otherwise("pending")
    return each.select(key, decision.alias("decision"), "ready_at", "failed_at")


START_OUT = "ord long, decision string, ready_at long, failed_at long"


class StartDecision(Step):
    """Readiness and the audio decision of a stream as they are settled, over rows of all its parts in order.

    Rows: those of `readiness` with audio_failed. A row is given when the stream becomes ready and when its audio first
    fails; a failure after it was ready is terminal, and nothing follows it. The last row of a stream is what
    `audio_decision` says of all its rows, where that is not pending.
    """

    STATE = "segments long, refreshed boolean, heard boolean, has_audio boolean, ready_at long, failed_at long, ended boolean"

    def __init__(self, need: int = 2, order: str = "ord") -> None:
        self.order = order
        self.need, self.segments, self.refreshed, self.heard, self.has_audio, self.ready_at, self.failed_at, self.ended = need, 0, False, False, False, None, None, False

    def decision(self) -> str:
        if not self.has_audio:
            return "disabled"
        if self.failed_at is not None:
            return "downgraded" if self.ready_at is None or self.failed_at < self.ready_at else "failed"
        return "active"

    def take(self, x) -> Iterator[tuple]:
        if self.ended:
            return
        at = int(getattr(x, self.order))
        was = self.ready_at, self.failed_at, self.has_audio
        self.segments += int(_flag(x, "new_segment"))
        self.refreshed |= _flag(x, "is_idr")
        self.heard |= _flag(x, "audio_ready")
        self.has_audio |= _flag(x, "has_audio")
        if self.ready_at is None and self.segments >= min(self.need, _whole(x.total_segments, self.need)) and self.refreshed and (self.heard or not _flag(x, "has_audio")):
            self.ready_at = at
        if self.failed_at is None and _flag(x, "audio_failed"):
            self.failed_at = at
        if (self.ready_at, self.failed_at, self.has_audio) != was and (self.ready_at, self.failed_at) != (None, None):
            yield at, self.decision(), self.ready_at, self.failed_at
            self.ended = self.decision() == "failed"
