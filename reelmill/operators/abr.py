"""The adaptive-bitrate controller over ordered samples of a session.

Its state has no closed form: a session's samples are folded in order, in the batch and the streaming form alike. The controller is a table: for each kind of sample, rules in order; the first one whose
condition holds changes counters and perhaps moves the rung.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.strict import validating
from reelmill.streaming.steps import fold

#: Thresholds of the controller.
UPGRADE_BUFFER_MS, LOW_BUFFER_MS, CRITICAL_BUFFER_MS = 8000, 3000, 1200
FAST_DOWNLOADS, HEALTHY_SAMPLES, SMOOTH_FRAMES, TROUBLED_FRAMES, LOW_SAMPLES, COOLDOWN = 4, 8, 90, 3, 2, 6
LATE_MS, SMOOTH_MS, SAFE_SHARE, DOWN_MARGIN = 180, 60, 0.72, 1.10


@dataclass
class Controller:
    """Rungs are bandwidths in rising order; ceiling is the highest rung that may be chosen. counts holds the runs of
    like samples that rules wait for."""

    rungs: list[int]
    ceiling: int
    index: int = 0
    manual: bool = False
    fast: float | None = None
    slow: float | None = None
    buffer_ms: int | None = None
    constrained: bool = False
    cooldown: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    def above(self) -> int:
        return self.rungs[self.index + 1]

    def estimate(self) -> float:
        return min(self.fast, self.slow)

    def measure(self, x) -> None:
        """What a sample tells besides the rules: throughput (two moving averages) and the buffer."""
        if x.kind == "download":
            rate = int(x.n_bytes) * 8e6 / max(1, int(x.elapsed_us))
            self.fast, self.slow = ((rate, rate) if self.fast is None else (0.5 * self.fast + 0.5 * rate, 0.8 * self.slow + 0.2 * rate))
            self.cooldown = self.cooldown if self.manual else max(0, self.cooldown - 1)
        elif x.kind == "buffer":
            self.buffer_ms = int(x.video_ms) if pd.isna(x.audio_ms) else min(int(x.video_ms), int(x.audio_ms))

    def select(self, rung: int | None) -> tuple[int, int, str] | None:
        """A viewer's choice of a rung, which stays; without one, back to automatic choice from the lowest rung. All that
        rules have counted is forgotten, not the throughput. A rung that there is not changes nothing."""
        if rung is not None and not 0 <= rung < len(self.rungs):
            return None
        was, self.index, self.manual = self.index, rung or 0, rung is not None
        self.buffer_ms, self.constrained, self.cooldown, self.counts = None, False, 0, {}
        return (was, self.index, "manual" if self.manual else "automatic") if self.index != was else None

    def step(self, x) -> tuple[int, int, str] | None:
        """One sample: kind download, failure, buffer, playback or selection, with that kind's fields. (from, to, reason)
        of a move. A sample that lacks a field it needs changes nothing (see sample_violations)."""
        if any(pd.isna(getattr(x, f)) for f in NEEDS.get(x.kind, ())):
            return None
        if x.kind == "selection":
            rung = getattr(x, "rung", None)
            return self.select(None if pd.isna(rung) else int(rung))
        self.measure(x)
        rule = None if self.manual else next((r for r in RULES.get(x.kind, ()) if r.when(self, x)), None)
        if rule is None:
            return None
        self.counts.update(dict.fromkeys(rule.clear, 0))
        if rule.count:
            self.counts[rule.count] = self.counts.get(rule.count, 0) + 1
            if self.counts[rule.count] < rule.upto(self):
                return None
            self.counts[rule.count] = 0
        return rule.act(self)


@dataclass(frozen=True)
class Rule:
    """when it applies; counters it clears; the counter it raises and how far before it acts; what it does then:
    trouble (a constrained state with a cooldown), calm (its end) and a move by so many rungs with a reason."""

    when: Callable[[Controller, Any], bool]
    clear: tuple[str, ...] = ()
    count: str | None = None
    upto: Callable[[Controller], int] = lambda c: 1
    trouble: bool = False
    calm: bool = False
    move: int = 0
    reason: str = ""

    def act(self, c: Controller) -> tuple[int, int, str] | None:
        if self.trouble:
            c.constrained, c.cooldown = True, COOLDOWN
            c.counts["healthy"] = 0
        if self.calm:
            c.constrained = False
        was = c.index
        c.index = max(0, min(c.index + self.move, c.ceiling if self.move > 0 else was))
        return (was, c.index, self.reason) if c.index != was else None


#: The fields that a kind of sample must have.
NEEDS = {"download": ("n_bytes", "elapsed_us"), "buffer": ("video_ms",), "playback": ("lateness_ms",)}


@validating
def sample_violations(samples: DataFrame) -> DataFrame:
    """samples with violation: unknown_kind, or missing_<field> for the first field that the kind needs and the row lacks.
    The controller passes over such rows."""
    known = F.col("kind").isin(*NEEDS, "failure", "selection")
    code = F.when(~F.coalesce(known, F.lit(False)), "unknown_kind")
    for kind, fields in NEEDS.items():
        for f in fields:
            code = code.when((F.col("kind") == kind) & F.col(f).isNull(), f"missing_{f}")
    return samples.withColumn("violation", code)


def _lags(c: Controller, x) -> bool:
    """A download that the rung is too much for: by its estimate, or as it took over nine tenths of its duration."""
    duration = 0 if pd.isna(x.segment_us) else int(x.segment_us)
    slow = duration > 0 and 10 * max(1, int(x.elapsed_us)) > 9 * duration
    return c.index > 0 and c.rungs[c.index] > 0 and (slow or c.estimate() < DOWN_MARGIN * c.rungs[c.index])


def _true(v) -> bool:
    return not pd.isna(v) and bool(v)


def _may_rise(c: Controller) -> bool:
    return not c.constrained and c.cooldown == 0 and c.index < c.ceiling and (c.buffer_ms or 0) >= UPGRADE_BUFFER_MS


RULES: dict[str, tuple[Rule, ...]] = {
    "download": (
        Rule(_lags, clear=("fast",), trouble=True, move=-1, reason="bandwidth"),
        Rule(lambda c, x: _may_rise(c) and 0 < c.above() <= SAFE_SHARE * c.estimate(), count="fast", upto=lambda c: FAST_DOWNLOADS, move=1, reason="headroom"),
        Rule(lambda c, x: True, clear=("fast",)),
    ),
    "failure": (Rule(lambda c, x: True, clear=("fast",), trouble=True, move=-1, reason="download_failed"),),
    "buffer": (
        Rule(lambda c, x: _true(x.starved), clear=("low",), trouble=True, move=-2, reason="starved"),
        Rule(lambda c, x: _true(x.playing) and c.buffer_ms <= CRITICAL_BUFFER_MS, clear=("low",), trouble=True, move=-1, reason="critical_buffer"),
        Rule(lambda c, x: _true(x.playing) and c.buffer_ms < LOW_BUFFER_MS, clear=("healthy", "fast"), count="low", upto=lambda c: LOW_SAMPLES, trouble=True, move=-1, reason="low_buffer"),
        Rule(lambda c, x: c.buffer_ms >= UPGRADE_BUFFER_MS, clear=("low",), count="healthy", upto=lambda c: HEALTHY_SAMPLES, calm=True),
        Rule(lambda c, x: True, clear=("low", "healthy")),
    ),
    "playback": (
        Rule(lambda c, x: _true(x.starved), clear=("smooth", "fast"), count="troubled", upto=lambda c: TROUBLED_FRAMES if c.constrained else 1, trouble=True, move=-1, reason="queue_starved"),
        Rule(lambda c, x: x.lateness_ms >= LATE_MS, clear=("smooth", "fast"), count="troubled", upto=lambda c: TROUBLED_FRAMES if c.constrained else 1, trouble=True, move=-1, reason="late"),
        Rule(lambda c, x: x.lateness_ms <= SMOOTH_MS, clear=("troubled",), count="smooth", upto=lambda c: SMOOTH_FRAMES, calm=True),
        Rule(lambda c, x: True, clear=("troubled", "smooth")),
    ),
}


SAMPLES = "kind n_bytes elapsed_us segment_us video_ms audio_ms playing starved lateness_ms".split()
DECISIONS = "ord long, from_index int, to_index int, bandwidth long, reason string"


class Abr:
    """The controller as a step object of reelmill.streaming.steps."""

    STATE = "index int, manual boolean, fast double, slow double, buffer_ms long, constrained boolean, cooldown int, counts map<string, int>"

    def __init__(self, rungs: list[int], ceiling: int | None = None) -> None:
        self.controller = Controller(sorted(rungs), len(rungs) - 1 if ceiling is None else ceiling)

    def state(self) -> tuple:
        c = self.controller
        return c.index, c.manual, c.fast, c.slow, c.buffer_ms, c.constrained, c.cooldown, dict(c.counts)

    def restore(self, was: tuple) -> None:
        c = self.controller
        c.index, c.manual, c.fast, c.slow, c.buffer_ms, c.constrained, c.cooldown, c.counts = *was[:7], dict(was[7])

    def expire(self) -> Iterator[tuple]:
        return iter(())

    def take(self, x) -> Iterator[tuple]:
        change = self.controller.step(x)
        if change is not None:
            yield x.ord, change[0], change[1], self.controller.rungs[change[1]], change[2]


def abr_decisions(samples: DataFrame, rungs: list[int], ceiling: int | None = None, key: str = "session_id") -> DataFrame:
    """key and the controller's changes (ord, from_index, to_index, bandwidth, reason) of each session; samples are in the
    order of ord. A sample of kind selection sets the rung in its column `rung` by hand, or with null returns to automatic
    choice; nothing else moves a rung that was set by hand."""
    return fold(samples.select(key, "ord", *SAMPLES, *[c for c in ("rung",) if c in samples.columns]), lambda: Abr(rungs, ceiling), key, "ord", DECISIONS)


def apply_switches(segments: DataFrame, key: str = "session_id", order: str = "sequence", rule: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds active_index: the target of the last segment that could switch, 0 before. A segment can if its bytes start
    with a refresh (safe); rule, a function of the column safe, replaces that test."""
    w = Window.partitionBy(key).orderBy(order)
    can = F.col("safe") if rule is None else rule(F.col("safe"))
    return segments.withColumn("active_index", F.coalesce(F.last(F.when(can, F.col("target_index")), ignorenulls=True).over(w), F.lit(0)))
