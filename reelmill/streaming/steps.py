"""Folding ordered rows: a step object a key takes its rows in order and yields output rows.

`fold` runs it over a whole table, `fold_stream` over a stream; both give the same rows if all input arrives, in one batch
or in many, each in order. A step that runs over streams names its state as a struct type (STATE) and gives and takes it
as a tuple (`state`, `restore`); between micro-batches the structs lie typed in a RocksDB map, an entry a key or a shelf
of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Shelves of a lane for streams that touch most of their keys in each trigger.
SHELVES = 256
#: Its column; Spark renames names with a leading underscore on their way to Python.
SHELF = "rm_shelf"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _schema(df: DataFrame, key: str, output: str) -> tuple[str, list[str]]:
    return f"{key} {df.schema[key].dataType.simpleString()}, {output}", [key, *[c.split()[0] for c in output.split(", ")]]


def _taken(frame: pd.DataFrame, key: str, step_of: Callable) -> Iterator[tuple]:
    at = frame.columns.get_loc(key)
    for x in frame.itertuples(index=False):
        for row in step_of(x[at]).take(x):
            yield (x[at], *row)


def fold(df: DataFrame, make: Callable, key: str, order: str, output: str) -> DataFrame:
    """key and the output columns that the step object of each key yields over all its rows. Rows come sorted by key and
    order, many keys in an Arrow batch; only the step of the key at hand is held."""
    schema, columns = _schema(df, key, output)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def step_of(k):
            if not held or held[0] != k and not (pd.isna(held[0]) and pd.isna(k)):
                held[:] = [k, make()]
            return held[1]

        for frame in frames:
            made = list(_taken(frame, key, step_of))
            if made:
                yield pd.DataFrame(made, columns=columns)

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def _plain(v):
    """A value that came from the state store as one that may go there again: Rows inside it as tuples."""
    if isinstance(v, tuple):
        return tuple(_plain(x) for x in v)
    return [_plain(x) for x in v] if isinstance(v, list) else v


class _Steps(StatefulProcessor):
    """The steps of a lane's keys. Only the shelves of keys that a trigger touches are read and written."""

    def __init__(self, make: Callable, key: str, key_type: str, order: str, columns: list[str], idle_ms: int | None) -> None:
        self.make, self.key, self.key_type, self.order, self.columns, self.idle_ms = make, key, key_type, order, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("steps", "shelf long", f"entries array<struct<k: {self.key_type}, seen_ms: long, step: struct<{self.make().STATE}>>>")

    def _put(self, shelf: int, was: dict, steps: dict, now: int) -> None:
        stay = [_plain(e) for k, e in was.items() if k not in steps]
        self.held.updateValue((shelf,), (stay + [(k, now, step.state()) for k, step in steps.items()],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values([SHELF, self.key, self.order], kind="stable")
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        made: list[tuple] = []
        at, on = frame.columns.get_loc(self.key), frame.columns.get_loc(SHELF)
        shelf, was, steps = None, {}, {}
        for x in frame.itertuples(index=False):
            if x[on] != shelf:
                if steps:
                    self._put(shelf, was, steps, now)
                shelf, steps = int(x[on]), {}
                found = self.held.getValue((shelf,))
                was = {e[0]: e for e in found[0]} if found is not None else {}
            k = None if pd.isna(x[at]) else x[at]
            if k not in steps:
                steps[k] = self.make()
                if k in was:
                    steps[k].restore(tuple(was[k][2]))
            made += [(x[at], *row) for row in steps[k].take(x)]
        if steps:
            self._put(shelf, was, steps, now)
        if self.idle_ms and not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.idle_ms)
        yield pd.DataFrame(made, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Ends and removes the keys that have been silent for idle_ms, and looks again when the next one might be."""
        now, made, changed, rest = timerValues.getCurrentProcessingTimeInMs(), [], [], []
        for shelf, found in self.held.iterator():
            stay = []
            for e in found[0]:
                if e[1] + self.idle_ms > now:
                    rest.append(e[1])
                    stay.append(_plain(e))
                    continue
                step = self.make()
                step.restore(tuple(e[2]))
                made += [(e[0], *row) for row in step.expire()]
            if len(stay) < len(found[0]):
                changed.append((tuple(shelf), stay))
        for shelf, stay in changed:
            if stay:
                self.held.updateValue(shelf, (stay,))
            else:
                self.held.removeKey(shelf)
        if rest:
            self.handle.registerTimer(max(min(rest) + self.idle_ms, now + 1))
        yield pd.DataFrame(made, columns=self.columns)

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, make: Callable, key: str, order: str, output: str, lanes: int | None = None, idle_ms: int | None = None, shelves: int | None = None) -> DataFrame:
    """The same over a streaming DataFrame, with the state of each key as a typed struct of its own.

    With lanes, keys are dealt by hash into so many groups: for many keys with few rows each, where a group a key would
    cost more than its rows; what is read and written is still the touched keys' entries alone. With shelves, the keys of
    a lane share so many entries: a call to the state store costs more than many keys in it, so that this pays where a
    trigger touches most keys; what is read and written is the touched keys' shelves then.
    idle_ms: a key without a row for so long (processing time) gives the rows of its step's `expire` and its state goes.
    The session's state store must be RocksDB's (it is set here if it is not).
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema, columns = _schema(df, key, output)
    dealt = F.xxhash64(key)
    grouped = df.withColumns({"_lane": F.pmod(dealt, F.lit(lanes)) if lanes else dealt, SHELF: F.pmod(F.shiftright(dealt, 32), F.lit(shelves)).cast("long") if shelves else dealt})
    steps = _Steps(make, key, df.schema[key].dataType.simpleString(), order, columns, idle_ms)
    # timers keep a query busy: Spark runs one trigger after the other for them, also with availableNow
    return grouped.groupBy("_lane").transformWithStateInPandas(steps, schema, "append", "processingTime" if idle_ms else "none")
