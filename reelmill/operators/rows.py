"""Rows of several tables put together for a window or an aggregate by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(frames: list[DataFrame], *keys: str) -> DataFrame:
    """The rows of all frames by column name (absent columns are null), for windows and aggregates by keys.

    A union of tables that are dealt by the same keys already may keep their partitions side by side and spare the
    exchange; once adaptive execution has coalesced them in different ways, a key's rows are no longer together and the
    window over them is wrong (a repartition is optimised away likewise). Keys that are computed anew in one table hide
    how it is dealt, so that the window gets its exchange.
    """
    first = frames[0].withColumns({k: F.greatest(k, k) for k in keys})
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [first, *frames[1:]])
