"""Strict mode: violations that end the job instead of staying in their rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raising(df: DataFrame, column: str = "violation") -> DataFrame:
    """df, whose evaluation fails at the first row with a violation. The test is a filter of the plan, so it costs no
    action of its own and holds whichever columns are read later; rows that a later limit never reaches are not tested."""
    keys = [c for c, kind in df.dtypes if c != column and kind in ("bigint", "int", "string")][:4]
    where = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in keys])
    message = F.concat(F.col(column), F.lit(" at "), where)
    return df.filter(F.when(F.col(column).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def validating(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Gives an operator whose result has a `violation` the keyword strict (see raising)."""

    @wraps(operator)
    def run(*args, strict: bool = False, **options) -> DataFrame:
        found = operator(*args, **options)
        return raising(found) if strict else found

    return run
