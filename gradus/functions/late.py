"""UDFs that are made when they are first used: their types need a session, which imports don't have."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def late(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def of(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return of
