"""Pandas UDFs that are made where they are used: modules stay importable without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorate a function of pandas series; the result takes columns."""

    def outer(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returnType=return_type)(*columns)

        return call

    return outer
