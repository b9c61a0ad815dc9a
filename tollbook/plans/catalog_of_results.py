"""Registry of named results: every analysis function is listed under a stable name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

RESULTS: dict[str, Callable[..., DataFrame]] = {}


def result(name: str):
    """Register an analysis ``(ws, **parameters) -> DataFrame`` under ``name``."""
    def wrap(fn):
        RESULTS[name] = fn
        return fn
    return wrap
