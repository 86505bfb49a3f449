"""Reuse of Column objects between queries.

A large expression costs thousands of calls into the JVM to build. Columns that
name their inputs are bound to no DataFrame, so one build serves all queries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext


def built_once(build: Callable) -> Callable:
    """Cache a function that returns Columns, per set of arguments and per JVM."""

    @lru_cache(maxsize=64)
    def kept(_jvm: int, *args, **kwargs):
        return build(*args, **kwargs)

    @wraps(build)
    def call(*args, **kwargs):
        return kept(id(SparkContext._gateway), *args, **kwargs)

    return call
