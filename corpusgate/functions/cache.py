"""Build a Column expression once per Spark context.

Rule expressions are large trees of built-in functions; assembling them
from Python costs one py4j call per node. They do not depend on the data,
so each is built over canonical column names once and reused by every
query that needs it.
"""
from __future__ import annotations

import functools

_CACHE: dict = {}


def session_cached(fn):
    @functools.wraps(fn)
    def wrapper(*args):
        from pyspark import SparkContext

        sc = SparkContext._active_spark_context
        key = (fn.__module__, fn.__qualname__, args, id(sc), id(getattr(sc, "_jsc", None)))
        if key not in _CACHE:
            _CACHE[key] = fn(*args)
        return _CACHE[key]
    return wrapper
