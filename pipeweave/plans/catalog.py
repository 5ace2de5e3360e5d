"""Registered queries of the network engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import scene as _scene

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, oracle: str | None = None, recursive: bool = False):
    """Register a function of a Scene under ``name``; ``oracle`` may use ``views``."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(_scene.Scene(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = _scene.with_sql(oracle, *views, recursive=recursive)
        return f

    return add


from . import queries  # noqa: E402, F401
