"""Registered queries, each next to the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame`, with its SQL where one exists."""

    def register(fn: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    from catalog import checks, evaluation, models, profiling, quality, sampling, sources, stored  # noqa: F401
