"""Names of all registered queries, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from .fixtures import Tables, with_views

FLAGSHIP = "a05_label_recall"
QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name; sql gives the same rows in DuckDB."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


for _name in ("scenes", "datasets", "arithmetic", "collection", "logs", "composites", "files", "unfinished"):
    importlib.import_module(f"quillframe.plans.{_name}")
