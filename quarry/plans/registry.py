"""The queries of every plan module and the DuckDB SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f
