"""Named queries over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib

from .registry import REGISTRY, Query

_MODULES = (
    "usage_reports",
    "text_queries",
    "chunk_queries",
    "decision_queries",
    "monitoring_queries",
    "relational_queries",
    "source_queries",
    "stream_queries",
)


def load_all() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY
