"""Registered queries over the driver tables, each with the SQL that states its result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .base import ORACLES, QUERIES

_MODULES = ("retrieval", "corpus", "tagging", "texts", "files", "replies", "dialog", "evaluation",
            "operations", "streams")


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return dict(QUERIES), dict(ORACLES)
