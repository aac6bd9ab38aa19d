"""All registered queries, one module per operator family."""

from __future__ import annotations

import importlib

from parcelspark.queries.registry import ORACLES, QUERIES, QueryFn

FAMILIES = ["spatial", "scalars", "feasibility", "sources", "versions", "candidates", "metering", "quality", "reports", "streams"]


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"parcelspark.queries.{name}")


def registered() -> dict[str, QueryFn]:
    _load()
    return QUERIES


def oracles() -> dict[str, str]:
    _load()
    return ORACLES
