"""Registered queries: one Spark plan and one DuckDB oracle per operator.

Each family module exposes ``QUERIES`` (name -> callable(spark, sf_dir) ->
DataFrame) and ``ORACLES`` (name -> SQL over the raw tables).  Queries without
an oracle are checked rows-only by the driver.
"""

from __future__ import annotations

import importlib

FAMILIES = (
    "compare",
    "voting",
    "runs",
    "profile",
    "schema",
    "values",
    "redact",
    "audit",
    "slices",
    "text",
    "sources",
    "sql",
)


def _modules():
    for fam in FAMILIES:
        try:
            yield importlib.import_module(f"arbiter.plans.{fam}")
        except ModuleNotFoundError as exc:  # family not written yet
            if exc.name != f"arbiter.plans.{fam}":
                raise


def all_queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_oracles():
    out = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
