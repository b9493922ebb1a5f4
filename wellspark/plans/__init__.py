"""Operators bound to the driver tables: ``all_queries()`` and their DuckDB oracles ``all_oracles()``."""

from __future__ import annotations

import importlib

# modules contributing QUERIES / ORACLES dicts
_MODULES = ("basic", "nutrition", "signals", "text", "transcripts", "scoring", "ppg_chain", "streams", "derived",
            "records", "files")


def _load():
    qs, os_ = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(f"wellspark.plans.{name}")
        qs.update(getattr(mod, "QUERIES", {}))
        os_.update(getattr(mod, "ORACLES", {}))
    return qs, os_


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
