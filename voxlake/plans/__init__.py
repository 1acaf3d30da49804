"""Registered queries: each module offers QUERIES (name -> callable) and ORACLES (name -> SQL)."""

from __future__ import annotations

from . import airband, evaluation, journal, panel, records, registry, reports, signal, text

MODULES = (journal, registry, text, evaluation, signal, airband, reports, records, panel)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
