"""Registered queries of the methylation operators and their SQL oracles."""

from __future__ import annotations

from . import analysis, core, locus, results

MODULES = (core, analysis, results, locus)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
