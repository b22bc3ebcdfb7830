"""All registered queries of the variant library."""

from __future__ import annotations

from helixspark.plans import annotation, catalog, evaluation, jobs, joins, learned, preparation, runs, scores, sources

MODULES = (catalog, annotation, evaluation, joins, scores, sources, jobs, learned, preparation, runs)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
