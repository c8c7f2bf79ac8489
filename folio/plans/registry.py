"""All queries of the engine by inventory id, gathered from the operator modules."""

from __future__ import annotations


def modules() -> list:
    from folio.operators import classify, cleanup, exchange, first_step, joins, jobs, ledger, lifecycle, messages, outline, rates, review, rounds, stores, streams, structure, telemetry

    return [cleanup, classify, first_step, structure, outline, joins, ledger, jobs, telemetry, exchange, review, rounds, messages, rates, lifecycle, stores, streams]


def queries() -> dict:
    return {k: v for m in modules() for k, v in m.CATALOG.queries.items()}


def oracles() -> dict:
    return {k: v for m in modules() for k, v in m.CATALOG.oracles.items()}


def flagship(spark, sf_dir: str):
    """Cleanup of all documents, rolled up by language."""
    return queries()["a01"](spark, sf_dir)
