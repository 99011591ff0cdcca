"""Registered queries with their check SQL, grouped by area."""

from outlay.queries import base


def load_all() -> None:
    from outlay.queries import (  # noqa: F401
        analysis, costs, evidence, gold, plans, retrieval, runs, scalars, silver, streams,
    )


def registry():
    load_all()
    return base.REGISTRY
