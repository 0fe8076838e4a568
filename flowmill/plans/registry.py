"""Every registered query of the broker operators, with its SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("routing", "queues", "flows", "storage")


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"flowmill.plans.{m}").QUERIES
    return out


def queries() -> dict:
    return {name: q[0] for name, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in _all().items() if q[1]}
