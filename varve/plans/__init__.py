"""Queries over the given tables; importing a module registers its queries."""

from varve.plans import columns, evidence, governance, history, io, learning, rules, warehouse  # noqa: F401
