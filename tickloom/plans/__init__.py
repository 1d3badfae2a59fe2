"""Registered queries: importing this package registers all of them."""

from tickloom.plans import feeds, market, models, released, store, streams  # noqa: F401
from tickloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
