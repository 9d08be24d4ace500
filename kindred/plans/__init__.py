"""Registered queries: the library's operators bound to the driver's tables."""

from kindred.plans import recommendations, records, stores, texts  # noqa: F401
from kindred.plans.registry import ORACLES, QUERIES  # noqa: F401
