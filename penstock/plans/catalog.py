"""All registered queries."""

from penstock.plans import balance, detection, features, models, preparation, streams  # noqa: F401
from penstock.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
