"""All registered queries."""

from hostweave.plans import catalog_eval, catalog_normal, catalog_signals  # noqa: F401
from hostweave.plans.catalog_base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
