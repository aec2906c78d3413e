"""All registered queries; importing this package fills the registry."""

from strataforge.plans.catalog import audits, datasets, files, history, mart, star, state  # noqa: F401
from strataforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
