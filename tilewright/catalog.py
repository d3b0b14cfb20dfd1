"""The queries on the driver's tables, by name, and their oracles."""

from tilewright.plans import build, elements, kernels, tiles  # noqa: F401
from tilewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
