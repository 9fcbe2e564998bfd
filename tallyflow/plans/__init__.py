"""Named queries over the provided tables and their reference SQL."""

from tallyflow.plans import checks, cubes, exchange, indicators, network, outputs, solving, trees  # noqa: F401
from tallyflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
