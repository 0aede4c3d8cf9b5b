"""All registered queries."""

from tidegauge.catalog import analysis, cleaning, features, forecast, storage  # noqa: F401
from tidegauge.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
