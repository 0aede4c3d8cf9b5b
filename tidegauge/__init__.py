"""Stock-and-flow capacity analytics on Spark DataFrames."""

from tidegauge.spec import (
    CapacityError,
    DataQualityError,
    SeriesSpec,
)

__all__ = ["CapacityError", "DataQualityError", "SeriesSpec"]
