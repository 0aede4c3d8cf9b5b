import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidegauge.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def source(spark):
    """520 daily rows of one smooth series with metrics."""
    from pyspark.sql import functions as F

    from tidegauge.operators.metrics import daily_metrics
    from tidegauge.spec import SeriesSpec

    t = F.col("id")
    days = spark.range(520).select(
        F.date_add(F.lit("2023-01-01").cast("date"), t.cast("int")).alias("date"),
        (100 + t % 13).alias("intake"),
        F.round(400 + 0.2 * t + 10 * F.sin(t / 8)).cast("long").alias("stock_a"),
        (95 + t % 11).alias("transfer"),
        F.round(4000 + 0.7 * t + 20 * F.sin(t / 15)).cast("long").alias("stock_b"),
        (93 + t % 9).alias("discharge"),
        F.lit(False).alias("is_imputed_date"),
        F.lit(False).alias("anomaly_any"),
    )
    return daily_metrics(days, SeriesSpec(), trusted=True).persist()
