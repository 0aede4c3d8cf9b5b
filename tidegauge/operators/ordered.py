"""Order-dependent values over rows that may repeat a date many times.

A daily panel holds one row per series and day, so its windows are bounded by the
calendar. Raw rows carry no such bound: one series, or one date, may hold a third of
them. The functions here compute the same values from positions and bounded chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.scalars import percent_change
from tidegauge.spec import SRC_ROW, STOCK_A, STOCK_B, SeriesSpec

CHUNK_ROWS = 200_000
_HALO = 13

EXPECTED = ("_x_growth", "_x_roll7", "_x_roll14", "_x_streak", "_prev_a", "_prev_b")


def add_positions(
    df: DataFrame, spec: SeriesSpec, bucket: Column | None = None, name: str = "_pos"
) -> DataFrame:
    """Row number in (date, source row) order without ordering a whole series.

    ``bucket`` is a monotone function of the source row; its groups must be small. By
    default it is a range of row numbers, or the file block of a row read from files.
    Offsets are summed over buckets within a date, then over dates within a series,
    so every window sees either one bucket, the buckets of one date, or one calendar.
    """
    keys = list(spec.keys)
    if bucket is None:
        kind = df.schema[SRC_ROW].dataType
        if isinstance(kind, T.StructType):
            bucket = F.struct(*[F.col(SRC_ROW).getField(n) for n in kind.names[:-1]])
        else:
            bucket = F.floor(F.col(SRC_ROW) / CHUNK_ROWS)
    far = F.lit("9999-12-31").cast("date")
    placed = df.withColumns(
        {"_d": F.coalesce(F.col(spec.date), far), "_b": bucket}
    )
    counts = placed.groupBy(*keys, "_d", "_b").count()
    earlier = (Window.unboundedPreceding, -1)
    in_day = counts.withColumn(
        "_in_day",
        F.coalesce(
            F.sum("count").over(
                Window.partitionBy(*keys, "_d").orderBy("_b").rowsBetween(*earlier)
            ),
            F.lit(0),
        ),
    )
    days = counts.groupBy(*keys, "_d").agg(F.sum("count").alias("_rows")).withColumn(
        "_before",
        F.coalesce(
            F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_d").rowsBetween(*earlier)),
            F.lit(0),
        ),
    )
    offsets = in_day.join(days.drop("_rows"), [*keys, "_d"]).select(
        *keys, "_d", "_b", (F.col("_in_day") + F.col("_before")).alias("_offset")
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_d", "_b").orderBy(SRC_ROW))
    return (
        placed.join(offsets, [*keys, "_d", "_b"])
        .withColumn(name, F.col("_offset") + rank)
        .drop("_d", "_b", "_offset")
    )


def _in_window(df: DataFrame, w, load: Column, net: Column) -> DataFrame:
    position = F.col("_pos")
    return df.withColumns(
        {
            "_x_growth": percent_change(load, F.lag(load).over(w)),
            "_x_roll7": F.avg(load).over(w.rowsBetween(-6, 0)),
            "_x_roll14": F.avg(load).over(w.rowsBetween(-13, 0)),
            "_prev_a": F.lag(STOCK_A).over(w),
            "_prev_b": F.lag(STOCK_B).over(w),
            "_still": F.max(F.when(~F.coalesce(net > 0, F.lit(False)), position)).over(
                w.rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )


def expected_metrics(
    df: DataFrame, spec: SeriesSpec, load: Column, net: Column, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Growth, rolling means, streak and previous stocks of rows in stable date order."""
    keys = list(spec.keys)
    position = F.col("_pos")
    placed = add_positions(df, spec).withColumn(
        "_own", F.floor((position - 1) / chunk_rows)
    )
    tail = F.pmod(position - 1, F.lit(chunk_rows)) >= chunk_rows - _HALO
    homes = F.when(tail, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(
        F.array(F.col("_own"))
    )
    spread = placed.withColumn("_chunk", F.explode(homes))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    local = _in_window(spread, w, load, net).where(F.col("_own") == F.col("_chunk"))
    still = F.max(F.when(~F.coalesce(net > 0, F.lit(False)), position))
    carried = (
        placed.groupBy(*keys, "_own")
        .agg(still.alias("_stop"))
        .select(
            *keys,
            F.col("_own").alias("_chunk"),
            F.max("_stop")
            .over(
                Window.partitionBy(*keys)
                .orderBy("_own")
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            .alias("_carry"),
        )
    )
    last = F.greatest(
        F.coalesce(F.col("_still"), F.lit(0)), F.coalesce(F.col("_carry"), F.lit(0))
    )
    return (
        local.join(carried, [*keys, "_chunk"], "left")
        .withColumn("_x_streak", (position - last).cast("double"))
        .drop("_pos", "_still", "_own", "_chunk", "_carry")
    )
