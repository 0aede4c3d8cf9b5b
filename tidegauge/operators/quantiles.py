"""Exact quantiles of groups of any size, and joins of small per-series statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-series statistics back to rows.

    Without keys ``stats`` is a global aggregate, hence exactly one row, and is
    broadcast. With keys the number of series decides: adaptive execution broadcasts
    a small table and splits hot keys of a shuffled join.
    """
    if keys:
        return df.join(stats, list(keys), "left")
    one = F.lit(1)
    joined = df.withColumn("_one", one).join(
        F.broadcast(stats.withColumn("_one", one)), "_one", "left"
    )
    return joined.drop("_one")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probabilities: Mapping[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Linearly interpolated quantiles per group, with no group held in one task.

    A mergeable sketch first brackets each wanted rank; its rank error is bounded by
    ``1 / accuracy``. A second pass counts rows outside the brackets as a whole and
    keeps counts per distinct value inside them, so the final ordering sees about
    ``4 / accuracy`` of a group. In a small group the neighbour that is interpolated with may
    stand just outside a bracket, as the last or first of the rows counted as a whole, whose
    ends are kept. The result is exact whatever the data.
    """
    keys = list(keys)
    names = list(probabilities)
    slack = 2.0 / accuracy
    lows = [max(0.0, p - slack) for p in probabilities.values()]
    highs = [min(1.0, p + slack) for p in probabilities.values()]
    value = F.col(column).cast("double")
    known = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
    cuts = F.array(*[F.lit(p) for p in (*lows, *highs)])
    brackets = known.groupBy(*keys).agg(
        F.percentile_approx("_v", cuts, accuracy).alias("_cuts")
    )
    count = len(names)
    marked = attach(known, brackets, keys).select(
        *keys,
        "_v",
        F.slice("_cuts", 1, count).alias("_low"),
        F.slice("_cuts", count + 1, count).alias("_high"),
    )
    inside = F.exists(
        F.arrays_zip("_low", "_high"),
        lambda b: (F.col("_v") >= b["_low"]) & (F.col("_v") <= b["_high"]),
    )
    region = F.size(F.filter("_high", lambda h: h < F.col("_v")))
    tallied = (
        marked.groupBy(*keys, F.when(inside, F.col("_v")).alias("_kept"), region.alias("_region"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_at"), F.max("_v").alias("_top"))
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = tallied.withColumns(
        {"_cum": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)}
    )
    picks = []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        for side, k in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            # of rows counted as a whole, only the first or the last can be wanted
            found = F.when(k == F.col("_cum") - F.col("_n"), F.col("_at")).otherwise(F.col("_top"))
            picks.append(F.min(F.when(F.col("_cum") > k, found)).alias(f"_{side}_{name}"))
    chosen = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return chosen.select(*keys, F.col("_total").alias("n"), *out)
