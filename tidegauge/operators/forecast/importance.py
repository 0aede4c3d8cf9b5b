"""Permutation importance: one exchange of whole rows, partners found by arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.forecast.linear import LinearModel
from tidegauge.spec import SeriesSpec

NOTE = "Features that move together share their importance, or hide each other's."
#: A prime under 2**31, so that products of two residues fit in 64 bits.
PRIME = 2_147_483_647
_ROUNDS = 4
_WALKS = 32


def row_numbers(
    rows: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[str], number: str, count: str
) -> DataFrame:
    """Number the rows of a group from 0 without sorting the group in one task, and give its row count.

    ``bucket`` columns cut the group into small ordered parts; counts of earlier parts are the offsets. The order is
    that of ``bucket`` and then ``order``, which together identify a row, so a retried task numbers alike.
    """
    group, bucket = list(group), list(bucket)
    sizes = rows.groupBy(*group, *bucket).agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(*group)
    before = F.sum("_size").over(whole.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*group, *bucket, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias(count))
    rank = F.row_number().over(Window.partitionBy(*group, *bucket).orderBy(*order))
    placed = rows.withColumn("_rank", rank).join(offsets, [*group, *bucket])
    return placed.withColumn(number, F.col("_before") + F.col("_rank") - 1).drop("_before", "_rank")


def partner(number: str, count: str, key: str) -> Column:
    """A keyed bijection of 0 .. count - 1, worked out for each row alone.

    A Feistel network permutes a grid of a x b places, where a * b passes ``count`` by less than a; a result outside is
    permuted again until it lies inside. Walks over 32 can't occur up to 1,024 rows and are practically impossible
    beyond (under 1/32 a step); one would be an error, not a wrong partner.
    """
    a = f"CAST(ceil(sqrt({count})) AS BIGINT)"
    b = f"(({count} + {a} - 1) DIV {a})"
    x = f"((s.r + {key} + k * 104729) % {PRIME})"
    mixed = f"((({x} * {x}) % {PRIME}) * 48271 + {x}) % {PRIME}"
    rounds = ", ".join(f"{k}L" for k in range(1, _ROUNDS + 1))
    once = (
        f"aggregate(array({rounds}), named_struct('l', v DIV {b}, 'r', v % {b}, 'a', {a}, 'b', {b}), "
        f"(s, k) -> named_struct('l', s.r, 'r', (s.l + {mixed}) % s.a, 'a', s.b, 'b', s.a), s -> s.l * s.b + s.r)"
    )
    inside = f"CASE WHEN v >= {count} THEN CAST(raise_error('no partner found') AS BIGINT) ELSE v END"
    return F.expr(
        f"aggregate(sequence(0, {_WALKS}), {number}, (v, t) -> CASE WHEN t = 0 OR v >= {count} THEN {once} ELSE v END, v -> {inside})"
    )


def permutation_importance(
    validation: DataFrame, spec: SeriesSpec, models: Mapping[int, LinearModel], target: str, seed: int = 42
) -> DataFrame:
    """Mean and SD over folds of the error increase when one feature is shuffled.

    A linear prediction changes by ``weight * (other - own)``, so each row is scored from its own prediction. A row
    sends all its features to one partner of its fold: rows are exchanged once, whatever the number of features, and
    the errors of all features are sums of one aggregate. A fold without rows adds nothing.
    """
    names = list(dict.fromkeys(c for m in models.values() for c in m.weights))

    def case(value) -> str:
        return "CASE fold " + " ".join(f"WHEN {f} THEN {value(m)}" for f, m in models.items()) + " END"

    cells = ", ".join(
        f"CAST(coalesce({c}, {case(lambda m, c=c: repr(float(m.medians.get(c, 0.0))) + 'D')}) AS DOUBLE)" for c in names
    )
    keys = ", ".join(f"CAST(`{k}` AS STRING)" for k in spec.keys)
    part = f"substr(md5(concat_ws('|', {keys})), 1, 2)" if keys else "''"
    scored = validation.selectExpr(
        "fold", *spec.keys, spec.date, f"CAST({target} AS DOUBLE) AS y", f"{case(lambda m: m.sql())} AS p", f"array({cells}) AS x", f"{part} AS _part",
    ).where(F.col("fold").isin(*models))
    numbered = row_numbers(scored, ["fold"], [spec.date, "_part"], spec.keys or [spec.date], "_at", "_n")
    key = f"(CAST(fold AS BIGINT) * 15485863 + {seed * 7919})"
    sent = numbered.select("fold", partner("_at", "_n", key).alias("_at"), F.col("x").alias("_other"))
    error = [F.avg(F.abs(F.col("y") - F.col("p"))).alias("_own")]
    for i, c in enumerate(names):
        weight = F.expr(case(lambda m, c=c: repr(float(m.weights[c])) + "D" if c in m.weights else "CAST(NULL AS DOUBLE)"))
        moved = F.col("p") + weight * (F.col("_other")[i] - F.col("x")[i])
        error.append(F.avg(F.abs(F.col("y") - moved)).alias(f"_e{i}"))
    folds = numbered.join(sent, ["fold", "_at"]).groupBy("fold").agg(*error)
    increases = [F.struct(F.lit(c).alias("feature"), (F.col(f"_e{i}") - F.col("_own")).alias("increase")) for i, c in enumerate(names)]
    return (
        folds.select("fold", F.inline(F.array(*increases)))
        .where("increase IS NOT NULL")
        .groupBy("feature")
        .agg(
            F.avg("increase").alias("mean_mae_increase"),
            F.stddev_pop("increase").alias("std_mae_increase"),
            F.count_distinct("fold").alias("folds"),
            F.lit(NOTE).alias("interpretation_note"),
        )
    )
