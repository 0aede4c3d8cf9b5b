"""Exact quantiles and distinct counts of many columns at once, without a row per cell.

A double becomes an unsigned number of the same order (its sortable bit pattern). A pass counts, for
every group and column, how many values share their leading 16 bits; such histograms add up over tasks.
The part that holds a wanted rank is counted again by its next 16 bits, until all its values are equal:
two passes for whole numbers of ordinary size, four for any data. Rows are never multiplied by the
number of columns, and what a pass shuffles is bounded by 65,536 counts per group, column and task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Workers receive this module's functions with the task: they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEP = 16
_TOP = np.uint64(1 << 63)


def sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; -0.0 counts as 0.0."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def _cells(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Column number, mask of known values, and values of each column of a batch."""
    for k, c in enumerate(columns):
        values = batch[c].to_numpy(zero_copy_only=False)  # null becomes NaN
        yield k, ~np.isnan(values), values


def _histograms(df: DataFrame, key: str, columns: Sequence[str], wanted: Mapping[tuple[int, int], Sequence[int]] | None, depth: int) -> DataFrame:
    """key, column, prefix, bin, n, low and high: counts by the ``_STEP`` bits after the first ``depth``.

    ``wanted`` has the prefixes of each key and column that are of interest; None stands for all values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - depth - _STEP)
        for batch in batches:
            keys = batch["_key"].to_numpy(zero_copy_only=False)
            out = [[] for _ in range(7)]
            for k, known, values in _cells(batch, columns):
                for group in np.unique(keys).tolist():
                    mine = values[known & (keys == group)]
                    bits = sortable(mine)
                    for prefix in wanted.get((group, k), ()) if wanted is not None else (0,):
                        if depth:
                            at = bits >> np.uint64(64 - depth) == np.uint64(prefix)
                            some, part = mine[at], bits[at]
                        else:
                            some, part = mine, bits
                        order = np.argsort(part, kind="stable")
                        bins = (part[order] >> shift) & np.uint64((1 << _STEP) - 1)
                        if not len(bins):
                            continue
                        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
                        n = np.diff(np.r_[first, len(bins)])
                        some = some[order]
                        for cell, value in zip(out, (np.full(len(first), group), np.full(len(first), k), np.full(len(first), prefix), bins[first], n, some[first], some[first + n - 1])):
                            cell.append(value)
            if out[0]:
                whole, real = (pa.int64(),) * 5, (pa.float64(),) * 2
                arrays = [pa.array(np.concatenate(c).astype(np.float64 if t == pa.float64() else np.int64), t) for c, t in zip(out, whole + real)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "column", "prefix", "bin", "n", "low", "high"])

    narrow = df.select(F.col(key).cast("long").alias("_key"), *[F.col(c).cast("double").alias(c) for c in columns]).where("_key IS NOT NULL")
    rows = narrow.mapInArrow(run, "key long, column long, prefix long, bin long, n long, low double, high double")
    return rows.groupBy("key", "column", "prefix", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def wide_quantiles(
    df: DataFrame, key: str, columns: Sequence[str], probabilities: Mapping[str, float]
) -> dict[tuple[int, str], dict[str, float]]:
    """Linearly interpolated quantiles per value of ``key`` (a whole number) and column, exact.

    For few groups of any size, such as folds: the driver gets two numbers per group, column and
    probability. Groups and columns without values are absent. Nulls and NaN are left out.
    """
    columns, names = list(columns), list(probabilities)
    found: dict[tuple[int, int, int], float] = {}
    total: dict[tuple[int, int], int] = {}
    # rank (from 0 inside the prefix) wanted of a key and column, by prefix
    open_ranks: dict[tuple[int, int, int], dict[int, list[int]]] = {}
    for depth in range(0, 64, _STEP):
        wanted = None if depth == 0 else {}
        for g, c, prefix in open_ranks:
            wanted.setdefault((g, c), []).append(prefix)
        counts = _histograms(df, key, columns, wanted, depth)
        part = Window.partitionBy("key", "column", "prefix")
        running = counts.withColumns({"upto": F.sum("n").over(part.orderBy("bin")), "all": F.sum("n").over(part)})
        if depth == 0:
            ranks = [f(F.lit(float(p)) * (F.col("all") - 1)).cast("long") for p in probabilities.values() for f in (F.floor, F.ceil)]
            hits = F.array_distinct(F.filter(F.array(*ranks), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
        else:
            entries = [(g, c, prefix, sorted(r)) for (g, c, prefix), r in open_ranks.items()]
            asked = df.sparkSession.createDataFrame(entries, "key long, column long, prefix long, ranks array<long>")
            running = running.join(F.broadcast(asked), ["key", "column", "prefix"])
            hits = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
        rows = running.withColumn("hits", hits).where(F.size("hits") > 0).collect()
        before, open_ranks = open_ranks, {}
        for r in rows:
            at = (r["key"], r["column"])
            if depth == 0:
                total[at] = r["all"]
            for rank in r["hits"]:
                asked_by = [rank] if depth == 0 else before[*at, r["prefix"]][rank]
                if r["low"] == r["high"]:
                    found.update({(*at, k): r["low"] for k in asked_by})
                else:
                    inside = rank - (r["upto"] - r["n"])
                    open_ranks.setdefault((*at, r["prefix"] << _STEP | r["bin"]), {}).setdefault(inside, []).extend(asked_by)
        if not open_ranks:
            break
    out = {}
    for (g, c), n in total.items():
        values = {}
        for name in names:
            rank = probabilities[name] * (n - 1)
            low, high = found[g, c, math.floor(rank)], found[g, c, math.ceil(rank)]
            values[name] = low + (high - low) * (rank - math.floor(rank))
        out[g, columns[c]] = values
    return out


def column_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, rows, missing_values and unique_values (exact, nulls and NaN left out) of many columns.

    Every task sends each of its different values of a column once with its count.
    """
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for k, known, values in _cells(batch, columns):
                different, n = np.unique(values[known] + 0.0, return_counts=True)
                out[0].append(np.full(len(different) + 1, k))
                out[1].append(pa.concat_arrays([pa.array(different), pa.nulls(1, pa.float64())]))
                out[2].append(np.r_[n, len(values) - known.sum()])
            if out[0]:
                arrays = [pa.array(np.concatenate(out[0]), pa.int32()), pa.concat_arrays(out[1]), pa.array(np.concatenate(out[2]), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["column", "value", "n"])

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, "column int, value double, n long")
    values = rows.groupBy("column", "value").agg(F.sum("n").alias("n"))
    facts = values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("missing_values"),
        F.count("value").alias("unique_values"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    return facts.withColumn("column", F.element_at(names, F.col("column") + 1))
