"""Connected components of links, distributed, without collecting a link to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage


def _smallest(pairs: DataFrame) -> DataFrame:
    """(node, other) -> (node, other, least) with the smallest neighbour or the node itself.

    The minimum is pre-aggregated before its shuffle; a node with very many links comes back in a
    join whose skewed side adaptive execution splits.
    """
    least = pairs.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select(F.col("node").alias("n"), F.least("node", "least").alias("least"))
    return pairs.join(least, pairs["node"] == least["n"]).select("node", "other", "least")


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b; long).

    Alternating large-star and small-star steps until nothing changes: then every node hangs on
    the smallest node of its component. Nulls and self-links are left out, repeats don't matter.
    """
    edges = cut_lineage(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node, other))").alias("x")).first()
        state = (state["n"], state["x"])
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = (
            _smallest(both)
            .where(F.col("other") > F.col("node"))
            .select(F.col("other").alias("node"), F.col("least").alias("other"))
            .distinct()
        )
        small = _smallest(large)
        edges = cut_lineage(
            small.select(F.col("other").alias("node"), F.col("least").alias("other"))
            .unionByName(small.select("node", F.col("least").alias("other")))
            .where(F.col("node") != F.col("other"))
            .distinct()
        )
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("other").alias("node")).distinct()
    return (
        edges.groupBy("node").agg(F.min("other").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )
