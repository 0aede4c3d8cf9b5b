"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

1. A vector is scaled to length one in double precision. Equal vectors form one class with a count.
2. Per table, the signs against random hyperplanes give a bucket. With more vectors a bucket takes
   more bits, so that its expected size stays the same, and the tables grow in number so that a pair
   at the threshold meets in at least one with the same probability (``miss``).
3. Large buckets are dealt into blocks; a task holds two blocks, works out exact cosines, and
   counts a pair only in the first table where it meets. What leaves a task is a count per vector
   and links that span its groups, never all pairs of a group.
4. Links form components.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, link with
nothing; vectors of another length than theirs never meet. Rows with a null id keep their row and
link with nothing; repeated rows of an id are one vector if equal, and are all compared if not.
Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.graph import components
from tidegauge.session import cut_lineage


@dataclass(frozen=True)
class SignConfig:
    cosine: float = 0.95
    #: Vectors that a bucket of unlike ones holds on average.
    load: float = 8.0
    least_bits: int = 8
    #: Probability that a pair at the threshold meets in no table.
    miss: float = 1e-3
    block: int = 1024
    seed: int = 11

    def bits(self, n: int) -> int:
        return min(62, max(self.least_bits, math.ceil(math.log2(max(n, 1) / self.load))))

    def tables(self, bits: int) -> int:
        meets = (1.0 - math.acos(self.cosine) / math.pi) ** bits
        return math.ceil(math.log(self.miss) / math.log1p(-meets))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors, or None where a vector is not to be linked."""
    out: list[np.ndarray | None] = []
    for cell in column:
        values = cell.as_py()
        if not values or None in values:
            out.append(None)
            continue
        v = np.array(values, np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0.0:
            out.append(None)
            continue
        v = v / top
        out.append(v / np.sqrt(v @ v))
    return out


def unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and the unit vector as bytes of doubles (null where it links with nothing)."""

    def run(batches):
        for batch in batches:
            made = [None if v is None else v.tobytes() for v in _vectors(batch["embedding"])]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(made, pa.binary())], names=["vec_id", "unit"])

    narrow = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return narrow.mapInArrow(run, "vec_id long, unit binary")


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, bits * tables))


def codes(units: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One bucket number per vector and table."""
    signs = (units @ planes(units.shape[1], bits, tables, seed) > 0).reshape(len(units), tables, bits)
    return signs.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of pairs that join groups not joined before (a forest over n items)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            kept.append(k)
    return kept


def _pairs_in(units: np.ndarray, code: np.ndarray, table: int, lefts: np.ndarray, rights: np.ndarray, same: bool, cosine: float):
    """Linked pairs of two blocks that meet in no earlier table, in tiles of bounded size."""
    for at in range(0, len(lefts), 256):
        rows = lefts[at : at + 256]
        hit = units[rows] @ units[rights].T >= cosine
        if same:
            hit &= rows[:, None] < rights[None, :]
        x, y = np.nonzero(hit)
        x, y = rows[x], rights[y]
        for k in range(0, len(x), 1 << 16):
            p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            new = ~(code[p, :table] == code[q, :table]).any(1)
            yield p[new], q[new]


def similar_vectors(rows: DataFrame, config: SignConfig = SignConfig()) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept, one row per vector."""
    vectors = cut_lineage(unit_vectors(rows))
    ready = vectors.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    classes = cut_lineage(ready.groupBy("unit").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")))
    # a repeated id with unlike vectors could name two classes: links run between ids, counts add up
    bits = config.bits(classes.count())
    tables = config.tables(bits)
    seed, cosine = config.seed, config.cosine

    def hashed(batches):
        for batch in batches:
            raw = batch["unit"].to_pylist()
            out = np.zeros((len(raw), tables), np.int64)
            lengths = np.array([len(r) for r in raw])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                out[at] = codes(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1), bits, tables, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.tobytes() for r in out], pa.binary()), pa.array(out.tolist(), pa.list_(pa.int64()))],
                names=["unit", "class_id", "copies", "codes", "buckets"],
            )

    coded = cut_lineage(classes.mapInArrow(hashed, "unit binary, class_id long, copies long, codes binary, buckets array<long>"))
    spread = coded.select("unit", "class_id", "copies", "codes", F.octet_length("unit").alias("width"), F.posexplode("buckets").alias("t", "bucket"))
    keys = ["t", "bucket", "width"]
    sizes = spread.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select(*keys, F.ceil(F.col("size") / config.block).cast("int").alias("blocks"))
    members = spread.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("unit", "t"), F.col("blocks")).cast("int"))
    # block pairs (i, j) with i <= j: a member goes to every pair that holds its block
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select(*keys, "unit", "class_id", "copies", "codes", "own", others)
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(table: pa.Table) -> pa.Table:
        t, i, j = table["t"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py()
        n = table.num_rows
        units = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(n, -1)
        code = np.frombuffer(b"".join(table["codes"].to_pylist()), np.int64).reshape(n, -1)
        own = table["own"].to_numpy()
        ids, copies = table["class_id"].to_numpy(), table["copies"].to_numpy()
        lefts, rights = np.flatnonzero(own == i), np.flatnonzero(own == j)
        counts = np.zeros(n, np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in _pairs_in(units, code, t, lefts, rights, i == j, cosine):
            np.add.at(counts, x, copies[y])
            np.add.at(counts, y, copies[x])
            span = _spanning(x, y, n)
            a.append(x[span])
            b.append(y[span])
        x, y = np.concatenate(a), np.concatenate(b)
        span = _spanning(x, y, n)
        x, y = ids[x[span]], ids[y[span]]
        hit = np.flatnonzero(counts)
        units_of = [u for u in (table["unit"][int(k)].as_py() for k in hit)]
        return pa.table({
            "unit": pa.array(units_of + [None] * len(x), pa.binary()),
            "links": pa.array(counts[hit].tolist() + [0] * len(x), pa.int64()),
            "a": pa.array([None] * len(hit) + x.tolist(), pa.int64()),
            "b": pa.array([None] * len(hit) + y.tolist(), pa.int64()),
        })

    found = cut_lineage(dealt.groupBy(*keys, "i", "j").applyInArrow(compare, "unit binary, links long, a long, b long"))
    counted = found.where("unit IS NOT NULL").groupBy("unit").agg(F.sum("links").alias("links"))
    own_links = (
        classes.join(counted, "unit", "left")
        .select("unit", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    )
    labels = components(found.where("a IS NOT NULL").select("a", "b"))
    full = vectors.join(own_links, "unit", "left").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id", "vec_id")
    return full.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
