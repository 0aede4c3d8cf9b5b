"""Near-duplicates of texts by SetSketch registers.

1. Every whole text becomes a sketch: per register the minimum of a hash over its distinct word
   shingles, kept as the exponent of an exponentially spaced scale, truncated to 16 bits. Sketches
   of unions are maxima of registers (``merge``).
2. Texts with one set of shingles fall into one class by a 128-bit digest; only the smallest id of
   a class goes on.
3. Bands of register values bring representatives together. In each bucket all members are held
   against one hub, the member that shares most buckets, so a bucket of n gives n - 1 pairs.
4. The Jaccard similarity of a pair is estimated from both sketches by maximum likelihood; pairs far
   below the threshold go, all others are confirmed on full sets.
5. Linked texts form components. In buckets whose members beside the hub are still in several
   components, the outliers are held, in blocks of bounded size, against the members of other
   components. A pair is tried in the first band it shares, and not once a block has joined its
   components; what leaves a task are links that join components, never the pairs of a group. So no
   link between different texts that share a band is lost.

With 28 bands of 5 registers a pair of similarity 0.8 shares a band with probability 0.99998.

Defined results: null, empty and blank texts have no shingles and link with nothing. Rows of a
null ``doc_id`` are left out of links but kept in the result. Repeated rows of one ``doc_id`` are one
document: the sets must agree, else the smallest digest stands. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.graph import components
from tidegauge.llm.tables import texts
from tidegauge.session import cut_lineage

TILE = 4096


@dataclass(frozen=True)
class SketchConfig:
    """Word shingles and the sketch. ``percent`` is the least similarity of a link."""

    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    #: Standard errors of the estimate by which a pair may miss the threshold and still be confirmed.
    slack: float = 5.0
    #: Members of a bucket in one block.
    block: int = 512

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - self.slack * (t * (1 - t) / self.registers) ** 0.5


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit digests of the word shingles of a whole text.

    A-Z are lower-cased; words are runs of anything but ASCII white space. A text with fewer words
    than a shingle is one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    size = min(words, n)
    with np.errstate(over="ignore"):
        mixed = np.full(n - size + 1, np.uint64(size), np.uint64)
        for k in range(size):
            mixed = (mixed ^ digests[k : n - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def multipliers(registers: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 31, registers, np.uint32) * np.uint32(2) + np.uint32(1)


def sketch(items: np.ndarray, config: SketchConfig, factors: np.ndarray) -> np.ndarray:
    """The registers of a set: floor(1 - log_base of the least exponential value), in 16 bits."""
    low = np.full(config.registers, 0xFFFFFFFF, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), TILE):
        tile = short[at : at + TILE]
        np.minimum(low, np.multiply.outer(factors, tile).min(axis=1), out=low)
    value = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / config.rate
    return np.clip(np.floor(1.0 - np.log(value) / np.log(config.base)), 0, 65535).astype("<u2")


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union of sets."""
    return np.maximum.reduce(sketches)


GRID = np.linspace(0.005, 0.995, 100)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, config: SketchConfig) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches of sets of known size.

    Of two registers one is larger with probability p(u - v J) or p(v - u J), where u and v are the
    shares of the sizes and p(x) = -log_b(1 - x (b - 1) / b); else they are equal.
    """
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    most = np.minimum(u / v, v / u)
    jaccard = GRID[None, :] * most
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1.0) * (config.base - 1) / config.base) / np.log(config.base)
    up, down = p(u - v * jaccard), p(v - u * jaccard)
    same = np.clip(1.0 - up - down, 1e-12, 1.0)
    fit = above[:, None] * np.log(up) + below[:, None] * np.log(down) + equal[:, None] * np.log(same)
    return jaccard[np.arange(len(a)), fit.argmax(1)]


def sketches(docs: DataFrame, config: SketchConfig) -> DataFrame:
    """doc_id, n_shingles, digest of the set (binary, null if empty) and registers (binary)."""
    factors = multipliers(config.registers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, registers = [], [], []
            for text in batch["text"]:
                items = shingles(text.as_py(), config.words)
                sizes.append(len(items))
                digests.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                registers.append(sketch(items, config, factors).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "registers"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def _bands(sketched: DataFrame, config: SketchConfig) -> DataFrame:
    """(band, bucket, doc): one row per band."""
    width = 2 * config.rows
    keys = [F.xxhash64(F.lit(k), F.substring("registers", 1 + width * k, width)) for k in range(config.bands)]
    return sketched.select(F.posexplode(F.array(*keys)).alias("band", "bucket"), F.col("doc_id").alias("doc"))


def _members(bands: DataFrame) -> DataFrame:
    """Rows of buckets with two or more members, with the bucket's size."""
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return bands.join(sizes, "bucket")


def _with_hubs(members: DataFrame) -> DataFrame:
    """Adds the hub of each bucket: the member with most company over all its buckets."""
    company = members.groupBy("doc").agg(F.sum("size").alias("company"))
    known = members.join(company, "doc")
    hubs = known.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("doc")).alias("d"))).alias("h"))
    hubs = hubs.select("bucket", (-F.col("h.d")).alias("hub"))
    return members.join(hubs, "bucket")


def _likely(pairs: DataFrame, sketched: DataFrame, config: SketchConfig) -> DataFrame:
    """Pairs (a, b) whose sizes and estimate don't rule the link out."""
    side = lambda k: sketched.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    joined = joined.where(100 * F.least("n_a", "n_b") >= config.percent * F.greatest("n_a", "n_b"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, config.registers) for c in ("r_a", "r_b")]
            sizes = [batch[c].to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
            keep = estimate(*regs, *sizes, config) >= config.least_estimate
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, config: SketchConfig) -> DataFrame:
    """The full sets (doc, items) of the texts that meet any other in a bucket."""

    def run(batches):
        for batch in batches:
            made = [shingles(t.as_py(), config.words).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.binary())], names=["doc", "items"])

    made = texts(docs).join(wanted.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return made.mapInArrow(run, "doc long, items binary").groupBy("doc").agg(F.min("items").alias("items"))


def _is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, config: SketchConfig) -> DataFrame:
    """Pairs (a, b) that are links by their full sets."""
    side = lambda k: sets.select(F.col("doc").alias(k), F.col("items").alias(f"s_{k}"))

    def run(batches):
        for batch in batches:
            keep = [
                _is_link(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), config.percent)
                for x, y in zip(batch["s_a"], batch["s_b"])
            ]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _outlier_links(members: DataFrame, labels: DataFrame, sketched: DataFrame, sets: DataFrame, config: SketchConfig) -> DataFrame:
    """Links (a, b) between components from the pairs of a bucket that don't hold its hub.

    Outliers are members outside their hub's component. They are dealt in blocks, and so are all
    members; a task sees one block of either.
    """
    label = lambda k, c: labels.select(F.col("node").alias(k), F.col("component").alias(c))
    own = F.coalesce("component", "doc")
    known = (
        members.join(label("doc", "component"), "doc", "left")
        .join(label("hub", "hub_component"), "hub", "left")
        .select("band", "bucket", "doc", "hub", own.alias("component"), (own != F.coalesce("hub_component", "hub")).alias("outlier"))
        .where("doc <> hub")
    )
    open_ = known.groupBy("bucket").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"), F.count_if("outlier").alias("m")
    )
    blocks = lambda n: F.ceil(F.col(n) / config.block).cast("int")
    open_ = open_.where("c0 <> c1").select("bucket", blocks("n").alias("right_blocks"), blocks("m").alias("left_blocks"))
    sized = sketched.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "registers")
    rows = known.join(open_, "bucket").join(sized, "doc").join(sets, "doc")
    at = lambda n: F.pmod(F.xxhash64("doc", "bucket"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["band", "bucket", "doc", "component", "registers", "items"]
    left = rows.where("outlier").select(*cols, F.lit(True).alias("left"), at("left_blocks").alias("i"), spread("right_blocks").alias("j"))
    right = rows.select(*cols, F.lit(False).alias("left"), at("right_blocks").alias("j"), spread("left_blocks").alias("i"))

    def run(table: pa.Table) -> pa.Table:
        is_left = table["left"].to_numpy(zero_copy_only=False)
        band, doc, label = table["band"][0].as_py(), table["doc"].to_numpy(), table["component"].to_numpy()
        regs = np.frombuffer(b"".join(table["registers"].to_pylist()), "<u2").reshape(-1, config.registers)
        items = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        size = np.array([len(x) for x in items], np.float64)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        rights, a, b = np.flatnonzero(~is_left), [], []
        for x in np.flatnonzero(is_left):
            other = rights[label[rights] != label[x]]
            other = other[100 * np.minimum(size[other], size[x]) >= config.percent * np.maximum(size[other], size[x])]
            equal = regs[other] == regs[x]
            likely = equal.mean(1) >= config.least_estimate - 0.02  # most go by their equal registers alone
            if band:
                likely &= ~equal[:, : band * config.rows].reshape(len(other), band, config.rows).all(2).any(1)
            other = other[likely]
            if not len(other):
                continue
            found = estimate(np.repeat(regs[x][None], len(other), 0), regs[other], np.full(len(other), size[x]), size[other], config)
            for k in np.argsort(-found, kind="stable"):
                if found[k] < config.least_estimate:
                    break
                y = other[k]
                p, q = find(int(label[x])), find(int(label[y]))
                if p != q and _is_link(items[x], items[y], config.percent):
                    root[max(p, q)] = min(p, q)
                    a.append(doc[x])
                    b.append(doc[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.unionByName(right).groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """doc_id, n_shingles, class_id (the smallest id with the same set), component_id (the smallest
    id reachable by links) and kept (whether that is the document itself)."""
    sketched = cut_lineage(sketches(docs, config))
    classes = sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classed = sketched.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    first = sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL").join(
        classes.select(F.col("class_id").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi"
    )
    least = F.min(F.struct("digest", "n_shingles", "registers")).alias("s")
    first = cut_lineage(first.groupBy("doc_id").agg(least).select("doc_id", "s.n_shingles", "s.registers"))
    members = cut_lineage(_with_hubs(_members(_bands(first, config))))
    sets = cut_lineage(_sets(docs, members, config))
    pairs = members.where("doc <> hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
    links = cut_lineage(_confirmed(_likely(pairs, first, config), sets, config))
    labels = cut_lineage(components(links))
    more = cut_lineage(_outlier_links(members, labels, first, sets, config))
    # a component's smallest member stands for it: links from it to its members keep it together
    labels = cut_lineage(components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    component: Column = F.coalesce("component", "class_id", "doc_id")
    return classed.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
