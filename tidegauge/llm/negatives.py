"""Hard negatives by threshold joins over an inverted index, with thresholds that fall until windows fill.

Vectors hold integers, a score is an exact inner product. Every anchor looks for its positives (the best
other rows of its label) and then, for each positive, for the best rows of other labels in a window
below the positive's score.

1. Rows are dealt evenly into blocks, and a block is stored once as an index: dimensions from the most
   to the least energetic in groups, and the norm of what is left of each row after every group.
2. A window has a lowest score wanted. Per block, rows whose remaining norm times the anchors' remaining
   norm stays under all thresholds omit their remaining groups from the index: they only have entries
   in the groups before. Partial scores add up group by group, and a row leaves as soon as its partial
   score plus the product of the remaining norms can't reach any threshold.
3. What is left is scored exactly. A block hands on the best few of each window, never all pairs.
4. The first threshold expects few rows above it, by the mean and covariance of all rows. Windows that
   found too few rows go on with lower thresholds, down to their end, where all rows count.

Anchors are a stated query set against all rows, both in blocks: a block of rows meets every block of
anchors once a round. No block depends on a label or an id, so frequent labels and ids change nothing.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component
take no part. Only vectors of equal length are compared. Repeated rows count as rows of their own, so
a copy of an anchor is one of its other rows, and a repeated anchor row gives its result each time.
Ties of score go by the smaller id. Other columns are not read. Scores beyond 2^53 are an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.session import cut_lineage


@dataclass(frozen=True)
class MiningConfig:
    positives: int = 5
    negatives: int = 5
    #: A negative has at least this percentage of the positive's score, and at most all of it.
    percent: int = 80
    #: Rows and anchors of a block.
    rows_a_block: int = 4096
    anchors_a_block: int = 1024
    #: Dimensions whose products are added at once.
    group: int = 8
    #: Rows that the first threshold expects above it, and how many times more each next one does.
    expected: int = 64
    growth: int = 64
    #: Tasks that share the blocks of rows; each gets all blocks of anchors.
    tasks: int = 4096
    #: Parts of a label's anchors in the join with the label's share.
    salts: int = 16


def _ready(rows: DataFrame, anchor: Column) -> DataFrame:
    """Rows that take part: vec_id, label, dim, vector (doubles as bytes), anchor, in blocks of rows."""

    def run(batches):
        for batch in batches:
            made = [np.array(v, np.float64).tobytes() for v in batch["vector"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=batch.schema.names)

    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    narrow = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.size("embedding").alias("dim"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND dim > 0")
    return narrow.where(sound).mapInArrow(run, "vec_id long, label long, anchor boolean, dim int, vector binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _moments(ready: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per vector length: count, mean and covariance of all rows. The driver gets dim * (dim + 1) sums of each length."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                m = _matrix(batch["vector"].filter(pa.array(dims == dim)), dim)
                new = np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()])
                sums[dim] = sums[dim] + new if dim in sums else new
        for dim, total in sums.items():
            columns = [pa.array([dim] * len(total), pa.int32()), pa.array(range(len(total)), pa.int64()), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "place", "total"])

    parts = ready.select("dim", "vector").mapInArrow(run, "dim int, place long, total double")
    totals: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("dim", "place").agg(F.sum("total").alias("total")).toLocalIterator():
        totals.setdefault(r["dim"], {})[r["place"]] = r["total"]
    out = {}
    for dim, by_place in totals.items():
        flat = np.array([by_place[k] for k in range(1 + dim + dim * dim)])
        n, mean = flat[0], flat[1 : 1 + dim] / flat[0]
        out[dim] = (int(n), mean, flat[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean))
    return out


def _dims_by_energy(moments) -> dict[int, np.ndarray]:
    return {d: np.argsort(-(np.diag(cov) + mean**2), kind="stable") for d, (_, mean, cov) in moments.items()}


def _rest(m: np.ndarray, group: int) -> np.ndarray:
    """Norm of what is left of each row from every group on; the last column is zero."""
    squares = np.cumsum((m * m)[:, ::-1], 1)[:, ::-1]
    return np.sqrt(np.concatenate([squares[:, ::group], np.zeros((len(m), 1))], 1))


def _blocks(ready: DataFrame, order: dict[int, np.ndarray], config: MiningConfig) -> DataFrame:
    """One row per block of rows: ids, labels, row numbers and the matrix, dimensions by energy."""
    size = config.rows_a_block

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            t = pa.Table.from_batches(held.pop(dim))
            m = _matrix(t["vector"], dim)[:, order[dim]]
            cells = [dim, *(t[c].to_numpy().astype(np.int64).tobytes() for c in ("row", "vec_id", "label")), np.ascontiguousarray(m).tobytes()]
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["dim", "rows", "ids", "labels", "matrix"])

        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, size):
                    piece = part.slice(at, size)
                    if sum(b.num_rows for b in held.get(dim, [])) + piece.num_rows > size:
                        yield out(dim)
                    held.setdefault(dim, []).append(piece)
        for dim in list(held):
            yield out(dim)

    return ready.mapInArrow(run, "dim int, rows binary, ids binary, labels binary, matrix binary")


def _exact(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(y).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return np.einsum("ij,ij->i", q, y).astype(np.int64)
    scores = [sum(int(a) * int(b) for a, b in zip(r, s)) for r, s in zip(q.tolist(), y.tolist())]
    if max(map(abs, scores), default=0) > 2**53:
        raise OverflowError("A score of the vectors is beyond 2^53.")
    return np.array(scores, np.int64)


def _most(acc: np.ndarray, q_rest: np.ndarray, rest: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Partial scores plus the product of what is left after ``depth`` groups, in one new matrix."""
    most = np.take(q_rest, depth, axis=1)
    most *= rest
    most += acc
    return most


def _reaching(q: np.ndarray, y: np.ndarray, low: np.ndarray, group: int):
    """(anchor, row, score) of all pairs whose score reaches the anchor's threshold ``low``."""
    q_rest, y_rest = _rest(q, group), _rest(y, group)
    last = y_rest.shape[1] - 1
    slack = 1e-9 * np.outer(q_rest[:, 0], y_rest[:, 0]).max(initial=0.0) + 0.5
    least = low.min() - slack
    # groups of each row in the index: what comes after can't reach a threshold by itself
    depth = (q_rest.max(0)[None, :] * y_rest >= max(least, 0.0)).sum(1).clip(0, last) if least > 0 else np.full(len(y), last)
    rows = np.argsort(-depth, kind="stable")
    depth = depth[rows]
    acc = np.zeros((len(q), len(rows)))
    for g in range(last):
        held = int(np.searchsorted(-depth, -g, side="left"))  # rows with more than g groups
        if not held:
            break
        cut = slice(g * group, (g + 1) * group)
        acc[:, :held] += q[:, cut] @ y[rows[:held], cut].T
        if least > -np.inf and g % 2:
            reached = np.minimum(depth, g + 1)
            alive = (_most(acc, q_rest, y_rest[rows, reached], reached) >= (low - slack)[:, None]).any(0)
            rows, depth, acc = rows[alive], depth[alive], acc[:, alive]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.nonzero(_most(acc, q_rest, y_rest[rows, depth], depth) >= (low - slack)[:, None])
    b = rows[b]
    score = np.concatenate([_exact(q[a[k : k + 65536]], y[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
    kept = score >= low[a]
    return a[kept], b[kept], score[kept]


def _first(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of every anchor by score descending and id."""
    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)]))
    return order[rank < most]


FOUND = "anchor_row long, slot int, vec_id long, score long"


def _round(blocks: DataFrame, windows: DataFrame, order, same: bool, most: int, config: MiningConfig) -> DataFrame:
    """The first rows of every window (anchor_row, label, dim, vector, slots of low and high) in every block."""

    def pack(batches):
        for batch in batches:
            for dim in np.unique(batch["dim"].to_numpy()).tolist():
                part = batch.filter(pa.array(batch["dim"].to_numpy() == dim))
                for at in range(0, part.num_rows, config.anchors_a_block):
                    t = part.slice(at, config.anchors_a_block)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, t.schema) as writer:
                        writer.write_batch(t)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["dim", "anchors"])

    def compare(batches):
        for batch in batches:
            for place, dim in enumerate(batch["dim"].to_pylist()):
                # views of the batch, which holds many blocks
                rows, ids, labels, matrix, packed = (batch[c][place].as_buffer() for c in ("rows", "ids", "labels", "matrix", "anchors"))
                anchors = pa.ipc.open_stream(packed).read_all()
                y = np.frombuffer(matrix, np.float64).reshape(-1, dim)
                row, vec, label = (np.frombuffer(c, np.int64) for c in (rows, ids, labels))
                q = _matrix(anchors["vector"], dim)[:, order[dim]]
                own, own_label = anchors["anchor_row"].to_numpy(), anchors["label"].to_numpy()
                slots = anchors["slots"].to_pylist()
                low = np.array([min(s["low"] for s in w) for w in slots])
                a, b, score = _reaching(q, y, low, config.group)
                like = own_label[a] == label[b]
                fits = (like & (own[a] != row[b])) if same else ~like
                a, b, score = a[fits], b[fits], score[fits]
                for k in range(max(len(w) for w in slots)):
                    lows = np.array([w[k]["low"] if k < len(w) else np.inf for w in slots])
                    highs = np.array([w[k]["high"] if k < len(w) else -np.inf for w in slots])
                    number = np.array([w[k]["slot"] if k < len(w) else -1 for w in slots], np.int32)
                    at = np.flatnonzero((score >= lows[a]) & (score <= highs[a]))
                    at = at[_first(a[at], score[at], vec[b[at]], most)]
                    if len(at):
                        columns = [pa.array(own[a[at]]), pa.array(number[a[at]]), pa.array(vec[b[at]]), pa.array(score[at])]
                        yield pa.RecordBatch.from_arrays(columns, names=["anchor_row", "slot", "vec_id", "score"])

    # every block of rows with every block of anchors of its length: rows stay, anchors go to every task
    salts = F.explode(F.sequence(F.lit(0), F.lit(config.tasks - 1))).alias("task")
    # by shuffle: the size of the anchors' file, of which Spark knows, is before they are copied for the tasks
    packed = windows.mapInArrow(pack, "dim int, anchors binary").select("dim", "anchors", salts)
    found = packed.hint("merge").join(blocks, ["dim", "task"]).mapInArrow(compare, FOUND)
    best = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def _expected_low(q: np.ndarray, moments: tuple, want: float, high: float) -> float:
    """The score with ``want`` rows expected between it and ``high``, were scores normal; -inf below their middle."""
    n, mean, cov = moments
    center, spread = float(q @ mean), float(np.sqrt(max(q @ cov @ q, 0.0)))
    if spread > 0 and high < np.inf:
        want += n * NormalDist().cdf((center - high) / spread)
    return -np.inf if 2 * want >= n else center - spread * NormalDist().inv_cdf(want / n)


def _filled(blocks: DataFrame, anchors: DataFrame, goals: DataFrame, moments, order, same: bool, most: int, config: MiningConfig) -> DataFrame:
    """The first ``most`` rows of every window of ``goals``: anchor_row, slot, end, high, and share, that of the rows of its kind.

    Rounds of falling thresholds; a window is done when it holds ``most`` rows or its threshold is at
    its end. In round k the threshold expects expected * growth ^ k rows.
    """
    done, open_goals, want = [], goals, float(config.expected)
    while True:
        last = want >= max(n for n, _, _ in moments.values())

        def lowered(batches, want=want, last=last):
            for batch in batches:
                slots = []
                for vector, dim, asked in zip(batch["vector"].to_pylist(), batch["dim"].to_pylist(), batch["asked"].to_pylist()):
                    q, own = np.frombuffer(vector, np.float64), []
                    for s in asked:
                        aim = -np.inf if last else _expected_low(q, moments[dim], want / s["share"], s["high"])
                        own.append({"slot": s["slot"], "low": max(s["end"], aim), "high": s["high"], "end": s["end"]})
                    slots.append(own)
                kept = [batch[c] for c in ("anchor_row", "label", "dim", "vector")]
                kind = pa.list_(pa.struct([("slot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("end", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(slots, kind)], names=["anchor_row", "label", "dim", "vector", "slots"])

        asked = open_goals.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("slot", "end", "high", "share"))).alias("asked"))
        schema = "anchor_row long, label long, dim int, vector binary, slots array<struct<slot:int,low:double,high:double,end:double>>"
        # by shuffle: equal vectors take no room in a file, but each its own in a broadcast
        windows = cut_lineage(anchors.hint("merge").join(asked, "anchor_row").mapInArrow(lowered, schema))
        found = cut_lineage(_round(blocks, windows, order, same, most, config))
        state = windows.select("anchor_row", F.inline("slots"))
        counts = found.groupBy("anchor_row", "slot").agg(F.count("*").alias("n"))
        state = state.join(counts, ["anchor_row", "slot"], "left").withColumn("complete", (F.coalesce("n", F.lit(0)) >= most) | (F.col("low") <= F.col("end")))
        state = cut_lineage(state.select("anchor_row", "slot", "complete"))
        done.append(found.join(state.where("complete"), ["anchor_row", "slot"], "left_semi"))
        open_goals = cut_lineage(open_goals.join(state.where("NOT complete"), ["anchor_row", "slot"], "left_semi"))
        if last or open_goals.isEmpty():
            break
        want *= config.growth
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchor: Column, config: MiningConfig = MiningConfig()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has vec_id, label and embedding (integers, of any numeric type); ``anchor`` says which rows are
    anchors. The first config.positives other rows of an anchor's label are its positives; for each, the
    first config.negatives rows of other labels with percent * positive_score <= 100 * negative_score
    <= 100 * positive_score follow by rank.
    """
    spark = rows.sparkSession
    ready = cut_lineage(_ready(rows, anchor).withColumn("row", F.monotonically_increasing_id()))
    moments = _moments(ready)
    if not moments:
        return spark.createDataFrame([], RESULT)
    order = _dims_by_energy(moments)
    total = sum(n for n, _, _ in moments.values())
    config = replace(config, tasks=min(config.tasks, -(-total // config.rows_a_block) + 1))
    task = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(config.tasks)).cast("int")
    blocks = cut_lineage(_blocks(ready, order, config).withColumn("task", task))
    salted = F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))).alias("salt")
    share = ready.groupBy("label").agg((F.count("*") / total).alias("share")).select("label", "share", salted)
    anchors = cut_lineage(ready.where("anchor").select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "label", "dim", "vector"))
    lowest, highest = F.lit(float("-inf")), F.lit(float("inf"))
    goals = anchors.withColumn("salt", F.pmod(F.xxhash64("anchor_row"), F.lit(config.salts)).cast("int")).join(share, ["label", "salt"]).select("anchor_row", F.lit(0).alias("slot"), lowest.alias("end"), highest.alias("high"), "share")
    positives = cut_lineage(
        _filled(blocks, anchors, cut_lineage(goals), moments, order, True, config.positives, config)
        .select("anchor_row", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    # a negative score has no window: its lower end lies above it
    end = F.ceil(F.col("positive_score") * F.lit(config.percent).cast("decimal(20,0)") / 100).cast("double")
    goals = positives.where("positive_score >= 0").select("anchor_row", "slot", end.alias("end"), F.col("positive_score").cast("double").alias("high"), F.lit(1.0).alias("share"))
    goals = cut_lineage(goals)
    if goals.isEmpty():
        return spark.createDataFrame([], RESULT)
    negatives = _filled(blocks, anchors, goals, moments, order, False, config.negatives, config)
    exact = (F.col("score") * F.lit(100).cast("decimal(20,0)") >= F.col("positive_score") * F.lit(config.percent).cast("decimal(20,0)")) & (F.col("score") <= F.col("positive_score"))
    return (
        negatives.join(positives, ["anchor_row", "slot"]).where(exact)
        .join(anchors.select("anchor_row", "anchor_id"), "anchor_row")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
