"""Removal of repeated passages by hashing lines and the sentences inside them.

1. Texts are cut into units: lines, inside a line sentences, and inside a sentence of over ``LONG`` words chunks. A chunk
   starts at a word whose hash is under those of the ``REACH`` words on either side, so that chunks of a
   passage align wherever in a sentence it begins or ends; equal words in a row have no such place.
   A unit is normalised (A-Z lower-cased, ASCII white space made single spaces, none at the ends) and
   digested to 96 bits, a chunk together with the words after it (at a sentence's end, before it) up to
   ``CONTEXT`` words, so that short phrases don't count as repeated. Its place is kept in characters.
2. A text's units are written as one row. Their digests are grouped over all documents, pre-aggregated before
   the shuffle; each that more than one document holds keeps its smallest doc_id, and is marked in a bitmap of a
   fixed size. A later occurrence is one in another document than that, or a repetition in its own text.
3. Inside each document, stretches of neighbouring units that are marked or repeated and have at least ``least_words``
   words ask for their digests' smallest doc_id; all other units are never sent. A false mark costs a question. Very
   common digests are known to the tasks. A stretch of neighbouring later occurrences is then removed if it has
   ``least_words`` words; shorter ones are left, so that common short lines and set phrases of clean texts stay.
4. The spans removed are returned with their original offsets next to the remaining text.

Defined results: null, empty and blank texts have no units and stay as they are, null included. A null
``doc_id`` stays and takes part neither as an occurrence nor as a text to be cut. Equal rows of a
``doc_id`` are one document and are cut alike; unequal texts under one id take nothing from each other.
Other columns pass through ``deduplicate`` unchanged, also such that are
named like ours.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.tables import texts
from tidegauge.session import cut_lineage

LEAST_WORDS = 25
REACH = 4
CONTEXT = 10
LONG = 16

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = _UPPER.lower()
_NEVER = 1 << 32
_ASCII_LOWER = str.maketrans(_UPPER.decode(), _LOWER.decode())
#: A unit ends at a line feed, or behind . ! or ? before white space.
_UNIT = re.compile(r"[^\n]*?(?:[.!?]+(?=[\t-\r ])|(?=\n)|\Z)", re.A)
_SPACE = re.compile(r"[\t-\r ]+", re.A)
_WORD = re.compile(r"[^\t-\r ]+", re.A)


SPAN = "start int, end int, words int, first_doc long"


def _chunk_starts(words: list[bytes]) -> list[int]:
    """Numbers of the words that start a chunk, but for the first."""
    n, out = len(words), []
    if n <= LONG:
        return out
    codes = [_NEVER] * REACH + [zlib.crc32(w) for w in words] + [_NEVER] * REACH
    for i in range(REACH + 1, n + REACH):
        h = codes[i]
        if h < codes[i - 1] and h < codes[i + 1] and h < min(codes[i - REACH : i - 1]) and h < min(codes[i + 2 : i + REACH + 1]):
            out.append(i - REACH)
    return out


def units(text: str) -> Iterator[tuple[int, int, int, int, str]]:
    """start, end, edges, number of words and normalised form of each unit that has a word.

    Edges: 1 if nothing but white space stands before the unit in its line, plus 2 if a line feed follows.
    """
    at, n, opens = 0, len(text), 1
    while at < n:
        end = _UNIT.match(text, at).end()
        feed = end < n and text[end] == "\n"
        if end > at:
            form = _SPACE.sub(" ", text[at:end]).strip(" ").translate(_ASCII_LOWER)
            if form:
                words = form.encode("utf-8", "surrogatepass").split(b" ")
                starts = _chunk_starts(words)
                if not starts:
                    yield at, end, opens + 2 * feed, len(words), form
                else:
                    yield from _chunks(text, at, end, opens, feed, words, starts)
                opens = 0
        if feed:
            at, opens = end + 1, 1
        else:
            at = max(end, at + 1)


def _chunks(text: str, at: int, end: int, opens: int, feed: bool, words: list[bytes], starts: list[int]) -> Iterator[tuple[int, int, int, int, str]]:
    """The units of a sentence of more than one chunk."""
    n, places = len(words), [m.start() for m in _WORD.finditer(text, at, end)]
    for a, b in zip([0, *starts], [*starts, n]):
        form = b" ".join(words[max(0, min(a, n - CONTEXT)) : max(b, a + CONTEXT)]).decode("utf-8", "surrogatepass")
        edges = (opens if a == 0 else 0) + (2 * feed if b == n else 0)
        yield places[a] if a else at, places[b] if b < n else end, edges, b - a, form


Digest = tuple[int, int]
#: Bits of the bitmap of repeated digests: 16 MB.
BITS = 1 << 27
#: A digest in more than one of so many occurrences is looked up without a shuffle; there are fewer such digests.
HOT = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per text: doc_id, version (hash of the text), its number of units, and of all units, as bytes, the
    digest's first 64 and next 32 bits, the gap since the unit before and the length in characters, words, and edges."""
    names = ["doc_id", "version", "size", "h0", "h1", "gap", "length", "words", "edges"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cells: list[list] = [[] for _ in names[2:]]
                for text in part["text"]:
                    found = list(units(text.as_py()))
                    digests = b"".join([xxhash.xxh3_128_digest(u[4].encode("utf-8", "surrogatepass"))[:12] for u in found])
                    halves = np.frombuffer(digests, [("h0", "<i8"), ("h1", "<i4")])
                    start, end, edges, words = np.array([u[:4] for u in found], np.int64).reshape(-1, 4).T
                    gap = start - np.r_[0, end[:-1]][: len(start)]
                    columns = (halves["h0"], halves["h1"], gap.astype("<i4"), (end - start).astype("<i4"), words.astype("<i4"), edges.astype("<i1"))
                    for cell, value in zip(cells, (len(found), *[c.tobytes() for c in columns])):
                        cell.append(value)
                kinds = [pa.int64(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["version"], *map(pa.array, cells, kinds)], names=names)

    known = texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("version", F.xxhash64("text"))
    return known.mapInArrow(run, "doc_id long, version long, size long, h0 binary, h1 binary, gap binary, length binary, words binary, edges binary")


def _digests(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["h0"], "<i8"), np.frombuffer(row["h1"], "<i4")


def _first_here(h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Whether no unit before it in the text has the same digest."""
    order = np.lexsort((np.arange(len(h0)), h1, h0))
    same = (h0[order][1:] == h0[order][:-1]) & (h1[order][1:] == h1[order][:-1])
    out = np.ones(len(h0), bool)
    out[order[1:][same]] = False
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {c: batch[c][k].as_py() for c in batch.schema.names}


def earliest(found: DataFrame) -> DataFrame:
    """h0, h1, first_doc and n (documents) of the digests in more than one document."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                h0, h1 = _digests(row)
                own = _first_here(h0, h1)
                doc = pa.array(np.full(int(own.sum()), row["doc_id"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h0[own]), pa.array(h1[own]), doc], names=["h0", "h1", "doc_id"])

    rows = found.where("size > 0").select("doc_id", "h0", "h1").mapInArrow(run, "h0 long, h1 int, doc_id long")
    grouped = rows.groupBy("h0", "h1").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))
    return grouped.where("first_doc < last_doc").select("h0", "h1", "first_doc", "n")


def _marks(repeated: DataFrame):
    """The bitmap of the repeated digests as a broadcast of BITS bits, whatever their number."""
    place = F.pmod("h0", F.lit(BITS))
    rows = repeated.groupBy(F.expr(f"pmod(h0, {BITS}) div 32768").alias("row")).agg(F.bitmap_construct_agg(place % 32768).alias("bitmap"))
    bits = bytearray(BITS // 8)
    for r in rows.toLocalIterator():  # at most BITS / 32,768 rows of 4 KB
        bits[r["row"] * 4096 : (r["row"] + 1) * 4096] = bytes(r["bitmap"])
    return repeated.sparkSession.sparkContext.broadcast(bits)


def _long_runs(candidate: np.ndarray, words: np.ndarray, least_words: int) -> np.ndarray:
    """Units in stretches of neighbouring candidates with enough words."""
    change = np.flatnonzero(np.diff(np.r_[False, candidate, False].astype(np.int8)))
    total = np.r_[0, np.cumsum(words)]
    out = np.zeros(len(candidate), bool)
    for a, b in zip(change[::2], change[1::2]):
        out[a:b] = total[b] - total[a] >= least_words
    return out


def candidates(found: DataFrame, marks, hot: dict[Digest, int], least_words: int) -> DataFrame:
    """The units that may be later occurrences and stand in stretches long enough: doc_id, version, digest, place,
    meta, and first_doc where it is known (repetitions in the text itself, hot digests)."""
    names = ["doc_id", "version", "h0", "h1", "place", "meta", "first_doc"]

    def run(batches):
        bits = np.frombuffer(marks.value, np.uint8)
        hot_h0 = np.array(sorted({h for h, _ in hot}), np.int64)
        for batch in batches:
            for row in _rows(batch):
                h0, h1 = _digests(row)
                place = (h0 % BITS).astype(np.int64)
                again = ~_first_here(h0, h1)
                candidate = again | ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)
                words = np.frombuffer(row["words"], "<i4").astype(np.int64)
                at = np.flatnonzero(_long_runs(candidate, words, least_words))
                if not len(at):
                    continue
                gap, length = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("gap", "length"))
                end = np.cumsum(gap + length)
                spot, meta = (end - length) << 32 | end, np.arange(len(h0)) << 34 | words << 2 | np.frombuffer(row["edges"], np.int8)
                first = [row["doc_id"] if a else None for a in again[at].tolist()]
                no_repeat = np.zeros(len(at), bool)
                for k in np.flatnonzero(np.isin(h0[at], hot_h0) & ~again[at]).tolist():
                    first[k] = hot.get((int(h0[at[k]]), int(h1[at[k]])))
                    no_repeat[k] = first[k] == row["doc_id"]
                ids = [pa.array(np.full(len(at), row[c], np.int64)) for c in ("doc_id", "version")]
                columns = [*ids, *(pa.array(c[at]) for c in (h0, h1, spot, meta)), pa.array(first, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(~no_repeat))

    schema = "doc_id long, version long, h0 long, h1 int, place long, meta long, first_doc long"
    return found.where("size > 0").mapInArrow(run, schema)


def stretches(group: list[dict], least_words: int) -> list[dict]:
    """Runs of neighbouring units with enough words. A run of whole lines goes with its last line feed."""
    out, run = [], []
    for item in [*sorted(group, key=lambda x: x["unit"]), None]:
        if run and (item is None or item["unit"] != run[-1]["unit"] + 1):
            words = sum(x["words"] for x in run)
            if words >= least_words:
                whole = run[0]["edges"] & 1 and run[-1]["edges"] & 2
                longest = max(run, key=lambda x: (x["words"], -x["unit"]))
                out.append({"start": run[0]["start"], "end": run[-1]["end"] + bool(whole), "words": words, "first_doc": longest["first_doc"]})
            run = []
        if item is not None:
            run.append(item)
    return out


def _unpacked(item: dict) -> dict:
    place, meta = item["place"], item["meta"]
    return {
        "start": place >> 32, "end": place & 0xFFFFFFFF, "unit": meta >> 34, "words": meta >> 2 & 0xFFFFFFFF, "edges": meta & 3,
        "first_doc": item["first_doc"],
    }


@contextmanager
def _rows_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """Queries run inside hand workers at most so many rows at once."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, version and spans of the documents to be cut.

    A span has its start and end in characters of the original text, its words, and the document
    that keeps the earliest occurrence of its longest unit.
    """
    # rows hold a whole text's units, so fewer of them go to a worker at once
    with _rows_at_once(docs.sparkSession, 1000):
        found = cut_lineage(occurrences(docs))
        repeated = cut_lineage(earliest(found))
    total = found.agg(F.sum("size")).first()[0] or 0
    hot = {(r["h0"], r["h1"]): r["first_doc"] for r in repeated.where(F.col("n") * HOT > total).collect()}  # under HOT rows
    marks = _marks(repeated)
    with _rows_at_once(docs.sparkSession, 1000):
        later = cut_lineage(candidates(found, marks, hot, least_words))
    marks.destroy()  # all that needs it is written
    item = F.struct("meta", "place", "first_doc")
    known = later.where("first_doc IS NOT NULL")
    asked = later.where("first_doc IS NULL").drop("first_doc").join(repeated.drop("n"), ["h0", "h1"])
    others = asked.where("doc_id <> first_doc")
    both = known.select("doc_id", "version", item.alias("u")).unionByName(others.select("doc_id", "version", item.alias("u")))
    # the units of one text: bounded by the text itself
    lists = both.groupBy("doc_id", "version").agg(F.collect_set("u").alias("u"))
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("first_doc", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans = [stretches(list(map(_unpacked, group)), least_words) for group in batch["u"].to_pylist()]
            rows = pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], pa.array(spans, spans_type)], names=["doc_id", "version", "spans"])
            yield rows.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return lists.mapInArrow(run, f"doc_id long, version long, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")


def remaining(text: Column, spans: Column) -> Column:
    """The text without its spans."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(spans.isNull(), text).otherwise(F.array_join(kept, ""))


def deduplicate(docs: DataFrame, least_words: int = LEAST_WORDS, spans: str = "removed_spans") -> DataFrame:
    """The documents with what remains of ``text``, and a new column of removed spans (null where
    nothing was removed; named ``spans``, with underscores before it if that name is taken)."""
    while spans in docs.columns:
        spans = "_" + spans
    cuts = repeats(docs, least_words).select(F.struct("doc_id", "version").alias("key"), "spans")
    right = cuts.select(F.col("key.doc_id").alias("k0"), F.col("key.version").alias("k1"), F.col("spans").alias("s"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = left.withColumns({"id": F.col("row.doc_id").cast("long"), "t": F.col("row.text").cast("string")})
    joined = left.join(right, (F.col("id") == F.col("k0")) & (F.xxhash64("t") == F.col("k1")), "left")
    columns = [F.col(f"row.`{c}`").alias(c) if c != "text" else remaining(F.col("t"), F.col("s")).alias("text") for c in docs.columns]
    return joined.select(*columns, F.col("s").alias(spans))
