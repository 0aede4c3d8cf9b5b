"""Bounded-space online packing of token sequences into windows.

Each partition streams its documents past a fixed number of open windows. What fills whole windows
by itself is emitted at once; the rest of a document goes where it leaves least room. If it fits nowhere
and no window is free, the fullest is topped up with the head of the rest and emitted, so that it needs
no padding, and what remains is placed again. At the end a partition tops its windows up with
each other; at most one is left partly filled. These leftovers are merged in rounds of bounded
groups until one is left for the whole table.

The packed pieces are written once; windows that were closed are read from there and never
shuffled. Only leftovers travel, with at most one window of ids per partition.

Defined results: a null or empty text is one end id; a null ``doc_id`` keeps its pieces. Repeated rows are
packed each, as documents of their own. A very long text gives many whole windows. An empty table
gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.chunks import ChunkEncoder, Unassigned, has_unassigned, once
from tidegauge.llm.tables import texts
from tidegauge.session import cut_lineage

END_ID = 0
WINDOW = 1024
OPEN_WINDOWS = 64
#: Leftover windows that one task of a merging round packs.
GROUP = 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECE.split(", ")]


class PreTokenEncoder:
    """Ids of whole texts as the ``tokenizers`` library gives them for a byte-level BPE file without
    normalisation, with repeated chunks encoded once.

    The library cuts texts by the same pattern; where the two read a character differently, which only
    code points that are unassigned here can cause, the library encodes the whole text. Special
    tokens inside a text cut it, as they do there. If the file's merges stand in the order of their ids,
    pieces are merged by ``tiktoken`` with the ids as ranks, which is the same and faster.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        ranks = _ranks(path)
        if ranks:
            encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.merge = lambda piece: array("I", encoding._encode_single_piece(piece)).tobytes()
        else:
            self.merge = self._ids
        self.known = ChunkEncoder(regex.compile(public_tokenizers.PATTERN).findall, self._piece)

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() and has_unassigned(piece):
            raise Unassigned
        return self.merge(piece)

    def _plain(self, text: str) -> bytes:
        try:
            return self.known(text) if text else b""
        except Unassigned:
            return self._ids(text)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.specials):
            return self._plain(text)
        cut = regex.split("(" + "|".join(map(regex.escape, self.specials)) + ")", text)
        return b"".join(array("I", [self.specials[x]]).tobytes() if x in self.specials else self._plain(x) for x in cut)


def _ranks(path: str) -> dict[bytes, int]:
    """Bytes of every token with its id, or nothing where ids don't follow the order of the merges."""
    with open(path, encoding="utf-8") as text:
        model = json.load(text)["model"]
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary.get(a + b, -1) for a, b in pairs]
    if order != list(range(256, 256 + len(order))) or any(vocabulary.get(c, 256) > 255 for c in letters):
        return {}
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(order)}


class Packer:
    """Open windows of one partition. ``emit`` takes the pieces of a closed window."""

    def __init__(self, window: int, most_open: int, emit: Callable[[list], None]):
        self.window, self.most_open, self.emit = window, most_open, emit
        self.gaps: list[tuple[int, int]] = []  # room left and number of each open window, in order
        self.open: dict[int, list] = {}
        self.made = 0

    def add(self, piece: tuple) -> None:
        """Places a piece: (document, first position, ids as bytes, tokens of the document)."""
        doc, start, ids, total = piece
        whole = 4 * self.window
        at = 0
        while len(ids) - at >= whole:
            self.emit([(doc, start + at // 4, ids[at : at + whole], total)])
            at += whole
        self._place(doc, start + at // 4, ids[at:], total)

    def _place(self, doc, start: int, ids: bytes, total: int) -> None:
        while ids:
            n = len(ids) // 4
            k = bisect_left(self.gaps, (n, -1))  # the window with least room that is enough
            if k < len(self.gaps):
                gap, number = self.gaps.pop(k)
                self._put(number, gap - n, (doc, start, ids, total))
                return
            if len(self.open) < self.most_open:
                self.made += 1
                self.open[self.made] = []
                self._put(self.made, self.window - n, (doc, start, ids, total))
                return
            gap, number = self.gaps.pop(0)  # none fits: the fullest takes what it can and goes
            self._put(number, 0, (doc, start, ids[: 4 * gap], total))
            start, ids = start + gap, ids[4 * gap :]

    def _put(self, number: int, gap: int, piece: tuple) -> None:
        self.open[number].append(piece)
        if gap:
            insort(self.gaps, (gap, number))
        else:
            self.emit(self.open.pop(number))

    def finish(self) -> list:
        """Tops the open windows up with each other; gives the pieces of the one that may be left."""
        pieces = [p for _, number in self.gaps for p in self.open[number]]
        self.gaps, self.open, self.most_open = [], {}, 1
        for doc, start, ids, total in pieces:
            self._place(doc, start, ids, total)
        return next(iter(self.open.values()), [])


def _rows(pieces: Iterator[tuple[int, list]], closed: bool) -> pa.RecordBatch:
    rows = []
    for sequence, members in pieces:
        offset = 0
        for doc, start, ids, total in members:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, None if closed else ids))
            offset += len(ids) // 4
    columns = list(zip(*rows)) if rows else [[]] * 8
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[*_NAMES, "ids"])


def _packed(pieces: Iterator[tuple], first_sequence: int, window: int, most_open: int) -> Iterator[pa.RecordBatch]:
    done: list[list] = []
    packer = Packer(window, most_open, done.append)
    number = first_sequence
    for piece in pieces:
        packer.add(piece)
        if len(done) > 20_000:
            yield _rows(enumerate(done, number), True)
            number += len(done)
            done.clear()
    left = packer.finish()
    yield _rows(enumerate(done, number), True)
    if left:
        yield _rows([(number + len(done), left)], False)


def pack(docs: DataFrame, path: str, window: int = WINDOW, most_open: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its document and place there, the crc32 of its ids (little-endian unsigned
    32-bit), the document's tokens with the end id, the sequence and the place in it."""

    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(f"pack:{path}", lambda: PreTokenEncoder(path))

        def pieces():
            for batch in batches:
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    ids = encoder(text.as_py()) + end
                    yield doc, 0, ids, len(ids) // 4

        yield from _packed(pieces(), TaskContext.get().partitionId() << 32, window, most_open)

    schema = PIECE + ", ids binary"
    packed = cut_lineage(texts(docs).mapInArrow(run, schema))
    closed, left = [packed.where("ids IS NULL").drop("ids")], packed.where("ids IS NOT NULL")
    groups = left.select("sequence_id").distinct().count()
    level = 0
    while groups > 1:
        level += 1
        left = cut_lineage(_merged(left, level, window, most_open, schema))
        closed.append(left.where("ids IS NULL").drop("ids"))
        left = left.where("ids IS NOT NULL")
        groups = left.select("sequence_id").distinct().count()
    out = left.drop("ids")
    for part in closed:
        out = out.unionByName(part)
    return out


def _merged(left: DataFrame, level: int, window: int, most_open: int, schema: str) -> DataFrame:
    """One merging round: GROUP leftover windows make full ones and at most one leftover."""
    # leftovers of a round are numbered by partition or group, so their ids divide into groups
    shift = 32
    group = F.expr(f"(shiftright(sequence_id, {shift}) & 16777215) DIV {GROUP}")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        cells = [table[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        first = (level << 56) | (table["g"][0].as_py() << shift)
        return pa.Table.from_batches(list(_packed(zip(*cells), first, window, most_open)))

    return left.withColumn("g", group).groupBy("g").applyInArrow(run, schema)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Sequences, tokens and padded positions: a sequence is padded to the window unless its length
    is a power of two."""
    sequences = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.expr("n & (n - 1)") == 0
    return sequences.agg(
        F.count("*").alias("sequences"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(whole, 0).otherwise(window - F.col("n"))), F.lit(0)).alias("padding"),
    )
