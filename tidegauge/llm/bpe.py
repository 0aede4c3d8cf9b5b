"""Byte-level BPE by prefix dynamic programming: exact encoding, appends and edits, and decoding.

For every prefix of a piece exactly one vocabulary entry can be the last token of its encoding: the
one whose join with the last token of what stands before it survives all merges. Storing that
token per prefix makes an append extend the store, an edit re-encode only until the stored tokens agree
again, and words with a common beginning share their work.

Ids are ranks, as in rank files, where two neighbours merge if their joined bytes have a rank.

Defined results: a null text is encoded as an empty one, to no ids; a null ``doc_id`` keeps its row.
Any text can be encoded: all 256 bytes are in the vocabulary. Repeated rows give repeated results;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.chunks import ChunkEncoder, Unassigned, has_unassigned, once
from tidegauge.llm.tables import texts


#: Stored prefixes, pairs of tokens, and bytes of a stored prefix that a worker keeps at most.
PREFIXES, PAIRS, LONGEST_PREFIX = 300_000, 400_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks with what the dynamic programme asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Ends of tokens: a stretch that isn't one can't be the end of a token either when it grows.
        self.ends = {token[k:] for token in ranks for k in range(len(token))}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._joins: dict[int, bool] = {}
        self._last: dict[bytes, int] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; the token itself twice for a single byte;
        None if merging its bytes ends elsewhere."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            if len(parts) == 1:
                self._halves[token] = (token, token)
            else:
                while len(parts) > 2:
                    merged = [self.ranks.get(self.tokens[a] + self.tokens[b], -1) for a, b in zip(parts, parts[1:])]
                    best = min((m for m in merged if m >= 0), default=-1)
                    if best < 0:
                        break
                    at = merged.index(best)
                    parts[at : at + 2] = [best]
                self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return self.halves(token) is not None

    def joins(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens' joined bytes is these two tokens."""
        key = left << 32 | right
        known = self._joins.get(key)
        if known is None:
            if len(self._joins) >= PAIRS:
                self._joins.clear()
            known = self._joins[key] = self.reachable(right) and self._survives(left, right)
        return known

    def _survives(self, left: int, right: int) -> bool:
        """Undo the later merge at the border, step by step: no earlier merge may cross it.

        A merge inside the left token wins ties of rank against one across the border, as it stands
        further left; one inside the right token loses them.
        """
        ranks, tokens = self.ranks, self.tokens
        after = None  # the merge, undone last, that a crossing merge would have to come before
        while True:
            crossing = ranks.get(tokens[left] + tokens[right])
            if crossing is not None and (after is None or (crossing, 0) < after):
                return False
            inner_left, inner_right = len(tokens[left]) > 1, len(tokens[right]) > 1
            if not inner_left and not inner_right:
                return True
            if inner_left and (not inner_right or left > right):
                after, left = (left, -1), self.halves(left)[1]
            else:
                after, right = (right, 1), self.halves(right)[0]

    def last_at(self, data: bytes, end: int, last: Sequence[int]) -> int:
        """The last token of ``data[:end]``, given those of all shorter prefixes (``last[k]``)."""
        rank_of, known = self.ranks.get, self._joins.get
        for start in range(end - 1, -1, -1):
            stretch = data[start:end]
            token = rank_of(stretch)
            if token is None:
                if stretch not in self.ends:
                    break
            elif start:
                joined = known(last[start] << 32 | token)
                if joined or (joined is None and self.joins(last[start], token)):
                    return token
            elif self.reachable(token):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and self.reachable(whole):
            return [whole]
        if len(piece) > LONGEST_PREFIX:
            return PrefixStore(self, piece).ids()
        last, known = [-1], self._last
        for k in range(1, len(piece) + 1):
            prefix = piece[:k]
            token = known.get(prefix)
            if token is None:
                token = self.last_at(piece, k, last)
                if len(known) >= PREFIXES:
                    known.clear()
                known[prefix] = token
            last.append(token)
        return self.walk(last, len(piece))

    def walk(self, last: Sequence[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixStore:
    """The encoding of one growing or changing piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        at, self.data = len(self.data), self.data + more
        for end in range(at + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.last_at(self.data, end, self.last))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces ``data[start:end]``; gives how many stored tokens had to be worked out.

        Behind the edit, work stops once as many stored tokens as the longest token has bytes agree:
        from there on every later token depends on equal bytes and equal tokens.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        longest = max(map(len, self.vocabulary.ranks))
        agreed = worked = 0
        for at in range(start + 1, len(self.data) + 1):
            token = self.vocabulary.last_at(self.data, at, self.last)
            self.last.append(token)
            worked += 1
            agreed = agreed + 1 if at > start + len(new) and old[at - shift] == token else 0
            if agreed >= longest:
                self.last += old[at - shift + 1 :]
                break
        return worked

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last, len(self.data))


class TextEncoder:
    """Encodes whole texts: each match of the splitting pattern by itself, repeated chunks once.

    Code points without a category here count as neither letters, numbers nor space, whatever a
    newer table may make of them.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.known = ChunkEncoder(self.find, self._piece)

    def _ids(self, piece: str) -> bytes:
        return array("I", self.vocabulary.encode(piece.encode("utf-8", "replace"))).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() and has_unassigned(piece):
            raise Unassigned
        return self._ids(piece)

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        try:
            return self.known(text)
        except Unassigned:
            return b"".join(map(self._ids, self._cut_plainly(text)))

    def _cut_plainly(self, text: str) -> Iterator[str]:
        at = 0
        for piece in self.find("".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in text)):
            yield text[at : at + len(piece)]
            at += len(piece)


def _list_array(rows: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _encoder(path: str) -> TextEncoder:
    return once(f"bpe:{path}", lambda: TextEncoder(Vocabulary(read_ranks(path))))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, by the rank file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = _list_array([encoder(t.as_py()) for t in part["text"]])
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and data (the decoded bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _encoder(path).vocabulary.tokens
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [b"".join(map(tokens.__getitem__, ids.values.to_numpy().tolist())) for ids in part["ids"]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


class _Decimal(dict):
    """Ids as decimal text."""

    def __missing__(self, token: int) -> bytes:
        self[token] = text = str(token).encode()
        return text


def _digest(ids: list[int]) -> str:
    """SHA-256 of the decimal ids joined by commas."""
    return hashlib.sha256(b",".join(map(once("decimal", _Decimal).__getitem__, ids))).hexdigest()


def digests(decoded: DataFrame) -> DataFrame:
    """n_tokens, the SHA-256 of the decimal ids joined by commas, and that of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ids.values.to_numpy().tolist() for ids in batch["ids"]]
            sizes, hashes = pa.array(map(len, found), pa.int64()), pa.array(map(_digest, found), pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, hashes, batch["decoded_sha256"]], names=DIGESTS)

    hashed = decoded.select("doc_id", "ids", F.sha2("data", 256).alias("decoded_sha256"))
    return hashed.mapInArrow(run, DIGEST_SCHEMA)


DIGESTS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``digests(decode(encode(docs)))`` in one pass, so that no list of ids leaves its worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        decode_ids = encoder.vocabulary.decode
        for batch in batches:
            sizes, hashes, decoded = [], [], []
            for text in batch["text"]:
                ids = memoryview(encoder(text.as_py())).cast("I").tolist()
                sizes.append(len(ids))
                hashes.append(_digest(ids))
                decoded.append(hashlib.sha256(decode_ids(ids)).hexdigest())
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=DIGESTS)

    return texts(docs).mapInArrow(run, DIGEST_SCHEMA)
