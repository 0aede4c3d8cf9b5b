"""Cutting texts where no token can cross, and a bounded memory for what repeats.

A text is cut at single spaces and line feeds between visible characters. With a splitting
pattern that only attaches one space to what follows it (``public_tokenizers.PATTERN``), such
chunks can be tokenized alone, so words that occur again cost one look-up.
"""

from __future__ import annotations

import sys
import types
import unicodedata
from collections.abc import Callable, Iterator

#: Chunks kept in each of the two generations of a worker's memory.
REMEMBERED = 200_000
#: Longer chunks are worked out each time, so that the memory's bytes are bounded too.
LONGEST_KEY = 64
#: Marks that follow a word as a piece of their own.
END_MARKS = frozenset(".,;:!?")


def once(name: str, build: Callable):
    """A value that a worker process builds once and keeps over its tasks."""
    kept = sys.modules.setdefault("_tidegauge_worker", types.ModuleType("_tidegauge_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, build())
    return getattr(kept, name)


class Memo(dict):
    """A function's results by key; the least recent generation goes when the newer is full."""

    def __init__(self, compute: Callable, size: int = REMEMBERED, longest: int = LONGEST_KEY):
        super().__init__()
        self.compute, self.size, self.longest, self.older = compute, size, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        if key in self.older:
            value = self.older.pop(key)
        else:
            value = self.compute(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Unassigned(Exception):
    """A text holds a code point of which pattern engines may think differently."""


def has_unassigned(piece: str) -> bool:
    return any(unicodedata.category(c) == "Cn" for c in piece)


def cut(text: str) -> list[str]:
    """Chunks of ``text``: the first is literal, one that starts with a line feed is literal,
    any other stands for itself after one space."""
    return text.replace("\n", " \n").split(" ")


def literal(chunk: str) -> str:
    return chunk if chunk[:1] == "\n" else " " + chunk


def is_closed(chunk: str) -> bool:
    """Whether a chunk that isn't the first can be tokenized alone: it ends visibly, and starts
    visibly, or with one line feed before something visible."""
    if not chunk or chunk[-1].isspace():
        return False
    start = 1 if chunk[0] == "\n" else 0
    return not chunk[start].isspace()


def mapped(text: str, memo: Memo, whole: Callable[[str], bytes]) -> Iterator:
    """Results for a text in order: ``memo`` on closed chunks, ``whole`` on literal stretches.

    ``memo`` gives None for chunks that aren't closed; those are joined with their neighbours.
    """
    chunks = cut(text)
    values = list(map(memo.__getitem__, chunks[1:]))
    first = chunks[0]
    closed_first = bool(first) and not first[-1].isspace()
    if closed_first and None not in values:
        yield whole(first)
        yield from values
        return
    values.insert(0, whole(first) if closed_first else None)
    n, i = len(chunks), 0
    while i < n:
        if values[i] is not None and (i + 1 == n or values[i + 1] is not None):
            yield values[i]
            i += 1
            continue
        j = i  # an open stretch: up to the last chunk before two closed ones, or the end
        while j < n and (values[j] is None or (j + 1 < n and values[j + 1] is None)):
            j += 1
        joined = " ".join(chunks[i : j + 1]).replace(" \n", "\n")
        yield whole(joined if i == 0 or chunks[i][:1] == "\n" else " " + joined)
        i = j + 1


class ChunkEncoder:
    """Encodes whole texts by a splitting pattern and an encoding of single pieces.

    ``find`` gives the pieces of a stretch of text, ``piece`` the encoding of one piece.
    """

    def __init__(self, find: Callable[[str], list[str]], piece: Callable[[str], bytes]):
        self.find, self.piece = find, piece
        self.pieces, self.chunks = Memo(piece), Memo(self._chunk)

    def _chunk(self, chunk: str) -> bytes | None:
        if chunk.isalpha():  # one piece with the space before it
            return self.piece(" " + chunk)
        if chunk[-1:] in END_MARKS and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.pieces[chunk[-1]]
        return self.stretch(literal(chunk)) if is_closed(chunk) else None

    def stretch(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def __call__(self, text: str) -> bytes:
        return b"".join(mapped(text, self.chunks, self.stretch))
