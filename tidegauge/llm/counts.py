"""Token counts with a whole-token shortcut, for sentencepiece BPE models.

Offline proofs, made once per worker from the model itself:

* No entry of the vocabulary holds a word mark behind anything but word marks, nor a line feed; so
  no merge crosses a space or a line feed, and a text can be counted between them.
* A vocabulary string that the library encodes alone as one token counts one wherever it stands
  between such borders; these strings are looked up, and only the rest is merged by the library.

Where a proof fails, or a text holds the word mark itself, the library counts the whole text.

Defined results: null is counted as an empty text: no bytes, no tokens, not over the limit. A null
``doc_id`` keeps its row; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

import sentencepiece
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.chunks import Memo, once
from tidegauge.llm.tables import texts

MARK = "▁"


class PieceCounter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.cuts_proved = self._cuts_are_safe(pieces)
        #: Chunks after a space that are one token; after a line feed there is one more.
        self.whole = self._whole_tokens(pieces) if self.cuts_proved else frozenset()
        self.chunks = Memo(self._count)

    def library(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def _cuts_are_safe(self, pieces: list[str]) -> bool:
        if any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in pieces):
            return False
        probe = "a  b"  # normalisation must leave spaces and line feeds alone, and mark the start
        kept = self.model.normalize(probe) in (MARK + "a" + MARK * 2 + "b", " " + probe)
        mark = self.model.piece_to_id(MARK)
        feed = self.model.encode("\n", num_threads=1)
        return kept and mark != self.model.unk_id() and len(feed) == 2 and feed[0] == mark

    def _whole_tokens(self, pieces: list[str]) -> frozenset[str]:
        marked = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
        return frozenset(s for s, ids in zip(marked, self.model.encode(marked, num_threads=1)) if len(ids) == 1)

    def _count(self, chunk: str) -> int:
        """Tokens of a chunk behind a space, or of one that starts with its line feed."""
        if chunk in self.whole:
            return 1
        if chunk[:1] == "\n":  # the library puts a mark before it, which counts one and merges with nothing
            return self.library(chunk) - 1
        return self.library(chunk)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts_proved or MARK in text:
            return self.library(text)
        chunks = text.replace("\n", " \n").split(" ")
        if "" not in chunks:
            first = chunks[0]
            head = self.library(first)
            return head + sum(map(self.chunks.__getitem__, chunks[1:]))
        total = spaces = 0
        for k, chunk in enumerate(chunks):
            if not chunk:  # one more mark for what follows; the first also stands for the start of the text
                spaces += 1
            elif chunk[0] == "\n":
                total += self._marks(spaces) + self.chunks[chunk]
                spaces = 0
            elif spaces:
                total += self.library(" " * spaces + chunk)
                spaces = 0
            else:
                total += self.chunks[chunk]
        return total + self._marks(spaces)

    def _marks(self, n: int) -> int:
        """Tokens of ``n`` word marks; the library puts the first one itself."""
        return self.library(" " * (n - 1)) if n > 1 else n


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) of every whole text."""

    def run(batches):
        counter = once(f"pieces:{path}", lambda: PieceCounter(path))
        for batch in batches:
            counts = [counter(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = texts(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
