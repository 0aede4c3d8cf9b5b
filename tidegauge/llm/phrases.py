"""Collocations: phrases whose words stand together far more often than apart, by prefix-free parsing.

1. A text is cut into pieces at punctuation, a piece into chunks at its trigger words: words whose
   hash meets a fixed condition, so that equal passages are cut alike wherever they begin. A chunk
   holds its own words and a look-ahead of ``longest - 1`` words that the next chunk owns.
2. Equal chunks become one row of a dictionary with their frequency in the parse.
3. Phrases are counted inside different chunks only, times the frequency. A phrase belongs to the
   chunk that owns its first word, so what two chunks overlap in is counted once.
4. Phrases of n words are counted only where both phrases of n - 1 words inside them are frequent.
   The frequent ones are marked in a bitmap of a fixed size; a false mark costs work, never a result.
5. Each candidate is scored at its weakest cut and left out if a longer one explains it.

Defined results: null texts are empty, a null language is ``und``, empty texts give nothing, repeated
rows count each time, ties have the order stated below. Only the text and language columns are read.
An empty table gives an empty result. Counts up to 10^16 are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.session import cut_lineage


@dataclass(frozen=True)
class PhraseConfig:
    #: Words of the longest phrase.
    longest: int = 3
    #: Occurrences that make a phrase a candidate.
    least: int = 10
    #: A candidate goes if a longer one has at least this percentage of its occurrences.
    explained: int = 50
    #: Phrases returned of a language.
    top: int = 2000
    #: One word in so many is a trigger.
    spacing: int = 32
    #: A chunk owns at most so many words, whatever the triggers.
    widest: int = 64
    #: Bits of the bitmap of frequent phrases: 16 MB.
    bits: int = 1 << 27
    #: Chunks that a task holds before it hands them on.
    held: int = 200_000
    #: Words whose phrases a task counts at once.
    words_at_once: int = 1 << 21
    #: Parts in which a language is ranked first.
    parts: int = 64


# the characters that end a piece, and the white space inside one
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def _chunks(words: list[bytes], trigger: Callable[[bytes], bool], config: PhraseConfig) -> Iterator[tuple[bytes, int]]:
    """Chunks of a piece with the number of words that each owns."""
    n, start, more = len(words), 0, config.longest - 1
    if n <= config.widest and not any(map(trigger, words)):
        yield b" ".join(words), n
        return
    for at in range(1, n):
        if trigger(words[at]) or at - start == config.widest:
            yield b" ".join(words[start : at + more]), at - start
            start = at
    yield b" ".join(words[start:]), n - start


class _Triggers(dict):
    """Whether a word is a trigger; a bounded memory of answers."""

    def __init__(self, spacing: int):
        self.spacing = spacing

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word) % self.spacing == 0
        return found


def parse(docs: DataFrame, config: PhraseConfig = PhraseConfig(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, words, own and freq: the dictionary of different chunks with their frequencies."""
    schema = "lang string, words string, own int, freq long"
    names = ["lang", "words", "own", "freq"]

    def run(batches):
        trigger = _Triggers(config.spacing).__getitem__
        held: Counter = Counter()

        def out():
            keys = list(held)
            columns = [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()),
                pa.array([k[2] for k in keys], pa.int32()),
                pa.array(list(held.values()), pa.int64()),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for language, body in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary())):
                # lower() of bytes changes A-Z only
                for piece in (body.as_py() or b"").lower().translate(ENDS).split(b"\n"):
                    words = piece.split()
                    if words:
                        for chunk, own in _chunks(words, trigger, config):
                            held[language, chunk, own] += 1
                if len(held) >= config.held:
                    yield out()
        if held:
            yield out()

    narrow = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.col(f"`{text}`").cast("string").alias("text"),
    ).where("text IS NOT NULL")
    found = narrow.mapInArrow(run, schema)
    return found.groupBy("lang", "words", "own").agg(F.sum("freq").alias("freq"))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent combination of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _hashes(values: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(v) for v in values.cast(pa.binary()).to_pylist()], np.uint64)


class _Words:
    """The words of a run of chunks as numbers, with hashes of the phrases that start at each."""

    def __init__(self, chunks: pa.Table):
        lists = pc.split_pattern(chunks["words"].combine_chunks(), " ")
        words = lists.flatten().dictionary_encode()
        self.dictionary, self.codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.chunk = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.arange(len(self.codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = np.repeat(sizes, sizes) - self.at
        langs = chunks["lang"].combine_chunks().dictionary_encode()
        self.langs, lang_codes = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
        self.lang = lang_codes[self.chunk]
        self.owned = self.at < chunks["own"].to_numpy()[self.chunk]
        self.freq = chunks["freq"].to_numpy()[self.chunk]
        self.lang_hash, self.word_hash = _hashes(self.langs), _hashes(self.dictionary)

    def frequent(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Whether the phrase of n words from each word on is marked (False where fewer words follow)."""
        at = np.flatnonzero(self.left >= n)
        value = self.lang_hash[self.lang[at]]
        for k in range(n):
            value = _mix(value, self.word_hash[self.codes[at + k]])
        out = np.zeros(len(self.codes), bool)
        out[at] = _marked(value, bits)
        return out

    def counted(self, n: int, start: np.ndarray) -> pa.Table:
        """lang, phrase and f of the phrases of n words at ``start``."""
        key, width = self.lang[start], np.int64(len(self.dictionary))
        for k in range(n):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * width + self.codes[start + k]
        order = np.argsort(key, kind="stable")
        key, start = key[order], start[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        f = np.add.reduceat(self.freq[start], first) if len(first) else np.zeros(0, np.int64)
        start = start[first]
        words = [self.dictionary.take(pa.array(self.codes[start + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]
        return pa.table([self.langs.take(pa.array(self.lang[start])), phrase, pa.array(f, pa.int64())], names=["lang", "phrase", "f"])


def _marked(value: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = value % np.uint64(len(bits) * 8)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count(chunks: DataFrame, n: int, config: PhraseConfig, bits=None) -> DataFrame:
    """lang, phrase and f of all phrases of n words, or of those whose parts of n - 1 words are marked."""

    def run(batches):
        def out(kept):
            words = _Words(pa.Table.from_batches(kept))
            start = words.owned & (words.left >= n)
            if bits is not None and n > 1:
                known = words.frequent(n - 1, np.frombuffer(bits.value, np.uint8))
                start[:-1] &= known[:-1] & known[1:]
            yield from words.counted(n, np.flatnonzero(start)).to_batches()

        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch["words"].nbytes
            if size >= 6 * config.words_at_once:
                yield from out(kept)
                kept, size = [], 0
        if kept:
            yield from out(kept)

    found = chunks.mapInArrow(run, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def marks(frequent: DataFrame, config: PhraseConfig):
    """The bitmap of the frequent phrases as a broadcast of config.bits bits, whatever their number."""
    size = config.bits
    per_row = 8 * 4096  # bits of one row of bitmap_construct_agg

    def run(batches):
        for batch in batches:
            phrases = batch["phrase"]
            lists = pc.split_pattern(phrases, " ")
            words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            value, at = _hashes(batch["lang"]), np.cumsum(sizes) - sizes
            hashed = _hashes(words)
            for k in range(int(sizes.max()) if len(sizes) else 0):
                more = np.flatnonzero(sizes > k)
                value[more] = _mix(value[more], hashed[at[more] + k])
            yield pa.RecordBatch.from_arrays([pa.array((value % np.uint64(size)).astype(np.int64))], names=["place"])

    places = frequent.select("lang", "phrase").mapInArrow(run, "place long")
    rows = places.groupBy(F.expr(f"place div {per_row}").alias("row")).agg(F.bitmap_construct_agg(F.col("place") % per_row).alias("bitmap"))
    bits = bytearray(size // 8)
    for r in rows.toLocalIterator():  # at most bits / 32,768 rows of 4 KB
        bits[r["row"] * 4096 : (r["row"] + 1) * 4096] = bytes(r["bitmap"])[: len(bits) - r["row"] * 4096]
    return frequent.sparkSession.sparkContext.broadcast(bits)


def _looked_up(phrases: DataFrame, key, counts: DataFrame, name: str) -> DataFrame:
    """``phrases`` with the count of the phrase ``key``."""
    counts = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
    return phrases.withColumn("_key", key).join(counts, (F.col("lang") == F.col("_lang")) & (F.col("_key") == F.col("_part"))).drop("_lang", "_part", "_key")


def _scored(phrases: DataFrame, n: int, levels: dict[int, DataFrame]) -> DataFrame:
    """a, l, r and score of phrases of n words at the cut with the lowest score, the first of equal ones."""
    out, cuts = phrases.withColumnRenamed("f", "a"), []
    for k in range(1, n):
        head = F.substring_index("phrase", " ", k)
        tail = F.substring_index("phrase", " ", k - n)
        out = _looked_up(_looked_up(out, head, levels[k], f"_l{k}"), tail, levels[n - k], f"_r{k}")
        wide = lambda c: F.col(c).cast("decimal(18,0)")
        product = wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")
        out = out.withColumn(f"_p{k}", product).withColumn(f"_q{k}", wide(f"_l{k}") * wide(f"_r{k}"))
        cuts.append(F.struct(F.expr(f"_p{k} div _q{k}").alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return out.withColumn("_best", best).select("lang", "phrase", "a", *[F.col(f"_best.{c}").alias(c) for c in ("l", "r", "score")])


def collocations(docs: DataFrame, config: PhraseConfig = PhraseConfig(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language.

    Sorted by score and count, both descending, then by the phrase's UTF-8 bytes. The ranks are
    worked out in parts of a language first, so that no task sorts all its candidates.
    """
    chunks = cut_lineage(parse(docs, config, text, lang))
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    levels: dict[int, DataFrame] = {}
    bits = None
    for n in range(1, config.longest + 1):
        levels[n] = cut_lineage(count(chunks, n, config, bits).where(F.col("f") >= config.least))
        if bits is not None:
            bits.destroy()  # all that needs it is written
        if n < config.longest:
            bits = marks(levels[n], config)
    scored = None
    for n in range(2, config.longest + 1):
        level = _scored(levels[n], n, levels)
        inside = None
        for m in range(n + 1, config.longest + 1):
            for k in range(m - n + 1):
                part = F.substring_index(F.substring_index("phrase", " ", k + n), " ", -n)
                one = levels[m].select("lang", part.alias("phrase"), F.col("f").alias("longer"))
                inside = one if inside is None else inside.unionByName(one)
        if inside is not None:
            inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            level = level.join(inside, ["lang", "phrase"], "left").where(
                F.coalesce(100 * F.col("longer") < config.explained * F.col("a"), F.lit(True))
            ).drop("longer")
        scored = level if scored is None else scored.unionByName(level)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(config.parts))
    ranked = scored.withColumn("_part", part).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    ranked = ranked.where(F.col("_k") <= config.top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= config.top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
