"""Quality rules kept as a ledger of failure bits and measurements.

Every rule is evaluated once per document; a policy is a version name and a set of rules, applied
to the stored bits, so that another policy or an ablation never reads the texts again.

Defined results: a null or blank text has no words, so ``few_words`` fails and every count is 0. A
null ``doc_id`` stays null. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.tables import texts

SPACES = (0x20, *range(0x09, 0x0E))
SYMBOLS = b"#*$%&|<>"
SLICE = 1 << 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

#: Bit, name and failure condition of each rule. A bit is never given to another rule.
RULES: Mapping[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "100 * n_symbols > 20 * n_words"),
    "duplicate_lines": (3, "100 * n_dup_lines > 50 * n_lines"),
    "shouting": (4, "n_upper > n_lower"),
    "word_length": (5, "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


POLICIES = {
    "base": Policy("base", BASE),
    "prose": Policy("prose", (*BASE, "symbols", "duplicate_lines", "shouting", "word_length")),
}


def byte_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(256, np.int64)
    view = np.frombuffer(data, np.uint8)
    for at in range(0, len(view), SLICE):
        counts += np.bincount(view[at : at + SLICE], minlength=256)
    return counts


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs, kinds = ids[:-1] * len(seen) + ids[1:], len(seen)
    if kinds >= 1 << 20:  # three ids don't fit one integer: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * kinds + ids[2:]
    ordered = np.sort(windows)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= hit
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    data = (text or "").encode()
    words = data.split()
    counts = byte_counts(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        int(len(data) - counts[0x80:0xC0].sum() - counts[list(SPACES)].sum()),
        int(counts[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(counts[0x41:0x5B].sum()),
        int(counts[0x61:0x7B].sum()),
    )


def measured(text: Column) -> Column:
    """A struct of the measurements of a text column."""

    @F.arrow_udf("struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")
    def run(batch: pa.Array) -> pa.Array:
        rows = [measure(t.as_py()) for t in batch]
        columns = zip(*rows) if rows else [[]] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))

    return run(text)


def failed_bits(rules: Mapping[str, tuple[int, str]] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for bit, condition in rules.values():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements and ``failed_bits``."""
    rows = texts(docs).select("doc_id", measured(F.col("text")).alias("m"))
    return rows.select("doc_id", "m.*").withColumn("failed_bits", failed_bits())


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``policy_failed`` (the bits of this policy's rules) and ``kept``."""
    bits = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    return entries.withColumn("policy_failed", bits).withColumn("kept", bits == 0)


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else (and so would
    return without it), and documents kept with and without it.

    Documents are counted by their bits first: at most 2^rules rows leave the partial sums.
    """
    by_bits = apply_policy(entries, policy).groupBy("policy_failed").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in policy.rules])
    spread = by_bits.select("policy_failed", "n", F.inline(rules))
    has = F.col("policy_failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("policy_failed") == F.col("bit")
    clean = F.col("policy_failed") == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    return spread.groupBy("rule").agg(
        count(has).alias("failed"),
        count(alone).alias("failed_alone"),
        count(clean).alias("kept_with"),
        count(clean | alone).alias("kept_without"),
    )


def verdicts(docs: DataFrame, policy: Policy = POLICIES["prose"]) -> DataFrame:
    """The ledger with the base verdict and that of ``policy``."""
    base = F.col("failed_bits").bitwiseAND(F.lit(POLICIES["base"].mask).cast("long")) != 0
    judged = apply_policy(ledger(docs).withColumn("base_failed", base), policy)
    return judged.withColumn("kept", F.col("kept") & ~F.col("base_failed"))


def passing(docs: DataFrame, policy: Policy = POLICIES["prose"]) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that a policy keeps; no shuffle."""
    rows = docs.select(F.struct("*").alias("row"), measured(F.col("text").cast("string")).alias("m"))
    judged = rows.select("row", "m.*").withColumn("failed_bits", failed_bits())
    return apply_policy(judged, policy).where("kept").select("row.*")
