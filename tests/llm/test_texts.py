import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import CLASHING, documents, empty, rows
from tidegauge.llm import bpe, chunks, counts, packing, quality

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = st.text(st.sampled_from("ab 's\n\t  1é日,.▁<|>՘\x85\x1c🙂") | st.characters(exclude_categories=["Cs"]), max_size=40) | st.sampled_from(
    ["<|endoftext|> a<|endoftext|>", "  a  b \n c\n", "\n\n a", "I'm 'll '  's", "a" * 300, " " * 90, "<s> <unk> <0x0A>", "x.. y,. z.\nA"]
)


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(bpe.Vocabulary(bpe.read_ranks(RANKS)))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(AWKWARD)
def test_bpe_is_that_of_the_library(encoder, reference, text):
    assert np.frombuffer(encoder(text), "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=20), st.integers(0, 80), st.integers(0, 80))
def test_appends_and_edits_are_exact(encoder, reference, data, new, i, j):
    vocabulary = encoder.vocabulary
    store = bpe.PrefixStore(vocabulary, data[: len(data) // 2])
    store.append(data[len(data) // 2 :])
    whole = lambda b: reference._encode_single_piece(b) if b else []
    assert store.ids() == whole(data)
    start, end = sorted((min(i, len(data)), min(j, len(data))))
    store.edit(start, end, new)
    assert store.data == data[:start] + new + data[end:]
    assert store.ids() == whole(store.data)
    assert vocabulary.decode(store.ids()) == store.data


def test_an_edit_stops_where_the_store_agrees(encoder):
    store = bpe.PrefixStore(encoder.vocabulary, b"the cat sat on the mat and " * 200)
    assert store.edit(100, 103, b"dog") < 1000


@settings(max_examples=300, deadline=None)
@given(AWKWARD)
def test_packing_ids_are_those_of_the_library(text):
    encoder, library = packed_encoder()
    assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def packed_encoder():
    return chunks.once("test-pack", lambda: (packing.PreTokenEncoder(JSON), Tokenizer.from_file(JSON)))


@settings(max_examples=300, deadline=None)
@given(AWKWARD)
def test_counts_are_those_of_the_library(text):
    counter = chunks.once("test-count", lambda: counts.PieceCounter(PIECES))
    assert counter.cuts_proved
    assert counter(text) == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))


def test_memory_is_bounded_and_exact():
    calls = []
    memo = chunks.Memo(lambda k: calls.append(k) or len(k), size=10, longest=5)
    for _ in range(3):
        for k in range(100):
            assert memo[f"{k}"] == len(str(k))
    assert memo["long key"] == 8 and len(memo) + len(memo.older) <= 21


def test_bpe_tables(spark, reference):
    out = bpe.decode(bpe.encode(documents(spark, extra=True), RANKS), RANKS).collect()
    assert len(out) == len(rows())
    texts = {i: t or "" for i, t, *_ in rows() if i is not None}
    for r in out:
        if r.doc_id is not None:
            assert list(r.ids) == reference.encode_ordinary(texts[r.doc_id]) and bytes(r.data).decode() == texts[r.doc_id]
    assert bpe.digests(bpe.decode(bpe.encode(empty(spark), RANKS), RANKS)).isEmpty()
    one_by_one = bpe.digests(bpe.decode(bpe.encode(documents(spark), RANKS), RANKS))
    assert sorted(map(str, bpe.round_trip(documents(spark), RANKS).collect())) == sorted(map(str, one_by_one.collect()))
    assert bpe.round_trip(empty(spark), RANKS).isEmpty()


def test_count_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = counts.count_tokens(documents(spark, extra=True), PIECES, 4096).collect()
    texts = {i: t or "" for i, t, *_ in rows() if i is not None}
    assert len(out) == len(rows())
    for r in out:
        if r.doc_id is not None:
            n = len(library.encode(texts[r.doc_id]))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    assert counts.count_tokens(empty(spark), PIECES, 4096).isEmpty()


def test_packing_covers_every_id_once(spark):
    import zlib

    library = Tokenizer.from_file(JSON)
    found = [r for r in rows() if r[0] != 400]
    pieces = packing.pack(documents(spark, found, extra=True), JSON).collect()
    assert max(r.offset + r.length for r in pieces) <= packing.WINDOW
    by_sequence: dict = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert sum(sum(r.length for r in m) < packing.WINDOW for m in by_sequence.values()) <= 1
    for i, text, *_ in found:
        if i is None:
            continue
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        own, at = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    assert packing.pack(empty(spark), JSON).isEmpty()


def test_leftovers_merge_over_many_partitions(spark):
    docs = documents(spark).select("doc_id", "text").limit(0).union(spark.range(200).selectExpr("id", "'a b c'"))
    pieces = packing.pack(docs.repartition(100), JSON)
    got = packing.padding(pieces).first()
    assert got.tokens == 200 * 4 and got.sequences == 1


def test_quality_measures_are_those_of_a_plain_reading(spark):
    def plain(text):
        text = text or ""
        words = [w for w in text.encode().split()]
        spaces = set(" \t\n\x0b\x0c\r")
        lines = [x for x in text.split("\n") if any(c not in spaces for c in x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        return (len(words), sum(c not in spaces for c in text), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))

    rng = random.Random(4)
    samples = [None, "", "a", "a b c a b c", "x\nx\n \nx", "é#é *\x85 b", "\n".join(rng.choice(["a b c", "d", "é e f g"]) for _ in range(60))]
    for text in samples + [r[1] for r in rows() if r[1] and len(r[1]) < 5000]:
        assert quality.measure(text)[:5] == plain(text)
    out = quality.verdicts(documents(spark, extra=True))
    assert out.count() == len(rows()) and quality.verdicts(empty(spark)).isEmpty()
    kept = quality.passing(documents(spark, extra=True))
    assert [*CLASHING] == kept.columns[-len(CLASHING) :]
    assert kept.count() == out.where("kept").count()


def test_ablation_counts_by_bits(spark):
    entries = spark.createDataFrame([(k, bits) for k, bits in enumerate([0, 0, 1, 3, 2, 4, 12, 1])], "doc_id long, failed_bits long")
    got = {r.rule: (r.failed, r.failed_alone, r.kept_with, r.kept_without) for r in quality.ablation(entries, quality.POLICIES["base"]).collect()}
    assert got == {"few_words": (3, 2, 4, 6), "repeated_words": (2, 1, 4, 5)}
