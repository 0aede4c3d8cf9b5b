import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import documents, empty
from tidegauge.llm import negatives, phrases


def plain_phrases(found, config):
    """lang -> rows in rank order, by counting every phrase of every text."""
    counts, total = Counter(), Counter()
    for lang, text in found:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            lowered = lowered.replace(end, "\n")
        for piece in lowered.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for m in range(1, config.longest + 1):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    frequent = {k: a for k, a in counts.items() if len(k) > 2 and a >= config.least}
    out = {}
    for key, a in frequent.items():
        lang, words = key[0], key[1:]
        longer = [f for k, f in frequent.items() if k[0] == lang and len(k) > len(key) and any(k[i : i + len(words)] == words for i in range(1, len(k)))]
        if any(100 * f >= config.explained * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        lang: [(n, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(rows)[: config.top], 1)]
        for lang, rows in out.items()
    }


def spoken(rng, n, marks):
    common = ["a", "Of", "é", "the", "THE", "x-y", " ", "日本"]
    return "".join(rng.choice(common if rng.random() < 0.7 else ["q%d" % rng.randrange(40)]) + rng.choice(marks) for _ in range(n))


@pytest.mark.parametrize("config", [phrases.PhraseConfig(least=3), phrases.PhraseConfig(least=3, longest=4, spacing=2, held=50, words_at_once=40, top=30, bits=1 << 15)])
def test_collocations_are_those_of_plain_counts(spark, config):
    rng = random.Random(4)
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "?! "]
    found = [(rng.choice(["en", "de", None, "und"]), spoken(rng, rng.randrange(60), marks)) for _ in range(120)]
    found += [("en", None), ("en", ""), (None, " \n.."), ("fr", "no repeats here"), ("en", "go on " * 4000), ("de", spoken(rng, 9000, [" "]))]
    found += [found[0]] * 5
    table = documents(spark, [(None if k % 7 == 0 else k, t, lang, "s", None) for k, (lang, t) in enumerate(found)], extra=True)
    got = {}
    for r in phrases.collocations(table.withColumn("lang", F.col("lang")).withColumn("freq", F.lit(1)), config).orderBy("lang", "rank").collect():
        got.setdefault(r.lang, []).append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert got == plain_phrases(found, config)


def test_chunks_overlap_and_each_phrase_has_one_owner():
    config = phrases.PhraseConfig(spacing=3, widest=5)
    trigger = phrases._Triggers(config.spacing).__getitem__
    rng = random.Random(8)
    for n in (1, 2, 3, 17, 200):
        words = [b"w%d" % rng.randrange(30) for _ in range(n)]
        starts = []
        for chunk, own in phrases._chunks(words, trigger, config):
            held = chunk.split(b" ")
            at = len(starts)
            assert held == words[at : at + len(held)] and own <= config.widest + (at + len(held) == n)
            assert len(held) >= min(own + config.longest - 1, n - at)
            starts += range(at, at + own)
        assert starts == list(range(n))


def test_a_full_bitmap_changes_no_result(spark):
    rng = random.Random(6)
    found = [(k, spoken(rng, 200, [" ", ". "]), "en", "s", None) for k in range(30)]
    config = phrases.PhraseConfig(least=4)
    key = lambda r: tuple(r)
    wide = sorted(map(key, phrases.collocations(documents(spark, found), config).collect()))
    tight = sorted(map(key, phrases.collocations(documents(spark, found), replace(config, bits=1 << 15)).collect()))
    assert wide and wide == tight


def test_no_documents_give_no_phrases(spark):
    assert phrases.collocations(empty(spark)).isEmpty()


VECTORS = "vec_id long, label int, embedding array<double>"


def plain_negatives(rows, anchor, config):
    sound = [(i, label, v) for i, label, v in rows if None not in (i, label, v) and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, label, v) in enumerate(sound):
        if not anchor(i):
            continue
        scored = [(-sum(int(a) * int(b) for a, b in zip(v, w)), j, other) for n, (j, other, w) in enumerate(sound) if n != k and len(w) == len(v)]
        positives = sorted(s[:2] for s in scored if s[2] == label)[: config.positives]
        for p, pid in positives:
            inside = sorted(s[:2] for s in scored if s[2] != label and config.percent * -p <= 100 * -s[0] <= 100 * -p)
            out += [(i, pid, n, nid, -p, -s) for n, (s, nid) in enumerate(inside[: config.negatives], 1)]
    return sorted(out)


def test_negatives_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(700):
        center = np.eye(12)[k % 3] * 40
        rows.append((k, int(rng.integers(0, 4)) if k % 5 else 0, np.floor(center + rng.normal(0, 25, 12)).tolist()))
    rows += [(None, 1, rows[0][2]), (1000, None, rows[0][2]), (1001, 1, None), (1002, 1, []), (1003, 1, [float("nan")] * 12), (1004, 1, [None] + rows[0][2][1:])]
    rows += [(2000 + k, k % 2, [float(k), 3.0]) for k in range(20)] + [(0, 0, rows[0][2]), (7, 1, rows[7][2]), (7, 1, rows[7][2]), (3000, 9, rows[1][2])]
    rows += [(4000 + k, 1, rows[20][2]) for k in range(30)] + [(5000, 2, [0.0] * 12), (5010, 3, [-x for x in rows[20][2]])]
    table = spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", "1 AS row", "'x' AS dim", "2 AS anchor", "0 AS score")
    for config in (negatives.MiningConfig(), negatives.MiningConfig(rows_a_block=64, anchors_a_block=16, expected=2, growth=8, group=5, positives=3, negatives=4, percent=60)):
        got = negatives.mine(table, F.col("vec_id") % 10 == 0, config)
        found = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())
        assert found == plain_negatives(rows, lambda i: i % 10 == 0, config)


def test_anchors_copied_for_the_tasks_are_never_broadcast(spark, monkeypatch):
    # equal vectors under unlike ids, as small in a file as one vector
    rows = [(k, k % 3, [float(k % 2), 5.0, 7.0]) for k in range(400)]
    config, plans, cut = negatives.MiningConfig(rows_a_block=16, anchors_a_block=16), [], negatives.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    monkeypatch.setattr(negatives, "cut_lineage", seen)
    got = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, config)
    copied = [p for p in plans if "anchors#" in p or "vector#" in p and "asked#" in p]
    assert len(copied) >= 4 and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in copied)
    found = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())
    assert found == plain_negatives(rows, lambda i: i % 10 == 0, config)


def test_no_vectors_or_anchors_give_no_rows(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).isEmpty()
    none = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], VECTORS)
    assert negatives.mine(none, F.col("vec_id") % 100 == 0).isEmpty()
    assert negatives.mine(none, F.col("vec_id") == 1).isEmpty()


def test_threshold_join_finds_all_and_keeps_large_scores_exact():
    rng = np.random.default_rng(3)
    for scale in (20, 1 << 21):
        q, y = (np.floor(rng.normal(0, scale, (n, 20)) * np.linspace(3, 0.2, 20)) for n in (9, 300))
        scores = np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in y.tolist()] for r in q.tolist()])
        for low in (np.quantile(scores, 0.97, axis=1), np.quantile(scores, 0.4, axis=1), np.full(9, -np.inf)):
            a, b, score = negatives._reaching(q, y, low, 8)
            found = sorted(zip(a.tolist(), b.tolist(), score.tolist()))
            assert found == sorted((i, j, int(scores[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(scores >= low[:, None]))))
    with pytest.raises(OverflowError):
        negatives._exact(np.full((1, 4), 2.0**40), np.full((1, 4), 2.0**40))
