import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import documents, empty, prose
from tidegauge.llm import chat, licenses, substring, toxicity

CHAT = "pair_id long, turn long, role string, text string"


def plain_cut(found):
    """Units, their earliest places, and what remains of every text."""
    split = {k: list(substring.units(t)) for k, t in found}
    first = {}
    for k, us in sorted(split.items()):
        for n, u in enumerate(us):
            first.setdefault(u[4], (k, n))
    out = {}
    for k, t in found:
        runs, run = [], []
        for n, u in enumerate([*split[k], None]):
            if u is not None and first[u[4]] != (k, n):
                run.append(u)
                continue
            if sum(x[3] for x in run) >= substring.LEAST_WORDS:
                whole = run[0][2] & 1 and run[-1][2] & 2
                runs.append((run[0][0], run[-1][1] + bool(whole)))
            run = []
        kept, at = "", 0
        for a, b in runs:
            kept, at = kept + t[at:a], b
        out[k] = (kept + t[at:], runs)
    return out


def test_units_cover_all_words():
    for text in ["a b. c d\n\n e! f", "x.y z", " . ", "a\r\nb.", "no end", "...", "é. É\x85b"]:
        found = list(substring.units(text))
        assert all(text[a:b].strip() for a, b, *_ in found)
        assert "".join(text[a:b] for a, b, *_ in found).split() == text.split() or sum(u[3] for u in found) == len(text.encode().split())


def test_passages_go_from_all_but_the_first(spark):
    rng = random.Random(9)
    passage = " ".join(prose(rng, 20).replace(".", "") + "." for _ in range(3))
    lines = prose(rng, 30).replace(".", "") + ".\n" + prose(rng, 40).replace(".", "") + "."
    found = [(k, prose(rng, 80).replace(".", "") + ". " + (passage if k % 3 == 0 else "") + "\n" + (lines + "\n" if k % 2 else "") + "Same short line.") for k in range(12)]
    found += [(50, None), (51, ""), (52, "\n \n"), (53, found[0][1]), (53, found[0][1])]
    table = documents(spark, [(k, t, "en", "s", None) for k, t in found], extra=True)
    out = substring.deduplicate(table)
    assert out.columns == [*table.columns, "_removed_spans"]
    want = plain_cut([(k, t) for k, t in dict(found).items() if t is not None])
    got = out.select("doc_id", "text", "_removed_spans").collect()
    assert len(got) == len(found)
    for r in got:
        if r.doc_id == 50:
            assert r.text is None
            continue
        assert (r.text, [(s.start, s.end) for s in r._removed_spans or []]) == want[r.doc_id]
    texts = [r.text for r in got if r.text and r.doc_id != 53]
    assert sum(passage in t for t in texts) == 1
    assert all("Same short line." in r.text for r in got if r.doc_id in (2, 4, 8, 10))  # not beside a passage
    assert substring.deduplicate(empty(spark)).isEmpty()


def test_passages_inside_longer_sentences_go(spark):
    rng = random.Random(4)
    words = lambda n: prose(rng, n).replace(".", "").lower()
    passage = words(60)
    joined = words(20) + ". " + words(20) + ". " + words(20)
    found = [(k, f"{words(30)} {passage} {words(40)}\n{words(9)} {joined} {words(11)}", "en", "s", None) for k in range(6)]
    found.append((10, "word " * 300, "en", "s", None))
    got = {r.doc_id: r for r in substring.deduplicate(documents(spark, found)).collect()}
    assert got[0].removed_spans is None and got[10].removed_spans is None
    for k, text, *_ in found[1:6]:
        cut = [text[x.start : x.end].strip() for x in got[k].removed_spans]
        assert len(cut) == 2 and cut[0] in passage and cut[1] in joined
        assert all(len(c.split()) >= 25 for c in cut)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    found, labels = [], []
    for k in range(1500):
        text, bad = prose(rng, rng.randint(5, 60)), k % 6 == 0
        if bad:
            text += " you utter nitwit and " + prose(rng, 5)
        found.append((k, text, "en", "s", len(text)))
        labels.append((k, None if k % 50 == 7 else int(bad if rng.random() > 0.03 else not bad)))
    found += [(2000, None, "en", "s", None), (2001, "", "en", "s", 0), (None, "nitwit", "en", "s", 6), (2002, prose(rng, 30_000), "en", "s", 9)]
    labels += [(0, labels[0][1]), (None, 1), (9999, 0)]
    return documents(spark, found, extra=True), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_holds_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for k, r in got.items() if k is not None and k < 1500 and r.held_out]
    assert 200 < len(held) < 400
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) / len(held) > 0.97
    assert got[2000].score == got[2001].score < 0.5
    kept = toxicity.passing(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.where("false"), model).isEmpty()


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    for few in (labels.where("false"), labels.where("toxic = 0")):
        assert {r.predicted for r in toxicity.score(docs.limit(20), toxicity.fit(docs, few)).collect()} == {0}


def test_toxicity_learns_from_ten_toxic_rows(spark):
    rng = random.Random(12)
    marked = lambda: prose(rng, 30) + " you utter nitwit and worthless blockhead " + prose(rng, 5)
    few = ["nitwit", "blockhead", "numbskull"]
    found = [(k, prose(rng, 20) + f" {few[k % 3]} " + prose(rng, 20) if k < 12 else prose(rng, 40), "en", "s", 1) for k in range(80)]
    labels = spark.createDataFrame([(k, int(k < 12)) for k in range(80)], "doc_id long, toxic int")
    new = [(1000 + k, marked() if k % 2 else prose(rng, 40), "en", "s", 1) for k in range(40)]
    got = toxicity.score(documents(spark, new), toxicity.fit(documents(spark, found), labels)).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 36


def test_toxicity_sample_is_of_documents(spark, labelled):
    docs, labels = labelled
    absent = spark.range(100_000, 110_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    config = toxicity.ToxicityConfig(sample=500)
    assert toxicity.training_rows(docs, labels.union(absent), config).count() == 500


def test_preference_pairs(spark):
    chosen = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "thanks"), (2, 0, "user", "same"), (3, 5, None, None), (4, 0, "user", "a"),
         (4, 0, "user", "a"), (4, 1, "assistant", "b"), (None, 0, "user", "x"), (6, None, "user", "x")], CHAT)
    rejected = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "bad one"), (2, 0, "user", "same"), (4, 0, "user", "A"), (4, 1, "assistant", "c"), (5, 0, "user", "z")], CHAT
    )
    got = {r.pair_id: r for r in chat.format_preferences(chosen.withColumn("prompt", F.lit("x")), rejected).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "pair", 2: "equal", 3: "no_rejected", 4: "pair", 5: "no_chosen"}
    r = got[1]
    assert r.prompt == "<|user|>\nq<|end|>\n" and r.n_prompt_turns == 1
    assert r.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nthanks<|end|>\n"
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["good<|end|>\n"]
    assert [r.rejected[m.start : m.end] for m in r.rejected_mask] == ["bad one<|end|>\n"]
    assert got[4].prompt == "" and [got[4].chosen[m.start : m.end] for m in got[4].chosen_mask] == ["b<|end|>\n"]
    assert got[2].prompt == "<|user|>\nsame<|end|>\n" and got[2].chosen == got[2].rejected == ""
    assert chat.format_preferences(chosen.where("false"), rejected.where("false")).isEmpty()


def test_licence_families(spark):
    rng = random.Random(6)
    notices = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc": "Licensed under CC BY-NC 4.0."}
    names = [*notices, None, "odd"]
    found = []
    for k in range(300):
        kind = names[k % 5]
        text = "\n".join(prose(rng, 15) for _ in range(4))
        text += "\n" + (notices.get(kind) or ("Released under the Foo Bar license." if kind else prose(rng, 10)))
        found.append((k, text, "en", "s", len(text)))
    found += [(900, None, "en", "s", None), (901, "", "en", "s", 0), (None, notices["mit"], "en", "s", 9), (902, "word " * 20_000, "en", "s", 9)]
    docs = documents(spark, found, extra=True)
    model = licenses.fit(docs)
    got = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    assert len(got) == len(found)
    for k in range(300):
        kind = names[k % 5]
        if kind in notices:
            assert got[k].families == got[k].confirmed_families == [kind]
        elif kind:
            assert got[k].confirmed_families == []
        else:
            assert got[k].families == []
    assert got[None].families == ["mit"] and got[900].n_notices == got[901].n_notices == got[902].n_notices == 0
    assert licenses.scan(empty(spark), licenses.fit(empty(spark))).isEmpty()


def test_reserved_rights_and_first_lines_of_licences(spark):
    rng = random.Random(16)
    lines = [
        ("proprietary", "All rights reserved."),
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (None, prose(rng, 12)),
    ]
    found = [(k, prose(rng, 15) + "\n" + lines[k % 4][1] + "\n" + prose(rng, 15), "en", "s", 1) for k in range(120)]
    docs = documents(spark, found)
    for r in licenses.scan(docs, licenses.fit(docs)).collect():
        family = lines[r.doc_id % 4][0]
        assert r.families == r.confirmed_families == ([family] if family else [])


def test_ordinary_sample_is_of_unlike_lines(spark):
    rng = random.Random(18)
    lines = spark.createDataFrame([(x,) for k in range(60) for x in [f"{prose(rng, 8)} {k}"] * (1 + k % 7 * 20)], "line string")
    found = licenses._ordinary(lines.withColumn("h", F.xxhash64("line")), licenses.LicenseConfig(sample=30))
    assert found.count() == found.distinct().count() == 30


def test_every_line_trains_by_default(spark):
    rng = random.Random(19)
    plain = [f"{prose(rng, 6)} {k}" for k in range(5_400)]
    like = "Redistribution in source and binary forms with or without modification are permitted"
    lines = [*plain, *plain[:50], like, *[f"Licensed under the MIT License, copy {k}." for k in range(5_200)], "A license of no name."]
    docs = documents(spark, [(k, "\n".join(lines[k::40]), "en", "s", 1) for k in range(40)])
    rows = licenses._training(docs, licenses.LicenseConfig()).groupBy("family").count()
    counts = {r["family"]: r["count"] for r in rows.collect()}
    assert counts["mit"] == 5_200 + len(licenses.TEMPLATES["mit"]) and counts[licenses.ORDINARY] == 5_400 + 2


def test_unlike_lines_by_hashes_and_by_strings(spark):
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    lines += [" ".join(t.split()[:n]) for t in lines for n in range(1, 20)] + ["", "of the rights under the", "ordinary words"]
    pairs = licenses.pairs_of(licenses.words_of(F.col("line")))
    plain = F.greatest(*[licenses._share(pairs, t) for ts in licenses.TEMPLATES.values() for t in ts]) <= 0.5
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    got = rows.select("line", plain.alias("a"), licenses._unlike_templates(licenses.ngrams(licenses.words_of(F.col("line")))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.a for r in got} == {True, False}


def test_upper_quantile_equals_percentile(spark):
    for n, above in ((1, 0.1), (7, 0.5), (101, 0.1), (1_000, 0.0001)):
        rows = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(997)) / 997).alias("x"))
        assert licenses._upper_quantile(rows, "x", above) == pytest.approx(rows.agg(F.percentile("x", 1 - above)).first()[0])
    assert licenses._upper_quantile(spark.range(0).select(F.rand().alias("x")), "x", 0.1) == 0


def test_notices_are_ranked_in_parts(spark):
    found = [(k, f"Licensed under the MIT License, copy {k}.", "en", "s", 1) for k in range(300)]
    rows = licenses._training(documents(spark, found), licenses.LicenseConfig(sample=20))
    assert rows.where("family = 'mit'").count() == 20 + len(licenses.TEMPLATES["mit"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod" in plan and plan.count("row_number()") >= 2


def test_the_pipeline_keeps_what_each_stage_should(spark, labelled, tmp_path):
    docs, labels = labelled
    rng = random.Random(2)
    clean = [(5000 + k, "\n".join(prose(rng, 30) for _ in range(5)), "en", "s", 1) for k in range(30)]
    copies = [(6000 + k, t, *rest) for k, (_, t, *rest) in enumerate(clean[:10])]
    passage = prose(rng, 70).replace(".", "") + "."
    shared = [(7000 + k, prose(rng, 150) + "\n" + passage, "en", "s", 1) for k in range(4)]
    toxic = [(8000, clean[0][1] + " you utter nitwit and " + prose(rng, 60), "en", "s", 1)]
    junk = [(9000, " ".join("%% ## $$" for _ in range(60)), "en", "s", 1), (9001, None, "en", "s", None)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").union(documents(spark, clean + copies + shared + toxic + junk))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["quality_rules", "toxicity", "minhash_near_dedup", "substring_dedup", "packing"]
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id for r in at.select("doc_id").collect()}
    ids = lambda group: {g[0] for g in group}
    assert ids(clean + shared) <= seen["minhash_near_dedup"] and not ids(junk) & seen["quality_rules"]
    assert ids(toxic) <= seen["quality_rules"] and not ids(toxic) & seen["toxicity"]
    assert ids(copies) <= seen["toxicity"] and not ids(copies) & seen["minhash_near_dedup"]
    cut = spark.read.parquet(f"{tmp_path}/3").where(F.col("text").contains(passage))
    assert [r.doc_id for r in cut.collect()] == [7000]
    assert seen["packing"] == seen["substring_dedup"]


def test_one_row_of_an_id_goes_through_the_pipeline(spark, tmp_path):
    rng = random.Random(21)
    rows = [(k, "\n".join(prose(rng, 30) for _ in range(4)), "en", "s", 1) for k in range(12)]
    copy = (40, rows[3][1], "en", "s", 1)
    bare = [(None, prose(rng, 90), "en", "s", 1)] * 2
    table = documents(spark, rows + [rows[0]] * 9 + [copy] * 3 + bare)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == table.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows + bare, key=str)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).where("doc_id IS NOT NULL").groupBy("doc_id")
    packed = pieces.agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows} and all(r["n"] == r["all"] for r in packed)
