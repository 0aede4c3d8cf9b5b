import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import components, documents, empty, prose, rows
from tidegauge.llm import embedding, minhash
from tidegauge.llm.graph import components as spark_components


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


@pytest.mark.parametrize("words", [2, 5])
def test_components_are_those_of_all_pairs(spark, words):
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, extra=True), minhash.SketchConfig(words=words)).collect() if r.doc_id is not None}
    sets = {i: shingle_set(t, words) for i, t, *_ in rows() if i is not None}
    ids = sorted(sets)
    links = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = components(ids, links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_every_row_is_returned_and_an_empty_table_works(spark):
    out = minhash.near_duplicates(documents(spark))
    assert out.count() == len(rows())
    assert out.where("doc_id IS NULL AND NOT kept").isEmpty()
    assert minhash.near_duplicates(empty(spark)).isEmpty()


def test_links_beside_the_hub_are_found(spark):
    """A chain: each text is like its neighbours only, so no single hub sees all links."""
    import random

    rng = random.Random(5)
    words = [f"v{k}" for k in range(2000)]
    texts = [" ".join(words[9 * k : 9 * k + 200]) for k in range(60)] + [prose(rng, 50)]
    found = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    config = minhash.SketchConfig(words=2, block=8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, found), config).collect()}
    sets = [shingle_set(t, 2) for t in texts]
    links = [(a, b) for a in range(61) for b in range(a + 1, 61) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert got == components(range(61), links)


def test_sketches_merge_and_estimate():
    config = minhash.SketchConfig()
    factors = minhash.multipliers(config.registers)
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 2**63, 4000, np.uint64)), np.unique(rng.integers(0, 2**63, 1000, np.uint64))
    one = minhash.sketch(a, config, factors)
    two = minhash.sketch(np.union1d(a, b), config, factors)
    assert (minhash.merge(one, minhash.sketch(b, config, factors)) == two).all()
    got = minhash.estimate(one[None], two[None], np.array([4000.0]), np.array([5000.0]), config)[0]
    assert abs(got - 0.8) < 0.15


def test_components_of_a_long_chain_and_a_star(spark):
    links = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1500).select(F.lit(999).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r.node: r.component for r in spark_components(links.union(star)).collect()}
    assert got == {**{k: 0 for k in range(301)}, **{k: 999 for k in range(999, 1500)}}


def test_vector_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    vectors = [centres[k % 30] + 0.12 * rng.standard_normal(16) for k in range(400)]
    cells = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(k + 400, vectors[k].tolist()) for k in range(40)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0] + [None] * 15), (905, [float("inf")] + [0.0] * 15),
           (906, [1.0, 2.0]), (None, vectors[0].tolist())]
    table = spark.createDataFrame(cells + odd, "vec_id long, embedding array<double>").withColumn("unit", F.lit("x"))
    got = embedding.similar_vectors(table, embedding.SignConfig(block=16, miss=1e-6)).collect()
    units = np.array([v for _, v in cells])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    hit = np.triu(units @ units.T >= 0.95, 1)
    links = np.argwhere(hit)
    want = components(range(len(cells)), links.tolist())
    degree = (hit | hit.T).sum(1)
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == len(cells) + len(odd)
    assert {k: by_id[k].n_links for k in want} == {k: degree[k] for k in want}
    assert {k: by_id[k].component_id for k in want} == want
    assert all(by_id[k].n_links == 0 and by_id[k].component_id == k and by_id[k].kept for k in range(900, 907))
    assert embedding.similar_vectors(table.where("false")).isEmpty()
