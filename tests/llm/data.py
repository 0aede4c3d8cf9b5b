"""Small tables with the awkward cases, and brute-force versions."""

import random

from pyspark.sql import types as T

WORDS = [f"w{k}" for k in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def changed(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators use themselves.
CLASHING = ("removed_spans", "score", "kept", "row", "m", "bucket", "digest", "component_id", "ids", "n_words", "unit", "s")


def rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([60, 120, 300])) for _ in range(6)]
    out, i = [], 10
    for text in base:
        for share in (0.0, 0.0, 0.01, 0.03, 0.06, 0.12):
            out.append((i, changed(rng, text, share)))
            i += rng.choice([1, 2, 5])
    long = prose(rng, 30_000)
    out += [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "two words"), (None, base[0]), (None, None),
        (400, base[1]), (400, base[1]), (401, long), (402, long + " end"), (403, "x" * 3000),
    ]
    return [(k, t, "en", "s0", None if t is None else len(t)) for k, t in out]


def documents(spark, found=None, extra: bool = False):
    df = spark.createDataFrame(rows() if found is None else found, SCHEMA).repartition(3)
    if extra:
        df = df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}
