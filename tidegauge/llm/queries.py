"""Queries of the operators over their whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bpe, chat, counts, embedding, licenses, minhash, negatives, packing, phrases, quality, substring, toxicity, wrappers
from tidegauge.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def record(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return record


CHAT_SQL = r"""
WITH c AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT pair_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM c GROUP BY pair_id),
b AS (SELECT c.pair_id, c.turn, c.role, c.text,
             CASE WHEN c.turn = l.last_turn AND o.last_text IS NOT NULL THEN o.last_text ELSE c.text END AS other
      FROM c JOIN last l ON l.pair_id = c.pair_id LEFT JOIN last o ON o.pair_id = xor(c.pair_id, CAST(1 AS BIGINT))),
d AS (SELECT *, min(CASE WHEN text <> other THEN turn END) OVER (PARTITION BY pair_id) AS differs,
             '<|' || role || '|>' || chr(10) AS head FROM b),
r AS (SELECT *, head || text || '<|end|>' || chr(10) AS one, head || other || '<|end|>' || chr(10) AS two,
             differs IS NULL OR turn < differs AS shared FROM d),
s AS (SELECT *, sum(CASE WHEN shared THEN 0 ELSE length(one) END) OVER w AS end1,
             sum(CASE WHEN shared THEN 0 ELSE length(two) END) OVER w AS end2
      FROM r WINDOW w AS (PARTITION BY pair_id ORDER BY turn))
SELECT pair_id, CASE WHEN min(differs) IS NULL THEN 'equal' ELSE 'pair' END AS status,
       count(*) FILTER (shared) AS n_prompt_turns, count(*) AS n_chosen_turns, count(*) AS n_rejected_turns,
       coalesce(string_agg(one, '' ORDER BY turn) FILTER (shared), '') AS prompt,
       coalesce(string_agg(one, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
       coalesce(string_agg(two, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
       coalesce(string_agg(CAST(CAST(end1 - length(one) + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(end1 AS BIGINT) AS VARCHAR), ',' ORDER BY turn)
                FILTER (NOT shared AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(CAST(end2 - length(two) + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(end2 AS BIGINT) AS VARCHAR), ',' ORDER BY turn)
                FILTER (NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY pair_id
"""


@query("op1_preference_format", CHAT_SQL)
def _(spark, sf_dir):
    pairs = chat.format_preferences(*chat.neighbour_pairs(table(spark, sf_dir, "conversations")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.withColumns({c: written(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


@query("op2_minhash_near_dedup")
def _(spark, sf_dir):
    config = minhash.SketchConfig(words=2, percent=80)
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), config)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win WHERE c IS NOT NULL),
inside AS (SELECT DISTINCT r, i + k AS at FROM twice, (VALUES (0), (1), (2)) AS v(k) WHERE n >= 2),
reps AS (SELECT r, count(*) AS n_repeat_words FROM inside GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN reps USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR n_upper > n_lower
       OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept,
       CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
       + (CASE WHEN n_upper > n_lower THEN 16 ELSE 0 END)
       + (CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits
FROM b
"""


@query("op4_quality_rules", QUALITY_SQL)
def _(spark, sf_dir):
    columns = ("doc_id", *quality.MEASURES[:5], "base_failed", "kept", "failed_bits")
    return quality.verdicts(table(spark, sf_dir, "documents")).select(*columns)


@query("op7_embedding_near_dedup")
def _(spark, sf_dir):
    return embedding.similar_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_byte_bpe")
def _(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path)


@query("op6_substring_dedup")
def _(spark, sf_dir):
    cut = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).where("removed_spans IS NOT NULL")
    field = lambda name: F.transform("removed_spans", lambda s: s[name])
    return cut.select(
        "doc_id",
        field("first_doc").alias("first_doc_ids"),
        field("start").alias("starts"),
        field("end").alias("ends"),
        F.aggregate(field("words"), F.lit(0).cast("long"), lambda a, x: a + x).alias("removed_words"),
        "text",
    )


@query("op8_packing")
def _(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_token_counts")
def _(spark, sf_dir):
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


@query("op10_license_scan")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


@query("op11_html_extraction")
def _(spark, sf_dir):
    return wrappers.main_text(table(spark, sf_dir, "pages"))


PHRASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, id, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
u AS (SELECT lang, id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM q),
w AS (SELECT lang, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS m, a AS phrase FROM w UNION ALL SELECT lang, 2, a || ' ' || b FROM w WHERE b IS NOT NULL
      UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM w WHERE c IS NOT NULL),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT c.*, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:m], ' ') AS tail FROM c, (VALUES (1), (2)) AS v(k) WHERE k < m),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.f AS l, y.f AS r,
             (CAST(k.a AS HUGEINT) * k.a * 1000000) // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head AND x.m = k.k JOIN f y ON y.lang = k.lang AND y.phrase = k.tail AND y.m = k.m - k.k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase, m ORDER BY score, k) = 1),
parts AS (SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
longer AS (SELECT lang, phrase, max(a) AS f FROM parts GROUP BY lang, phrase),
kept AS (SELECT b.* FROM b LEFT JOIN longer z ON z.lang = b.lang AND z.phrase = b.phrase AND b.m = 2 WHERE z.f IS NULL OR 100 * z.f < 50 * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


@query("op12_phrase_mining", PHRASE_SQL)
def _(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


NEGATIVE_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.k AS ak, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.k <> b.k AND len(a.v) = len(b.v)),
pos AS (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id) AS j FROM p WHERE same QUALIFY j <= 5),
neg AS (SELECT pos.anchor_id, pos.vec_id AS positive_id, pos.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
               row_number() OVER (PARTITION BY pos.ak, pos.j ORDER BY n.score DESC, n.vec_id) AS rank
        FROM pos JOIN p n ON n.ak = pos.ak AND NOT n.same AND 80 * pos.score <= 100 * n.score AND n.score <= pos.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""


@query("op13_hard_negatives", NEGATIVE_SQL)
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(finite(x), F.floor(256 * x).cast("double")).otherwise(x))
    return negatives.mine(vectors.withColumns({"label": label, "embedding": whole}), F.col("vec_id") % 100 == 0)
