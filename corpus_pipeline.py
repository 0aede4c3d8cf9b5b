"""The corpus pipeline: documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result is written as
Parquet and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import minhash, packing, quality, substring, toxicity
from tidegauge.llm.tables import table
from tidegauge.session import cut_lineage, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy ``prose`` keeps."""
    return quality.passing(docs, quality.POLICIES["prose"])


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    return toxicity.passing(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates by five-word shingles.

    Documents without an id are kept. Of equal texts under one id one row stays, the least by its columns
    as JSON; unlike texts under one id all stay if the id does.
    """
    found = minhash.near_duplicates(docs, minhash.SketchConfig(words=5, percent=80)).where("doc_id IS NOT NULL")
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    ids = cut_lineage(ids.where("NOT kept OR n > 1"))  # a row for each id but the unique and kept ones
    single = docs.join(ids, docs["doc_id"] == ids["_id"], "left_anti")
    several = ids.where("kept")
    several = docs.join(several, docs["doc_id"] == several["_id"], "left_semi")
    # equal rows are counted together before the shuffle
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = several.groupBy("doc_id", F.xxhash64("text").alias("_text")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return single.unionByName(several.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars is that of the new text.

    A text of which nothing is left stays as an empty one, and is packed as its end id alone.
    """
    cut = substring.deduplicate(docs, spans="removed_spans")
    changed = cut.columns[-1]
    size = F.when(F.col(changed).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", size).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", not_toxic),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", pack),
]

#: A fitted classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
