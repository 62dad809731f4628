"""From documents to token ids: filter, deduplicate, mix and encode.

Every stage takes all documents its predecessor kept and returns documents
(``doc_id, text, lang, source, n_chars``); the last returns token ids.  Between
stages documents are written as Parquet in the shared folder and read again,
so that a lost executor costs at most a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwise.llm import bpe, simhash, substring_dedup, toxicity
from rankwise.llm import mixing as mix
from rankwise.llm.common import documents, stored
from rankwise.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model, trained on the training folds here, predicts to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=COLUMNS[1:])
    return scored.where(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints (3-word shingles, 2 bits) the document of smallest ``doc_id`` stays.

    Equal rows are linked, so one of them stays.  Of a group without any
    ``doc_id`` one row stays.
    """
    rows = docs.select(*COLUMNS).withColumn("uid", F.xxhash64("doc_id", "text"))
    groups = simhash.dedup(rows, shingle=3, max_bits=2, carry=["uid"])
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("uid").alias("uid"))
    return rows.join(kept.select("uid"), "uid", "left_semi").dropDuplicates(["uid"]).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document of smaller ``doc_id`` has; the rest keeps its white space."""
    cut = substring_dedup.dedup(docs.select(*COLUMNS[:4]), carry=["lang", "source"], spaces=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                      F.char_length("kept").cast("bigint").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and drops documents so that sources have their target weights."""
    return mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return bpe.encode(docs, carry=["lang", "source", "n_chars"])


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("substring_dedup", drop_repeated_passages),
          ("mixing", mix_sources), ("bpe", encode)]

#: SQL has neither the tokenizer nor the learned model; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
