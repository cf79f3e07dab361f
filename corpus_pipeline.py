"""The corpus pipeline: toxicity, exact dedup, near duplicates, source mix, sampled encodings.

Each stage takes the rows that its predecessor kept and returns a DataFrame; all but the last return the
columns of `documents`. `run` applies them one after another, each written as Parquet to the shared
folder that `spark.checkpoint.dir` names and read again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillstream.llm import block_names, mixing, partenum, sampled_pieces, toxicity
from tillstream.llm.common import ensure_checkpoint_dir, read

# Trained models and samples behind it have no SQL; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return block_names.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return partenum.keep_one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at the end of a budget gives its first words."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document: doc_id, sample, ids, log_prob, inclusion."""
    import public_tokenizers

    return sampled_pieces.sample_encodings(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("source_mix", mix_sources), ("sampled_pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
