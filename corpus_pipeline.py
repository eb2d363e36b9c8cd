"""From raw documents to token files, in five stages.

toxicity -> near-dedup -> decontamination -> mixing -> token ids.  Each stage
takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
to the shared folder and read again as the next one's docs.  All but the last
return the columns of documents.  The mix may hold a document twice; each copy
is a row.  A stage begins with a collection in driver and executors, so that it
does not stand on top of the memory that earlier ones took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import common, decontam, mixing, neardup, tokens, toxicity
from brindle.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored toxic; learns from the labelled ones among ``docs``."""
    common.give_back_everywhere(spark)
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, 0.8)."""
    common.give_back_everywhere(spark)
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark."""
    common.give_back_everywhere(spark)
    return decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their target weights; a row per copy taken."""
    common.give_back_everywhere(spark)
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and reads them back: a row per document of the mix."""
    common.give_back_everywhere(spark)
    return tokens.encode_documents(docs, common.new_path(spark, "tokens"), tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: A trained network, signatures and a hashed mix are beyond SQL; tests/llm checks run() instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
