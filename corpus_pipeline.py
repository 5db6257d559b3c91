"""The corpus pipeline: from raw documents to shards of a training mix.

Each stage is one operator of ``safelens.llm`` over all that its predecessor kept. Between stages the documents
are written as Parquet to the folder that the session's ``spark.checkpoint.dir`` names, and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from safelens.llm import common, decontaminate, mixing, near_dup, quality, sharding


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those of a score under 0.25, as losing a good one costs more than keeping junk.

    Null and empty texts are scored by their statistics, all zero. Rows of one doc_id stay or go together; those without one stay.
    """
    return quality.good_documents(docs, common.read(spark, sf_dir, "labels"), least=0.25)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest doc_id stays.

    Texts that are null, empty or without words are no duplicates of each other; of rows that repeat a doc_id one stays; rows
    without a doc_id stay.
    """
    return near_dup.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; rows without a doc_id stay."""
    return decontaminate.clean_documents(docs, common.read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: never, once or twice.

    A null source is a source. A text that is null, empty or without words has nothing that a mix could take, so it goes. Repeated rows
    stand for themselves.
    """
    return mixing.mixed_documents(docs)


def jump_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it. Rows without a doc_id share a shard; repeated rows have slots of their own."""
    return sharding.shard_documents(docs, carry=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("jump_sharding", jump_sharding),
]

#: The classifier and the latent search can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has written on its way is deleted once its result stands."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.swept(spark) as kept:
            before, docs = docs, common.written(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
        if hasattr(before, "_written_at"):
            common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
