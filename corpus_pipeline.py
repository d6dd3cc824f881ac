"""The training-data pipeline: stages over ``documents``, each written and read again.

Language ID, near duplicates, benchmark decontamination, mixing, sharding. Every stage but the last
returns the columns of its input, whatever they are. A null text has no language, and so does
not pass the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eddyfield.llm import decontaminate, jaccard, langid, mixing, sharding
from eddyfield.llm.common import digests_of, read, without_texts
from eddyfield.llm.registry import query
from eddyfield.session import new_path

LEAST_SCORE = 0.5  # of the predicted language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of too doubtful a one, go."""
    judged = langid.detect(docs, langid.learn(docs))
    gone = digests_of(docs, (judged["lang"] == langid.UNKNOWN) | (judged["score"] < LEAST_SCORE))
    return without_texts(docs.filter("text IS NOT NULL"), gone)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows without an id stay."""
    return jaccard.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources that weigh more than their share are repeated; none is lost."""
    _, sources = mixing.plan(docs)
    return mixing.draw(docs, sources, epoch="__epoch").drop("__epoch")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return sharding.assign(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None  # language models and alignments have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline", ORACLE_SQL)(run)
