"""A training corpus from raw documents, stage by stage.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir), works on all its
predecessor kept and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, mixing, secrets, similarity, toxicity
from sparkloom.llm.common import Spool, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return similarity.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that they share with the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked."""
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their weights and probabilities."""
    return mixing.mix(docs).where("mix_sampled").drop("mix_sampled")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_copies),
    ("decontaminate", cut_benchmark),
    ("secrets", mask_secrets),
    ("mix_sources", mix_sources),
]

#: Learned models, similarity groups and hashed draws have no SQL twin; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spool = Spool(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = spool.save(stage(spark, docs, sf_dir), name)
        if i:
            spool.drop(STAGES[i - 1][0])
    return docs
