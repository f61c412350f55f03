"""The corpus pipeline: toxic documents go, then exact and near copies; sources are mixed; the mix is packed."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from wavetally.llm import exact_dedup, mixing, near_copies, packing, toxicity
from wavetally.llm.common import stash_alone, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("simhash_near_dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learned and hashed stages; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each one's result is written and read again by the next.

    A stage's own intermediate tables go when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash_alone(partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
