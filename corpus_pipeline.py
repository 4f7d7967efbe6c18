"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing, packing; each stage reads what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelmill.llm import exact_dedup, langid, minhash, mixing, packing
from reelmill.llm.common import stored
from reelmill.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled ones teach; `und` (null text, no letter) and texts whose
    best language scores below 0.4 go, texts in two known languages stay. With no labelled document there is nothing to
    judge by, and only texts without a letter go."""
    model = langid.train(docs)
    if model is None:
        return docs.filter("text rlike '\\\\p{L}'")
    return langid.keep_known(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of under-weighted sources repeated as the temperature mixture draws them, laid
    out in the order of its blocks."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, packed in groups of consecutive rows of the mixture."""
    return packing.pack_documents(docs, *vocabulary(), in_order=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Trained models, MinHash and bin packing are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
