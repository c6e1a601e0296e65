"""Documents from raw to packed: quality rules, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read before the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import hostrules, linededup, lshforest, packing
from tokenloom.llm.common import new_path
from tokenloom.llm.registry import PACK_END, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected."""
    return hostrules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a document that is nothing else goes whole."""
    return linededup.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return lshforest.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, each with its sequence and its place there."""
    return packing.packed_documents(docs, vocabulary("word_bpe_49k.json"), 2048, PACK_END)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("packing", pack)]

#: Line dedup and packing go beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
