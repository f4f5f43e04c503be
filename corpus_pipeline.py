"""From raw documents to token ids, in five stages over whole tables.

Each stage takes what its predecessor kept. All but the last return the columns of
documents; the last adds `ids` and `n_tokens`, and its `text` is decoded from the
ids. Nulls, empty tables and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltair.llm import decontaminate, pieces, quality, simhash, suffix_dedup
from voltair.llm.common import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of 100-byte strings; a document that loses all of its text stays, empty."""
    return suffix_dedup.remove(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages."""
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text decoded from them."""
    coded = pieces.tokenise(docs, keep_text=False)
    decoded = pieces.detokenise(coded, text_name="text")
    return decoded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeated_strings),
    ("benchmark decontamination", cut_benchmark),
    ("sentencepiece", to_pieces),
]

#: The classifier is a trained network; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
