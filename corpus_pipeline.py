"""The corpus pipeline: toxicity filter, near-duplicate removal, source mixing, best-fit packing.

Every stage is (spark, docs, sf_dir) -> DataFrame; all but the last return documents' own columns, whatever
they are called, and drop or keep rows without changing them. Each stage's result is written as Parquet and
read again as the next one's input.

Rows with a null doc_id go through: they are scored, have no near copies, and are drawn like doc_id 0. A null
text is an empty one: never toxic by its words, no near copy of anything, kept by mixing, one end token in
packing. Texts of any length count whole; rows that repeat a doc_id are judged each, and removed together by
near_dedup. Ties are told by doc_id. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snaptable.llm.mixing import mixed
from snaptable.llm.near_dedup import without_near_copies
from snaptable.llm.packing import pack
from snaptable.llm.pieces import token_pieces
from snaptable.llm.queries import tokenizer
from snaptable.llm.scratch import Scratch
from snaptable.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    return without_toxic(Scratch(spark, "pipe5"), docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    return without_near_copies(Scratch(spark, "pipe9"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws half of the tokens, raked to tempered shares of source, language and topic."""
    return mixed(Scratch(spark, "pipe4"), docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2,048 tokens."""
    return pack(Scratch(spark, "pipe3"), token_pieces(docs, tokenizer("byte_bpe_50k.json"), end_id=0))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL expresses neither the fitted machine nor the tokenizer; tests/llm/test_pipeline.py holds every stage and the
#: whole against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
