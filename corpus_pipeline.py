"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token ids.

Each stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.

Cases: a null or empty text fails the quality rules and goes. Documents stay as they were, failing lines included: the
rules decide on whole documents. Rows without id are judged by themselves and are no near-duplicates of others; rows of
one id whose texts differ are documents of their own. An empty table gives empty stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.decontaminate import decontaminated
from quarry.llm.mixing import repeated
from quarry.llm.near_dup import deduplicated
from quarry.llm.quality import judge
from quarry.llm.token_ids import TOKENIZER, read_rows, write_files
from quarry.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, as they were."""
    return judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return deduplicated(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and length of every document in the token files, as read back from them."""
    return read_rows(write_files(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID output", token_ids),
]

#: SQL can't express the stages: tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
