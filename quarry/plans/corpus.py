"""The driver's documents table seen as an indexed corpus: documents, line chunks and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[a-z0-9_./:-]{2,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the columns that indexing derives."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "lang", "source", "n_chars",
        "left(trim(split(text, '\\n')[0]), 80) AS title",
        "concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') AS relative_path",
        "CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'design' END AS source_kind",
        "date_add(DATE'2024-01-01', CAST((doc_id * 37) % 365 AS INT)) AS effective_date",
        "concat(source, ':', lang) AS family_key",
        "sha2(text, 256) AS content_hash",
    )


#: The same in DuckDB, as the head of a WITH.
CORPUS_SQL = """corpus AS (SELECT doc_id, text, lang, source, n_chars,
  left(trim(string_split(text, chr(10))[1]), 80) AS title,
  concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR), '.txt') AS relative_path,
  CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'design' END AS source_kind,
  CAST(DATE '2024-01-01' + CAST((doc_id * 37) % 365 AS INTEGER) AS DATE) AS effective_date,
  concat(source, ':', lang) AS family_key, sha256(text) AS content_hash
  FROM documents)"""


def line_chunks(docs: DataFrame, *keep: str) -> DataFrame:
    """One row for each line that isn't blank; ordinal is the line's number from 0."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("ordinal", "chunk_text")).where(
        F.trim("chunk_text") != ""
    ).withColumn("ordinal", F.col("ordinal").cast("long"))


CHUNKS_SQL = """chunks AS (SELECT * FROM (SELECT corpus.*, CAST(u.i - 1 AS BIGINT) AS ordinal, string_split(text, chr(10))[u.i] AS chunk_text
  FROM corpus, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i) u) WHERE trim(chunk_text) <> '')"""
