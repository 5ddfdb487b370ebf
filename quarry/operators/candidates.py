"""Candidate generation over chunks: canonical rows, term statistics, weighted scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import hot_join

WORD = r"[a-z0-9_./:-]{2,}"


def canonical_ids(docs: DataFrame) -> DataFrame:
    """canonical_id: of the newest of the documents of equal content (then by path and id).

    Groups are partial aggregates of narrow columns, and the largest ones are broadcast: copies never meet in one task.
    """
    best = F.min(F.struct((-F.unix_date("effective_date")).alias("d"), "relative_path", "doc_id"))
    groups = docs.groupBy("content_hash").agg(best.alias("b"), F.count("*").alias("copies")).select("content_hash", F.col("b.doc_id").alias("canonical_id"), "copies")
    return hot_join(docs, groups, ["content_hash"], "copies", F.col("doc_id")).drop("copies")


def canonical(docs: DataFrame) -> DataFrame:
    """The documents that are their groups' canonical ones: ids from narrow columns, texts only for what is left."""
    ids = docs.groupBy("content_hash").agg(F.min(F.struct((-F.unix_date("effective_date")).alias("d"), "relative_path", "doc_id")).alias("b")).select("b.doc_id")
    return docs.join(ids, "doc_id", "left_semi")


def leaders(docs: DataFrame) -> DataFrame:
    """(doc_id, outranked_by) of the first of equal documents of each source: the newest, then by path and id.

    outranked_by has the (source_id, source_kind) of the leaders that come before it. A content's array has at most one
    entry a source, however many copies there are.
    """
    best = F.min(F.struct((-F.unix_date(F.col("effective_date").cast("date"))).alias("age"), "relative_path", "doc_id"))
    each = docs.groupBy("content_hash", "source_id", "source_kind").agg(best.alias("b")).select("content_hash", F.struct("b.age", "b.relative_path", "b.doc_id", "source_id", "source_kind").alias("x"))
    ladder = each.groupBy("content_hash").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    place = ladder.select("xs", F.posexplode("xs").alias("k", "x"))
    return place.select("x.doc_id", F.transform(F.slice("xs", F.lit(1), F.col("k")), lambda y: F.struct(y["source_id"].alias("source_id"), y["source_kind"].alias("source_kind"))).alias("outranked_by"))


def first_in_scope(source_ids: Sequence[str], kinds: Sequence[str] = ()) -> Column:
    """Whether a document with leaders()' column is in the scope of some sources, and of some kinds if any are given, and
    the first of its content there: no equal document of the scope comes before it."""

    def inside(source: Column, kind: Column) -> Column:
        return source.isin(list(source_ids)) & kind.isin(list(kinds)) if kinds else source.isin(list(source_ids))

    before = F.exists("outranked_by", lambda x: inside(x["source_id"], x["source_kind"]))
    return inside(F.col("source_id"), F.col("source_kind")) & F.coalesce(~before, F.lit(False))


def postings(chunks: DataFrame, *keep: str) -> DataFrame:
    """Distinct terms of every chunk."""
    return chunks.select("doc_id", "ordinal", *keep, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("chunk_text"), F.lit(WORD), 0))).alias("term"))


def idf(n, df):
    """ln(1 + (N - n + .5) / (n + .5)) with N not below n."""
    return F.log(1 + (F.greatest(n, df) - df + 0.5) / (df + 0.5))


def concept_scores(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Score of each chunk: the sum of its terms' inverse document frequencies, normalised to sum 1 over the terms.

    Of a chunk's words only those of the terms are kept, without a row for each word; their frequencies are one broadcast row.
    """
    words = F.regexp_extract_all(F.lower("chunk_text"), F.lit(WORD), 0)
    found = chunks.withColumn("_found", F.array_intersect(words, F.array(*map(F.lit, terms))))
    counts = [F.sum(F.array_contains("_found", t).cast("long")).alias(f"d{i}") for i, t in enumerate(terms)]
    row = found.agg(F.count("*").alias("n"), *counts)
    weight = [F.when(F.col(f"d{i}") > 0, idf(F.col("n"), F.col(f"d{i}"))).otherwise(0.0) for i in range(len(terms))]
    total = reduce(lambda a, b: a + b, weight)
    row = row.select(F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*[w / total for w in weight])).alias("_w"))
    keys = [c for c in ("doc_id", "ordinal", "relative_path", "effective_date") if c in chunks.columns]
    hits = found.where(F.size("_found") > 0).select(*keys, "_found").crossJoin(F.broadcast(row))
    return hits.select(*keys, F.aggregate("_found", F.lit(0.0), lambda s, t: s + F.col("_w")[t]).alias("score"))
