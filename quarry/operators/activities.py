"""Documents of a named activity: reruns that leave the number out of their title, and what to tell of names that are alike."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import reruns as R
from quarry.functions.query import Named, QueryPlan
from quarry.operators.ranking import newest, preceding
from quarry.operators.search import named_score, standalone
from quarry.session import ship, stored

#: Names of an activity that are judged at once, and chunks before one that may head references.
NAMES, BEFORE = 1_000, 3


def known_names(docs: DataFrame, group: Named) -> Iterator[list[tuple[str, str, str]]]:
    """(full name, name without number, title) of the activities that documents (title, relative_path, effective_date) are
    named as: titles before paths, then the newest, the shorter title, its order. About NAMES of them at a time."""

    def spans(v: pd.Series) -> pd.Series:
        return v.map(lambda x: sorted(set(R.spans(x or "", group))))

    named = docs.where((named_score(F.col("title"), group) > 0) | (named_score(F.col("relative_path"), group) > 0))
    both = F.array(*[F.struct(F.lit(k).alias("by"), F.col(c).alias("value")) for k, c in enumerate(("title", "relative_path"))])
    each = named.select("title", "effective_date", F.explode(both).alias("v")).select("v.by", "title", "effective_date", F.explode(F.pandas_udf(spans, "array<string>")("v.value")).alias("name"))
    best = F.min(F.struct("by", newest("effective_date").alias("age"), F.length("title").alias("size"), "title"))
    rows = stored(each.groupBy("name").agg(best.alias("b")), "activity-names")
    n = -(-rows.count() // NAMES)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k)
        yield sorted((r.name, r.name.removesuffix(group.number), r.b.title) for r in part.collect())


def judge(pairs: list[tuple[str, str]], owners: dict[str, str]):
    """Judges chunks by R.rerun_of(), with the titles that own the names."""

    def of(title: pd.Series, heading: pd.Series, text: pd.Series, before: pd.Series) -> pd.DataFrame:
        rows = []
        for t, h, x, b in zip(title, heading, text, before, strict=True):
            r = R.rerun_of(t or "", h or "", x or "", list(reversed(b)), pairs)
            rows.append((r[0], owners[r[0]], r[1]) if r else (None, None, None))
        return pd.DataFrame(rows, columns=["name", "owner", "words"])

    return of


def declared_reruns(chunks: DataFrame, plan: QueryPlan) -> DataFrame:
    """(doc_id, title, effective_date, name, owner, words) of documents that name one of the question's activities in full
    only in their text: words is their declaration that they are its rerun, null where they make none.

    Only titles with the name's beginning are looked into; their chunks and up to BEFORE chunks above go through Python.
    """
    ship(chunks.sparkSession)
    schema = "doc_id long, title string, effective_date date, name string, owner string, words string"
    found = None
    docs = chunks.select("doc_id", "title", "relative_path", "effective_date").distinct()
    for group in plan.named:
        own = (named_score(F.col("title"), group) > 0) | (named_score(F.col("relative_path"), group) > 0)
        maybe = chunks.where(~own & F.regexp_replace("title", r"[^\p{L}\p{N}]", "").contains(group.entity))
        maybe = preceding(maybe.select("doc_id", "ordinal", "title", "heading", "effective_date", "chunk_text"), "doc_id", "ordinal", "heading", "chunk_text", BEFORE)

        parts = []
        for names in known_names(docs, group):
            judged = judge([(n, bare) for n, bare, _ in names], {n: t for n, _, t in names})
            verdict = F.pandas_udf(judged, "struct<name:string,owner:string,words:string>")("title", "heading", "chunk_text", "before")
            parts.append(maybe.select("doc_id", "title", "effective_date", "ordinal", verdict.alias("v")).where("v.name IS NOT NULL"))
        if not parts:
            continue
        each = reduce(DataFrame.unionByName, parts)
        # of a document's chunks the first that declares, else the first that names
        best = F.min(F.struct(F.col("v.words").isNull().alias("none"), "ordinal", "v.name", "v.owner", "v.words"))
        each = each.groupBy("doc_id", "title", "effective_date").agg(best.alias("b")).select("doc_id", "title", "effective_date", "b.name", "b.owner", "b.words")
        found = each if found is None else found.unionByName(each)
    return found.dropDuplicates(["doc_id"]) if found is not None else chunks.sparkSession.createDataFrame([], schema)


def notes(reruns: DataFrame) -> list[str]:
    """A note on the newest declared rerun of each activity."""
    best = F.min(F.struct(newest("effective_date").alias("age"), F.length("title").alias("size"), "title", "owner", "words"))
    rows = reruns.where("words IS NOT NULL").groupBy("name").agg(best.alias("b")).orderBy("name").collect()
    return [f"《{r.b.title}》: no number in its title, but “{r.b.words}” in its text; it may be a rerun of the activity of 《{r.b.owner}》" for r in rows]


def ambiguities(docs: DataFrame, plan: QueryPlan) -> list[str]:
    """A warning where a name stands for itself in one title and within a longer name in another: the newest of both."""
    out = []
    for g in plan.named:
        alone = standalone(F.col("title"), g)
        of = lambda c: F.min(F.when(c, F.struct(newest("effective_date").alias("age"), F.length("title").alias("size"), "title")))
        row = docs.where(named_score(F.col("title"), g) > 0).agg(of(alone).alias("a"), of(~alone).alias("b")).first()
        if row.a and row.b:
            out.append(f"“{g.entity}{g.number}” is 《{row.a.title}》 by its words; 《{row.b.title}》 only holds it within a longer name and may be another activity")
    return out
