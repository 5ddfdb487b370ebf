"""Candidates from stored postings: terms by bucket, entries by block of documents, frequencies beside them.

Below an index's path lie two tables and a small file. postings has a row, an entry, for each term and chunk that holds it; it is
partitioned by the term's bucket, and a file has blocks of few remainders, so that a question reads the files of its terms'
buckets and keeps of these the blocks it needs; within a file entries are in no order. It is shuffled once and nothing is collected. terms has each term's frequency by bucket,
the file its sums. A block holds the documents of one hash value; there are as many as BLOCK_CHUNKS asks for.

An entry's mask tells which fields of the chunk hold the term. Titles and paths belong to a document's first chunk alone,
a heading to the first chunk that has it: rows to be indexed have nulls elsewhere.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.query import QueryPlan, distinct, required_tokens
from quarry.session import read_small, write_small

#: Fields by bit; those of a chunk's head; what each weighs in lexical ranks; of trigrams only heads are indexed.
FIELDS = {"title": 1, "heading": 2, "path": 4, "body": 8}
HEADS, WEIGHTS = 7, {1: 8.0, 2: 6.0, 4: 5.0, 8: 1.0}
MOST_BUCKETS, BUCKET_CHUNKS, BLOCK_CHUNKS, SPREAD = 1_024, 8_192, 16_384, 16
#: Saturation and length of lexical ranks, the least weight of a term, terms of a trigram question.
K1, B, LEAST_IDF, MOST_TERMS = 1.2, 0.75, 1e-6, 24
#: Documents whose blocks are read alone; beyond, all blocks of the terms are.
MOST_CHOSEN = 20_000


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    return F.when(F.length(text) > 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def entries(rows: DataFrame, terms: Callable[[Column], Column] = T.folded_terms) -> DataFrame:
    """(doc_id, ordinal, term, mask, size) of rows (doc_id, ordinal, title, heading, path, body): size is that of all fields' terms.

    A chunk's terms are those of its head, then those of its body alone: none has to be grouped.
    """
    each = rows.select("doc_id", "ordinal", *[F.coalesce(terms(F.col(c)), F.array().cast("array<string>")).alias(c) for c in FIELDS])
    each = each.withColumn("_heads", F.array_distinct(F.concat(*[c for c, bit in FIELDS.items() if bit & HEADS])))
    size = reduce(lambda a, b: a + b, [F.size(c) for c in FIELDS])
    every = F.when(F.size("_heads") == 0, F.col("body")).otherwise(F.concat("_heads", F.array_except("body", "_heads")))
    # outer: else the optimiser would make the terms twice, once to see whether there are any
    each = each.select("doc_id", "ordinal", size.alias("size"), *FIELDS, F.size("_heads").alias("_n"), F.posexplode_outer(every).alias("_k", "term")).where("term IS NOT NULL")
    held = reduce(lambda a, b: a + b, [F.when(F.array_contains(c, F.col("term")), bit).otherwise(0) for c, bit in FIELDS.items()])
    return each.select("doc_id", "ordinal", "term", F.when(F.col("_k") < F.col("_n"), held).otherwise(FIELDS["body"]).alias("mask"), "size")


def build(
    rows: DataFrame, path: str, terms: Callable[[Column], Column] = T.folded_terms, buckets: int | None = None, block_chunks: int = BLOCK_CHUNKS, gone: DataFrame | None = None,
    counts: DataFrame | None = None, size: Callable[[], Column] | None = None,
) -> Postings:
    """Write the postings of rows (see entries()) below path.

    gone are rows of other segments that these replace: their terms count less one, so that the sums over all segments
    are right. counts (term, df, best, total, n, size) are given where segments are merged: the sums of theirs. size is a
    chunk's where it isn't that of its terms.
    """
    spark = rows.sparkSession
    n = rows.count()
    buckets = buckets or min(MOST_BUCKETS, max(1, n // BUCKET_CHUNKS))
    place = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int").alias("bucket")
    n_blocks = max(1, -(-n // block_chunks))
    e = entries(rows, terms).select(place, "term", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "ordinal", "mask", "size")
    e.repartition("bucket", F.pmod("block", F.lit(SPREAD))).sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    head = (F.col("mask").bitwiseAND(HEADS) != 0).cast("int")
    own = spark.read.schema("term string, mask int, bucket int").parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df"), F.max(1 + head).alias("best"), F.sum(F.bit_count("mask")).alias("total"))
    measured = lambda r: r.agg(F.count("*"), F.sum(size() if size else F.lit(0))).first()
    if counts is not None:
        own = counts.select(place, "term", "df", "best", "total")
        n, total = counts.agg(F.max("n"), F.max("size")).first()
    else:
        total = measured(rows)[1] or 0 if size else None
        if gone is not None:
            own = own.unionByName(entries(gone, terms).groupBy("term").agg((-F.count("*")).alias("df"), F.lit(1).alias("best"), (-F.sum(F.bit_count("mask"))).alias("total")).select(place, "*"))
            n_gone, size_gone = measured(gone)
            n, total = n - n_gone, None if total is None else total - (size_gone or 0)
    own.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("best").alias("best"), F.sum("total").alias("total")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    if total is None:
        total = spark.read.schema("total long").parquet(f"{path}/terms").agg(F.sum("total")).first()[0] or 0
    filled = not spark.read.schema("block int").parquet(f"{path}/postings").isEmpty()
    write_small(spark, f"{path}/stats.json", {"chunks": n or 0, "total": total or 0, "blocks": n_blocks, "buckets": buckets, "filled": filled})
    return Postings(spark, [(None, path)])


@dataclass
class Branch:
    """Terms of which a chunk must hold all of one group: groups of tokens, and what a match weighs."""

    groups: list[list[str]]
    factor: float = 1.0
    weight: float = 0.0

    @property
    def tokens(self) -> list[str]:
        return distinct(t for g in self.groups for t in g)


def tokens_of(term: str) -> list[str]:
    """Index terms that a term asks for: words parted at their marks."""
    return distinct(p for t in required_tokens(term) for p in (re.split("[_./:-]+", t) if t.isascii() else [t]) if len(p) > 1)


def branches(plan: QueryPlan) -> list[list[Branch]]:
    """For each concept its own branch and that of its alternates, which counts half."""
    out = []
    for c in plan.concepts:
        own, others = tokens_of(c.primary), [g for g in map(tokens_of, c.alternates) if g]
        out.append([Branch([own])] * bool(own) + [Branch(others, 0.5)] * bool(others))
    return out


def idf(n: int, df: int) -> float:
    return math.log(1 + (max(n, df) - df + 0.5) / (df + 0.5)) if df else 0.0


@dataclass
class Postings:
    """Written indexes as one: (segment, path) of each. Entries of a segment count for documents of that segment alone."""

    spark: SparkSession
    parts: list[tuple[str | None, str]]
    #: What the last question read: buckets, branches that chose documents, and blocks by segment (None: all).
    read: dict = field(default_factory=dict)
    _counts: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._stats = [read_small(self.spark, f"{p}/stats.json") for _, p in self.parts]
        if None in self._stats:
            raise FileNotFoundError(f"FileNotFound: statistics of {self.parts}")
        self.chunks, self.total = sum(s["chunks"] for s in self._stats), sum(s["total"] for s in self._stats)
        #: What tells documents apart.
        self.keys = ["doc_id", "segment"] if any(label for label, _ in self.parts) else ["doc_id"]

    def table(self, name: str, tokens: Iterable[str], blocks: list[list[int]] | None = None) -> DataFrame | None:
        """Rows of some terms: their buckets' files alone, of the parts that have any, and blocks by part."""
        wanted, found = sorted(set(tokens)), []
        for k, ((label, path), stats) in enumerate(zip(self.parts, self._stats, strict=True)):
            if name == "postings" and not stats["filled"]:
                continue
            places = sorted({bucket_of(t, stats["buckets"]) for t in wanted})
            self.read["buckets"] = places
            rows = self.spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(places) & F.col("term").isin(wanted))
            if blocks is not None:
                rows = rows.where(F.col("block").isin(blocks[k]))
            found.append(rows.withColumn("segment", F.lit(label)) if label else rows)
        return reduce(DataFrame.unionByName, found) if found else None

    def frequencies(self, tokens: Iterable[str]) -> dict[str, int]:
        """Chunks of each term, kept as long as this object is."""
        tokens = list(tokens)
        new = [t for t in set(tokens) if t not in self._counts]
        if new and self.total:
            self._counts |= dict.fromkeys(new, 0) | {r.term: r.df for r in self.table("terms", new).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        return {t: self._counts.get(t, 0) for t in tokens}

    def matches(self, tokens: Sequence[str], blocks: list[list[int]] | None = None, chosen: DataFrame | None = None) -> DataFrame:
        """(doc_id, segment, ordinal, size, m0, m1, ...): the mask of each token in each chunk that holds one, null where it doesn't."""
        rows = self.table("postings", tokens, blocks)
        if chosen is not None:
            rows = rows.join(F.broadcast(chosen), self.keys, "left_semi")
        return rows.groupBy(*self.keys, "ordinal").agg(F.max("size").alias("size"), *[F.max(F.when(F.col("term") == t, F.col("mask"))).alias(f"m{i}") for i, t in enumerate(tokens)])

    @staticmethod
    def holds(branch: Branch, tokens: Sequence[str], bits: int = 15) -> Column:
        """Whether a row of matches() holds one of the branch's groups, in fields of those bits."""
        place = {t: i for i, t in enumerate(tokens)}
        has = lambda t: F.coalesce(F.col(f"m{place[t]}").bitwiseAND(bits) != 0, F.lit(False))
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(has, g)) for g in branch.groups])

    def weighted(self, plan: QueryPlan, live: DataFrame | None = None) -> tuple[list[Branch], list[float]]:
        """(branches with weights, weight of each concept): inverse document frequencies from the table of terms.

        Groups of several terms are counted from their postings, all in one row; live (doc_id, segment) are the documents
        whose entries count, where there are segments.
        """
        each = branches(plan)
        flat = [b for pair in each for b in pair]
        df = self.frequencies(t for b in flat for t in b.tokens)
        many = [b for b in flat if len(b.groups) > 1 or len(b.groups[0]) > 1]
        key = lambda b: ("branch", tuple(map(tuple, b.groups)))
        new = [b for b in many if key(b) not in self._counts]
        if new and self.total:
            tokens = distinct(t for b in new for t in b.tokens)
            row = (self.matches(tokens) if live is None else self.matches(tokens).join(live.select(self.keys), self.keys, "left_semi")).agg(*[F.sum(self.holds(b, tokens).cast("long")).alias(f"b{i}") for i, b in enumerate(new)]).first()
            self._counts |= {key(b): row[i] or 0 for i, b in enumerate(new)}
        for b in flat:
            b.weight = b.factor * idf(self.chunks, self._counts.get(key(b), 0) if b in many else df[b.groups[0][0]])
        first = [next((b.weight for b in pair if b.weight > 0), 0.0) for pair in each]
        least = min((w for w in first if w > 0), default=0.0)
        return [b for b in flat if b.weight > 0], [w or least for w in first]

    def score(self, found: list[Branch], tokens: Sequence[str]) -> Column:
        """A match in any field counts its weight, one in the head the same again."""
        known = set(tokens)
        parts = [F.lit(b.weight) * (self.holds(b, tokens).cast("int") + self.holds(b, tokens, HEADS).cast("int")) for b in found if known.issuperset(b.tokens)]
        return F.round(reduce(lambda a, b: a + b, parts), 9)

    def concept_candidates(self, found: list[Branch], docs: DataFrame, limit: int, per_document: int) -> DataFrame:
        """(doc_id, ordinal, rank): the best chunks of the best documents of docs (doc_id, relative_path, effective_date).

        Documents are ordered by their best chunk's score, then date and path; each gives per_document chunks at most.
        Branches are taken by what they can add: once the limit-th document by those taken so far scores more than all
        others together can give, no document without them can come in. Then only blocks of documents that can still
        reach that score are read for the other terms.
        """
        if not found or not self.total:
            return self.none(docs)
        found = sorted(found, key=lambda b: -b.weight)
        tokens = distinct(t for b in found for t in b.tokens)
        order = [F.desc("doc_score"), F.desc("effective_date"), "relative_path", "doc_id"]
        chosen = blocks = None
        self.read["choosing"] = len(found)
        for k in range(1, len(found)):
            own, rest = distinct(t for b in found[:k] for t in b.tokens), 2 * sum(b.weight for b in found[k:])
            if 2 * sum(b.weight for b in found[:k]) <= rest or sum(self.frequencies(own).values()) < limit:
                continue
            part = self.matches(own).withColumn("score", self.score(found[:k], own)).where("score > 0").groupBy(self.keys).agg(F.max("score").alias("doc_score")).join(docs.select(self.keys), self.keys, "left_semi")
            top = part.orderBy(F.desc("doc_score")).limit(limit).agg(F.count("*").alias("n"), F.min("doc_score").alias("least")).first()
            if top.n == limit and top.least > rest + 1e-6:
                can = part.where(F.col("doc_score") >= top.least - rest - 1e-6).select(*self.keys, F.xxhash64("doc_id").alias("h")).limit(MOST_CHOSEN + 1)
                hashes = [r.h for r in can.select("h").collect()]
                if len(hashes) <= MOST_CHOSEN:
                    chosen, blocks = can.drop("h"), [sorted({h % s["blocks"] for h in hashes}) for s in self._stats]
                self.read["choosing"] = k
                break
        self.read["blocks"] = blocks
        scored = self.matches(tokens, blocks, chosen).select(*self.keys, "ordinal", self.score(found, tokens).alias("score")).where("score > 0").join(docs, self.keys)
        best = scored.groupBy("doc_id", "relative_path", "effective_date").agg(F.max("score").alias("doc_score")).orderBy(*order).limit(limit)
        kept = scored.select("doc_id", "ordinal", "score").join(F.broadcast(best), "doc_id")
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal"))).where(F.col("_r") <= per_document)
        return kept.orderBy(*order, F.desc("score"), "ordinal").limit(limit).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), (-F.col("score")).alias("rank"))

    def none(self, docs: DataFrame) -> DataFrame:
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("ordinal"), F.lit(0.0).alias("rank"))

    def _saturated(self, weight: float, hits: Column) -> Column:
        """A term's share of a lexical rank, from its hits weighted by field; size is the chunk's."""
        average = self.total / max(1, self.chunks)
        return F.when(hits > 0, F.lit(weight) * hits * (K1 + 1) / (hits + K1 * (1 - B + B * F.col("size") / average))).otherwise(0.0)

    def _weight(self, df: int) -> float:
        x = (self.chunks - df + 0.5) / (df + 0.5)
        return max(LEAST_IDF, math.log(x)) if x > 0 else LEAST_IDF

    def _first(self, scored: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
        best = scored.join(docs, self.keys).orderBy(F.desc("score"), F.desc("effective_date"), "relative_path", "doc_id", "ordinal").limit(limit)
        return best.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), (-F.col("score")).alias("rank"))

    def lexical_candidates(self, terms: Iterable[str], docs: DataFrame, limit: int) -> DataFrame:
        """(doc_id, ordinal, rank) of chunks that hold any of the terms, by BM25 over fields: title 8, heading 6, path 5, text 1."""
        groups = [g for g in map(tokens_of, terms) if g]
        if not groups or not self.total:
            return self.none(docs)
        tokens = distinct(t for g in groups for t in g)
        df, m = self.frequencies(tokens), self.matches(tokens).where(self.holds(Branch(groups), tokens))
        hits = lambda i: reduce(lambda a, b: a + b, [F.when(F.col(f"m{i}").bitwiseAND(bit) != 0, w).otherwise(0.0) for bit, w in WEIGHTS.items()])
        score = reduce(lambda a, b: a + b, [self._saturated(self._weight(df[t]), hits(i)) for i, t in enumerate(tokens)])
        return self._first(m.withColumn("score", F.round(score, 9)), docs, limit)


class Trigrams(Postings):
    """Postings of three characters over titles, headings and paths, with these fields beside them to confirm on."""

    def candidates(self, terms: Iterable[str], docs: DataFrame, limit: int, live: DataFrame | None = None) -> DataFrame:
        """(doc_id, ordinal, rank) of chunks with any term of three characters or more within one field, by BM25: 8, 6, 5."""
        words = distinct(t for t in terms if len(t) > 2)[:MOST_TERMS]
        if not words or not self.total:
            return self.none(docs)
        parts = {w: distinct(w[i : i + 3] for i in range(len(w) - 2)) for w in words}
        tokens = distinct(t for p in parts.values() for t in p)
        place = {t: i for i, t in enumerate(tokens)}
        in_field = lambda w, bit: reduce(lambda a, b: a & b, [F.coalesce(F.col(f"m{place[t]}").bitwiseAND(bit) != 0, F.lit(False)) for t in parts[w]])
        may = reduce(lambda a, b: a | b, [in_field(w, bit) for w in words for bit in (1, 2, 4)])
        heads = [self.spark.read.parquet(f"{p}/heads") for _, p in self.parts]
        heads = reduce(DataFrame.unionByName, [h.withColumn("segment", F.lit(label)) if label else h for h, (label, _) in zip(heads, self.parts, strict=True)])
        rows = self.matches(tokens).where(may).select(*self.keys, "ordinal").join(heads.withColumn("size", heads_size()), [*self.keys, "ordinal"])
        if live is not None:
            rows = rows.join(live.select(self.keys), self.keys, "left_semi")
        # a place for each occurrence, overlapping ones too
        count = lambda w, c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"(?={re.escape(w)})"))
        hits = lambda w: reduce(lambda a, b: a + b, [count(w, F.col(c)) * WEIGHTS[bit] for c, bit in FIELDS.items() if bit & HEADS])
        rows = rows.select(*self.keys, "ordinal", "size", *[hits(w).alias(f"h{i}") for i, w in enumerate(words)])
        row = rows.agg(*[F.sum((F.col(f"h{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(words))]).first()
        score = reduce(lambda a, b: a + b, [self._saturated(self._weight(row[i] or 0), F.col(f"h{i}")) for i in range(len(words))])
        return self._first(rows.withColumn("score", F.round(score, 9)).where("score > 0"), docs, limit)


def heads_size() -> Column:
    """Number of runs of three characters in a chunk's title, heading and path."""
    return reduce(lambda a, b: a + b, [F.greatest(F.lit(0), F.length(F.coalesce(F.col(c), F.lit(""))) - 2) for c, bit in FIELDS.items() if bit & HEADS])


def build_trigrams(rows: DataFrame, path: str, gone: DataFrame | None = None, **how) -> Trigrams:
    """Write the trigrams of the rows' heads."""
    spark = rows.sparkSession
    heads = [c for c, bit in FIELDS.items() if bit & HEADS]
    headed = lambda r: r.where(F.coalesce(*heads).isNotNull()).select("doc_id", "ordinal", *heads, F.lit(None).cast("string").alias("body"))
    headed(rows).drop("body").write.parquet(f"{path}/heads")
    build(headed(spark.read.parquet(f"{path}/heads")), path, trigrams, gone=None if gone is None else headed(gone), size=heads_size, **how)
    return Trigrams(spark, [(None, path)])


def merged(exact: DataFrame | None, ranked: list[DataFrame], docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, ordinal, rank): the least rank of each chunk over all branches, exact ones first.

    docs has canonical_id: of copies, a document with an exact row stands for all. Rows are ordered by rank, then date
    from late to early, path and place.
    """
    cols = ["doc_id", "ordinal", "rank"]
    rows = reduce(DataFrame.unionByName, [r.select(cols) for r in ranked]) if ranked else None
    if exact is not None:
        first = exact.select("doc_id").distinct().join(docs.select("doc_id", F.coalesce("canonical_id", "doc_id").alias("canonical_id")), "doc_id").groupBy("canonical_id").agg(F.min("doc_id").alias("_own"))
        if rows is not None:
            own = rows.join(docs.select("doc_id", F.coalesce("canonical_id", "doc_id").alias("canonical_id")), "doc_id").join(F.broadcast(first), "canonical_id", "left")
            rows = own.where(F.col("_own").isNull() | (F.col("_own") == F.col("doc_id"))).select(cols).unionByName(exact.select(cols))
        else:
            rows = exact.select(cols)
    best = rows.groupBy("doc_id", "ordinal").agg(F.min("rank").alias("rank")).join(docs.select("doc_id", "relative_path", "effective_date"), "doc_id")
    best = best.orderBy("rank", F.desc("effective_date"), "relative_path", "doc_id", "ordinal")
    return (best if limit is None else best.limit(limit)).select(cols)


def caps(limit: int, excerpts: int, tables: bool) -> tuple[int, int]:
    """(candidates, candidates of a document) of a search."""
    return 1200 if tables else min(1200, max(320, limit * 40)), max(8, excerpts * 3)
