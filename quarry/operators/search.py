"""Weighted search and retrieval: one scan for term statistics, one for scores, everything in Columns.

Chunks have doc_id, ordinal, chunk_text and the document's title, relative_path, heading, source_kind, family_key and
effective_date, all folded at indexing time.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from operator import itemgetter

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.query import Concept, Named, QueryPlan, required_tokens, weigh
from quarry.functions.text import cosine, fold, utf16_length, without_marks
from quarry.operators.ranking import first_per, newest, quality_floor, rank_bonus, with_hybrid
from quarry.session import stored

FIELDS = ("title", "heading", "relative_path", "chunk_text")
GAP = r"[^\p{L}\p{N}]*"


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def holds(term: str) -> Column:
    return _any(F.col(c).contains(term) for c in FIELDS)


def _literal(word: str) -> str:
    """A pattern of the word's characters with any marks between them."""
    return GAP.join(regex.escape(c) for c in word)


def named_score(value: Column, group: Named) -> Column:
    """4 for name and number together, 3.5 to 2 for the number later, by the bytes between; 1 less within a longer name."""
    compact = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    at = F.instr(compact, group.entity)
    rest = F.substr(compact, at + len(group.entity))
    gap = F.instr(rest, group.number)
    apart = F.greatest(F.lit(2.0), 3.5 - F.least(F.lit(1.5), F.octet_length(F.left(rest, gap - 1)) / 8))
    together = F.instr(compact, group.entity + group.number) > 0
    score = F.when(together, 4.0).when((at > 0) & (gap > 0), apart).otherwise(0.0)
    return score - F.when((score > 0) & embedded(value, group), 1.0).otherwise(0.0)


def embedded(value: Column, group: Named) -> Column:
    """Whether the first occurrence follows a Han character, as part of a longer name."""
    whole, name = _literal(group.entity + group.number), _literal(group.entity)
    at = F.when(F.regexp_instr(value, F.lit(whole)) > 0, F.regexp_instr(value, F.lit(whole))).otherwise(F.regexp_instr(value, F.lit(name)))
    return (at > 1) & F.substr(value, at - 1, F.lit(1)).rlike(r"\p{IsHan}") & F.substr(value, at, F.lit(1)).rlike(r"\p{IsHan}")


def standalone(value: Column, group: Named) -> Column:
    return (named_score(value, group) > 0) & ~embedded(value, group)


def named_strength(group: Named) -> Column:
    title, heading, path, text = (F.col(c) for c in FIELDS)
    return (
        F.when(standalone(title, group), 0.8).when(standalone(heading, group) | standalone(path, group), 0.6)
        .when(named_score(title, group) > 0, 0.5).when((named_score(heading, group) > 0) | (named_score(path, group) > 0), 0.4)
        .when(text.contains(group.entity) & text.contains(group.number), 0.25).otherwise(0.0)
    )


def cell_column(text: Column, term: str) -> Column:
    """Letters of the first column with a cell that equals the term; empty where there is none."""
    return F.regexp_extract(text, rf"(?<= )([a-z]+)={regex.escape(term)}(?=$|\s\|| 行 |\n)", 1)


def is_name_column(text: Column, column: Column) -> Column:
    """Whether the header row calls the column a name."""
    header = F.substring_index(F.regexp_replace(text, r"\s行 ", "\u0000"), "\u0000", 1)
    cell = F.regexp_extract_all(header, F.lit(r"(?<= )([a-z]+=[^|\n]*)"), 1)
    return F.exists(cell, lambda c: (F.substring_index(c, "=", 1) == column) & F.substr(c, F.instr(c, "=") + 1).rlike("name|名称|名字"))


def strength(term: str) -> Column:
    """Strongest field that holds the term; in tables, cells and directories count too."""
    title, heading, path, text = (F.col(c) for c in FIELDS)
    table, cell = F.col("source_kind") == "table", cell_column(text, term)
    return (
        F.when(title == term, 1.0).when(title.contains(term), 0.85)
        .when(table & (cell != "") & is_name_column(text, cell), 0.85)
        .when(table & F.regexp_replace(path, r"(^|[/\\])[^/\\]*$", "").contains(term), 0.8).when(table & (cell != ""), 0.75)
        .when(heading.contains(term) | path.contains(term), 0.65).when(text.contains(term), 0.3).otherwise(0.0)
    )


def concept_strength(c: Concept) -> Column:
    """The keyword's strength; below a half, a synonym's half where that is more."""
    own = named_strength(c.named) if c.named else strength(c.primary)
    if not c.alternates:
        return own
    other = F.greatest(*[strength(a) for a in c.alternates]) if len(c.alternates) > 1 else strength(c.alternates[0])
    return F.when(own < 0.5, F.greatest(own, other / 2)).otherwise(own)


def score(plan: QueryPlan, rank: Column | None = None, semantic: Column | None = None) -> Column:
    s = F.lit(0.18)
    s = s + 0.72 * reduce(lambda a, b: a + b, [F.lit(c.weight) * concept_strength(c) for c in plan.concepts])
    for p in plan.phrases:
        s = s + F.when(_any(F.col(c).contains(p) for c in FIELDS[:3]), 0.08).when(F.col("chunk_text").contains(p), 0.03).otherwise(0.0)
    if rank is not None:
        s = s + rank_bonus(rank)
    if semantic is not None:
        s = F.when(semantic > 0, s * 0.72 + semantic * 0.28).otherwise(s)
    return F.least(F.lit(1.0), s)


def indexed(term: str) -> Column:
    """Whether a chunk's index terms hold all that the term asks for.

    Title and path are indexed with a document's first chunk alone, a heading with the first chunk that has it; letters
    count without marks.
    """
    fields = [F.col("chunk_text"), F.when(F.col("ordinal") == 0, F.concat_ws(" ", "title", "relative_path")), F.when(F.col("ordinal") == 0, F.col("heading"))]

    def found(token: str) -> Column:
        if token.isascii():
            return _any(F.coalesce(without_marks(c).rlike(rf"(?<![a-z0-9]){regex.escape(token)}(?![a-z0-9])"), F.lit(False)) for c in fields)
        return _any(F.coalesce(c.contains(token), F.lit(False)) for c in fields)

    tokens = required_tokens(term)
    return reduce(lambda a, b: a & b, map(found, tokens)) if tokens else F.lit(False)


def weighted(chunks: DataFrame, plan: QueryPlan) -> QueryPlan:
    """plan with inverse document frequencies as weights: one aggregate row, a column for each keyword."""
    tests = [(indexed(c.primary), _any(indexed(a) for a in c.alternates)) for c in plan.concepts]
    sums = [F.sum(t.cast("long")).alias(f"{kind}{i}") for i, pair in enumerate(tests) for kind, t in zip("pa", pair, strict=True)]
    row = chunks.agg(F.count("*").alias("n"), *sums).first()
    idf = lambda d: math.log(1 + (max(row.n, d) - d + 0.5) / (d + 0.5)) if d else 0.0
    # a keyword that stands nowhere has half the weight of its synonyms, or the least of all
    found = [idf(row[f"p{i}"] or 0) or idf(row[f"a{i}"] or 0) / 2 for i in range(len(tests))]
    least = min((w for w in found if w > 0), default=0.0)
    return weigh(plan, [w or least for w in found])


@dataclass(frozen=True)
class Filters:
    """What a request narrows its results to; empty means all. Dates are inclusive."""

    sources: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    documents: tuple = ()
    updated_after: dt.date | None = None
    updated_before: dt.date | None = None

    def of(self, chunks: DataFrame) -> DataFrame:
        """Chunks that pass; filters on columns of documents reach the scan."""
        for column, values in (("source_id", self.sources), ("source_kind", self.kinds), ("section", self.sections), ("doc_id", self.documents)):
            chunks = chunks.where(F.col(column).isin(*values)) if values else chunks
        if self.extensions:
            chunks = chunks.where(F.lower("extension").isin(*[e.lower() for e in self.extensions]))
        if self.updated_after:
            chunks = chunks.where(F.col("effective_date") >= F.lit(self.updated_after))
        return chunks.where(F.col("effective_date") <= F.lit(self.updated_before)) if self.updated_before else chunks


# Roles of documents beside an activity's plan, by title, and what asks for each.
ROLES = (
    ("累充|充值", "累充|充值"), ("玩法内容|玩法设计|表格设计", "玩法内容|玩法设计|表格设计|配表"), ("数组特效|特效设计", "数组特效|特效设计"),
    ("商业数值|数值模型", "商业数值|数值模型"), ("复用", "复用|沿用|套用"),
)
ACTIVITY = "活动"


def named_document(title: Column, path: Column, groups: Iterable[Named]) -> Column:
    """How well a document is named as one of the activities, a title a quarter more than a path; 0 if it isn't."""
    scores = [c for g in groups for c in (F.when(named_score(title, g) > 0, named_score(title, g) + 0.25).otherwise(0.0), named_score(path, g))]
    return F.greatest(F.lit(0.0), F.lit(0.0), *scores)


def role_score(plan: QueryPlan) -> Column:
    """How much a document's title and path make it the one that is asked for, among those of an activity or anchor."""
    if not plan.named and not (plan.latest and plan.document_anchors):
        return F.lit(0.0)
    title, path = F.col("title"), F.col("relative_path")
    both, query = F.concat_ws("\n", title, path), fold(plan.query)
    s = named_document(title, path, plan.named) * 4
    for a in plan.document_anchors:
        s = s + F.when(title.contains(a), 1.0).when(path.contains(a), 0.25).otherwise(0.0)
    for t in plan.terms:
        s = s + F.when(both.contains(t), min(10, len(t)) * 0.08).otherwise(0.0)
    if plan.named or ACTIVITY in query:
        s = s + F.when(title.contains(ACTIVITY), 1.0).otherwise(0.0)
    for of_title, of_query in ROLES:
        s = s + F.when(title.rlike(of_title), 0.6 if regex.search(of_query, query) else -0.45).otherwise(0.0)
    return s


def required_documents(chunks: DataFrame, anchors: Iterable[str], most: int = 12) -> DataFrame | None:
    """(doc_id) of the document for each anchor: titled so, else with it in the title, the path or a heading; the newest of equals.

    One row an anchor, from a partial aggregate.
    """
    anchors = list(anchors)[:most]
    if not anchors:
        return None
    title, path, heading = F.col("title"), F.col("relative_path"), F.col("heading")
    level = lambda a: F.when(title == a, 0).when(title.contains(a), 1).when(path.contains(a), 2).when(heading.contains(a), 3)
    best = [F.min(F.when(level(a).isNotNull(), F.struct(level(a).alias("level"), newest("effective_date").alias("age"), "relative_path", "doc_id"))).alias(f"a{i}") for i, a in enumerate(anchors)]
    return chunks.agg(*best).select(F.explode(F.array_compact(F.array(*[F.col(f"a{i}.doc_id") for i in range(len(anchors))]))).alias("doc_id")).distinct()


def breadth(plan: QueryPlan) -> Column:
    """How much of the question a chunk's own text covers beside the keyword it covers best."""
    text = F.col("chunk_text")
    parts = []
    for c in plan.concepts:
        own = text.contains(c.named.entity) & text.contains(c.named.number) if c.named else text.contains(c.primary)
        other = F.lit(False) if c.named else _any(text.contains(a) for a in c.alternates)
        words = (c.named.entity, c.named.number) if c.named else (c.primary,)
        told = reduce(lambda a, b: a & b, [F.col("title").contains(w) | F.col("relative_path").contains(w) for w in words])
        parts.append(F.when(told, 0.0).when(own, c.weight).when(other, c.weight / 2).otherwise(0.0))
    return reduce(lambda a, b: a + b, parts) - F.greatest(F.lit(0.0), F.lit(0.0), *parts)


# The collation of paths and ids; how far ahead a chunk's score secures its place, and what breadth counts beside it.
COLLATION, LOCKED, BREADTH = "zh", 0.03, 0.3
DOCUMENT = ("doc_id", "title", "relative_path", "source_kind", "family_key", "effective_date")


def search(
    chunks: DataFrame, plan: QueryPlan, limit: int | None = 20, sort: str = "newest", latest_per_family: bool = False, excerpts: int = 3,
    filters: Filters = Filters(), semantic: DataFrame | None = None, targeted: bool = False, reruns: DataFrame | None = None, known: bool = False,
) -> DataFrame:
    """The best documents with their best chunks: doc_id, relevance, and the columns of documents, ordinals in order of score.

    Every chunk that holds a term is scored; chunks of a document meet in partial aggregates, and texts don't travel.
    Documents below their kind's floor go, but for those that an anchor requires, that are named as the activity, or that
    have the role asked for. sort is newest, relevance or hybrid: the first limit documents in that order are taken, the
    required ones before all others; without a limit all are, in no order. Ties go by path and doc_id, in the order of
    Chinese. A question without concepts finds nothing.

    filters narrow before scores are compared. semantic is (doc_id, ordinal, similarity) for the rows that have one. With
    targeted, the documents are chosen already: no floor, and chunks that cover more of the question come sooner. reruns
    (doc_id) count as named too. known says that the plan's weights are those of the corpus, as where chunks are candidates
    of an index; their rank, if they have one, counts too.
    """
    if not plan.concepts:
        return chunks.limit(0).select("doc_id", F.lit(0.0).alias("relevance"), *DOCUMENT[1:], F.array().cast("array<long>").alias("ordinals"))
    plan = plan if known else weighted(chunks, plan)
    chunks = filters.of(chunks)
    words = [w for c in plan.concepts for w in (c.primary, *c.alternates, *((c.named.entity,) if c.named else ()))]
    anchored = [holds(a) for a in plan.anchors if a in plan.document_anchors]
    hit = chunks if targeted else chunks.where(_any([*(holds(w) for w in dict.fromkeys(words)), *anchored]))
    if semantic is not None:
        hit = hit.join(semantic.select("doc_id", "ordinal", "similarity"), ["doc_id", "ordinal"], "left")
    value = F.round(score(plan, F.col("rank") if "rank" in chunks.columns else None, F.coalesce("similarity", F.lit(0.0)) if semantic is not None else None), 9)
    # what a result must hold: a word of the first concept or a document anchor; one of these anchors; every other anchor
    needles = {f"_p{i}": w for i, w in enumerate(plan.primary)} | {f"_d{i}": a for i, a in enumerate(plan.document_anchors)} | {f"_a{i}": a for i, a in enumerate(a for a in plan.anchors if a not in plan.document_anchors)}
    own = breadth(plan) if targeted else F.lit(0.0)
    scored = hit.select(*DOCUMENT, F.col("ordinal").cast("long").alias("ordinal"), value.alias("score"), F.round(own, 9).alias("breadth"), *[holds(w).alias(k) for k, w in needles.items()])
    # two levels, so that a document of very many chunks is cut to its best before its chunks meet
    order = [F.desc("score"), "ordinal"]
    if targeted:
        edge = Window.partitionBy("doc_id").orderBy(*order)
        scored = scored.withColumn("_edge", F.coalesce(F.nth_value("score", excerpts).over(edge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(-1.0)))
        ahead = F.col("score") > F.col("_edge") + LOCKED
        scored = scored.withColumn("_key", F.when(ahead | (F.col("_edge") < 0), 10 + F.col("score")).otherwise(F.round(F.col("score") + BREADTH * F.col("breadth"), 9)))
        order = [F.desc("_key"), "ordinal"]
        top = scored.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    else:
        top = scored.withColumn("_key", F.col("score")).withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", F.col("ordinal") % 64).orderBy(*order)))
    relevance = scored.groupBy("doc_id").agg(F.max("score").alias("relevance"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("_key")).alias("s"), "ordinal", *needles)))
    docs = top.where(F.col("_r") <= excerpts).groupBy(*DOCUMENT).agg(F.slice(best, 1, excerpts).alias("best")).join(relevance, "doc_id")
    docs = docs.withColumn("ordinals", F.transform("best", lambda x: x["ordinal"]))
    if needles and not targeted:
        has = {k: F.array_contains(F.transform("best", itemgetter(k)), True) for k in needles}
        of = lambda p: [c for k, c in has.items() if k.startswith(p)]
        document = _any(of("_d"))
        keep = document | _any(of("_p")) if plan.primary else F.lit(True)
        if plan.document_anchors:
            keep = keep & document
        for c in of("_a"):
            keep = keep & c
        docs = docs.where(keep)
    docs = docs.drop("best").withColumn("role", F.round(role_score(plan), 9)).withColumn("named", named_document(F.col("title"), F.col("relative_path"), plan.named) > 0)
    if reruns is not None:
        docs = docs.join(reruns.select("doc_id", F.lit(True).alias("_own")).distinct(), "doc_id", "left").withColumn("named", F.col("named") | F.coalesce("_own", F.lit(False))).drop("_own")
    # written once, without texts: floors, spans and the order below each read it, and would score all chunks again
    docs = stored(docs, "search")
    if not targeted:
        docs = identity_gate(docs, plan)
    required = None if targeted else required_documents(chunks, plan.document_anchors)
    docs = docs.withColumn("required", F.lit(False)) if required is None else docs.join(F.broadcast(required.withColumn("_q", F.lit(True))), "doc_id", "left").withColumn("required", F.coalesce("_q", F.lit(False))).drop("_q")
    if not targeted:
        docs = quality_floor(docs, "source_kind", "relevance", F.col("required") | F.col("named") | (F.col("role") >= 0.9))
    docs = with_hybrid(docs, "relevance", "effective_date", "mixed")
    keys = {"newest": [newest("effective_date"), -F.col("role"), -F.col("relevance")], "relevance": [-F.col("relevance"), newest("effective_date")], "hybrid": [-F.round("mixed", 9)]}[sort]
    keys = [*keys, F.collate("relative_path", COLLATION), *([F.collate("doc_id", COLLATION)] if docs.schema["doc_id"].dataType.typeName() == "string" else []), F.col("relative_path"), F.col("doc_id")]
    if latest_per_family:
        docs = first_per(docs, "family_key", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    chosen = docs if limit is None else docs.orderBy(F.desc("required"), *keys).limit(limit).orderBy(*keys)
    return chosen.select("doc_id", "relevance", *DOCUMENT[1:], "ordinals")


def identity_gate(docs: DataFrame, plan: QueryPlan) -> DataFrame:
    """docs narrowed to those of the named activity, or of the anchors where the newest is asked for, if there are any.

    A question about tables narrows designs alone. Whether there are any comes from one broadcast row.
    """
    anchored = _any(F.concat_ws("\n", "title", "relative_path").contains(a) for a in plan.document_anchors)
    if plan.named:
        own, all_kinds = F.col("named"), not plan.tables
    elif plan.latest and plan.document_anchors and not plan.tables:
        own, all_kinds = anchored, True
    else:
        return docs
    found = docs.agg(F.coalesce(F.max(own.cast("int")), F.lit(0)).alias("_any"))
    other = F.lit(False) if all_kinds else F.col("source_kind") != "design"
    return docs.crossJoin(F.broadcast(found)).where((F.col("_any") == 0) | own | other).drop("_any")


def retrieve(
    chunks: DataFrame, plan: QueryPlan, documents: int = 8, per_document: int = 4, characters: int = 16_000, sort: str = "newest",
    chosen: tuple = (), filters: Filters = Filters(), reruns: DataFrame | None = None, known: bool = False, semantic: DataFrame | None = None,
) -> DataFrame:
    """Evidence of both kinds of source: (position, doc_id, ordinal, size, used), until the characters are spent.

    Three quarters of the places go to designs by date, or to tables by relevance where the question asks for tables;
    the rest go to the other kind by relevance, then both fill up. Documents that the question requires come before all:
    of a named activity the design titled so, its newest declared rerun (reruns: doc_id, words) and the newest of a longer
    name, as far as designs have places; and for each anchor a document that is named so. With chosen documents only these
    are searched. Limits are clamped to 1-50, 1-10 and 2,000-60,000. At most 150 rows of each kind are ranked.
    """
    documents, per_document, characters = min(50, max(1, documents)), min(10, max(1, per_document)), min(60_000, max(2_000, characters))
    first, second = ("table", "design") if plan.tables else ("design", "table")
    pool, chosen = max(documents * 3, 12 if plan.named else 0), tuple(dict.fromkeys(chosen))[:documents]
    of = lambda k: search(chunks.where(F.col("source_kind") == k), plan, pool, sort, excerpts=per_document, filters=replace(filters, documents=chosen or filters.documents), semantic=semantic, targeted=bool(chosen), reruns=reruns, known=known)
    both = of(first).unionByName(of(second))
    title, path = F.col("title"), F.col("relative_path")
    names = F.concat_ws("\n", title, path)
    none = F.lit(False)
    if reruns is not None:
        both = both.join(reruns.select("doc_id", F.lit(True).alias("_body"), F.col("words").isNotNull().alias("_rerun")), "doc_id", "left").withColumn("_body", F.coalesce("_body", none)).withColumn("_rerun", F.coalesce("_rerun", none))
    else:
        both = both.withColumn("_body", none).withColumn("_rerun", none)
    identity = named_document(title, path, plan.named) > 0 if plan.named else _any(names.contains(a) for a in plan.document_anchors)
    if not plan.tables and not chosen and (plan.named or (plan.latest and plan.document_anchors)):
        found = both.agg(F.coalesce(F.max((identity | F.col("_body")).cast("int")), F.lit(0)).alias("_any"))
        both = both.crossJoin(F.broadcast(found)).where((F.col("_any") == 0) | identity | F.col("_body")).drop("_any")
    by_rel = Window.partitionBy("source_kind").orderBy(F.desc("relevance"), F.desc("effective_date"), "relative_path", "doc_id")
    by_day = Window.partitionBy("source_kind").orderBy(F.desc("effective_date"), F.desc("relevance"), "relative_path", "doc_id")
    quota = (documents * 3 + 3) // 4
    both = both.withColumn("_rel", F.row_number().over(by_rel)).withColumn("_day", F.row_number().over(by_day))
    place = F.col("_rel") if plan.tables else F.col("_day")
    is_first, design = F.col("source_kind") == first, F.col("source_kind") == "design"
    level = F.when(is_first & (place <= quota), 10).when(~is_first & (F.col("_rel") <= documents - quota), 20).when(is_first, 30).otherwise(40)
    both = both.withColumn("_level", level)
    # the first document that meets each requirement, in the order of requirements
    titled = named_document(title, F.lit(""), plan.named) if plan.named else F.lit(0.0)
    needs: list[tuple[Column, Column]] = []
    if plan.named:
        needs.append((design & ((titled > 0) | identity), -titled))
        slots = max(documents - quota, min(3, documents // 2)) if plan.tables else documents
        longer = _any((named_score(title, g) > 0) & ~standalone(title, g) for g in plan.named)
        needs += [(design & c, F.lit(0.0)) for c in (F.col("_rerun"), longer)][: max(0, slots - 1)]
    numbers = {g.number for g in plan.named}
    needs += [(names.contains(a), F.lit(0.0)) for a in plan.document_anchors if a not in numbers]
    if needs and not chosen:
        order = lambda c, key: F.min(F.when(c, F.struct(key.alias("k"), newest("effective_date").alias("age"), "relative_path", "doc_id")))
        row = both.agg(*[order(c, key).alias(f"n{i}") for i, (c, key) in enumerate(needs)])
        must = row.select(F.array_compact(F.array(*[F.col(f"n{i}.doc_id") for i in range(len(needs))])).alias("_must"))  # one row
        both = both.crossJoin(F.broadcast(must)).withColumn("_at", F.array_position("_must", F.col("doc_id")))
        both = both.withColumn("_level", F.when(F.col("_at") > 0, F.least(F.col("_at"), F.lit(9))).otherwise(F.col("_level"))).drop("_must", "_at")
    one = Window.orderBy("_level", F.when(F.col("_level") == 10, place).otherwise(F.col("_rel")), "doc_id")  # at most 300 rows
    kept = both.withColumn("_n", F.row_number().over(one)).where(F.col("_n") <= documents)
    last = [F.desc("relevance"), F.desc("effective_date")] if plan.tables or sort == "relevance" else [F.desc("effective_date"), F.desc("relevance")]
    kept = kept.withColumn("position", F.row_number().over(Window.orderBy(*last, "relative_path", "doc_id")).cast("long"))
    rows = kept.select("position", "doc_id", F.posexplode("ordinals").alias("_k", "ordinal"))
    texts = chunks.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), utf16_length(F.col("chunk_text")).alias("size"))
    packed = texts.join(F.broadcast(rows), ["doc_id", "ordinal"])  # at most 500 rows
    running = Window.orderBy("position", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return packed.withColumn("used", F.sum("size").over(running)).where(F.col("used") <= characters).select("position", "doc_id", "ordinal", "size", "used")
