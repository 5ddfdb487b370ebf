"""Weighted search and retrieval over line chunks, each with its SQL, which is written from the rules and not from the plan's code."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.query import QueryPlan, required_tokens, understand
from quarry.operators import search as S
from quarry.operators.candidates import canonical
from quarry.plans.corpus import CHUNKS_SQL, CORPUS_SQL, corpus, line_chunks, table

#: The corpus is European: ASCII words are anchors, all of which a result must hold.
QUESTION = "idiot und the"
#: Titles and lines in Han, by document and line, with a question whose keywords have synonyms.
HAN_TITLES = ("每日签到", "登录奖励", "抽奖规则", "夏日奖励", "夜港通知", "补签说明", "奖励")
HAN_LINES = ("签到领取", "奖品一览", "补签次数", "奖励", "掉落", "无关", "每日登录")
HAN_QUESTION = "签到奖励"
FIELDS = ("title", "heading", "relative_path", "source_kind", "family_key", "effective_date")


def index(s: SparkSession, d: str) -> DataFrame:
    """Canonical line chunks in lower case, without headings."""
    docs = canonical(corpus(s, d)).withColumn("title", F.lower("title")).withColumn("heading", F.lit(""))
    return line_chunks(docs, *FIELDS).withColumn("chunk_text", F.lower("chunk_text"))


def han_index(s: SparkSession, d: str) -> DataFrame:
    """The same with a Han title, and a Han word before every line."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    return index(s, d).withColumn("title", pick(HAN_TITLES, F.col("doc_id"))).withColumn("chunk_text", F.concat(pick(HAN_LINES, F.col("doc_id") + F.col("ordinal")), F.lit(" "), "chunk_text"))


def shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("relevance", 6).alias("relevance"), F.array_join(F.col("ordinals").cast("array<string>"), ",").alias("ordinals"))


def search_ranked(s, d):
    """The newest three of all that qualify, which are more."""
    return shown(S.search(index(s, d), understand(QUESTION), 3, "newest"))


def search_hybrid(s, d):
    return shown(S.search(index(s, d), understand("und the"), 12, "hybrid"))


def search_families(s, d):
    return S.search(index(s, d), understand("the"), 15, "relevance", latest_per_family=True).select("doc_id", "family_key", F.round("relevance", 6).alias("relevance"))


FILTERS = S.Filters(kinds=("design",), updated_after=dt.date(2024, 3, 1), updated_before=dt.date(2024, 9, 30))


def search_filtered(s, d):
    return shown(S.search(index(s, d), understand("the"), 10, "newest", filters=FILTERS))


def search_han(s, d):
    return shown(S.search(han_index(s, d), understand(HAN_QUESTION), 40, "relevance"))


def search_semantic(s, d):
    """Scores mixed with the similarity of the document's vector to that of vector 0."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    near = e.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), F.round(F.greatest(F.lit(0.0), S.cosine(F.col("embedding"), F.col("q"))), 6).alias("similarity"))
    chunks = index(s, d)
    return shown(S.search(chunks, understand("the"), 10, "relevance", semantic=chunks.select("doc_id", F.col("ordinal").cast("long").alias("ordinal")).join(near, "doc_id")))


def retrieve_bundle(s, d):
    return S.retrieve(index(s, d), understand(QUESTION), 8, 4, 6000)


def targeted_chunks(s, d):
    """Of every document the two chunks that cover most of a question."""
    found = S.search(index(s, d), understand("und the"), None, "newest", excerpts=2, targeted=True)
    return found.select("doc_id", F.array_join(F.col("ordinals").cast("array<string>"), ",").alias("ordinals"))


def named_activities(s, d):
    """How each document is named as one activity, by a title and a path made from its id."""
    plan = understand("北港777")
    docs = corpus(s, d).withColumn("title", F.concat(F.element_at(F.array(*map(F.lit, ("北港", "远北港", "北港·看灯", "夜市"))), (F.col("doc_id") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("777", "", "活动777"))), (F.col("doc_id") % 3 + 1).cast("int"))))
    return docs.select("doc_id", F.round(S.named_document(F.col("title"), F.col("relative_path"), plan.named), 6).alias("score"), S.embedded(F.col("title"), plan.named[0]).alias("embedded"))


NAMED_SQL = f"""WITH {CORPUS_SQL}, t AS (SELECT doc_id, ['北港', '远北港', '北港·看灯', '夜市'][doc_id % 4 + 1] || ['777', '', '活动777'][doc_id % 3 + 1] AS title FROM corpus),
c AS (SELECT doc_id, title, replace(title, '·', '') AS c FROM t), g AS (SELECT *, doc_id % 4 = 1 AS emb, CASE WHEN NOT contains(c, '北港') OR NOT contains(c, '777') THEN 0.0 WHEN contains(c, '北港777') THEN 4.0 WHEN contains(c, '看灯活动') THEN 2.0 WHEN contains(c, '看灯') OR contains(c, '活动') THEN 2.75 END AS s FROM c)
SELECT doc_id, round(CASE WHEN s > 0 THEN CAST(s AS DOUBLE) - CASE WHEN emb THEN 1 ELSE 0 END + 0.25 ELSE 0.0 END, 6) AS score, emb AND contains(title, '北港') AS embedded FROM g"""


def _strength(w: str) -> str:
    cell = f"regexp_matches(t, ' [a-z]+={w}($|\\s\\|| 行 )')"
    return f"CASE WHEN title = '{w}' THEN 1.0 WHEN contains(title, '{w}') THEN 0.85 WHEN source_kind = 'table' AND contains(regexp_replace(relative_path, '/[^/]*$', ''), '{w}') THEN 0.8 WHEN source_kind = 'table' AND {cell} THEN 0.75 WHEN contains(relative_path, '{w}') THEN 0.65 WHEN contains(t, '{w}') THEN 0.3 ELSE 0.0 END"


def _holds(w: str) -> str:
    return f"(contains(title, '{w}') OR contains(relative_path, '{w}') OR contains(t, '{w}'))"


def _indexed(w: str) -> str:
    """Words of title and path are indexed with the first chunk alone."""

    def token(x: str) -> str:
        of = (lambda c: f"regexp_matches(strip_accents({c}), '(^|[^a-z0-9]){x}([^a-z0-9]|$)')") if x.isascii() else (lambda c: f"contains({c}, '{x}')")
        return f"({of('t')} OR (ordinal = 0 AND {of("title || ' ' || relative_path")}))"

    return "(" + " AND ".join(map(token, required_tokens(w))) + ")"


def _own(c) -> str:
    """A keyword's strength; below a half, a synonym's half where that is more."""
    own = _strength(c.primary)
    return f"CASE WHEN {own} < 0.5 THEN greatest({own}, greatest({', '.join(map(_strength, c.alternates))}) / 2) ELSE {own} END" if c.alternates else own


def _sql(plan: QueryPlan, texts: str = "", where: str = "TRUE", semantic: str = "") -> str:
    """CTEs to fl: the documents that pass the needles and their kind's floor."""
    k = range(len(plan.concepts))
    words = [w for c in plan.concepts for w in (c.primary, *c.alternates)]
    idf = lambda p: f"CASE WHEN {p} = 0 THEN 0 ELSE ln(1 + (n - {p} + 0.5) / ({p} + 0.5)) END"
    others = lambda c: " OR ".join(map(_indexed, c.alternates)) or "FALSE"
    phrases = "".join(f" + CASE WHEN contains(title, '{p}') OR contains(relative_path, '{p}') THEN 0.08 WHEN contains(t, '{p}') THEN 0.03 ELSE 0.0 END" for p in plan.phrases)
    total = " + ".join(f"w{i}" for i in k)
    needles = [("p", w) for w in plan.primary] + [("d", a) for a in plan.document_anchors] + [("a", a) for a in plan.anchors if a not in plan.document_anchors]
    has = "".join(f", bool_or({_holds(w)}) FILTER (r <= 3) AS h{i}" for i, (_, w) in enumerate(needles))
    any_of = lambda kind: " OR ".join(f"h{i}" for i, (x, _) in enumerate(needles) if x == kind) or "FALSE"
    keep = [f"h{i}" for i, (x, _) in enumerate(needles) if x == "a"] + ([f"({any_of('d')})"] if plan.document_anchors else []) + ([f"({any_of('d')} OR {any_of('p')})"] if plan.primary else [])
    raw = f"0.18 + 0.72 * ({' + '.join(f'w{i} / ({total}) * CAST({_own(c)} AS DOUBLE)' for i, c in enumerate(plan.concepts))}){phrases}"
    mixed = f"CASE WHEN coalesce(similarity, 0) > 0 THEN ({raw}) * 0.72 + similarity * 0.28 ELSE {raw} END" if semantic else raw
    return f"""WITH {CORPUS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY effective_date DESC, relative_path, doc_id) AS crn FROM corpus),
canon AS (SELECT * REPLACE (lower(title) AS title) FROM ranked WHERE crn = 1), {CHUNKS_SQL.replace('FROM corpus,', 'FROM canon corpus,')}, x0 AS (SELECT *, lower(chunk_text) AS t FROM chunks), x AS (SELECT {texts or '*'} FROM x0),
n AS (SELECT count(*) AS n, {', '.join(f"count(*) FILTER ({_indexed(c.primary)}) AS p{i}, count(*) FILTER ({others(c)}) AS q{i}" for i, c in enumerate(plan.concepts))} FROM x),
f AS (SELECT {', '.join(f"CASE WHEN p{i} > 0 THEN {idf(f'p{i}')} ELSE ({idf(f'q{i}')}) / 2 END AS f{i}" for i in k)} FROM n),
m AS (SELECT *, (SELECT min(v) FROM (VALUES {', '.join(f'(f{i})' for i in k)}) AS l(v) WHERE v > 0) AS least FROM f),
w AS (SELECT {', '.join(f'CASE WHEN f{i} > 0 THEN f{i} ELSE least END AS w{i}' for i in k)} FROM m){semantic},
sc AS (SELECT x.*, round(least(1.0, {mixed}), 9) AS score FROM x {'LEFT JOIN near USING (doc_id)' if semantic else ''}, w WHERE ({' OR '.join(_holds(w) for w in dict.fromkeys([*words, *plan.document_anchors]))}) AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS r FROM sc),
docs AS (SELECT doc_id, relative_path, source_kind, family_key, effective_date, max(score) AS relevance, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS ordinals{has} FROM r GROUP BY doc_id, relative_path, source_kind, family_key, effective_date),
b AS (SELECT *, max(relevance) OVER (PARTITION BY source_kind) AS best FROM docs WHERE {' AND '.join(keep) or 'TRUE'}), fl AS (SELECT * FROM b WHERE relevance >= least(best, greatest(0.3, 0.7 * best)))"""  # fmt: skip


OUT = "SELECT doc_id, round(relevance, 6) AS relevance, ordinals"
NEWEST = "ORDER BY fl.effective_date DESC, fl.relevance DESC, relative_path, doc_id"
BEST = "ORDER BY fl.relevance DESC, fl.effective_date DESC, relative_path, doc_id"
HYBRID = "mx AS (SELECT *, min(effective_date) OVER () AS lo, max(effective_date) OVER () AS hi FROM fl), v AS (SELECT *, round(0.68 * relevance + 0.32 * CASE WHEN hi > lo THEN CAST(effective_date - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) ELSE 1.0 END, 9) AS mixed FROM mx)"
SEMANTIC = ", near AS (SELECT vec_id AS doc_id, round(greatest(0.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))), 6) AS similarity FROM embeddings)"
HAN = f"* REPLACE ([{', '.join(repr(x) for x in HAN_TITLES)}][doc_id % {len(HAN_TITLES)} + 1] AS title, [{', '.join(repr(x) for x in HAN_LINES)}][(doc_id + ordinal) % {len(HAN_LINES)} + 1] || ' ' || t AS t)"

QUERIES = {
    "search_ranked": (search_ranked, f"{_sql(understand(QUESTION))} {OUT} FROM fl {NEWEST} LIMIT 3"),
    "search_hybrid": (search_hybrid, f"{_sql(understand('und the'))}, {HYBRID} {OUT} FROM v ORDER BY mixed DESC, relative_path, doc_id LIMIT 12"),
    "search_families": (search_families, f"{_sql(understand('the'))}, k AS (SELECT *, row_number() OVER (PARTITION BY family_key ORDER BY relevance DESC, effective_date DESC, relative_path) AS k FROM fl) SELECT doc_id, family_key, round(relevance, 6) AS relevance FROM k WHERE k = 1 ORDER BY k.relevance DESC, effective_date DESC, relative_path LIMIT 15"),
    "search_filtered": (search_filtered, f"{_sql(understand('the'), where="source_kind = 'design' AND effective_date BETWEEN DATE '2024-03-01' AND DATE '2024-09-30'")} {OUT} FROM fl {NEWEST} LIMIT 10"),
    "search_han": (search_han, f"{_sql(understand(HAN_QUESTION), HAN)} {OUT} FROM fl {BEST} LIMIT 40"),
    "search_semantic": (search_semantic, f"{_sql(understand('the'), semantic=SEMANTIC)} {OUT} FROM fl {BEST} LIMIT 10"),
    "named_activities": (named_activities, NAMED_SQL),
    "retrieve_bundle": (retrieve_bundle, None),
    "targeted_chunks": (targeted_chunks, None),
}
