"""Filters, statistics, ranking, evidence and maintenance over the corpus, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.chunking import chunk_udf
from quarry.operators import maintenance as M
from quarry.operators import ranking as R
from quarry.operators.candidates import canonical_ids, idf, postings
from quarry.operators.vectors import nearest
from quarry.plans.corpus import CHUNKS_SQL, CORPUS_SQL, corpus, line_chunks, table

WITH = f"WITH {CORPUS_SQL}"
WITH_CHUNKS = f"WITH {CORPUS_SQL}, {CHUNKS_SQL}"
POST_SQL = "post AS (SELECT DISTINCT doc_id, ordinal, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9_./:-]{2,}')) AS term FROM chunks)"
REL_SQL = "CASE WHEN title = 'the' THEN 1.0 WHEN contains(title, 'the') THEN 0.85 WHEN contains(relative_path, 'the') THEN 0.65 WHEN contains(text, 'the') THEN 0.3 ELSE 0.0 END"


def day():
    """The business date as text, which both engines write alike."""
    return F.col("effective_date").cast("string").alias("effective_date")


def relevance(d: DataFrame) -> DataFrame:
    """Strength of one term and a share of the length, so that few rows tie."""
    s = R.field_strength(F.lit("the"), F.col("title"), F.col("relative_path"), F.col("text"))
    return d.withColumn("relevance", F.round(s * 0.9 + 0.1 * (F.col("n_chars") % 1000) / 1000.0, 6))


RELEVANCE_SQL = f"rel AS (SELECT *, round(CAST({REL_SQL} AS DOUBLE) * 0.9 + 0.1 * CAST(n_chars % 1000 AS DOUBLE) / 1000.0, 6) AS relevance FROM corpus)"


def canonical_dedup(s: SparkSession, d: str) -> DataFrame:
    return canonical_ids(corpus(s, d)).select("doc_id", "canonical_id")


def duplicate_groups(s, d):
    return corpus(s, d).groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def idf_stats(s, d):
    chunks = line_chunks(corpus(s, d))
    df = postings(chunks).groupBy("term").agg(F.count("*").alias("df"))
    n = chunks.agg(F.count("*").alias("n"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


def posting_and(s, d):
    """Chunks that hold both terms."""
    hits = postings(line_chunks(corpus(s, d))).where(F.col("term").isin("the", "and"))
    return hits.groupBy("doc_id", "ordinal").agg(F.count("*").alias("n")).where("n = 2").select("doc_id", "ordinal")


def format_stats(s, d):
    return corpus(s, d).groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.sum(F.when(F.col("source_kind") == "table", 1).otherwise(0)).cast("long").alias("tables")
    )


def source_status(s, d):
    return canonical_ids(corpus(s, d)).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.when(F.col("doc_id") == F.col("canonical_id"), 1).otherwise(0)).cast("long").alias("canonical"), F.max("effective_date").cast("string").alias("newest")
    )


def consistency(s, d):
    c = line_chunks(corpus(s, d))
    kept = corpus(s, d).where("doc_id % 10 <> 0")
    return c.agg(F.count("*").alias("chunks")).join(M.orphans(c, kept, "doc_id").agg(F.count("*").alias("orphan_chunks"))).join(kept.agg(F.count("*").alias("documents")))


def exact_anchor_rank(s, d):
    """For each term, documents by where they hold it, one of each content, four a term."""
    terms = s.createDataFrame([("the",), ("idiot",), ("src1/en",)], "term string")
    docs = corpus(s, d)
    hit = docs.join(F.broadcast(terms), F.col("title").contains(F.col("term")) | F.col("relative_path").contains(F.col("term")) | F.col("text").contains(F.col("term")))
    level = F.when(F.col("title") == F.col("term"), 0).when(F.col("title").contains(F.col("term")), 1).when(F.col("relative_path").contains(F.col("term")), 2).otherwise(3).cast("long")
    hit = hit.withColumn("level", level)
    best = hit.groupBy("term", "content_hash").agg(F.min(F.struct("level", (-F.unix_date("effective_date")).alias("age"), "relative_path", "doc_id")).alias("b")).select("term", "b.*")
    w = Window.partitionBy("term").orderBy("level", "age", "relative_path", "doc_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 4").select("term", "rank", "doc_id", "level")


def like_fallback(s, d):
    """Newest documents that hold any term as it stands, wildcard characters included."""
    terms = ["idiot", "|", "%%%"]
    any_of = F.lit(False)
    for t in terms:
        any_of = any_of | F.lower("title").contains(t) | F.lower("text").contains(t)
    return corpus(s, d).where(any_of).orderBy(F.desc("effective_date"), "relative_path", "doc_id").limit(50).select("doc_id", day())


def doc_scores(s, d):
    """Chunks of all documents by where they hold the terms, the best two of each."""
    return best_chunks(corpus(s, d))


def best_chunks(docs: DataFrame) -> DataFrame:
    c = line_chunks(docs, "title", "relative_path")
    score = F.lit(0)
    for t in ("the", "ention"):
        score = score + F.when(F.col("title").contains(t), 10).otherwise(0) + F.when(F.col("relative_path").contains(t), 6).otherwise(0) + F.when(F.col("chunk_text").contains(t), 4).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal")
    return c.withColumn("score", score.cast("long")).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2").select("doc_id", "ordinal", "score", "rank")


def latest_per_family(s, d):
    return R.first_per(corpus(s, d), "family_key", R.newest("effective_date"), "relative_path", "doc_id").select("family_key", "doc_id", day())


def version_chain(s, d):
    return corpus(s, d).where("family_key = 'src1:en'").orderBy(F.desc("effective_date"), "relative_path").limit(30).select("doc_id", day(), "title")


def request_filters(s, d):
    return corpus(s, d).where("source_kind = 'design' AND lang IN ('en', 'de') AND effective_date >= DATE'2024-03-01' AND effective_date <= DATE'2024-09-30'").select("doc_id", "lang", day())


def source_scope(s, d):
    scope = s.createDataFrame([("src1", "en"), ("src2", "fr"), ("src3", "de")], "source string, lang string")
    return corpus(s, d).join(F.broadcast(scope), ["source", "lang"], "left_semi").select("doc_id", "source", "lang")


def quality_floor(s, d):
    return R.quality_floor(relevance(corpus(s, d)), "source_kind", "relevance").select("doc_id", "source_kind", "relevance")


def hybrid_sort(s, d):
    c = R.with_hybrid(relevance(corpus(s, d)), "relevance", "effective_date", "_value")
    return c.withColumn("rank_value", F.round("_value", 6)).orderBy(F.desc("rank_value"), "relative_path").limit(40).select("doc_id", "rank_value")


def evidence_budget(s, d):
    """Chunks of the 30 best documents until 24,000 UTF-16 characters are spent."""
    best = relevance(corpus(s, d)).orderBy(F.desc("relevance"), "doc_id").limit(30)
    c = line_chunks(best, "relevance").withColumn("size", T.utf16_length(F.col("chunk_text"))).withColumn("bundle", F.lit(1))
    return R.within_budget(c, [F.desc("relevance"), "doc_id", "ordinal"], "size", 24_000, ["bundle"]).select("doc_id", "ordinal", "size", "used")


def preceding_chunks(s, d):
    c = line_chunks(corpus(s, d)).withColumn("heading", F.left("chunk_text", F.lit(1))).withColumn("n", F.length("chunk_text").cast("long"))
    return R.preceding(c, "doc_id", "ordinal", "heading", "n").where("size(before) > 0").select("doc_id", "ordinal", F.array_join(F.col("before").cast("array<string>"), ",").alias("sizes"))


def source_reconcile(s, d):
    c = corpus(s, d)
    before = c.where("doc_id % 5 <> 0").groupBy("source").agg(F.max("doc_id").cast("string").alias("identity"))
    after = c.where("source <> 'src3' AND doc_id % 7 <> 0").groupBy("source").agg(F.max("doc_id").cast("string").alias("identity"))
    return M.reconcile(before.where("source <> 'src5'"), after, "source", "identity")


def missing_deleted(s, d):
    c = corpus(s, d)
    return M.mark_missing(c.select("doc_id", "source"), c.where("doc_id % 4 <> 0"), c.where("source IN ('src1', 'src2')"), "doc_id", "source").groupBy("source").agg(F.sum(F.col("deleted").cast("long")).alias("deleted"), F.count("*").alias("documents"))


def incremental_upsert(s, d):
    c = corpus(s, d)
    old = c.where("doc_id % 3 <> 0").select("doc_id", F.lit("old").alias("version"), "content_hash")
    return M.upsert(old, c.where("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("version"), "content_hash"), "doc_id").groupBy("version").agg(F.count("*").alias("documents"))


def semantic_neighbours(s, d):
    """Every row whose id is divisible by 20 against all rows: the nearest 80 of each."""
    e = table(s, d, "embeddings")
    return nearest(e, e.where("vec_id % 20 = 0"), 80)


def chunk_lengths(s, d):
    return line_chunks(corpus(s, d)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"), F.max("ordinal").alias("last"))


def sparse_headings(s, d):
    """A heading's terms go to the first chunk that has it."""
    c = line_chunks(corpus(s, d)).withColumn("heading", F.left("chunk_text", F.lit(3)))
    return c.groupBy("doc_id", "heading").agg(F.min("ordinal").alias("ordinal"))


def find_dates_texts(s, d):
    """Dates of whole texts."""
    return corpus(s, d).select("doc_id", F.array_join(F.transform(T.find_dates(F.col("text")), lambda x: x.cast("string")), ",").alias("dates"))


def section_classify(s, d):
    heads = F.element_at(F.array(*[F.lit(x) for x in ("奖励数值", "玩法规则", "panel", "", "背景", "drop table id")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return corpus(s, d).select("doc_id", T.classify_section(heads, F.lower(F.left("text", F.lit(240)))).alias("section"))


def _section_sql() -> str:
    rule = lambda c: " ".join(f"WHEN regexp_matches({c}, '{p.replace('(?![a-z0-9_])', '([^a-z0-9_]|$)')}') THEN '{n}'" for n, p in T.SECTION_RULES)
    return f"{WITH}, h AS (SELECT doc_id, ['奖励数值', '玩法规则', 'panel', '', '背景', 'drop table id'][doc_id % 6 + 1] AS head, lower(left(text, 240)) AS t FROM corpus) SELECT doc_id, CASE {rule('head')} {rule('t')} ELSE 'other' END AS section FROM h"


def family_key_titles(s, d):
    k = T.family_key(T.normalize_text(F.col("title")))
    return corpus(s, d).select("doc_id", k.alias("k")).select("doc_id", "k.key", F.round("k.confidence", 4).alias("confidence"))


def normalized_titles(s, d):
    return corpus(s, d).select("doc_id", T.normalize_text(F.col("title")).alias("title"))


def text_chunks(s, d):
    """Documents in overlapping pieces of 2,000 characters."""
    return corpus(s, d).select("doc_id", F.posexplode(chunk_udf(2000, 100)(F.col("text"))).alias("ordinal", "piece")).select("doc_id", F.col("ordinal").cast("long"), F.length("piece").cast("long").alias("chars"))


def _family_sql() -> str:
    """The drops in their order; the borders of ASCII words are \\b here."""
    drops, c = [p.replace("(?<![a-z0-9_])", r"\b").replace("(?![a-z0-9_])", r"\b") for p in T.FAMILY_DROPS], "n"
    for p in drops:
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    trimmed = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"""{WITH}, t AS (SELECT doc_id, lower({trimmed('title')}) AS n FROM corpus), b AS (SELECT *, {trimmed(c)} AS bare FROM t), k AS (SELECT *, trim(regexp_replace(bare, '{T.FAMILY_ENDINGS}', '')) AS cut FROM b),
    r AS (SELECT *, CASE WHEN cut = '' THEN n ELSE cut END AS key FROM k)
    SELECT doc_id, key, round(CASE WHEN bare = n THEN CAST(0.55 AS DOUBLE) ELSE greatest(0.45, least(0.95, 0.62 + CAST(greatest(0, length(n) - length(key)) AS DOUBLE) / greatest(20, length(n)))) END, 4) AS confidence FROM r"""


FAMILY_SQL = _family_sql()
#: A piece ends after the last sentence's end in its second half; the next begins 100 characters before that.
PIECES_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, t, 0 AS ordinal, 0 AS pos, least(length(t), 2000) AS till FROM t WHERE t <> ''
  UNION ALL SELECT doc_id, t, ordinal + 1, greatest(pos + 1, cut - 100), least(length(t), greatest(pos + 1, cut - 100) + 2000) FROM (
    SELECT *, CASE WHEN till >= length(t) THEN till WHEN regexp_matches(substr(t, pos + 1001, till - pos - 1000), '[。！？!?；;\n]') THEN pos + 1000 + length(regexp_replace(substr(t, pos + 1001, till - pos - 1000), '[^。！？!?；;\n]*$', '')) ELSE till END AS cut FROM c) WHERE cut < length(t)),
p AS (SELECT doc_id, ordinal, t, pos, CASE WHEN till >= length(t) THEN till WHEN regexp_matches(substr(t, pos + 1001, till - pos - 1000), '[。！？!?；;\n]') THEN pos + 1000 + length(regexp_replace(substr(t, pos + 1001, till - pos - 1000), '[^。！？!?；;\n]*$', '')) ELSE till END AS cut FROM c)
SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(length(regexp_replace(substr(t, pos + 1, cut - pos), '^\s+|\s+$', '', 'g')) AS BIGINT) AS chars FROM p"""


QUERIES = {
    "canonical_dedup": (canonical_dedup, f"{WITH} SELECT doc_id, first_value(doc_id) OVER (PARTITION BY content_hash ORDER BY effective_date DESC, relative_path, doc_id) AS canonical_id FROM corpus"),
    "duplicate_groups": (duplicate_groups, f"{WITH} SELECT content_hash, count(*) AS copies, min(doc_id) AS first_id FROM corpus GROUP BY 1 HAVING count(*) > 1"),
    "idf_stats": (idf_stats, f"{WITH_CHUNKS}, {POST_SQL}, df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), n AS (SELECT count(*) AS n FROM chunks) SELECT term, df, round(ln(1 + (greatest(n, df) - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, n"),
    "posting_and": (posting_and, f"{WITH_CHUNKS}, {POST_SQL} SELECT doc_id, ordinal FROM post WHERE term IN ('the', 'and') GROUP BY 1, 2 HAVING count(*) = 2"),
    "format_stats": (format_stats, f"{WITH} SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(CASE WHEN source_kind = 'table' THEN 1 ELSE 0 END) AS BIGINT) AS tables FROM corpus GROUP BY 1"),
    "source_status": (source_status, f"{WITH}, c AS (SELECT *, first_value(doc_id) OVER (PARTITION BY content_hash ORDER BY effective_date DESC, relative_path, doc_id) AS cid FROM corpus) SELECT source, count(*) AS documents, CAST(sum(CASE WHEN doc_id = cid THEN 1 ELSE 0 END) AS BIGINT) AS canonical, CAST(max(effective_date) AS VARCHAR) AS newest FROM c GROUP BY 1"),
    "consistency": (consistency, f"{WITH_CHUNKS} SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM corpus WHERE doc_id % 10 <> 0)) AS orphan_chunks, (SELECT count(*) FROM corpus WHERE doc_id % 10 <> 0) AS documents"),
    "exact_anchor_rank": (exact_anchor_rank, f"{WITH}, t AS (SELECT unnest(['the', 'idiot', 'src1/en']) AS term), h AS (SELECT term, doc_id, content_hash, effective_date, relative_path, CAST(CASE WHEN title = term THEN 0 WHEN contains(title, term) THEN 1 WHEN contains(relative_path, term) THEN 2 ELSE 3 END AS BIGINT) AS level FROM corpus, t WHERE contains(title, term) OR contains(relative_path, term) OR contains(text, term)), a AS (SELECT *, row_number() OVER (PARTITION BY term, content_hash ORDER BY level, effective_date DESC, relative_path, doc_id) AS r FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY level, effective_date DESC, relative_path, doc_id) AS rank FROM a WHERE r = 1) SELECT term, rank, doc_id, level FROM b WHERE rank <= 4"),
    "like_fallback": (like_fallback, f"{WITH} SELECT doc_id, CAST(effective_date AS VARCHAR) AS effective_date FROM corpus WHERE contains(lower(title), 'idiot') OR contains(lower(text), 'idiot') OR contains(text, '|') OR contains(text, '%%%') ORDER BY corpus.effective_date DESC, relative_path, doc_id LIMIT 50"),
    "doc_scores": (doc_scores, f"{WITH_CHUNKS}, s AS (SELECT doc_id, ordinal, CAST((CASE WHEN contains(title, 'the') THEN 10 ELSE 0 END) + (CASE WHEN contains(relative_path, 'the') THEN 6 ELSE 0 END) + (CASE WHEN contains(chunk_text, 'the') THEN 4 ELSE 0 END) + (CASE WHEN contains(title, 'ention') THEN 10 ELSE 0 END) + (CASE WHEN contains(relative_path, 'ention') THEN 6 ELSE 0 END) + (CASE WHEN contains(chunk_text, 'ention') THEN 4 ELSE 0 END) AS BIGINT) AS score FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS rank FROM s) SELECT * FROM r WHERE rank <= 2"),
    "latest_per_family": (latest_per_family, f"{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY family_key ORDER BY effective_date DESC, relative_path, doc_id) AS r FROM corpus) SELECT family_key, doc_id, CAST(effective_date AS VARCHAR) AS effective_date FROM r WHERE r = 1"),
    "version_chain": (version_chain, f"{WITH} SELECT doc_id, CAST(effective_date AS VARCHAR) AS effective_date, title FROM corpus WHERE family_key = 'src1:en' ORDER BY corpus.effective_date DESC, relative_path LIMIT 30"),
    "request_filters": (request_filters, f"{WITH} SELECT doc_id, lang, CAST(effective_date AS VARCHAR) AS effective_date FROM corpus WHERE source_kind = 'design' AND lang IN ('en', 'de') AND corpus.effective_date BETWEEN DATE '2024-03-01' AND DATE '2024-09-30'"),
    "source_scope": (source_scope, f"{WITH} SELECT doc_id, source, lang FROM corpus WHERE (source, lang) IN (('src1', 'en'), ('src2', 'fr'), ('src3', 'de'))"),
    "quality_floor": (quality_floor, f"{WITH}, {RELEVANCE_SQL}, b AS (SELECT *, max(relevance) OVER (PARTITION BY source_kind) AS best FROM rel) SELECT doc_id, source_kind, relevance FROM b WHERE relevance >= least(best, greatest(0.3, 0.7 * best))"),
    "hybrid_sort": (hybrid_sort, f"{WITH}, {RELEVANCE_SQL}, m AS (SELECT min(effective_date) AS lo, max(effective_date) AS hi FROM rel) SELECT doc_id, round(0.68 * relevance + 0.32 * (CAST(effective_date - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE)), 6) AS rank_value FROM rel, m ORDER BY rank_value DESC, relative_path LIMIT 40"),
    "evidence_budget": (evidence_budget, f"{WITH}, {RELEVANCE_SQL}, best AS (SELECT * FROM rel ORDER BY relevance DESC, doc_id LIMIT 30), {CHUNKS_SQL.replace('SELECT corpus.*', 'SELECT corpus.doc_id, corpus.relevance').replace('FROM corpus,', 'FROM best corpus,')}, s AS (SELECT doc_id, ordinal, relevance, CAST(length(chunk_text) + len(regexp_extract_all(chunk_text, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS BIGINT) AS size FROM chunks), u AS (SELECT *, CAST(sum(size) OVER (ORDER BY relevance DESC, doc_id, ordinal) AS BIGINT) AS used FROM s) SELECT doc_id, ordinal, size, used FROM u WHERE used <= 24000"),
    "preceding_chunks": (preceding_chunks, f"{WITH_CHUNKS}, c AS (SELECT doc_id, ordinal, left(chunk_text, 1) AS h, length(chunk_text) AS n FROM chunks), w AS (SELECT *, lag(h, 1) OVER v = h AND lag(ordinal, 1) OVER v = ordinal - 1 AS a1, lag(h, 2) OVER v = h AND lag(ordinal, 2) OVER v = ordinal - 2 AS a2, lag(h, 3) OVER v = h AND lag(ordinal, 3) OVER v = ordinal - 3 AS a3, lag(n, 1) OVER v AS n1, lag(n, 2) OVER v AS n2, lag(n, 3) OVER v AS n3 FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY ordinal)) SELECT doc_id, ordinal, concat_ws(',', n1, CASE WHEN a2 THEN n2 END, CASE WHEN a2 AND a3 THEN n3 END) AS sizes FROM w WHERE a1"),
    "source_reconcile": (source_reconcile, f"{WITH}, b AS (SELECT source, max(doc_id) AS i FROM corpus WHERE doc_id % 5 <> 0 AND source <> 'src5' GROUP BY 1), a AS (SELECT source, max(doc_id) AS i FROM corpus WHERE source <> 'src3' AND doc_id % 7 <> 0 GROUP BY 1) SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.i IS NULL THEN 'added' WHEN a.i IS NULL THEN 'removed' WHEN a.i <> b.i THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a ON a.source = b.source"),
    "missing_deleted": (missing_deleted, f"{WITH} SELECT source, CAST(sum(CASE WHEN doc_id % 4 = 0 AND source IN ('src1', 'src2') THEN 1 ELSE 0 END) AS BIGINT) AS deleted, count(*) AS documents FROM corpus GROUP BY 1"),
    "incremental_upsert": (incremental_upsert, f"{WITH} SELECT CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS version, count(*) AS documents FROM corpus WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0 GROUP BY 1"),
    "semantic_neighbours": (semantic_neighbours, "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 5) AS similarity FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 80"),
    "chunk_lengths": (chunk_lengths, f"{WITH_CHUNKS} SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS chars, max(ordinal) AS last FROM chunks GROUP BY 1"),
    "sparse_headings": (sparse_headings, f"{WITH_CHUNKS} SELECT doc_id, left(chunk_text, 3) AS heading, min(ordinal) AS ordinal FROM chunks GROUP BY 1, 2"),
    "find_dates_texts": (find_dates_texts, None),
    "section_classify": (section_classify, _section_sql()),
    "family_key_titles": (family_key_titles, FAMILY_SQL),
    "normalized_titles": (normalized_titles, f"{WITH} SELECT doc_id, lower(regexp_replace(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g')) AS title FROM corpus"),
    "text_chunks": (text_chunks, PIECES_SQL),
}
