"""Candidates from stored postings, each with SQL over the texts themselves; copies within a scope of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.query import distinct, understand
from quarry.operators import serving as V
from quarry.operators.candidates import canonical, first_in_scope, leaders
from quarry.plans.corpus import CHUNKS_SQL, CORPUS_SQL, corpus, line_chunks
from quarry.plans.evidence_queries import _terms_sql
from quarry.plans.retrieval_queries import HAN_LINES, HAN_QUESTION, HAN_TITLES
from quarry.session import shared_path

QUESTION, LIMIT, EXCERPTS = "idiot und the", 8, 3
TRIGRAM_TERMS = ("src1/en/1", "and", "idiot", "no")
SCOPES = {"all": None, "two": ("src2", "src3"), "one": ("src4",)}


def rows(docs: DataFrame, han: bool = False) -> DataFrame:
    """What is indexed of line chunks: title and path with the first line of a document."""
    c = line_chunks(docs, "title", "relative_path")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    title, body = F.lower("title"), F.col("chunk_text")
    if han:
        title, body = pick(HAN_TITLES, F.col("doc_id")), F.concat(pick(HAN_LINES, F.col("doc_id") + F.col("ordinal")), F.lit(" "), body)
    first = F.col("ordinal") == 0
    return c.select("doc_id", "ordinal", F.when(first, title).alias("title"), F.lit(None).cast("string").alias("heading"), F.when(first, F.col("relative_path")).alias("path"), body.alias("body"))


def narrow(docs: DataFrame) -> DataFrame:
    return canonical(docs).select("doc_id", "relative_path", "effective_date")


def shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "ordinal", F.round(F.col("rank"), 6).alias("rank"))


def index_search(s: SparkSession, d: str, question: str = QUESTION, han: bool = False) -> DataFrame:
    """Candidates of a question from an index of all chunks: the caps of a search for eight documents."""
    docs = corpus(s, d)
    index = V.build(rows(docs, han), shared_path(s, "serving"))
    found, _ = index.weighted(understand(question))
    return shown(index.concept_candidates(found, narrow(docs), *V.caps(LIMIT, EXCERPTS, False)))


def index_search_han(s, d):
    return index_search(s, d, HAN_QUESTION, True)


def index_lexical(s, d):
    """The best chunks by BM25 over fields."""
    docs = corpus(s, d)
    return shown(V.build(rows(docs), shared_path(s, "serving")).lexical_candidates(QUESTION.split(), narrow(docs), 320))


def index_trigrams(s, d):
    """Chunks whose title or path holds a term as it stands, by BM25."""
    docs = corpus(s, d)
    return shown(V.build_trigrams(rows(docs), shared_path(s, "trigrams")).candidates(TRIGRAM_TERMS, narrow(docs), 320))


def candidate_pool(s, d):
    """Both branches merged by least rank."""
    docs = corpus(s, d)
    own = narrow(docs)
    terms, heads = V.build(rows(docs), shared_path(s, "serving")), V.build_trigrams(rows(docs), shared_path(s, "trigrams"))
    found, _ = terms.weighted(understand(QUESTION))
    cap, per_document = V.caps(LIMIT, EXCERPTS, False)
    both = [terms.concept_candidates(found, own, cap, per_document), heads.candidates(TRIGRAM_TERMS, own, cap)]
    return shown(V.merged(None, both, own.withColumn("canonical_id", F.col("doc_id")), 200))


def canonical_in_scope(s, d):
    """Of equal contents, the one that counts where only some sources do."""
    docs = corpus(s, d).withColumn("source_id", F.col("source"))
    docs = docs.join(leaders(docs), "doc_id", "left")
    of = lambda name, ids: docs.where(first_in_scope(ids) if ids else F.size("outranked_by") == 0).select(F.lit(name).alias("scope"), "doc_id", "source")
    return reduce(DataFrame.unionByName, [of(k, v) for k, v in SCOPES.items()])


SCOPE_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS scope, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY effective_date DESC, relative_path, doc_id) AS r FROM corpus {f'WHERE source IN {v if len(v) > 1 else str(v).replace(chr(44), str())}' if v else ''}) WHERE r = 1"
    for k, v in SCOPES.items()
)

CANON_SQL = "canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY effective_date DESC, relative_path, doc_id) AS crn FROM corpus) WHERE crn = 1)"


def _post_sql(title: str = "lower(title)", body: str = "chunk_text", han: bool = False) -> str:
    """One row for each chunk, field and term: title 1, path 4, text 8."""
    pairs = lambda c: f"unnest(list_distinct(flatten(list_transform(regexp_extract_all({c}, '[\\x{{4E00}}-\\x{{9FFF}}]{{2,}}'), lambda r: list_transform(generate_series(1, length(r) - 1), lambda i: substr(r, CAST(i AS INTEGER), 2))))))"
    one = lambda bit, c, where: " UNION ALL ".join(f"SELECT doc_id, ordinal, {bit} AS bit, {f(c)} AS term FROM chunks WHERE {where}" for f in ([_terms_sql, pairs] if han else [_terms_sql]))
    return f"post AS ({one(1, title, 'ordinal = 0')} UNION ALL {one(4, 'relative_path', 'ordinal = 0')} UNION ALL {one(8, body, 'TRUE')}), n AS (SELECT count(*) AS n FROM chunks)"


def _matches_sql(tokens: list[str]) -> str:
    quoted = ", ".join(f"'{t}'" for t in tokens)
    return f"m AS (SELECT doc_id, ordinal, {', '.join(f"coalesce(bit_or(bit) FILTER (term = '{t}'), 0) AS m{i}" for i, t in enumerate(tokens))} FROM post WHERE term IN ({quoted}) GROUP BY 1, 2)"


def _concept_sql(question: str, **how) -> str:
    found = [b for pair in V.branches(understand(question)) for b in pair]
    tokens = distinct(t for b in found for t in b.tokens)
    at = {t: i for i, t in enumerate(tokens)}
    holds = lambda b, bits: "(" + " OR ".join("(" + " AND ".join(f"m{at[t]} & {bits} <> 0" for t in g) + ")" for g in b.groups) + ")"
    k = range(len(found))
    df = ", ".join(f"CAST(count(*) FILTER ({holds(b, 15)}) AS DOUBLE) AS d{i}" for i, b in enumerate(found))
    weights = ", ".join(f"CASE WHEN d{i} > 0 THEN {b.factor} * ln(1 + (greatest(n, d{i}) - d{i} + 0.5) / (d{i} + 0.5)) ELSE 0 END AS w{i}" for i, b in enumerate(found))
    score = " + ".join(f"w{i} * (CAST({holds(found[i], 15)} AS INT) + CAST({holds(found[i], 7)} AS INT))" for i in k)
    cap, each = V.caps(LIMIT, EXCERPTS, False)
    return f"""WITH {CORPUS_SQL}, {CHUNKS_SQL}, {CANON_SQL}, {_post_sql(**how)}, {_matches_sql(tokens)}, f AS (SELECT {df} FROM m), w AS (SELECT {weights} FROM f, n),
sc AS (SELECT doc_id, ordinal, round({score}, 9) AS score FROM m, w), j AS (SELECT sc.*, relative_path, effective_date, max(score) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS r FROM sc JOIN canon USING (doc_id) WHERE score > 0),
cand AS (SELECT doc_id, ordinal, -score AS rank FROM j WHERE r <= {each} ORDER BY best DESC, j.effective_date DESC, relative_path, doc_id, score DESC, ordinal LIMIT {cap})"""


#: Saturation 1.2, length 0.75, weights of fields 8, 6, 5 and 1.
def _bm25(hits: str, size: str, df: str) -> str:
    weight = f"greatest(1e-6, ln((n - {df} + 0.5) / ({df} + 0.5)))"
    return f"CASE WHEN {hits} > 0 THEN {weight} * {hits} * 2.2 / ({hits} + 1.2 * (0.25 + 0.75 * {size} / average)) ELSE 0 END"


def _lexical_sql() -> str:
    tokens = QUESTION.split()
    hits = lambda i: f"(8.0 * CAST(m{i} & 1 <> 0 AS INT) + 5.0 * CAST(m{i} & 4 <> 0 AS INT) + 1.0 * CAST(m{i} & 8 <> 0 AS INT))"
    df = ", ".join(f"CAST(count(*) FILTER (m{i} <> 0) AS DOUBLE) AS d{i}" for i in range(len(tokens)))
    score = " + ".join(_bm25(hits(i), "size", f"d{i}") for i in range(len(tokens)))
    return f"""WITH {CORPUS_SQL}, {CHUNKS_SQL}, {CANON_SQL}, {_post_sql()}, {_matches_sql(tokens)}, f AS (SELECT {df} FROM m), z AS (SELECT doc_id, ordinal, CAST(count(*) AS DOUBLE) AS size FROM post GROUP BY 1, 2),
a AS (SELECT sum(size) / max(n) AS average FROM z, n), sc AS (SELECT doc_id, ordinal, round({score}, 9) AS score FROM m JOIN z USING (doc_id, ordinal), f, n, a)
SELECT doc_id, ordinal, round(-score, 6) AS rank FROM sc JOIN canon USING (doc_id) ORDER BY score DESC, canon.effective_date DESC, relative_path, doc_id, ordinal LIMIT 320"""


def _trigram_sql() -> str:
    words = [t for t in TRIGRAM_TERMS if len(t) > 2]
    count = lambda w, c: f"(length({c}) - length(replace({c}, '{w}', ''))) / {len(w)}"
    hits = ", ".join(f"8.0 * {count(w, 'title')} + 5.0 * {count(w, 'relative_path')} AS h{i}" for i, w in enumerate(words))
    df = ", ".join(f"CAST(count(*) FILTER (h{i} > 0) AS DOUBLE) AS d{i}" for i in range(len(words)))
    score = " + ".join(_bm25(f"h{i}", "size", f"d{i}") for i in range(len(words)))
    return f"""hd AS (SELECT doc_id, ordinal, relative_path, lower(title) AS title FROM chunks WHERE ordinal = 0), hh AS (SELECT *, CAST(greatest(0, length(title) - 2) + greatest(0, length(relative_path) - 2) AS DOUBLE) AS size, {hits} FROM hd),
tf AS (SELECT {df}, CAST(count(*) AS DOUBLE) AS n, sum(size) / count(*) AS average FROM hh), ts AS (SELECT hh.doc_id, ordinal, hh.relative_path, round({score}, 9) AS score FROM hh, tf),
tri AS (SELECT doc_id, ordinal, -score AS rank FROM ts JOIN canon USING (doc_id) WHERE score > 0 ORDER BY score DESC, canon.effective_date DESC, canon.relative_path, doc_id, ordinal LIMIT 320)"""


HAN = {"title": f"[{', '.join(repr(x) for x in HAN_TITLES)}][doc_id % {len(HAN_TITLES)} + 1]", "body": f"[{', '.join(repr(x) for x in HAN_LINES)}][(doc_id + ordinal) % {len(HAN_LINES)} + 1] || ' ' || chunk_text", "han": True}
OUT = "SELECT doc_id, ordinal, round(rank, 6) AS rank"

QUERIES = {
    "index_search": (index_search, f"{_concept_sql(QUESTION)} {OUT} FROM cand"),
    "index_search_han": (index_search_han, f"{_concept_sql(HAN_QUESTION, **HAN)} {OUT} FROM cand"),
    "index_lexical": (index_lexical, _lexical_sql()),
    "index_trigrams": (index_trigrams, f"WITH {CORPUS_SQL}, {CHUNKS_SQL}, {CANON_SQL}, {_trigram_sql()} {OUT} FROM tri"),
    "candidate_pool": (candidate_pool, f"{_concept_sql(QUESTION)}, {_trigram_sql()}, u AS (SELECT doc_id, ordinal, min(rank) AS rank FROM (SELECT * FROM cand UNION ALL SELECT * FROM tri) GROUP BY 1, 2) SELECT u.doc_id, ordinal, round(u.rank, 6) AS rank FROM u JOIN canon USING (doc_id) ORDER BY u.rank, canon.effective_date DESC, relative_path, u.doc_id, ordinal LIMIT 200"),
    "canonical_in_scope": (canonical_in_scope, f"WITH {CORPUS_SQL} {SCOPE_SQL}"),
}
