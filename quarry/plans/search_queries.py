"""Candidate generation: weighted term branches, scores by chunk, best chunks by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.candidates import canonical, concept_scores
from quarry.plans.corpus import CHUNKS_SQL, CORPUS_SQL, corpus, line_chunks

TERMS = ["the", "idiot", "und"]


def concept_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 documents for three weighted terms over the chunks of canonical documents."""
    docs = canonical(corpus(spark, sf_dir))
    chunks = line_chunks(docs, "relative_path", "effective_date")
    scored = concept_scores(chunks, TERMS)
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal")
    return (
        scored.withColumn("doc_score", F.max("score").over(Window.partitionBy("doc_id")))
        .withColumn("doc_rank", F.row_number().over(best)).where("doc_rank <= 1")
        .orderBy(F.desc(F.round("doc_score", 6)), F.desc("effective_date"), "relative_path").limit(20)
        .select("doc_id", "ordinal", F.round("score", 6).alias("score"), F.col("doc_rank").cast("long").alias("doc_rank"))
    )


CONCEPT_SQL = f"""WITH {CORPUS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY effective_date DESC, relative_path, doc_id) AS crn FROM corpus),
canon AS (SELECT * FROM ranked WHERE crn = 1), {CHUNKS_SQL.replace('FROM corpus,', 'FROM canon corpus,')},
post AS (SELECT DISTINCT doc_id, ordinal, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9_./:-]{{2,}}')) AS term FROM chunks),
hits AS (SELECT * FROM post WHERE term IN ('the', 'idiot', 'und')),
n AS (SELECT count(*) AS n FROM chunks), df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
w AS (SELECT term, ln(1 + (greatest(n, df) - df + 0.5) / (df + 0.5)) AS w FROM df, n), ws AS (SELECT sum(w) AS s FROM w),
sc AS (SELECT doc_id, ordinal, sum(w / s) AS score FROM hits JOIN w USING (term), ws GROUP BY 1, 2),
j AS (SELECT sc.*, effective_date, relative_path, max(score) OVER (PARTITION BY doc_id) AS doc_score,
  row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS doc_rank FROM sc JOIN canon USING (doc_id))
SELECT doc_id, ordinal, round(score, 6) AS score, doc_rank FROM j WHERE doc_rank <= 1
ORDER BY round(doc_score, 6) DESC, effective_date DESC, relative_path LIMIT 20"""

QUERIES = {"concept_topk": (concept_topk, CONCEPT_SQL)}
