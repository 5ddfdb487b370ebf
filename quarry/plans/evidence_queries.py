"""Excerpts, citations, stored postings, write outcomes, dates and HTML blocks, with SQL where it can express them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import citations as C
from quarry.operators import indexing as I
from quarry.plans.corpus import CHUNKS_SQL, CORPUS_SQL, corpus, line_chunks, table
from quarry.session import ship
from quarry.sources.formats import html_blocks as blocks_of_html

WITH_CHUNKS = f"WITH {CORPUS_SQL}, {CHUNKS_SQL}"
TERM, LIMIT = "the", 60


def excerpt_slices(s, d) -> DataFrame:
    """Every line about a word, in at most 60 characters."""
    ship(s)

    def cut(t: pd.Series) -> pd.Series:
        return t.map(lambda x: C.around(x, [TERM], LIMIT)[0])

    return line_chunks(corpus(s, d)).select("doc_id", "ordinal", F.pandas_udf(cut, "string")(F.col("chunk_text")).alias("shown"))


#: In units of UTF-16, which are characters but for those above U+FFFF: these stand as two, and no slice parts them.
EXCERPT_SQL = f"""{WITH_CHUNKS}, p AS (SELECT doc_id, ordinal, chunk_text AS t, length(chunk_text) AS n, strpos(lower(chunk_text), '{TERM}') - 1 AS p FROM chunks),
s AS (SELECT *, CASE WHEN p < 0 THEN 0 ELSE greatest(0, least(n - {LIMIT - 2}, p - {int((LIMIT - 2) * 0.3)})) END AS a FROM p),
e AS (SELECT *, CASE WHEN p < 0 THEN {LIMIT - 1} ELSE least(n, a + {LIMIT} - CASE WHEN a > 0 THEN 1 ELSE 0 END - CASE WHEN a + {LIMIT - 2} < n THEN 1 ELSE 0 END) END AS e FROM s)
SELECT doc_id, ordinal, CASE WHEN n <= {LIMIT} THEN t ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || regexp_replace(substr(t, a + 1, e - a), '^\\s+|\\s+$', '', 'g') || CASE WHEN e < n THEN '…' ELSE '' END END AS shown FROM e"""


def citation_round_trip(s, d) -> DataFrame:
    """Every line cited: what its citation alone gives back from the line, and whether it notices another line's text."""
    ship(s)

    def check(doc: pd.Series, n: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for i, k, x in zip(doc, n, t, strict=True):
            chunk = {"text": x, "locator": f"行 {k}", "content_hash": I.sha(x)}
            e = C.excerpt(x, chunk["locator"], [TERM], LIMIT)
            cite = C.identifier(f"chunk_{chunk['content_hash'][:16]}_{i & 0xFFFFFFFF:08x}_{k}", chunk["locator"], chunk["content_hash"], e)
            try:
                C.recall(C.parse(cite), chunk | {"content_hash": I.sha(x + "!")}, cite)
                noticed = False
            except C.BadCitation:
                noticed = True
            rows.append((C.recall(C.parse(cite), chunk, cite).text, noticed))
        return pd.DataFrame(rows, columns=["shown", "noticed"])

    c = line_chunks(corpus(s, d))
    return c.select("doc_id", "ordinal", F.pandas_udf(check, "struct<shown:string,noticed:boolean>")("doc_id", "ordinal", "chunk_text").alias("r")).select("doc_id", "ordinal", "r.shown", "r.noticed")


def posting_build(s, d) -> DataFrame:
    """Index terms by field: how many chunks have each. Title and path belong to a document's first chunk."""
    docs = corpus(s, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    chunks = line_chunks(docs).select("doc_id", F.concat_ws("_", "doc_id", "ordinal").alias("chunk_id"), "ordinal", F.array().cast("array<string>").alias("headings"), F.col("chunk_text").alias("text"))
    return I.postings(docs, chunks).groupBy("field", "term").agg(F.count("*").alias("chunks"))


def _terms_sql(c: str) -> str:
    whole = f"regexp_extract_all(lower(strip_accents({c})), '[a-z0-9_./:-]{{2,}}')"
    parts = lambda p: f"list_filter(flatten(list_transform({whole}, lambda x: string_split_regex(x, '{p}'))), lambda x: length(x) > 1)"
    return f"unnest(list_distinct(list_concat(list_concat({whole}, {parts('[/]')}), {parts('[_./:-]+')})))"


POSTING_SQL = f"""{WITH_CHUNKS}, b AS (SELECT 'body' AS field, {_terms_sql('chunk_text')} AS term FROM chunks),
t AS (SELECT 'title' AS field, {_terms_sql('title')} AS term FROM chunks WHERE ordinal = 0), p AS (SELECT 'path' AS field, {_terms_sql('relative_path')} AS term FROM chunks WHERE ordinal = 0)
SELECT field, term, count(*) AS chunks FROM (SELECT * FROM b UNION ALL SELECT * FROM t UNION ALL SELECT * FROM p) GROUP BY 1, 2"""


def upsert_outcomes(s, d) -> DataFrame:
    """Documents after a run in which some files were unchanged, some unreadable and some new."""
    c = corpus(s, d).withColumn("id", F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("string"))
    empty = {"date_source": "'path'", "needs_ocr": "false", "warnings": "array()", "chunk_count": "1L", "extension": "'.txt'"}
    base = c.selectExpr("id", "doc_id", "source AS source_id", "source_kind", "relative_path AS path", "relative_path", "title", "n_chars AS size", "TIMESTAMP'2024-01-01' AS modified", "CAST(effective_date AS TIMESTAMP) AS effective_date", "content_hash", *[f"{v} AS {k}" for k, v in empty.items()])
    old = base.where("id % 3 <> 0").selectExpr("*", "'k' AS family_key", "0.5D AS family_confidence", "id % 7 = 0 AS stale", "false AS deleted", "CAST(NULL AS STRING) AS extraction_error", "'before' AS generation", "CAST(NULL AS STRING) AS canonical_id").drop("id")
    outcome = F.when(F.col("id") % 4 == 0, "unchanged").when(F.col("id") % 4 == 1, "issue").otherwise("draft")
    results = base.where("id % 5 <> 0").withColumn("outcome", outcome).withColumn("message", F.lit("bad")).withColumn("size", F.col("size") + 1).drop("id")
    after = I.outcomes(old, results, "now")
    return after.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "stale", "extraction_error", "generation")


UPSERT_SQL = f"""WITH {CORPUS_SQL}, o AS (SELECT *, doc_id % 3 <> 0 AS known, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 4 = 0 THEN 'unchanged' WHEN doc_id % 4 = 1 THEN 'issue' ELSE 'draft' END AS outcome FROM corpus)
SELECT doc_id, CASE WHEN outcome = 'none' THEN n_chars ELSE n_chars + 1 END AS size, CASE outcome WHEN 'none' THEN doc_id % 7 = 0 WHEN 'issue' THEN TRUE ELSE FALSE END AS stale, CASE WHEN outcome = 'issue' THEN 'bad' END AS extraction_error, CASE WHEN outcome = 'none' THEN 'before' ELSE 'now' END AS generation
FROM o WHERE known OR outcome = 'draft'"""

TODAY = dt.date(2026, 9, 28)


def find_dates_made(s, d) -> DataFrame:
    """Dates in names made from ids: written apart, without day, together, of days that aren't, out of range, between digits."""
    y, m, k = F.format_string("%02d", F.col("doc_id") % 40), F.format_string("%02d", F.col("doc_id") % 14), F.format_string("%02d", F.col("doc_id") % 33)
    sep = F.element_at(F.array(*map(F.lit, "-/._")), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("v20"), y, sep, m, sep, k, F.lit(" 20"), y, m, k, F.lit("_120"), y, m, k, F.lit(" 20"), y, F.lit("年"), m, F.lit("月"))
    return corpus(s, d).select("doc_id", F.array_join(F.transform(T.find_dates(name, F.lit(TODAY)), lambda x: x.cast("string")), ",").alias("dates"))


DATES_SQL = f"""WITH p AS (SELECT doc_id, 2000 + doc_id % 40 AS y, doc_id % 14 AS m, doc_id % 33 AS k FROM documents),
c AS (SELECT doc_id, m BETWEEN 1 AND 12 AS month, try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y, m, k) AS DATE) AS whole, CASE WHEN m BETWEEN 1 AND 12 THEN make_date(y, m, 1) END AS first, k BETWEEN 1 AND 31 AS daylike FROM p),
l AS (SELECT doc_id, list_distinct(list_filter([CASE WHEN month AND daylike THEN whole END, first], lambda x: x IS NOT NULL AND x <= DATE '{TODAY}' + 366)) AS ds FROM c)
SELECT doc_id, array_to_string(list_transform(list_sort(ds), lambda x: CAST(x AS VARCHAR)), ',') AS dates FROM l"""


#: Pages of a task, which Spark hands to Python at once, and of an answer from there.
TASK_PAGES, PAGES = 2_000, 64


def cut_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks of rows (page_id, html), a few pages at a time."""
    for batch in batches:
        text = [pa.field(c, pa.string()) for c in ("text", "heading", "section", "locator")]
        schema = pa.schema([batch.schema.field(0).with_name("page_id"), pa.field("ordinal", pa.int64()), *text])
        for a in range(0, batch.num_rows, PAGES):
            some = batch.slice(a, PAGES)
            out = [
                (page, k, b.text, " / ".join(b.headings), b.section, b.locator)
                for page, html in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) for k, b in enumerate(blocks_of_html(html or ""))
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def html_blocks(s, d) -> DataFrame:
    """Blocks of every page with the heading above them."""
    ship(s)
    pages = table(s, d, "pages").select("page_id", "html")
    pages = pages.repartition(max(8, s.sparkContext.defaultParallelism, -(-pages.count() // TASK_PAGES)))
    return pages.mapInArrow(cut_pages, f"page_id {pages.schema['page_id'].dataType.simpleString()}, ordinal long, text string, heading string, section string, locator string")


QUERIES = {
    "excerpt_slices": (excerpt_slices, EXCERPT_SQL),
    "citation_round_trip": (citation_round_trip, f"SELECT doc_id, ordinal, shown, noticed FROM ({EXCERPT_SQL}) JOIN ({WITH_CHUNKS} SELECT doc_id, ordinal, length(chunk_text) > {LIMIT} AS noticed FROM chunks) USING (doc_id, ordinal)"),
    "posting_build": (posting_build, POSTING_SQL),
    "upsert_outcomes": (upsert_outcomes, UPSERT_SQL),
    "find_dates_made": (find_dates_made, DATES_SQL),
    "html_blocks": (html_blocks, None),
}
