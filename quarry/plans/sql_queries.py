"""The engine's functions as SQL uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.corpus import CORPUS_SQL, corpus
from quarry.plans.index_queries import FAMILY_SQL, PIECES_SQL
from quarry.sql import register


def sql_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles folded, the keys of their families, and the number of index terms of the whole texts."""
    register(s)
    return s.sql("SELECT doc_id, normalize_text(title) AS title, family_key(normalize_text(title)) AS key, CAST(size(index_terms(normalize_text(text))) AS BIGINT) AS terms FROM {docs}", docs=corpus(s, d))


def sql_chunks(s, d):
    """Documents in overlapping pieces, by the table function."""
    register(s)
    return s.sql("SELECT doc_id, ordinal, CAST(length(piece) AS BIGINT) AS chars FROM {docs}, LATERAL chunk_text(text, 2000, 100)", docs=corpus(s, d))


TERMS_SQL = """SELECT doc_id, CAST(len(list_distinct(list_concat(w, flatten(list_transform(w, lambda x: list_filter(string_split_regex(x, '[_./:-]+') || string_split(x, '/'), lambda y: length(y) > 1)))))) AS BIGINT) AS terms
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_./:-]{2,}') AS w FROM corpus)"""

QUERIES = {
    "sql_titles": (sql_titles, f"WITH {CORPUS_SQL} SELECT doc_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title, key, terms FROM corpus JOIN ({FAMILY_SQL}) USING (doc_id) JOIN ({TERMS_SQL}) USING (doc_id)"),
    "sql_chunks": (sql_chunks, PIECES_SQL),
}
