"""The engine's functions in SQL: register(spark) makes them temporary functions of the session.

normalize_text, classify_section, family_key, index_terms and find_dates are SQL functions, so that what they do is part
of the plan; only compatibility forms of Unicode go through Python, by Arrow. chunk_text is a table function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.chunking import pieces
from quarry.session import ship


def quoted(pattern: str) -> str:
    """A string literal; backslashes stay as they are."""
    return "r'" + pattern + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rules(column: str) -> str:
    return " ".join(f"WHEN {column} RLIKE {quoted(p)} THEN '{name}'" for name, p in T.SECTION_RULES)


def _family() -> str:
    spaced = "title"
    for p in T.FAMILY_DROPS:
        spaced = f"regexp_replace({spaced}, {quoted(p)}, ' ')"
    bare = f"trim(regexp_replace({spaced}, {quoted(chr(92) + 's+')}, ' '))"
    key = f"trim(regexp_replace({bare}, {quoted(T.FAMILY_ENDINGS)}, ''))"
    return f"CASE WHEN {key} = '' THEN title ELSE {key} END"


APART, JOINED = r"(?<!\d)20\d{2}[-/.年_](?:0?[1-9]|1[0-2])(?:[-/.月_](?:0?[1-9]|[12]\d|3[01])日?)?(?!\d)", r"(?<!\d)20\d{2}(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])(?!\d)"
_PARTS = f"split(rtrim(regexp_replace(m, {quoted('[-/.年月日_]')}, ' ')), ' ')"
FUNCTIONS = {
    "normalize_text(x STRING) RETURNS STRING": f"CASE WHEN octet_length(x) <> length(x) THEN quarry_fold(coalesce(x, '')) ELSE regexp_replace(lower(regexp_replace(coalesce(x, ''), {quoted(r'^[\t-\r\x1c-\x20]+|[\t-\r\x1c-\x20]+$')}, '')), {quoted(r'[\t\n\f\r ]+')}, ' ') END",
    "classify_section(heading STRING, body STRING) RETURNS STRING": f"CASE {_rules('heading')} {_rules('left(body, 240)')} ELSE 'other' END",
    "family_key(title STRING) RETURNS STRING": _family(),
    "index_terms(x STRING) RETURNS ARRAY<STRING>": f"""array_distinct(concat(
        CASE WHEN octet_length(x) <> length(x) AND x RLIKE {quoted(T.MAY_BE_HAN)} THEN regexp_extract_all(x, {quoted(T.HAN_PAIRS)}, 1) ELSE array() END,
        regexp_extract_all(lower(x), {quoted(T.WHOLE)}, 0), regexp_extract_all(lower(x), {quoted(T.PLAIN)}, 0),
        CASE WHEN contains(x, '/') THEN regexp_extract_all(lower(x), {quoted(T.UNSLASHED)}, 0) ELSE array() END))""",
    "find_dates(x STRING) RETURNS ARRAY<DATE>": f"""array_sort(array_distinct(filter(concat(
        transform(regexp_extract_all(x, {quoted(APART)}, 0), m -> try_cast(concat_ws('-', {_PARTS}[0], lpad({_PARTS}[1], 2, '0'), lpad(coalesce(get({_PARTS}, 2), '1'), 2, '0')) AS DATE)),
        transform(regexp_extract_all(x, {quoted(JOINED)}, 0), m -> try_cast(concat_ws('-', left(m, 4), substr(m, 5, 2), right(m, 2)) AS DATE))), d -> d IS NOT NULL)))""",
}


class ChunkText:
    """Rows (ordinal, piece) of a text: pieces of target characters that overlap, cut after the end of a sentence."""

    def eval(self, text: str, target: int, overlap: int):
        yield from enumerate(pieces(text, target, overlap))


def register(spark: SparkSession) -> None:
    ship(spark)

    def fold(x: pd.Series) -> pd.Series:
        return T.fold_series(x)

    spark.udf.register("quarry_fold", F.pandas_udf(fold, "string"))
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="ordinal: bigint, piece: string"))
