"""Text functions as Columns, with Python only for Unicode compatibility forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Section types with their patterns, in order of priority.
SECTION_RULES = (
    ("version_history", "版本|修订|修改记录|更新记录|历史改动|变更|迭代|复用记录|revision|changelog"),
    ("animation_requirement", "动画|动效|特效需求|动画需求"),
    ("art_requirement", "美术|原画|资源需求|音效|ui需求"),
    ("statistics", "统计|埋点|数据上报|行为分析"),
    ("reward_value", "奖励数值|奖励配置|奖励和消耗|奖品价值|价值表"),
    ("panel_logic", "面板.*逻辑|界面逻辑|panel|页面逻辑"),
    ("flow", "流程|步骤|交互|逻辑|入口|界面流转|状态机|时序"),
    ("gameplay", "玩法|规则|奖励|概率|抽奖|轮盘|转盘|奖池|保底|次数|积分|活动"),
    ("config", "配置|配表|字段|参数|数值|id(?![a-z0-9_])|枚举|掉落|activity|module|dropunit"),
    ("overview", "概述|背景|目标|需求说明|简介|总览|summary|overview"),
)
# What a family key drops, in this order, and the generic endings. The borders of the third are those of ASCII
# words, which the JVM's \b are not: it counts Han characters as parts of words.
FAMILY_DROPS = (
    r"【\s*(复用|通用|历史|旧版|最终版?)\s*】",
    r"[（(]\s*(复用|通用|历史|旧版|最终版?)\s*[)）]",
    r"(?<![a-z0-9_])(v|ver|version)\s*\d+(\.\d+){0,3}(?![a-z0-9_])",
    r"20\d{2}[-_.年/]?\d{1,2}([-_.月/]?\d{1,2}日?)?",
    r"[_\-—]+",
)
FAMILY_ENDINGS = r"(策划案|需求文档|配置表|活动方案|说明文档)$"


ZERO_WIDTH, SPACES = re.compile("[\u200b\u200c\u200d\ufeff]"), re.compile("[\t\n\f\r ]+")


def fold(text: str | None) -> str:
    """NFKC, without zero-width characters, trimmed, lower case by code point, white space runs as one space."""
    t = ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", text or "")).strip()
    # the lower case of all others is one character, whatever is around
    t = "".join(c.lower() if len(c.lower()) == 1 else c for c in t) if "\u03a3" in t or "\u0130" in t else t.lower()
    return SPACES.sub(" ", t)


def fold_series(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def normalize_text(text: Column) -> Column:
    """fold() of a column. ASCII stays in the JVM: Python workers get nulls for it."""
    plain = F.coalesce(text, F.lit(""))
    other = not_ascii(plain)
    ascii_ = F.regexp_replace(F.lower(F.regexp_replace(plain, r"^[\t-\r\x1c-\x20]+|[\t-\r\x1c-\x20]+$", "")), r"[\t\n\f\r ]+", " ")
    return F.when(other, F.pandas_udf(fold_series, "string")(F.when(other, plain))).otherwise(ascii_)


def classify_section(heading: Column, text: Column) -> Column:
    """Section type of normalised heading and text: the first rule that the heading meets, else the text's beginning."""
    start = F.left(text, F.lit(240))
    rule = lambda c: F.coalesce(*[F.when(c.rlike(p), F.lit(n)) for n, p in SECTION_RULES])
    return F.coalesce(rule(heading), rule(start), F.lit("other"))


def section_of(headings: Sequence[str], text: str) -> str:
    """classify_section() of one block, in Python: its headings, joined, and its text, both as they are."""
    heading, start = fold(" / ".join(headings)), fold(text)[:240]
    return next((name for where in (heading, start) if where for name, p in SECTION_RULES if re.search(p, where)), "other")


def family_key(title: Column) -> Column:
    """struct(key, confidence) of a normalised title: what is left without tags, versions, dates and separators."""
    spaced = reduce(lambda c, p: F.regexp_replace(c, p, " "), FAMILY_DROPS, title)
    bare = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    key = F.trim(F.regexp_replace(bare, FAMILY_ENDINGS, ""))
    key = F.when(key == "", title).otherwise(key)
    removed = F.greatest(F.lit(0), F.length(title) - F.length(key))
    sure = F.greatest(F.lit(0.45), F.least(F.lit(0.95), 0.62 + removed / F.greatest(F.lit(20), F.length(title))))
    return F.struct(key.alias("key"), F.when(bare == title, F.lit(0.55)).otherwise(sure).alias("confidence"))


def find_dates(text: Column, today: Column | None = None) -> Column:
    """Sorted distinct valid dates, written apart (20yy-m[-d]) or together (20yymmdd); digits may not touch them.

    With today, only dates to a year and a day after it count.
    """
    apart = r"(?<!\d)20\d{2}[-/.年_](?:0?[1-9]|1[0-2])(?:[-/.月_](?:0?[1-9]|[12]\d|3[01])日?)?(?!\d)"
    joined = r"(?<!\d)20\d{2}(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])(?!\d)"

    def parsed(m: Column) -> Column:
        p = F.split(F.rtrim(F.regexp_replace(m, "[-/.年月日_]", " ")), " ")
        day = F.when(F.size(p) > 2, p[2]).otherwise("1")
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", p[0], F.lpad(p[1], 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")))

    a = F.transform(F.regexp_extract_all(text, F.lit(apart), 0), parsed)
    b = F.transform(F.regexp_extract_all(text, F.lit(joined), 0), lambda m: F.to_date(F.try_to_timestamp(m, F.lit("yyyyMMdd"))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(a, b), lambda d: d.isNotNull() if today is None else d.isNotNull() & (d <= F.date_add(today, 366)))))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where lengths differ or a norm is 0."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(double(a), double(b), lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(double(a), lambda x: x * x))) * F.sqrt(total(F.transform(double(b), lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(F.lit(0.0))


#: Index terms by pattern: pairs of adjacent Han characters, tokens, and the tokens' parts between slashes and between all marks.
HAN_PAIRS, WHOLE, UNSLASHED, PLAIN = r"(?=(\p{script=Han}{2}))", "[a-z0-9_./:-]{2,}", "[a-z0-9_.:-]{2,}", "[a-z0-9]{2,}"
#: Where scripts of East Asia begin: cheaper to look for than a script.
MAY_BE_HAN = r"[\x{2E80}-\x{10FFFF}]"
#: All but ASCII and unified Han, which has neither marks nor case.
MAY_BE_MARKED = r"[^\x00-\x7F\x{3400}-\x{9FFF}]"
NOT_ASCII = re.compile(r"[^\x00-\x7F]+")


def not_ascii(text: Column) -> Column:
    """Whether a text has other characters, from its lengths, without a pattern."""
    return F.octet_length(text) != F.length(text)


def lower_terms(text: Column) -> Column:
    """search_terms() of a text in lower case.

    A token's parts are runs of the text without the marks that part it: patterns find them, and no function is called a token.
    """
    none = F.array().cast("array<string>")
    han = F.when(not_ascii(text) & text.rlike(MAY_BE_HAN), F.regexp_extract_all(text, F.lit(HAN_PAIRS), 1)).otherwise(none)
    whole, unslashed, plain = (F.regexp_extract_all(text, F.lit(p), 0) for p in (WHOLE, UNSLASHED, PLAIN))
    return F.array_distinct(F.concat(han, whole, F.when(text.contains("/"), unslashed).otherwise(none), F.when(text.rlike("[_./:-]"), plain).otherwise(none)))


def search_terms(text: Column) -> Column:
    """Distinct index terms: pairs of adjacent Han characters, and tokens of letters, digits and _./:- with their parts."""
    return lower_terms(F.lower(text))


@lru_cache(1 << 16)
def bare(run: str) -> str:
    """Characters without the marks above and below them."""
    return "".join(c for c in unicodedata.normalize("NFD", run) if not unicodedata.combining(c))


def unmarked(s: pd.Series) -> pd.Series:
    """Without marks above and below letters, in lower case: how an index compares words."""
    # a run is looked up as one, since marks belong to the letter before them and all others stand for themselves
    one = lambda m: bare(m[0]) if len(m[0]) <= 2 else "".join(map(bare, m[0]))
    return s.map(lambda t: NOT_ASCII.sub(one, t).lower(), na_action="ignore")


def without_marks(text: Column) -> Column:
    other = not_ascii(text) & text.rlike(MAY_BE_MARKED)
    return F.when(other, F.pandas_udf(unmarked, "string")(F.when(other, text))).otherwise(F.lower(text))


def folded_terms(text: Column) -> Column:
    """search_terms() without marks on letters, as words are indexed: café and cafe are one."""
    return lower_terms(without_marks(text))
