"""What a question asks for: keywords, synonyms, concepts, anchors and named activities, worked out on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import regex

from quarry.functions.text import fold

# Groups of words that mean the same.
SYNONYMS = (
    ("轮盘", "转盘", "幸运轮盘", "抽奖轮盘", "roulette"),
    ("抽奖", "抽取", "奖池", "概率", "保底", "扭蛋"),
    ("签到", "登录奖励", "每日登录", "累签", "补签"),
    ("复用", "沿用", "套用", "模板", "通用版"),
    ("历史改动", "版本记录", "修改记录", "更新记录", "迭代记录", "变更记录"),
    ("配置", "配表", "字段", "参数", "数值"),
    ("流程", "步骤", "交互", "逻辑", "时序"),
    ("玩法", "规则", "机制"),
    ("奖励", "奖品", "掉落", "兑换", "产出"),
)
# Phrases of asking, which part keywords.
STOP_PHRASES = (
    "我需要", "我要", "我想", "想要", "需要", "帮我把", "帮我", "给我", "请问", "麻烦", "帮忙", "看一下", "看看", "看下",
    "查一下", "查下", "找一下", "找到", "找出", "查找", "查询", "搜索", "告诉我", "说明一下", "解释一下", "介绍一下", "整理一下", "总结一下",
    "列出来", "列一下", "列出", "有哪些", "有没有", "是多少", "是什么", "哪些", "哪个", "哪张", "哪里", "什么", "怎么样", "怎么",
    "怎样", "如何", "多少", "最近几期", "最新的", "最新", "最近", "新增", "新的", "一个", "一下", "这个", "那个", "这些",
    "那些", "里面的", "里面", "其中", "以及", "还有", "分别", "可以", "能否", "能不能", "应该", "的", "了", "吗",
    "呢", "吧", "把", "和", "与", "及", "表格", "逻辑",
)
# Nouns that part long fragments, beside the synonyms; words too general to search for; words before a name.
NOUNS = (
    "活动", "玩法", "策划", "版本", "道具", "精灵", "皮肤", "礼包", "商店", "任务", "剧情", "产出", "消耗", "设计", "内容",
)
GENERAL = {"id", "ids"}
LEADS = (
    "帮我", "给我", "我要", "我想", "想要", "需要", "找到", "找出", "查找", "查询", "看看", "最新", "最近", "复用", "沿用", "套用", "一个", "这个", "那个", "关于", "分析", "说明", "请", "的",
)
GENERIC_NAMES = {"活动", "玩法", "配置", "配表", "表格", "任务", "奖励", "版本", "最新", "最近"}
TABLE_INTENT = regex.compile("(?i)(配表|配置表|哪些表|表格|字段|参数|前端模块|后台模块)")
LATEST_INTENT = regex.compile(r"(?i)(最新|最近|(?<![a-z0-9_])latest(?![a-z0-9_]))")
NAMED = regex.compile(r"([\p{Han}·•・:_-]{2,24})[\s·•・:_-]*(\d{2,})")
NAMED_KEYWORD = regex.compile(r"^(\p{Han}{2,24})(\d{2,})$")
CLAUSES = regex.compile(r"[\s,，。！？、;；:：]+")

CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"


def _longest_first(words) -> str:
    return "|".join(regex.escape(w) for w in sorted(dict.fromkeys(words), key=len, reverse=True))


#: What lies between keywords: a phrase of asking, other characters, or the border of CJK and Latin letters.
_BREAKS = regex.compile(rf"{_longest_first(STOP_PHRASES)}|[^\p{{L}}\p{{N}}_./:-]+|(?<={CJK})(?=[a-z])|(?<=[a-z])(?={CJK})", regex.V1)
_VOCABULARY = regex.compile(f"({_longest_first([w for g in SYNONYMS for w in g if not w.isascii()] + list(NOUNS))})")


def distinct(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def segments(fragment: str) -> list[str]:
    """The fragment parted at known nouns, where no part is a single character."""
    parts = [p for p in _VOCABULARY.split(fragment) if p]
    return parts if all(len(p) > 1 for p in parts) else [fragment]


def keywords(query: str) -> list[str]:
    parts = [s.strip("_./:-") for f in _BREAKS.split(fold(query)) if f for s in segments(f)]
    return distinct(p for p in parts if len(p) > 1 and p not in GENERAL)


def fired_groups(query: str) -> list[tuple[str, ...]]:
    """Synonym groups of which the query holds a word; the first is the mandatory concept."""
    q = fold(query)
    return [g for g in SYNONYMS if any(w in q for w in g)]


def expanded_terms(query: str, synonyms: bool = True) -> list[str]:
    """The whole query, its clauses, its keywords and their synonyms."""
    q = fold(query)
    clauses = [c for c in CLAUSES.split(q) if len(c) > 1]
    return distinct([q, *clauses, *keywords(q), *(w for g in fired_groups(q) if synonyms for w in g)])


def lexical_terms(query: str, synonyms: bool = True) -> list[str]:
    found = keywords(query)
    return distinct([*found, *(w for g in fired_groups(query) if synonyms for w in g)]) if found else expanded_terms(query, synonyms)


def ordered_terms(terms) -> list[str]:
    """Distinct folded terms of two characters or more: words before numbers, longer before shorter."""
    return sorted(distinct(t for t in map(fold, terms) if len(t) > 1), key=lambda t: (t.isdecimal(), -len(t)))


@dataclass(frozen=True)
class Named:
    """An activity by its name and number."""

    entity: str
    number: str


@dataclass(frozen=True)
class Concept:
    primary: str
    alternates: tuple[str, ...] = ()
    named: Named | None = None
    weight: float = 0.0


@dataclass(frozen=True)
class QueryPlan:
    query: str
    concepts: tuple[Concept, ...]
    phrases: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()
    document_anchors: tuple[str, ...] = ()
    named: tuple[Named, ...] = ()
    latest: bool = False
    tables: bool = False
    #: Words of the first group of synonyms that the question names: one of them must be in a result.
    primary: tuple[str, ...] = ()
    terms: tuple[str, ...] = field(default=(), repr=False)


def named_groups(query: str) -> list[Named]:
    """Names with a number of two digits or more; words of asking before the name go, general names don't count."""
    out = []
    lead = regex.compile(rf"^(?:[\s·•・:_-]|{'|'.join(LEADS)})+")
    for name, number in NAMED.findall(query):
        entity = regex.sub(r"[^\p{L}\p{N}]", "", lead.sub("", fold(name)))
        if len(entity) > 1 and entity not in GENERIC_NAMES:
            out.append(Named(entity, fold(number)))
    return list(dict.fromkeys(out))


def weigh(plan: QueryPlan, weights: list[float]) -> QueryPlan:
    """plan with weights scaled to sum 1, or equal ones where none is above 0."""
    w = [max(0.0, x) for x in weights]
    total = math.fsum(w)
    scaled = [x / total for x in w] if total else [1 / len(w)] * len(w)
    return replace(plan, concepts=tuple(replace(c, weight=x) for c, x in zip(plan.concepts, scaled, strict=True)))


def understand(query: str, synonyms: bool = True) -> QueryPlan:
    """The plan of a question. Without keywords each expanded term is a concept. An empty question has no concepts."""
    q, words = fold(query), keywords(query)
    concepts = [Concept(t) for t in ordered_terms(expanded_terms(query, synonyms))] if not words else []
    for word in words:
        groups = [g for g in SYNONYMS if synonyms and any(w in word or word in w for w in g)]
        m = NAMED_KEYWORD.match(word)
        concepts.append(Concept(word, tuple(distinct(w for g in groups for w in g if w != word)), Named(m[1], m[2]) if m else None))
    phrases = distinct(p for p in [q, *CLAUSES.split(q)] if len(p) > 3 and p not in words) if words else []
    latest = bool(LATEST_INTENT.search(query))
    found = [a for a in regex.findall(r"(?i)[a-z0-9_./:-]{2,}", query) if fold(a) not in GENERAL and not (latest and fold(a) == "latest")]
    marked = [a for a in found if (regex.search("[A-Z]", a) and len(a) > 2) or regex.search(r"[\d_./:-]", a) or len(a) > 7]
    plan = QueryPlan(
        query, tuple(concepts), tuple(phrases), tuple(distinct(map(fold, found))), tuple(distinct(map(fold, marked))), tuple(named_groups(query)),
        latest, bool(TABLE_INTENT.search(query)), next(iter(fired_groups(query)), ()), tuple(ordered_terms(expanded_terms(query, synonyms))),
    )
    return weigh(plan, [1.0] * len(concepts)) if concepts else plan


def query_tokens(term: str) -> list[str]:
    """What an index looks up for a term: characters and pairs of Han runs, runs of at most eight, other words whole."""
    out: list[str] = []
    for han, word in regex.findall(r"(\p{Han}+)|([a-z0-9_./:-]{2,})", fold(term)):
        out += [*han, *(han[i : i + 2] for i in range(len(han) - 1)), *([han] if 1 < len(han) <= 8 else [])] if han else [word]
    return distinct(out)


def required_tokens(term: str) -> list[str]:
    """Index terms that must all be there for a term to match: pairs of Han characters, and words."""
    out: list[str] = []
    for han, word in regex.findall(r"(\p{Han}+)|([a-z0-9_./:-]{2,})", fold(term)):
        out += [han[i : i + 2] for i in range(len(han) - 1)] if han else [word]
    return distinct(out)
