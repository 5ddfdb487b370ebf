"""What counts as a declaration, by the parts that statements are made of."""

import itertools

import pytest

from quarry.functions import reruns as R
from quarry.functions.query import Named

NAME, GROUP = "云舟旅人777", Named("云舟", "777")


def declared(text):
    return R.Spelled(text).declared(NAME) is not None


def test_subjects_and_markers():
    for subject, link, marker in itertools.product(R.SUBJECTS, (*R.CONNECTORS, ""), R.MARKERS):
        assert declared(f"{subject}{link}{NAME}活动{marker}") and declared(f"{subject}{link}{marker}{NAME}活动，日期待定")
        assert not declared(f"{subject}不{link}{marker}{NAME}活动") and not declared(f"听说{link}{NAME}活动上线")


def test_beginnings():
    for mark, marker in itertools.product(("", "改了日期。", "备注；", "- ", "· ", "2. ", "# ", "（甲）", "行 5 | C="), R.MARKERS):
        assert declared(f"{mark}云舟·旅人 777 活动的{marker}，改日期")
        for noun in R.DOCUMENTS:
            assert not declared(f"{mark}{NAME}活动{marker}{noun}")
    assert not declared(f"备注：{NAME}活动返场") and not declared(f"远{NAME}活动返场") and not declared(f"{NAME}活动再次返场") and not declared(NAME)


def test_references_quotes_and_questions():
    for word in R.REFERENCES:
        assert not declared(f"{word}、{NAME}活动返场") and declared(f"{word}旧表。{NAME}活动返场")
    for a, b in (*R.QUOTES, ('"', '"')):
        assert not declared(f"旧文{a}开头。{NAME}活动返场{b}") and declared(f"旧文{a}开头{b}。{NAME}活动返场")
    assert not declared(f"{NAME}活动返场吗") and not declared(f"{NAME}活动返场？") and declared(f"{NAME}活动返场，日期改不改？")
    for tag in R.TAGS:
        assert not declared(f"{NAME}活动返场，{tag}？")


HEADS = {"reference": ["参考内容：", "1.参照内容：", "参考内容", "二、借鉴", "## 对标", "行 4 | A=参考内容： | D=备注"], "own": ["本期内容：", "1.本次内容：", "本期内容", "二、目的", "## 目的", "行 4 | A=本次内容： | D=备注", "改动："]}


@pytest.mark.parametrize("kind", HEADS)
def test_headings_above(kind):
    for head in HEADS[kind]:
        sheet = head.startswith("行")
        item = f"行 9 | B=·{NAME}活动返场" if sheet else f"·{NAME}活动返场"
        between = "行 6 | B=·夜港活动返场" if sheet else "·夜港活动返场"
        other = HEADS["own" if kind == "reference" else "reference"]
        for text in (f"{head}\n{item}", f"{head}\n{between}\n{item}", f"{other[5 if sheet else 0]}\n{between}\n{head}\n{item}"):
            assert declared(text) == (kind == "own"), text


def test_cells_beside():
    assert not declared(f"行 2 | A=参考内容： | B={NAME}活动返场") and declared(f"行 1 | A=参考内容： | C=x\n行 2 | A=改动： | B=·{NAME}活动返场")
    assert not declared(f"行 1 | A=参考内容：\n行 2 | A=名称： | B={NAME}活动返场") and not declared(f"| 参考内容： | | x |\n| | ·{NAME}活动返场 | |")
    assert not declared(f"参考内容：\n1. 夜港：\n说明\n2. {NAME}活动返场") and declared(f"1.参考内容：\n·夜港\n2.本期内容：\n·{NAME}活动返场")


def test_names():
    assert R.match("云舟777", GROUP) == (4.0, False) and R.match("破云舟·裂空777", GROUP) == (2.75, True) and R.match("云舟·旅人777", GROUP) == (2.75, False) and R.match("云舟", GROUP) == (0.0, False)
    assert R.spans("云舟·旅人777活动 破云舟777", GROUP) == ["云舟旅人777"] and R.names_standalone("新 云舟", "云舟") and not R.names_standalone("破云舟", "云舟")


def test_titles():
    for marker in R.MARKERS:
        assert R.title_declares(f"云舟旅人{marker}_1") and not R.title_declares(f"云舟旅人（非{marker}）") and not R.title_declares(f"不是{marker}") and not R.title_declares(f"不{marker}")
    assert not R.title_declares("云舟旅人") and R.title_declares("不是复用而是返场")


def test_headings():
    assert all(R.heads_references(f"{x}图") and R.heads_references(f"3.1{x}：") for x in R.REFERENCES)
    assert not any(map(R.heads_references, ("背景", "", "说明：参照旧例来做的这一段，带句读", "本期")))


def test_documents():
    names = [(NAME, "云舟旅人")]
    text = "云舟旅人777活动返场,改日期"
    assert R.rerun_of("云舟旅人限时返场", "概述", text, [], names) == (NAME, text)
    assert R.rerun_of("云舟旅人限时返场", "概述", text, ["参考活动："], names) == (NAME, None)
    assert R.rerun_of("云舟旅人周年庆", "概述", text, [], names) == (NAME, None) and R.rerun_of("云舟旅人限时返场", "参考活动", text, [], names) == (NAME, None)
    assert R.rerun_of("云舟新活动", "概述", text, [], names) is None and R.rerun_of("云舟旅人限时返场", "概述", "other", [], names) is None
