import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.chunking import pieces


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_fold():
    assert T.fold("ＡＢＣ​  奖励\n逻辑 ") == "abc 奖励 逻辑"
    assert T.fold(None) == "" and T.fold("café") == unicodedata.normalize("NFKC", "café")


@pytest.mark.parametrize("text, dates", [("2026.01.02_2026.03.04 / 20260805_20260901 / 20260805", ["2026-01-02", "2026-03-04", "2026-08-05", "2026-09-01"]), ("20260100 20260231", []), ("2026-02-30", []), ("12026-01-02", [])])
def test_dates(spark, text, dates):
    assert [str(x) for x in one(spark, text, T.find_dates)] == dates


def test_terms(spark):
    got = one(spark, "POOL_001_ABC 配置表 root/file.xlsx D1:D8", T.search_terms)
    assert {"pool_001_abc", "pool", "001", "abc", "配置", "置表", "root/file.xlsx", "root", "file.xlsx", "xlsx", "d1:d8", "d1", "d8"} <= set(got) and len(got) == len(set(got))


def test_family(spark):
    key = lambda t: tuple(one(spark, T.fold(t), T.family_key))
    assert key("plain title") == ("plain title", 0.55)
    k, sure = key("【复用】夜港活动 v1.2 2026-01-02")
    assert k == "夜港活动" and 0.62 < sure <= 0.95


def test_sections(spark):
    df = spark.createDataFrame([("奖励数值", ""), ("", "玩法说明"), ("x", "y"), ("", "idle"), ("", "row id here")], "h string, t string")
    assert [r[0] for r in df.select(T.classify_section(F.col("h"), F.col("t"))).collect()] == ["reward_value", "gameplay", "other", "other", "config"]


def test_lengths(spark):
    assert one(spark, "a🙂é", T.utf16_length) == 4


def test_pieces():
    assert pieces("  ") == [] and pieces(None) == [] and pieces(" x ") == ["x"]
    text = "".join(f"Sentence {i}. 好。" for i in range(900))
    out = pieces(text, 500, 50)
    assert all(len(p) <= 500 for p in out) and all(p.endswith("。") for p in out[:-1])
    at = 0
    for p in out:  # each piece begins within the overlap of the one before
        found = text.index(p, max(0, at - 60))
        assert found <= at
        at = found + len(p)
    assert at == len(text)


def test_terms_and_folding_are_those_of_each_token(spark):
    """Patterns over the whole text find what parting each token found; folding by runs gives what folding by characters did."""
    r = random.Random(3)
    texts = ["".join(r.choice("ab1_./:-\\ ,éßΣ奖励签𠀀") for _ in range(r.randint(0, 30))) for _ in range(300)]

    def parted(t):
        t, out = t.lower(), set()
        for w in re.findall("[a-z0-9_./:-]{2,}", t):
            out |= {w, *(p for p in w.split("/") if len(p) > 1), *(p for p in re.split("[_./:-]+", w) if len(p) > 1)}
        return out | {x[i : i + 2] for x in re.findall("[奖励签𠀀]{2,}", t) for i in range(len(x) - 1)}

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plan = df.select(T.search_terms(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    for row in df.select("t", T.search_terms(F.col("t")).alias("x"), T.folded_terms(F.col("t")).alias("y")).collect():
        assert set(row.x) == parted(row.t) and len(row.x) == len(set(row.x)), row.t
        assert set(row.y) == parted(row.t.replace("é", "e")), row.t
    assert [T.fold(t) for t in ("ΑΣ İx", " Ａ​\t\nB\x0b c ")] == ["ασ İx", "a b\x0b c"]
    marks = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).lower()
    assert list(T.unmarked(pd.Series(texts + ["á̧ΑΣ가"]))) == [marks(t) for t in [*texts, "á̧ΑΣ가"]]
