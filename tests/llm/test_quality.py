import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm.quality import judge, op7_quality_lines
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside), "base_failed": len(w) < 10 or 100 * len(inside) > 20 * len(w),
    }


def test_counts_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op7_quality_lines(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert {k: r[k] for k in brute("")} == brute(texts[r.doc_id])


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e a b c d e"), (5, long), (6, long), (6, long), (7, "x\x0by\x0cz\r\nq r"), (None, "one two three four five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("lang", F.lit(None).cast("string"))
    got = judge(df).collect()
    assert len(got) == len(rows) and "lang" in got[0].asDict()
    for r in got:
        assert {k: r[k] for k in brute("")} == brute(r.text)
        assert r.kept == (r.doc_id in (5, 6))
    assert judge(df.limit(0)).count() == 0


def test_lines(spark):
    prose = "The quick brown fox jumps over the lazy dog and runs into the deep green forest."
    nav = "Home | News | Sport | Weather | Contact"
    rows = [(1, f"{nav}\n{prose}"), (2, "\n".join([nav + str(i) for i in range(9)] + [prose]))]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == prose
    assert not got[2].kept and got[2].n_bad_lines == 9


def test_a_filter_on_kept_judges_each_line_once(spark):
    """Catalyst pushes the filter below the verdicts; a text of many lines must not cost their square."""
    text = "\n".join(f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}." for i in range(4000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string")
    assert [r.doc_id for r in judge(docs).where("kept").select("doc_id").collect()] == [1]


def test_long_lines_are_judged(spark):
    grant = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom it is given to do so, subject to the following conditions:'
    warranty = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT OR OTHERWISE, ARISING FROM THE SOFTWARE.'
    prose = "The quick brown fox jumps over the lazy dog and runs into the deep green forest. " * 30
    nav = "home" + " - a part of the site" * 20
    rows = [(1, grant), (2, warranty), (3, " ".join(["We use cookies on this site, see our privacy policy for what that means."] * 9)), (4, prose + "They accept cookies."), (5, nav), (6, "home" + " - a part" * 9000 + " of more than thirty characters without a bar"), (7, "We use cookies.")]
    assert all(len(t) > 300 for i, t in rows if i < 7)
    got = {r.doc_id: r.n_bad_lines for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0, 7: 1}
