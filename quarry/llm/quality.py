"""Line-first quality rules, with DataFrame operations alone.

Punctuation, navigation and boilerplate rules judge every line, at any length; lines that fail go, and a document that
loses too much of its text goes too. Base rules on whole documents stand before them. A line is boilerplate if it has a
phrase for each PHRASE_CHARS characters or part of that (so one is enough in a short line), or if the sentences with a
phrase are PHRASE_SHARE of its characters.

Cases: a null or empty text has no words, fails the base rule and isn't kept. A line without words neither counts nor
fails. Equal rows get equal results. An empty table gives an empty result. Columns of the input stay unless they clash
with those of the result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.native import SPACE, WORD, let

MOST_LOST = 0.5
PHRASE_CHARS, PHRASE_SHARE = 300, 0.2
SYMBOLS = "#*$%&|<>"
#: Boilerplate phrases, matched in lower case.
BOILERPLATE = (
    r"all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|we use cookies|"
    r"enable javascript|subscribe to our newsletter|sign up for our|click here to|lorem ipsum|"
    r"licensed under the|permission is hereby granted|without warranty of any kind"
)
#: What a boilerplate phrase holds at least: cheap to look for in long lines.
NEEDLES = ("all rights reserved", "terms of ", "privacy policy", "cookie", "enable javascript", "subscribe to our", "sign up for our", "click here to", "lorem ipsum", "licensed under the", "permission is hereby", "without warranty of")
SENTENCE_END = r"(?<=[.!?;])\s+"
#: A navigation word, then parts of at most 30 characters between bars; possessive, so that long lines cost their length.
NAVIGATION = r"^(?:home|menu|login|log in|sign in|sign up|next|previous|prev|back|top|search|share|print|skip to content|read more|contact|about|sitemap)(?: ?+[|>»/-] ?+[^|>»/\-\n\r\x{85}\x{2028}\x{2029}]{0,30}+)*+$"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "lost_share", "n_lines", "n_bad_lines")


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more, from the hashes of all windows."""

    def covered(at: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(5), lambda s, k: s + F.least(F.lit(5), at[k] - at[k - 1]))
        return F.when(F.size(at) < 2, F.lit(0)).otherwise(steps)

    def positions(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"]))
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda k: s[k]["i"]))

    def count(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(pairs, positions), covered))

    def of(hashes: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*[hashes[i + k] for k in range(5)])), count)

    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of)).cast("long")


def line_fails(line: Column) -> Column:
    """True where a line with words breaks a punctuation, navigation or boilerplate rule."""
    solid = F.length(F.translate(line, SPACE, ""))
    symbols = solid - F.length(F.translate(F.translate(line, SPACE, ""), SYMBOLS + "{}[]^~=_\\", ""))
    bars = F.length(line) - F.length(F.translate(line, "|»›•", ""))
    shouts = F.length(line) - F.length(F.regexp_replace(line, "[!?]{2,}", ""))
    punctuation = (symbols * 10 > solid) | (shouts * 20 > solid) | (~line.rlike(r"[\p{L}\p{N}]"))
    navigation = (bars >= 3) | F.lower(F.trim(line)).rlike(NAVIGATION)
    return punctuation | navigation | let(F.lower(line), boilerplate)


def boilerplate(low: Column) -> Column:
    """True where phrases, or the sentences that hold them, are a good part of a line in lower case."""
    maybe = reduce(or_, [low.contains(x) for x in NEEDLES])
    dense = F.size(F.regexp_extract_all(low, F.lit(BOILERPLATE), 0)) * PHRASE_CHARS >= F.length(low)
    hit = F.filter(F.split(low, SENTENCE_END), lambda x: x.rlike(BOILERPLATE))
    held = F.aggregate(hit, F.lit(0), lambda n, x: n + F.length(x))
    return F.when(maybe & low.rlike(BOILERPLATE), dense | (held >= F.length(low) * PHRASE_SHARE)).otherwise(False)


def judge(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """docs with the base counts, base_failed, the text of the lines that pass, lost_share and kept."""
    d = docs.drop(*RESULT).withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    d = d.withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), 0))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    # a line and its verdict lie side by side: a filter on kept that Catalyst pushes below still judges each line once
    d = d.withColumn("_judged", F.transform("_lines", lambda x: F.struct(x.alias("line"), line_fails(x).alias("bad"))))
    d = d.withColumn("_base", let(F.col("_words"), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("again"))))
    joined = lambda j: F.array_join(F.transform(j, lambda x: x["line"]), "\n")
    good = lambda j: joined(F.filter(j, lambda x: ~x["bad"]))
    d = d.select(
        "*",
        F.col("_base.n").alias("n_words"),
        F.length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_base.again").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_judged", lambda x: x["bad"])).cast("long").alias("n_bad_lines"),
        good(F.col("_judged")).alias("clean_text"),
        let(F.col("_judged"), lambda j: F.when(F.size(j) > 0, 1.0 - F.length(good(j)) / F.length(joined(j))).otherwise(1.0)).alias("lost_share"),
        let(F.col("_base"), lambda c: (c["n"] < 10) | (100 * c["again"] > 20 * c["n"])).alias("base_failed"),
    )
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= most_lost))
    return d.drop("_t", "_words", "_lines", "_judged", "_base")



def op7_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", F.round("lost_share", 6).alias("lost_share"))
