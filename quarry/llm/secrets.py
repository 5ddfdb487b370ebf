"""Secret scans, with DataFrame operations alone: patterns, and character Markov models for what patterns miss.

Two first-order models over ASCII characters, one of random strings and one of ordinary identifiers, are counted from
labelled samples. Tokens have 12 characters or more, as in the assignment pattern. A token is a secret where the summed
log-likelihood ratio exceeds THRESHOLD for each step, and for FULL steps at least: short tokens need more evidence a
character. Spans of the patterns stay; of a secret that they cover in part, what they leave is added in pieces that look
random with the characters beside them. Positions are code points, ends exclusive.

Cases: a null text is empty and has no spans. Equal rows get equal results. Ties in start are ordered by kind. An empty
table gives an empty result; the models then know random strings only by rule and identifiers by the built-in sample.
Columns of the input stay unless they clash with those of the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.native import let, running, uniform

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
KINDS = ("assign", "access", "hex", "markov")
#: Mean log-likelihood ratio of a character (nats) from which a token counts as random.
THRESHOLD = 0.6
#: Steps from one character to the next for which a shorter token must make up.
FULL = 19
#: Bounds of the labelled sample: documents whose words are identifiers, random strings of each alphabet.
SAMPLE_DOCS, SAMPLE_RANDOM = 500, 2_000
SIDE = 128
#: Pattern spans that are looked through together.
LOOK = 64
RESULT = ("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "secrets")


def labelled(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_random: int = SAMPLE_RANDOM) -> DataFrame:
    """(label, token): 1 for random strings in hex, base64 and base32-like alphabets, 0 for words, composed identifiers and numbers."""
    spark = docs.sparkSession
    raw = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    random = spark.range(n_random).select(
        F.explode(F.array(F.substring(raw, 1, 40), F.base64(F.unhex(raw)), F.upper(F.substring(F.translate(F.base64(F.unhex(F.sha2(raw, 256))), "+/=", "XY7"), 1, 32)))).alias("token")
    ).select(F.lit(1).alias("label"), "token")
    parts = "get set user name list item count index value cache file path read write open close query result config client server request response handler manager buffer stream parse format update delete create insert table column record default internal public private static version message header content".split()
    words = F.array(*[F.lit(x) for x in parts])
    pick = lambda k: words[(uniform(F.col("id"), F.lit(k)) * len(parts)).cast("int")]
    composed = spark.range(n_random).select(F.explode(F.array(F.concat_ws("_", pick(1), pick(2), pick(3)), F.concat(pick(4), F.initcap(pick(5)), F.initcap(pick(6))), F.concat_ws("/", pick(7), pick(8), pick(9)))).alias("token")).select(F.lit(0).alias("label"), "token")
    digits = F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string"), 12, "0")
    part = lambda a, n: F.substring(digits, a, n)
    numbers = spark.range(n_random).select(F.explode(F.array(digits, F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)), F.concat(F.lit("+"), F.concat_ws("-", part(1, 2), part(3, 3), part(6, 7))))).alias("token")).select(F.lit(0).alias("label"), "token")
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    prose = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    has = F.concat_ws("|", F.lit(ASSIGN), F.lit(r"AKIA[A-Z0-9]{14,}"), F.lit(r"[0-9a-f]{16,}"))
    prose = prose.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", has, " "), F.lit(r"[A-Za-z_/-]{3,}"), 0)).alias("token")).select(F.lit(0).alias("label"), "token")
    return random.unionByName(composed).unionByName(numbers).unionByName(prose)


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of ASCII characters (index: first * 128 + second), by smoothed transition counts.

    At most 2 * 128 * 128 counts come to the driver, whatever the samples' size.
    """
    step = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.struct(F.ascii(F.substr(F.col("token"), i, F.lit(1))).alias("a"), F.ascii(F.substr(F.col("token"), i + 1, F.lit(1))).alias("b")))
    pairs = samples.where(F.length("token") >= 2).select("label", F.explode(step).alias("p")).where(f"p.a < {SIDE} AND p.b < {SIDE}")
    counts = pairs.groupBy("label", "p.a", "p.b").agg(F.count("*").alias("n")).collect()
    n = [[0.0] * SIDE * SIDE for _ in range(2)]
    for r in counts:
        n[r.label][r.a * SIDE + r.b] = float(r.n)
    alphabet, prior = 66, 0.5
    ratio = [0.0] * SIDE * SIDE
    row = [[sum(m[a * SIDE : (a + 1) * SIDE]) for a in range(SIDE)] for m in n]
    for a in range(SIDE):
        for b in range(SIDE):
            k = a * SIDE + b
            p1 = (n[1][k] + prior) / (row[1][a] + prior * alphabet)
            p0 = (n[0][k] + prior) / (row[0][a] + prior * alphabet)
            ratio[k] = math.log(p1 / p0)
    return ratio


def spans_of(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches: their places follow from the pieces between them.

    With keep, only of those for which it is true.
    """

    def place(pieces: Column, matches: Column) -> Column:
        both = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        spans = let(let(both, running), lambda at: F.transform(matches, lambda m, i: F.struct((at[i] + F.length(pieces[i])).alias("s"), (at[i] + F.length(pieces[i]) + F.length(m)).alias("e"), m.alias("m"))))
        return spans if keep is None else F.filter(spans, lambda x: keep(x["m"]))

    found = let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: place(p, m)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def scan(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with counts by kind, the digest of the pattern spans, all spans and the secrets themselves."""
    d = docs.drop(*RESULT).withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    # matches that are too short are dropped afterwards only where that differs from asking for the length at once
    d = d.withColumn("_assign", F.filter(spans_of(F.col("_t"), ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12))
    d = d.withColumn("_access", spans_of(F.col("_t"), r"AKIA[A-Z0-9]{14,}")).withColumn("_hex", spans_of(F.col("_t"), r"[0-9a-f]{16,}"))
    tag = lambda c, k: F.transform(F.col(c), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))
    d = d.withColumn("_base", F.array_sort(F.concat(tag("_assign", 0), tag("_access", 1), tag("_hex", 2))))
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratio)), ",").cast("array<double>")

    def score(m: Column) -> Column:
        codes = F.transform(F.split(m, ""), F.ascii)
        return let(codes, lambda c: F.aggregate(F.sequence(F.lit(1), F.length(m) - 1), F.lit(0.0), lambda s, i: s + F.element_at(table, c[i - 1] * SIDE + c[i] + 1)))

    # spans of patterns in runs with their borders, so that a token looks into few of them
    runs = F.sequence(F.lit(0), F.floor((F.size("_base") - 1) / LOOK).cast("int"))
    d = d.withColumn("_runs", F.when(F.size("_base") > 0, F.transform(runs, lambda r: let(F.slice("_base", r * LOOK + 1, F.lit(LOOK)), lambda b: F.struct(b[0]["s"].alias("s"), F.array_max(F.transform(b, lambda x: x["e"])).alias("e"), b.alias("of"))))))
    meets = lambda b, x: (b["s"] < x["e"]) & (x["s"] < b["e"])

    def rest(x: Column) -> Column:
        """What the patterns leave of a secret token: the token itself, or the pieces that look random."""
        over = F.when(F.size("_base") > 0, F.flatten(F.transform(F.filter("_runs", lambda r: meets(r, x)), lambda r: F.filter(r["of"], lambda b: meets(b, x))))).otherwise(F.col("_base"))
        piece = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e"), F.substr(x["m"], s - x["s"] + 1, e - s).alias("m")))
        start = F.struct(x["s"].alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))
        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["e"]).alias("at"), F.when(b["s"] > acc["at"], F.concat(acc["out"], piece(acc["at"], b["s"]))).otherwise(acc["out"]).alias("out"))
        pieces = F.aggregate(over, start, step, lambda acc: F.when(acc["at"] < x["e"], F.concat(acc["out"], piece(acc["at"], x["e"]))).otherwise(acc["out"]))
        # a piece is judged with the character on either side of it
        beside = lambda p: F.substr(x["m"], F.greatest(p["s"] - x["s"], F.lit(1)), F.least(p["e"] + 1, x["e"]) - F.greatest(p["s"] - 1, x["s"]))
        random = F.filter(pieces, lambda p: let(beside(p), lambda m: score(m) > threshold * (F.length(m) - 1)))
        return F.when(F.size(over) == 0, F.array(x)).otherwise(random)

    secret = lambda m: score(m) > threshold * F.greatest(F.length(m) - 1, F.lit(FULL))
    d = d.withColumn("_tokens", spans_of(F.col("_t"), CANDIDATE, secret))
    d = d.withColumn("_markov", F.flatten(F.transform("_tokens", rest)))
    d = d.withColumn("_all", F.array_sort(F.concat(F.col("_base"), tag("_markov", 3))))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(F.col(c), lambda x: F.concat_ws(":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")
    n = lambda c: F.size(c).cast("long")
    d = d.select(
        "*", n("_assign").alias("n_assign"), n("_access").alias("n_access"), n("_hex").alias("n_hex"), n("_markov").alias("n_markov"),
        F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_all").alias("spans"), F.transform("_all", lambda x: x["m"]).alias("secrets"),
    )
    return d.drop("_t", "_assign", "_access", "_hex", "_base", "_runs", "_tokens", "_markov", "_all")


def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, fit(labelled(docs))).select("doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")
