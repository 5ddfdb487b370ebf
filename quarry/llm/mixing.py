"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations alone.

Every document gets an exponential key divided by its quality weight. Within a source, documents are taken in the order
of their keys until the sum of their sizes meets the source's budget. Where the budget is larger than the source,
complete epochs come first and the keys select only what is left.

Cases: a null text has size 0 and is never taken. A null source is a source of its own, after the others. Documents of
equal id and key are ordered by size and a hash of their text. An empty table gives an empty result. Columns of the
input that clash with those of the result are dropped, others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.native import SPACE, n_words, prefix_sums, uniform
from quarry.operators.joins import hot_join
from quarry.session import stored

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED, BIN_ROWS = 1.5, 2.0, 17, 1_000
#: Steps of quality weights for which keys have a distribution of their own; a source of more than 1 / HOT_SHARE of the rows is hot.
LEVELS, HOT_SHARE = 20, 200
RESULT = ("size", "source_size", "target", "taken", "epochs", "quality_weight")


def quality_weight(text):
    """Between 0.1 and 1: falls with the share of symbols among the characters that are no white space."""
    t = F.coalesce(text, F.lit(""))
    solid = F.length(F.translate(t, SPACE, ""))
    symbols = solid - F.length(F.translate(F.translate(t, SPACE, ""), "#*$%&|<>{}[]^~=_\\", ""))
    return F.greatest(F.lit(0.1), 1.0 - 4.0 * symbols / F.greatest(solid, F.lit(1)))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, ...) with target: share of all sizes, split by weight.

    A target stops at most times the source's size and the rest is shared anew. The fixed point of that is
    min(cap, level * weight); with sources in the order of cap / weight, the level is the largest of
    (total - caps before) / (weights from here on). One row a source meets in one task here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(every))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    s = s.withColumn("_level", F.max("_level").over(every))
    return s.withColumn("target", F.least(F.col("_cap"), F.col("_level") * F.col("_w"))).drop("_w", "_cap", "_total", "_level")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, bin_rows: int = BIN_ROWS) -> DataFrame:
    """docs (doc_id, source, text and others; the text goes) with size, source_size, target, epochs and taken."""
    rows = docs.drop(*RESULT).select(
        *[c for c in docs.columns if c not in RESULT and c != "text"],
        n_words(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("quality_weight"), F.xxhash64("text").alias("_tie"),
    )
    # rows without id get keys of their own too, by their text
    rows = rows.withColumn("_key", -F.log(uniform(F.coalesce("doc_id", "_tie"), F.lit(seed))) / F.col("quality_weight"))
    rows = stored(rows, "mix-rows")  # texts are read once; what follows reads a few numbers a row
    named = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(c)))
    levels = rows.groupBy("source", F.round(F.col("quality_weight") * LEVELS).alias("_level")).agg(F.sum("size").alias("s"), F.count("*").alias("c"), F.avg("quality_weight").alias("w"))
    sizes = levels.groupBy("source").agg(F.sum("s").alias("source_size"), F.sum("c").alias("_n"), F.collect_list(F.struct("c", "w")).alias("_levels"))
    plan = targets(sizes, weights, share, most).withColumn("_bins", F.ceil(F.col("_n") / bin_rows))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    hot = max(1, rows.count() // HOT_SHARE)
    rows = hot_join(rows.withColumn("_source", named("source")), plan.withColumn("_source", named("source")).drop("source"), ["_source"], "_n", F.col("_tie"), hot).drop("_source")
    # keys are exponential with few rates: their distribution function deals them evenly to the bins, in their order
    later = F.aggregate("_levels", F.lit(0.0), lambda s, x: s + x["c"] * F.exp(-F.col("_key") * x["w"])) / F.col("_n")
    rows = rows.withColumn("_bin", F.least(F.floor(F.col("_bins") * (1.0 - later)), F.col("_bins") - 1)).drop("_n", "_levels")
    rows = prefix_sums(rows, ["source"], "_bin", ["_key", "doc_id", "size", "_tie"], F.col("size"), "_before")
    # the document at the border is taken where that brings the sum nearer to the target
    extra = F.col("_before") + F.col("size") / 2.0 <= F.col("target") - F.col("epochs") * F.col("source_size")
    taken = F.col("size") * (F.col("epochs") + F.when(extra, 1).otherwise(0))
    return rows.withColumn("taken", taken.cast("long")).drop("_bins", "_bin", "_key", "_tie", "_before")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "epochs", "quality_weight")


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: the columns of docs, each document as many times as it is taken.

    Rows equal in all columns share what is taken of them.
    """
    cols = docs.columns
    row = F.xxhash64(*cols)
    chosen = mix(docs.select("doc_id", "source", "text", row.alias("_row")), **how)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    chosen = chosen.select("_row", times.alias("_times")).groupBy("_row").agg(F.sum("_times").cast("int").alias("_times"), F.count("*").alias("_equal"))
    chosen = stored(chosen.where("_times > 0"), "mix-chosen")
    kept = docs.withColumn("_row", row).join(chosen, "_row")
    if not chosen.where("_equal > 1").isEmpty():
        kept = kept.where("_equal = 1").unionByName(kept.where("_equal > 1").dropDuplicates(["_row"]))
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*cols)
