"""Column and DataFrame helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: Bins that are summed together before one task sums over the group.
SUPER = 1_000
#: Items of an array whose sum is taken anew for each of them.
RUN = 128
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def uniform(*cols: Column) -> Column:
    """A double in (0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null. Words are runs, so their number is that of the split's non-empty pieces."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.length(t) == 0, F.lit(0).cast("long")).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+")).cast("long"))


def prefix_sums(df: DataFrame, group: list[str], bin_col: str, order: list, value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over the rows before this one in its group.

    Rows are ordered by bin_col, then by order; bin_col must not fall as order rises. Only the rows of one bin meet in
    a task: sums of whole bins come from a partial aggregate, those of SUPER bins from theirs, and one row for each of
    these is summed over the group.
    """
    keys = [*group, bin_col]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_bin_sum")).withColumn("_super", F.floor(F.col(bin_col) / SUPER))
    above = [*group, "_super"]
    supers = totals.groupBy(*above).agg(F.sum("_bin_sum").alias("_super_sum"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    supers = supers.select(*[F.col(k).alias(f"_s_{k}") for k in above], so_far("_super_sum", before(*group).orderBy("_super")).alias("_super_before"))
    totals = totals.withColumn("_within", so_far("_bin_sum", before(*above).orderBy(bin_col)))
    totals = totals.join(supers, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in above]))
    offsets = totals.select(*[F.col(k).alias(f"_o_{k}") for k in keys], (F.col("_super_before") + F.col("_within")).alias("_offset"))
    joined = df.join(offsets, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]).drop(*[f"_o_{k}" for k in keys])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_offset")


def running(lengths: Column) -> Column:
    """Sums of the first 0, 1, 2, ... lengths (one for each), in runs of RUN, so that no array is copied for each of its items."""
    add = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    firsts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int"))

    def of(runs: Column) -> Column:
        starts = F.transform(firsts, lambda r: add(F.slice(runs, F.lit(1), r)))
        at = lambda i: F.floor(i / RUN).cast("int")
        return let(starts, lambda s: F.transform(lengths, lambda x, i: s[at(i)] + add(F.slice(lengths, at(i) * RUN + 1, i - at(i) * RUN))))

    return F.when(F.size(lengths) > 0, let(F.transform(firsts, lambda r: add(F.slice(lengths, r * RUN + 1, F.lit(RUN)))), of)).otherwise(F.array().cast("array<int>"))
