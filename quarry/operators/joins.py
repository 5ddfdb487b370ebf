"""Joins that no single key can hold up."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are taken as hot where no other bound is given.
MOST_HOT = 200


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, spread: Column, hot: int | None = None) -> DataFrame:
    """left, each row with the columns of the one row of right that has its keys (null where there is none).

    size is a column of right: the number of left's rows of the key. Hot keys are broadcast, and their rows are dealt by
    spread, so that no key's rows meet in one task: those of more than hot rows, of which there are at most left's rows /
    hot, or else the MOST_HOT largest.
    """
    values = F.struct(*[c for c in right.columns if c not in keys])
    side = lambda df, name: df.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], values.alias(f"_{name}"))
    same = lambda name: reduce(and_, [F.col(k) == F.col(f"_{name}_{k}") for k in keys])
    if hot is None:
        large = right.orderBy(F.desc(size), *keys).limit(MOST_HOT)
        small = right.join(F.broadcast(large.select(keys)), keys, "left_anti")
    else:
        large, small = right.where(F.col(size) > hot), right.where(F.col(size) <= hot)
    served = left.join(F.broadcast(side(large, "hot")), same("hot"), "left")
    served = served.withColumn("_place", F.when(F.col("_hot").isNotNull() | F.col(keys[0]).isNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long")))
    # always 0, but no constant: the optimiser would take a constant out of the keys
    cold = side(small, "cold").withColumn("_cold_place", F.pmod(F.xxhash64(*[f"_cold_{k}" for k in keys]), F.lit(1)).cast("long"))
    out = served.join(cold, same("cold") & (F.col("_place") == F.col("_cold_place")), "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return out.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in right.columns if c not in keys])
