"""Upserts, reconciliation and consistency of written snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def mark_missing(old: DataFrame, seen: DataFrame, scanned: DataFrame, key: str, source: str) -> DataFrame:
    """old with deleted: not seen any more, in a source that was scanned."""
    s = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    c = scanned.select(source).distinct().withColumn("_scanned", F.lit(True))
    d = old.join(s, key, "left").join(F.broadcast(c), source, "left")
    return d.withColumn("deleted", F.col("_seen").isNull() & F.col("_scanned").isNotNull()).drop("_seen", "_scanned")


def reconcile(before: DataFrame, after: DataFrame, key: str, identity: str) -> DataFrame:
    """(key, change): added, removed, changed or same."""
    b, a = before.select(key, F.col(identity).alias("_b")), after.select(key, F.col(identity).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")
