"""Windows, scores and selections over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key, in ascending order of Columns: a partial aggregate, so that no key meets in one task."""
    best = F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]))
    return df.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def newest(day: str) -> Column:
    """An ascending key that puts late days first."""
    return -F.unix_date(F.col(day))


def field_strength(term: Column, title: Column, path: Column, text: Column) -> Column:
    """How strongly a term meets a document: equal to its title, within title, path or text."""
    return F.when(title == term, 1.0).when(title.contains(term), 0.85).when(path.contains(term), 0.65).when(text.contains(term), 0.3).otherwise(0.0)


def rank_bonus(rank: Column) -> Column:
    """0 gives .06, a negative rank r gives -r / (1 - r) * .06, a positive one nothing."""
    return F.when(rank == 0, 0.06).when(rank < 0, -rank / (1 - rank) * 0.06).otherwise(0.0)


def quality_floor(df: DataFrame, kind: str, relevance: str, exempt: Column | None = None) -> DataFrame:
    """Rows not below min(best, max(.3, .7 best)) of their kind, and exempt ones; the best is a partial aggregate, so no kind meets in one task."""
    best = df.groupBy(kind).agg(F.max(relevance).alias("_best"))
    enough = F.col(relevance) >= F.least(F.col("_best"), F.greatest(F.lit(0.3), 0.7 * F.col("_best")))
    return df.join(F.broadcast(best), kind).where(enough if exempt is None else enough | exempt).drop("_best")


def with_hybrid(df: DataFrame, relevance: str, day: str, name: str) -> DataFrame:
    """df with .68 relevance + .32 recency, scaled over its rows; where all are of one day, recency is 1. One row is broadcast."""
    span = df.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    width = F.datediff("_hi", "_lo").cast("double")
    recent = F.when(width > 0, F.datediff(F.col(day), F.col("_lo")) / width).otherwise(1.0)
    return df.crossJoin(F.broadcast(span)).withColumn(name, 0.68 * F.col(relevance) + 0.32 * recent).drop("_lo", "_hi")


def within_budget(df: DataFrame, order: list, size: str, budget: int, by: list[str]) -> DataFrame:
    """Rows before the first that makes the running size exceed the budget (packing stops there)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def preceding(df: DataFrame, doc: str, ordinal: str, same: str, value: str, n: int = 3) -> DataFrame:
    """Up to n rows before each in its document, back to the first whose `same` differs."""
    w = Window.partitionBy(doc).orderBy(ordinal)
    ok, out = F.lit(True), []
    for k in range(1, n + 1):
        ok = ok & F.coalesce((F.lag(same, k).over(w) == F.col(same)) & (F.lag(ordinal, k).over(w) == F.col(ordinal) - k), F.lit(False))
        out.append(F.when(ok, F.lag(value, k).over(w)))
    return df.withColumn("before", F.array_compact(F.array(*out)))
