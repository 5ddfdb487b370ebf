"""Connected components of an edge table by alternating star contractions; nothing but two sums comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import hot_join
from quarry.session import remove_path, shared_path

MOST_ROUNDS, HOT_SHARE = 60, 200


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the smallest node reachable. Each round is written.

    Rounds grow with the logarithm of the longest path; MOST_ROUNDS of them are an error. Nodes of very many edges are
    joined by broadcast, at most 2 * HOT_SHARE of them.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before, old = None, None
    n = edges.count()
    for _ in range(MOST_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
        hot = max(1, n // HOT_SHARE)
        # larger neighbours of each node point to the smallest of its neighbourhood
        at = shared_path(spark, "components-large")
        hot_join(both, low, ["u"], "d", F.col("v"), hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().write.parquet(at)
        large = spark.read.parquet(at)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        # of the smaller neighbours, and the node itself, each points to the smallest
        small = hot_join(large, least, ["u"], "d", F.col("v"), hot)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        path = shared_path(spark, "components")
        small.write.parquet(path)
        e = spark.read.parquet(path)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        for done in (at, old):
            if done:
                remove_path(spark, done)
        old = path
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
