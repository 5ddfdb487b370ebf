"""Nearest vectors: blocks of queries against all rows as matrix products, with the best of each query kept in the task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ship

#: Bytes of a block of queries, with the places that a task keeps for their best; products of a matrix at once; digits that
#: similarities are compared by.
BLOCK_BYTES, PRODUCTS, DIGITS = 32 << 20, 1 << 20, 5
NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])


def matrix(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as rows, filled up with zeros to width; their lengths): one that is null, empty or zero has none."""
    lengths = np.array([0 if v is None else v for v in vectors.value_lengths().to_pylist()], np.int64)
    out = np.zeros((len(vectors), max(int(lengths.max(initial=0)), width or 0)))
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0), lengths


def best_of(batches: Iterator[pa.RecordBatch], block, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of a task's rows (vec_id, embedding) for each query of the block: by rounded similarity, then vec_id."""
    ids, unit, lengths = block.value
    own = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    least = np.full(len(ids), -np.inf)
    waiting: list[list[np.ndarray]] = []
    size, step = 0, max(1, PRODUCTS // max(1, len(ids)))

    def settle() -> None:
        nonlocal own, waiting, size
        q, v, s = (np.concatenate([o, *w]) for o, w in zip(own, zip(*waiting, strict=True), strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        own = [q[nth < k], v[nth < k], s[nth < k]]
        least[q[nth == k - 1]] = s[nth == k - 1]
        waiting, size = [], 0

    for batch in batches:
        for a in range(0, batch.num_rows, step):
            rows = batch.slice(a, step)
            there, sizes = matrix(rows.column(1), unit.shape[1])
            similar = np.round(unit @ there[:, : unit.shape[1]].T, DIGITS) + 0.0
            similar[lengths[:, None] != sizes] = 0.0
            q, r = np.nonzero(similar >= least[:, None])
            waiting.append([q, rows.column(0).to_numpy()[r], similar[q, r]])
            size += len(q)
            if size > max(k * len(ids), PRODUCTS):
                settle()
    if waiting:
        settle()
    for a in range(0, len(own[0]), 100_000):
        part = [x[a : a + 100_000] for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part[0]]), pa.array(part[1]), pa.array(part[2])], schema=NEAR)


def nearest(rows: DataFrame, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k rows (vec_id, embedding) of largest cosine for each of queries (the same columns).

    A block of queries is broadcast for each pass over the rows; a task hands on k rows a query, and no pair is a row. With
    what a task keeps for them, queries have about block_bytes, so that a task's memory doesn't grow with the table. Vectors of unequal length or without direction have similarity 0. Ties go by vec_id.
    """
    spark = rows.sparkSession
    ship(spark)
    rows, queries = (df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for df in (rows, queries))
    total = queries.agg(F.sum(8 * (2 + F.greatest(F.lit(0), F.size("embedding")) + 3 * k))).first()[0] or 0
    n = max(1, -(-total // block_bytes)) * (2 if total > block_bytes else 1)
    found = []
    for i in range(n):
        block = queries if n == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i)
        got = block.orderBy("vec_id").toArrow().combine_chunks()  # less than block_bytes
        if got.num_rows:
            unit, lengths = matrix(got.column(1).combine_chunks())
            shared = spark.sparkContext.broadcast((got.column(0).to_numpy(), unit, lengths))
            found.append(rows.mapInArrow(partial(best_of, block=shared, k=k), "query_id long, vec_id long, similarity double"))
    if not found:
        return spark.createDataFrame([], "query_id long, vec_id long, similarity double, rank long")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
