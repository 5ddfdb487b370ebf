"""MinHash near-duplicates by min-max hashing, confirmed on full shingle sets.

Each of N_HASH multiplications of a document's shingles gives two signature values, its minimum and its maximum, so half
the evaluations serve for a signature. Bands of ROWS values make buckets: two sets of similarity 0.8 share none of BANDS
buckets with probability (1 - 0.8 ** 6) ** 42, 3 in a million. Documents of equal sets are one class from the start.

In a bucket every class is first compared with the smallest. Where that leaves a bucket in several components, the
classes outside its largest component are compared with all classes of other components there: within a component no
further link can change the result, so no link is lost and no bucket is capped. That goes in two rounds, first with the
nearest class of each other component, then with whatever is still apart; bitmaps of the sets bound their difference from
below, so that pairs too far apart are never made rows.

Cases: a null or empty text has no shingles and is linked with nothing; fewer words than a shingle count as one. Equal
rows are one class. Documents that share an id are one node; deduplicated tells them apart by their text. A document
without id is never linked and is kept. An empty table gives an empty result. Columns of the input that clash are dropped.
Sets are sets of 64-bit hashes of shingles, in the confirmation too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.graph import components
from quarry.llm.words import blocks, mix, release, shingle_sets
from quarry.operators.joins import hot_join
from quarry.session import ship, stored

N_HASH, ROWS, BANDS = 126, 6, 42
PERCENT = 80
#: Bits of a set's bitmap; buckets up to SMALL are joined with themselves, others compared in squares of SIDE.
BITS, SMALL, SIDE = 1024, 12, 512
#: A class or bucket of more than 1 / HOT_SHARE of the documents is hot: there are at most BANDS * HOT_SHARE such.
HOT_SHARE = 200
FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, N_HASH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 2 * N_HASH values for each (non-empty) set: minima, then maxima."""
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    x = np.concatenate(sets)
    sig = np.empty((2 * N_HASH, len(sets)), np.uint64)
    for j, f in enumerate(FACTORS):
        y = x * f
        np.minimum.reduceat(y, at, out=sig[j])
        np.maximum.reduceat(y, at, out=sig[N_HASH + j])
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS keys for each set (a row each)."""
    out = np.empty((sig.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(sig.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h ^ sig[b * ROWS + r]) + np.uint64(r)
        out[:, b] = h
    return out


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bits", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        ids, texts = batch.column(0), [(t or "").encode() for t in batch.column(1).to_pylist()]
        for a, b in blocks(texts):
            sets = shingle_sets(texts[a:b], width)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            k = np.zeros((2, len(sets)), np.uint64)
            bands: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            if len(full):
                own = [sets[i] for i in full]
                at = np.concatenate(([0], np.cumsum(n[full])))[:-1]
                x = np.concatenate(own)
                k[0, full] = mix(np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), at) + n[full].astype(np.uint64))
                k[1, full] = mix(np.add.reduceat(mix(x + np.uint64(0x14057B7EF767814F)), at))
                for i, row in zip(full.tolist(), band_keys(signatures(own)).view(np.int64), strict=True):
                    bands[i] = row
                    flags = np.zeros(BITS, bool)
                    flags[sets[i] & np.uint64(BITS - 1)] = True
                    bits[i] = np.packbits(flags).tobytes()
            keys = [pa.array(v.view(np.int64), mask=n == 0) for v in k]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n.astype(np.int64)), *keys, pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=SKETCH)


CONFIRMED = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Pairs of one class that are confirmed in one run of rows; texts looked at in one step.
GROUP, STEP = 512, 64


def confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of those rows (a, b, text) whose full sets are similar enough; a's own row, without b, comes before them.

    One set is kept and one made at a time, so that memory follows the longest text and not the number of pairs.
    """
    kept = np.empty(0, np.uint64)
    for batch in batches:
        hits = []
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            for i, (b, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).cast(pa.binary()), strict=True), at):
                own = shingle_sets([text.as_py() or b""], width)[0]
                if b is None:
                    kept = own
                    continue
                common = len(kept) + len(own) - len(np.unique(np.concatenate((kept, own))))
                if 100 * common >= percent * (len(kept) + len(own) - common) and common:
                    hits.append(i)
        yield batch.select([0, 1]).take(pa.array(hits, pa.int32())).cast(CONFIRMED)


REST = pa.schema([("a", pa.int64()), ("na", pa.int64()), ("b", pa.int64()), ("nb", pa.int64()), ("run", pa.int64())])


def possible(left: pa.Table, right: pa.Table, percent: int, nearest: bool) -> pa.Table:
    """Pairs of different components whose bitmaps allow the similarity: bits that differ are shingles that differ.

    nearest: of each component only the one that differs least.
    """
    left = left.rename_columns([c[2:] for c in left.column_names])
    x, y = (t.select(["cid", "n", "comp"]).to_pydict() for t in (left, right))
    bits = [np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(t.num_rows, BITS // 64) for t in (left, right)]
    cid, n, comp = (np.array(y[k], np.int64) for k in ("cid", "n", "comp"))
    run = right.column("i")[0].as_py() << 32 | right.column("j")[0].as_py() if right.num_rows else 0
    out: list[tuple[np.ndarray, ...]] = []
    for i, (a, na, ca) in enumerate(zip(x["cid"], x["n"], x["comp"], strict=True)):
        differ = np.bitwise_count(bits[0][i] ^ bits[1]).sum(axis=1, dtype=np.int64)
        ok = np.flatnonzero(((100 + percent) * differ <= (100 - percent) * (na + n)) & (comp != ca))
        if nearest and len(ok):
            ok = ok[np.argsort(differ[ok], kind="stable")]
            ok = ok[np.unique(comp[ok], return_index=True)[1]]
        if len(ok):
            other, size, first = cid[ok], n[ok], a < cid[ok]
            out.append((np.where(first, a, other), np.where(first, na, size), np.where(first, other, a), np.where(first, size, na)))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
    return pa.Table.from_arrays([*map(pa.array, cols), pa.array(np.full(len(cols[0]), run))], schema=REST)


def remaining(members: DataFrame, roots: DataFrame, bits: DataFrame, percent: int, nearest: bool, hot: int) -> DataFrame:
    """Distinct pairs (a, na, b, nb, run) between the classes outside a bucket's largest component and those of its others.

    A class has at most about SIDE pairs in a run. Small buckets are joined with themselves. Large ones are dealt in squares of at most about SIDE * SIDE pairs, whose
    bitmaps are compared in numpy, so that only pairs that may be similar enough become rows.
    """
    own = members.join(roots, members.cid == roots.node, "left").select("bucket", "cid", "n", "size", F.coalesce("root", "cid").alias("comp"))
    sizes = own.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("c").alias("rows")).where("comps > 1")
    # buckets of several components are few: they are written once, and what follows reads these alone
    mixed = stored(mixed.select("bucket", F.col("top.comp").alias("top"), "rows"), "near-mixed")
    comp = stored(hot_join(own, mixed, ["bucket"], "rows", F.col("cid"), hot).where("top IS NOT NULL").drop("rows"), "near-comp")
    small = comp.where(F.col("size") <= SMALL)
    rare = small.where("comp <> top").select("bucket", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    cross = rare.join(small, "bucket").where((F.col("ca") != F.col("comp")) & (F.least("na", "n") * 100 >= F.greatest("na", "n") * percent))
    low = F.col("a") < F.col("cid")
    cross = cross.select(F.least("a", "cid").alias("a"), F.when(low, F.col("na")).otherwise(F.col("n")).alias("na"), F.greatest("a", "cid").alias("b"), F.when(low, F.col("n")).otherwise(F.col("na")).alias("nb"), F.lit(0).cast("long").alias("run"))

    large = comp.where(F.col("size") > SMALL).join(bits, "cid").withColumn("sides", F.ceil(F.col("size") / SIDE).cast("int"))
    mine = F.pmod(F.xxhash64("cid"), F.col("sides")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    rows = large.where("comp <> top").withColumn("i", mine).withColumn("j", every).drop("size", "top", "sides")
    cols = large.withColumn("j", mine).withColumn("i", every).drop("size", "top", "sides")
    rows = rows.select(*[F.col(c).alias(f"x_{c}") for c in rows.columns])
    squares = rows.groupBy("x_bucket", "x_i", "x_j").cogroup(cols.groupBy("bucket", "i", "j"))
    return cross.unionByName(squares.applyInArrow(partial(possible, percent=percent, nearest=nearest), "a long, na long, b long, nb long, run long")).groupBy("a", "na", "b", "nb").agg(F.min("run").alias("run"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(docs.mapInArrow(partial(sketch, width=width), "doc_id long, n_shingles long, k1 long, k2 long, bits binary, bands array<long>"), "near-sketches")
    hot = max(1, rows.count() // HOT_SHARE)
    classes = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies")).where("cid IS NOT NULL")
    heads = rows.select("k1", "k2", F.col("doc_id").alias("cid"), "n_shingles", "bits", "bands").join(classes, ["k1", "k2", "cid"], "left_semi")
    members = heads.select("cid", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = stored(hot_join(members, hubs, ["bucket"], "size", F.col("cid"), hot).where("size IS NOT NULL").select("bucket", "cid", "n", "hub", "size"), "near-members")
    texts = docs.join(classes.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi")

    def linked(pairs: DataFrame) -> DataFrame:
        """Confirmed links of distinct pairs (a, na, b, nb, run), a < b: a text a row, a's before those of its run."""
        fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        pairs = pairs.where(fits).select("a", "run", "b")
        first = pairs.select("a", "run").distinct().select("a", "run", F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
        wanted = first.unionByName(pairs.withColumn("doc_id", F.col("b")))
        both = wanted.join(texts, "doc_id").select("a", "run", "b", "text").repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
        return both.select("a", "b", "text").mapInArrow(partial(confirm, width=width, percent=percent), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))

    # hubs are the smallest classes of their buckets: a < b
    first = members.where("cid <> hub.cid").groupBy(F.col("hub.cid").alias("a"), F.col("hub.n").alias("na"), F.col("cid").alias("b"), F.col("n").alias("nb")).agg(F.max("size").alias("size"))
    first = stored(first.withColumn("run", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / GROUP)).cast("long")), "near-first")
    links = stored(linked(first), "near-links")
    roots = stored(components(links), "near-roots")

    seen = first.select("a", "b")
    bits = heads.select("cid", "bits")
    for nearest in (True, False):
        pairs = stored(remaining(members, roots, bits, percent, nearest, hot).join(seen, ["a", "b"], "left_anti"), "near-rest")
        if pairs.isEmpty():
            continue
        more = stored(linked(pairs), "near-links")
        seen = seen.unionByName(pairs.select("a", "b"))
        if not more.isEmpty():
            roots = stored(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "near-roots")

    named = classes.join(roots, classes.cid == roots.node, "left").select("k1", "k2", F.coalesce("root", "cid").alias("root"), "copies")
    out = hot_join(rows.drop("bands", "bits"), named, ["k1", "k2"], "copies", F.col("doc_id"), hot)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs without those near-duplicates of a smaller id: one row of each component stays, and all rows without id.

    Rows of one id whose texts differ are nodes of their own, by a negative number from their content; copies of a row are one.
    """
    h = F.xxhash64("doc_id", "text")
    odd = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").select("doc_id")
    odd = stored(odd, "near-odd-ids")
    nodes = docs.withColumn("_node", F.col("doc_id").cast("long"))
    if not odd.isEmpty():
        mark = odd.select(F.col("doc_id").alias("_odd"))
        nodes = docs.join(mark, docs.doc_id == F.col("_odd"), "left")
        nodes = nodes.withColumn("_node", F.when(F.col("_odd").isNotNull(), h.bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("doc_id").cast("long"))).drop("_odd")
    kept = near_duplicates(nodes.select(F.col("_node").alias("doc_id"), "text"), width, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    named = nodes.join(kept, nodes["_node"] == F.col("_id"), "left_semi").dropDuplicates(["_node"]).drop("_node")
    return named.unionByName(docs.where("doc_id IS NULL"))
