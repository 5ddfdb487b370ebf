"""Balanced label propagation: linked documents gather in shards, under quotas that keep the shards' row counts even.

Links join documents of equal text. All documents of a group in one shard have the same neighbours, so a round of label
propagation is a join and two sums over (group, shard, number): each group's documents vote for the shard where most of
their neighbours are among those with free places, and as many move there from shards with fewer as its quota admits,
largest groups first. Rounds go on until no document moves; each move brings more neighbours together, so they end.
Groups larger than a shard's quota are placed before: they fill shards whole, one after the other. Unlinked documents
fill every shard to its quota at the end, so that counts are at most one apart. cut_edges counts the links that are cut.

Cases: a null text has no bytes, size 16 and crc 0; null texts are one group. Repeated ids are dealt like others; rows
of equal id and text may change places. An empty table gives an empty result. Columns of the input that clash with those of the result are dropped, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.native import prefix_sums, uniform
from quarry.operators.joins import hot_join
from quarry.session import stored

SHARDS, BIN_ROWS = 40, 1_000
#: A group of more than 1 / HOT_SHARE of the rows is hot.
HOT_SHARE = 200
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _binned(df: DataFrame, total: Column, *by: Column, bin_rows: int) -> DataFrame:
    """df with _u, uniform by hash, and _bin, its bin of about bin_rows rows of total."""
    u = uniform(*by)
    return df.withColumn("_u", u).withColumn("_bin", F.floor(F.col("_u") * F.ceil(total / F.lit(float(bin_rows)))))


def fill(sizes: list[int], places: list[int]) -> list[tuple[int, int, int]]:
    """(index of the size, shard, number), largest sizes first, each in few shards; takes from places."""
    out = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        while n and max(places):
            whole = [k for k, x in enumerate(places) if x >= n]
            shard = min(whole, key=lambda k: places[k]) if whole else max(range(len(places)), key=lambda k: places[k])
            out.append((i, shard, min(n, places[shard])))
            n -= out[-1][2]
            places[shard] -= out[-1][2]
    return out


def propagate(state: DataFrame, quota: Column, rounds: int | None = None) -> DataFrame:
    """state (gid, shard, n): n documents of a group in a shard; until nothing moves, or for so many rounds.

    quota is each shard's, from column shard. Each round is written, which ends its lineage. One number a round comes to the driver.
    """
    done = 0
    while rounds is None or done < rounds:
        here = state.groupBy("shard").agg(F.sum("n").alias("used")).select(F.col("shard").alias("to"), F.greatest(quota - F.col("used"), F.lit(0)).alias("free"))
        order = lambda shard: F.struct("n", F.xxhash64("gid", "shard").alias("h"), shard)
        open_ = state.join(F.broadcast(here.where("free > 0")), F.col("shard") == F.col("to"), "left_semi")
        best = open_.groupBy("gid").agg(F.max(order("shard")).alias("b"))
        moves = state.join(best, "gid", "left").withColumn("wants", F.coalesce(order("shard") < F.col("b"), F.lit(False)))
        movers = moves.where("wants").select("gid", "shard", "n", F.col("b.shard").alias("to"), F.col("b.n").alias("gain")).join(F.broadcast(here), "to")
        # large gains first: bins by the logarithm of the gain, halved further by hash
        movers = movers.withColumn("_bin", (-F.floor(F.log2(F.col("gain"))) * 64 + F.pmod(F.xxhash64("gid"), F.lit(64))).cast("long"))
        movers = prefix_sums(movers, ["to"], "_bin", ["gid", "shard"], F.col("n"), "before")
        movers = movers.withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), F.col("free") - F.col("before"))).cast("long"))
        none = F.lit(0).cast("long").alias("moved")
        stay = moves.where("NOT wants").select("gid", "shard", "n", none).unionByName(movers.select("gid", "shard", (F.col("n") - F.col("go")).alias("n"), none))
        gone = movers.select("gid", F.col("to").alias("shard"), F.col("go").alias("n"), F.col("go").alias("moved"))
        state = stored(stay.unionByName(gone).where("n > 0").groupBy("gid", "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")), "shard-state")
        done += 1
        if not state.agg(F.sum("moved")).first()[0]:
            break
        state = state.drop("moved")
    return state.select("gid", "shard", "n")


def cut_edges(rows: DataFrame, key: str = "gid") -> DataFrame:
    """One row (edges, cut): pairs of rows of one key, and those of them in different shards."""
    pairs = lambda n: F.coalesce(F.sum((n * (n - 1) / 2).cast("decimal(38,0)")), F.lit(0))
    each = rows.groupBy(key, "shard").agg(F.count("*").cast("decimal(18,0)").alias("n"))
    total = each.groupBy(key).agg(F.sum("n").cast("decimal(18,0)").alias("n")).agg(pairs(F.col("n")).alias("edges"))
    return total.crossJoin(each.agg(pairs(F.col("n")).alias("within"))).select("edges", (F.col("edges") - F.col("within")).alias("cut"))


def balanced(docs: DataFrame, n_shards: int = SHARDS, rounds: int | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """docs (doc_id, text and others; the text goes) with size, text_crc32, law, shard, slot and grown_shard."""
    gid = F.concat_ws("-", F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit("again"), F.col("text"))), F.isnull("text").cast("string"))
    rows = docs.drop(*RESULT).select(
        *[c for c in docs.columns if c not in RESULT and c != "text"],
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), gid.alias("gid"),
    )
    rows = stored(rows, "shard-rows")
    total = rows.count()
    quota = F.floor(F.lit(total) / n_shards).cast("long")
    groups = rows.groupBy("gid").agg(F.count("*").alias("group_n"))
    hot = max(1, total // HOT_SHARE)
    rows = stored(hot_join(rows, groups, ["gid"], "group_n", F.col("doc_id"), hot), "shard-grouped")
    linked = rows.where("group_n > 1")
    linked = _binned(linked, F.col("group_n"), F.col("doc_id"), F.lit("in-group"), bin_rows=bin_rows)
    linked = stored(prefix_sums(linked, ["gid"], "_bin", ["_u", "doc_id"], F.lit(1), "rank").drop("_u", "_bin"), "shard-linked")

    # groups above the quota are at most twice as many as shards: they are placed by the driver
    least = max(1, total // n_shards)
    large = groups.where((F.col("group_n") > least) & (F.col("group_n") > 1)).orderBy("gid").collect()
    left = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    placed = [(large[i].gid, shard, n) for i, shard, n in fill([r.group_n for r in large], left)]
    till = F.array(*[F.lit(sum(left[: k + 1])).cast("long") for k in range(n_shards)])
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(max(1, sum(left))))
    first = linked.where(F.col("group_n") <= least).select("gid", start.alias("at"))
    first = first.select("gid", F.least(F.size(F.filter(till, lambda x: x <= F.col("at"))), F.lit(n_shards - 1)).alias("shard"))
    free = F.array(*[F.lit(x).cast("long") for x in left])[F.col("shard")]
    state = propagate(stored(first.groupBy("gid", "shard").agg(F.count("*").alias("n")), "shard-start"), free, rounds)
    state = state.unionByName(docs.sparkSession.createDataFrame(placed, "gid string, shard int, n long"))

    # each group's documents, in the order of their ranks, fill the places that its state holds: at most n_shards a group
    places = state.withColumn("till", F.sum("n").over(Window.partitionBy("gid").orderBy(F.desc("n"), "shard")))
    places = places.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("till", "shard"))).alias("places"), F.max("till").alias("of"))
    seated = hot_join(linked, places, ["gid"], "of", F.col("doc_id"), hot).drop("of").withColumn("shard", F.filter("places", lambda p: F.col("rank") < p["till"])[0]["shard"]).drop("places", "rank")

    # exact quotas: what stands over a shard's quota is dealt anew with the unlinked documents
    share = (F.lit(total) / n_shards).cast("long") + F.when(F.col("shard") < total % n_shards, 1).otherwise(0)
    seated = _binned(seated, quota, F.col("gid"), F.col("doc_id"), bin_rows=bin_rows)
    seated = prefix_sums(seated, ["shard"], "_bin", ["_u", "doc_id", "gid"], F.lit(1), "at").withColumn("fits", F.col("at") < share).drop("_u", "_bin", "at")
    seated = stored(seated, "shard-seated")
    alone = rows.where("group_n = 1").drop("group_n")
    free = alone.unionByName(seated.where("NOT fits").drop("group_n", "fits", "shard"))
    shards = docs.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    used = seated.where("fits").groupBy("shard").agg(F.count("*").alias("used"))
    gaps = shards.join(used, "shard", "left").withColumn("gap", share - F.coalesce("used", F.lit(0)))
    gaps = gaps.withColumn("till", F.sum("gap").over(Window.orderBy("shard")))  # n_shards rows
    gaps = gaps.agg(F.array_sort(F.collect_list(F.struct("till", "shard"))).alias("gaps"))
    free = _binned(free, F.lit(total), F.col("doc_id"), F.col("gid"), F.lit("free"), bin_rows=bin_rows)
    free = prefix_sums(free, [], "_bin", ["_u", "doc_id", "gid"], F.lit(1), "rank").crossJoin(F.broadcast(gaps))  # one row
    free = free.withColumn("shard", F.filter("gaps", lambda p: F.col("rank") < p["till"])[0]["shard"]).drop("gaps", "rank", "_u", "_bin")

    out = seated.where("fits").drop("group_n", "fits").unionByName(free)
    out = _binned(out, quota + 1, F.col("doc_id"), F.col("gid"), F.lit("slot"), bin_rows=bin_rows)
    out = prefix_sums(out, ["shard"], "_bin", ["_u", "doc_id", "gid"], F.lit(1), "slot").drop("_u", "_bin")
    return out.withColumn("slot", F.col("slot").cast("long")).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return balanced(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", F.col("gid").alias("group_key"))
