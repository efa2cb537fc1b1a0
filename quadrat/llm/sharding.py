"""Sharding by longest-processing-time scheduling: groups that must stay together go, largest first, to the shard with
the least load, by a heap.

Groups of one size are interchangeable, so the schedule needs how many groups each size has, not the groups. k distinct
sizes sum to k * k / 2 bytes at least, so the driver sees at most the root of twice the corpus' bytes as rows (some
250,000 for 30 GB, 14 million for 100 TB). A size's groups are dealt as the heap deals them one by one; only which of
them goes where is decided in the cluster, by their rank among their equals. Groups with more than 1 / ``HOT`` of all rows
(fewer than HOT) are broadcast, so no join or window gathers one of them in a task.

Defined results: null texts are one group, apart from the empty text; rows that repeat are of one group; an empty table
gives no rows; ties go by the text's digest and then to the lower shard; other columns are passed over.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm import common as C

SHARDS, HOT, BUCKET = 16, 10_000, 16_384
MAX_BROADCAST = 100_000


def numbered(df: DataFrame, n: DataFrame, key: str, order: Sequence[str], to: str) -> DataFrame:
    """df with gapless numbers from 0 in each key, by buckets of about BUCKET rows (in bucket order, then by order).
    n: (key, _n) counts of df's rows, a small table."""
    own = df.join(n.select(key, F.greatest(F.ceil(F.col("_n") / BUCKET), F.lit(1)).alias("_parts")), key)
    own = own.withColumn("_b", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    own = own.withColumn("_at", F.row_number().over(W.partitionBy(key, "_b").orderBy(*order)) - 1)
    base = own.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    base = base.select(key, "_b", (F.sum("_c").over(W.partitionBy(key).orderBy("_b")) - F.col("_c")).alias("_base"))
    return own.join(base, [key, "_b"]).withColumn(to, F.col("_base") + F.col("_at")).drop("_b", "_base", "_at")


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> list[list[int]]:
    """Of (size, number of groups) in falling order of size, how many of these groups go to each shard: what a heap gives one by one."""
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, n in sizes:
        own = [0] * shards
        if n > 4 * shards:
            # Group k of shard i would be its turn at a load of load + k * size; the n least turns are taken. All turns
            # below a level are, for the highest level below which there are no more than n; the rest go by the heap.
            turns = lambda level: [max(0, -((load - level) // size)) for load, _ in heap]
            low, high = heap[0][0], max(heap)[0] + n * size
            while low < high:
                level = (low + high + 1) // 2
                low, high = (level, high) if sum(turns(level)) <= n else (low, level - 1)
            taken = turns(low)
            for (_, i), k in zip(heap, taken):
                own[i] = k
            heap = [(load + k * size, i) for (load, i), k in zip(heap, taken)]
            heapq.heapify(heap)
        for _ in range(n - sum(own)):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            own[i] += 1
        out.append(own)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, group (a digest), shard, slot. Size: UTF-8 bytes and one more."""
    spark = docs.sparkSession
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = C.written(docs.select(F.col(id_col).alias(id_col), size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("group")), "shard-rows")
    groups = C.written(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")), "shard-groups")
    known = C.written(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), "shard-sizes").toPandas().sort_values("bytes", ascending=False)
    dealt = schedule(zip(known["bytes"].tolist(), known["n"].tolist()), shards)
    ends = [(b, n, [sum(own[: i + 1]) for i in range(shards)]) for b, n, own in zip(known["bytes"].tolist(), known["n"].tolist(), dealt)]
    ends = C.written(spark.createDataFrame(ends, "bytes long, _n long, ends array<long>"), "shard-plan")
    plan = F.broadcast(ends) if len(dealt) * shards <= MAX_BROADCAST * 16 else ends
    ranked = numbered(groups, plan, "bytes", ["group"], "_k").join(plan.select("bytes", "ends"), "bytes")
    placed = C.written(ranked.select("group", "copies", F.size(F.filter("ends", lambda e: e <= F.col("_k"))).alias("shard")), "shard-groups-placed")
    n = rows.count()
    first = F.broadcast(placed.where(F.col("copies") * hot > n).select("group", "shard"))  # fewer than hot rows
    out = rows.join(first, "group", "left")
    own = ["group", *[c for c in rows.columns if c != "group"], "shard"]
    rest = out.where("shard IS NULL").drop("shard").join(placed.where(F.col("copies") * hot <= n).select("group", "shard"), "group")
    out = C.written(out.where("shard IS NOT NULL").select(own).unionAll(rest.select(own)), "shard-placed")
    return numbered(out, F.broadcast(out.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))), "shard", [id_col, "group"], "slot")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = lambda: shard(C.table(spark, sf_dir, "documents"))
    return C.settled(out, "op6").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
