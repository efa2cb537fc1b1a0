"""Connected components of an edge table by alternating large-star and small-star steps, all as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.storage import discard, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", F.least("u", "m").alias("m"))
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    near = edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    return near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of any orderable type -> (u, root): a row for each vertex that has an edge; the root is the component's least.

    Each round is written to the shared folder, so the lineage stays short, and the one before is deleted. Hubs are split by
    skew joins, and minima are summed map-side. Self loops and nulls have no effect; an empty table gives no rows.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        r = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s")).first()
        if (r.n, r.h, r.s) == state or not r.n:
            break
        state = (r.n, r.h, r.s)
        before, now = now, written(_small(_large(now).distinct()), "edges")
        discard(before)
    return now.select("u", F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
