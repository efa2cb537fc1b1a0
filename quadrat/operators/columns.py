"""Columns: co-localisation of three layers of particles. Rows: layer (1, 2, 3), tomo_id, part_id, x, y, z."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.clusters import single_linkage
from quadrat.operators.points import pairs_within
from quadrat.storage import discard, settling, written


def layer_clusters(points: DataFrame, radius: float) -> DataFrame:
    """points with cluster: single linkage of each layer and tomogram at the radius; one point each if it is 0 or less."""
    c = single_linkage(points, radius, ["layer", "tomo_id"]).withColumnRenamed("id", "part_id")
    return points.join(c, ["layer", "tomo_id", "part_id"])


def alignment(clusters: DataFrame, upper: int, lower: int, radius: float, axes=("x", "y")) -> DataFrame:
    """tomo_id, upper, lower, n: pairs of particles of two layers' clusters that lie within radius of each other, seen along z."""
    a, b = clusters.where(F.col("layer") == upper), clusters.where(F.col("layer") == lower)
    p = pairs_within(a, b, radius, ["tomo_id"], axes)
    return p.groupBy("tomo_id", F.col("a.cluster").alias("upper"), F.col("b.cluster").alias("lower")).agg(F.count(F.lit(1)).alias("n"))


def build(clusters: DataFrame, radius: float) -> DataFrame:
    """tomo_id, column (cluster of layer 1), layer, cluster: clusters of layers 2 and 3 go to the layer 1 cluster with most aligned pairs
    (ties to the least); columns with all three layers are kept."""
    parts = None
    for k in (2, 3):
        best = alignment(clusters, 1, k, radius).groupBy("tomo_id", "lower").agg(F.min(F.struct(-F.col("n"), "upper")).alias("_b"))
        part = best.select("tomo_id", F.col("_b.upper").alias("column"), F.lit(k).alias("layer"), F.col("lower").alias("cluster"))
        parts = part if parts is None else parts.unionAll(part)
    whole = parts.groupBy("tomo_id", "column").agg(F.countDistinct("layer").alias("_n")).where("_n = 2").drop("_n")
    return whole.withColumns({"layer": F.lit(1), "cluster": F.col("column")}).unionByName(parts.join(whole, ["tomo_id", "column"], "left_semi"))


def sub_columns(clusters: DataFrame, radius: float) -> DataFrame:
    """tomo_id, c1, c2, c3: every combination of a layer 1 cluster with aligned clusters of layers 2 and 3 (not exclusive)."""
    two = alignment(clusters, 1, 2, radius).select("tomo_id", F.col("upper").alias("c1"), F.col("lower").alias("c2"))
    three = alignment(clusters, 1, 3, radius).select("tomo_id", F.col("upper").alias("c1"), F.col("lower").alias("c3"))
    return two.join(three, ["tomo_id", "c1"])


def particles(columns: DataFrame, clusters: DataFrame) -> DataFrame:
    """Particles in columns, with their column; all others are dropped."""
    return clusters.join(columns, ["tomo_id", "layer", "cluster"])


def counts(members: DataFrame) -> DataFrame:
    """tomo_id, n_columns, n_particles."""
    return members.groupBy("tomo_id").agg(F.countDistinct("column").alias("n_columns"), F.countDistinct("layer", "part_id").alias("n_particles"))


def overlap(members: DataFrame, other: DataFrame, radius: float) -> DataFrame:
    """Layer 1 particles of members with overlaps: whether a layer 1 particle of the other finder's columns lies within radius."""
    a, b = members.where("layer = 1"), other.where("layer = 1")
    near = pairs_within(a, b, radius, ["tomo_id"]).select("tomo_id", F.col("a.part_id").alias("part_id")).distinct().withColumn("_o", F.lit(True))
    return a.join(near, ["tomo_id", "part_id"], "left").withColumn("overlaps", F.coalesce("_o", F.lit(False))).drop("_o")


def near_columns(members: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """points with near: whether a member of a column of the same tomogram is at most radius away, seen along z."""
    hit = pairs_within(points, members, radius, ["tomo_id"], ("x", "y")).select("tomo_id", F.col("a.part_id").alias("part_id")).distinct().withColumn("near", F.lit(True))
    return points.join(hit, ["tomo_id", "part_id"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def count_where(columns: DataFrame, condition) -> DataFrame:
    """tomo_id, n: columns whose properties meet a condition."""
    return columns.groupBy("tomo_id").agg(F.count_if(condition).alias("n"))


MOST = 1_000_000  # aligned pairs of a tomogram that one task sweeps; larger ones go by rounds


@settling
def exclusive_sub_columns(clusters: DataFrame, radius: float) -> DataFrame:
    """tomo_id, c1, c2, c3: sub-columns in which each cluster takes part once: those with most aligned pairs (both sides' sum) come first, ties to the least clusters.

    Both ways work on the aligned pairs, not on their combinations: a layer 1 cluster's best open sub-column is made of its
    best open pair on each side.
    """
    sides = [alignment(clusters, 1, k, radius).select("tomo_id", F.lit(k).alias("k"), F.col("upper").alias("c1"), F.col("lower").alias("c"), "n") for k in (2, 3)]
    pairs = written(sides[0].unionByName(sides[1]))
    large = written(pairs.groupBy("tomo_id").count().where(F.col("count") > MOST).select("tomo_id"))
    kind = {c: pairs.schema[c].dataType.simpleString() for c in ("tomo_id", "c")}
    swept = pairs.join(large, "tomo_id", "left_anti").groupBy("tomo_id").applyInPandas(_sweep, f"tomo_id {kind['tomo_id']}, c1 {kind['c']}, c2 {kind['c']}, c3 {kind['c']}")
    return swept if large.isEmpty() else swept.unionByName(_rounds(pairs.join(large, "tomo_id", "left_semi")))


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sub-columns of a tomogram's pairs (k, c1, c, n), one by one."""
    order = pdf.assign(m=-pdf["n"]).sort_values(["c1", "m", "c"])
    sides = {k: {c1: (g["m"].to_numpy(), g["c"].to_numpy()) for c1, g in order[order["k"] == k].groupby("c1")} for k in (2, 3)}
    at = {k: dict.fromkeys(s, 0) for k, s in sides.items()}
    used: dict[int, set] = {2: set(), 3: set()}

    def best(c1):
        m, cs = 0, []
        for k in (2, 3):
            ms, ids = sides[k][c1]
            while at[k][c1] < len(ids) and ids[at[k][c1]] in used[k]:
                at[k][c1] += 1
            if at[k][c1] == len(ids):
                return None
            m += ms[at[k][c1]]
            cs.append(ids[at[k][c1]])
        return (m, c1, *cs)

    heap = [best(c1) for c1 in sides[2] if c1 in sides[3]]
    heapq.heapify(heap)
    kept = []
    while heap:
        _, c1, c2, c3 = heapq.heappop(heap)
        if c2 in used[2] or c3 in used[3]:
            if (again := best(c1)) is not None:
                heapq.heappush(heap, again)
            continue
        used[2].add(c2)
        used[3].add(c3)
        kept.append((pdf["tomo_id"].iloc[0], c1, c2, c3))
    return pd.DataFrame(kept, columns=["tomo_id", "c1", "c2", "c3"])


def _rounds(pairs: DataFrame) -> DataFrame:
    """The same by rounds: a layer 1 cluster's best sub-column stays if it is also the best that its two other clusters can have; then all pairs of its three clusters go."""
    sides = {k: written(pairs.where(F.col("k") == k).select("tomo_id", "c1", F.col("c").alias(f"c{k}"), "n")) for k in (2, 3)}
    kept = None
    while True:
        best = {k: s.groupBy("tomo_id", "c1").agg(F.min(F.struct((-F.col("n")).alias("m"), f"c{k}")).alias("_b")).select("tomo_id", "c1", F.col("_b.m").alias(f"m{k}"), f"_b.c{k}") for k, s in sides.items()}
        top = written(best[2].join(best[3], ["tomo_id", "c1"]))
        if top.isEmpty():
            return top.select("tomo_id", "c1", "c2", "c3") if kept is None else kept
        stays = top
        for k, other in ((2, "m3"), (3, "m2")):
            open_ = sides[k].join(top.select("tomo_id", "c1", other), ["tomo_id", "c1"])
            first = open_.groupBy("tomo_id", f"c{k}").agg(F.min(F.struct((F.col(other) - F.col("n")).alias("m"), "c1")).alias("_f"))
            stays = stays.join(first.select("tomo_id", f"c{k}", "_f.c1"), ["tomo_id", f"c{k}", "c1"], "left_semi")
        stays = written(stays.select("tomo_id", "c1", "c2", "c3"))
        kept = stays if kept is None else kept.unionByName(stays)
        for k, s in sides.items():
            left = s.join(top.select("tomo_id", "c1"), ["tomo_id", "c1"], "left_semi")
            for c in ("c1", f"c{k}"):
                left = left.join(stays.select("tomo_id", c), ["tomo_id", c], "left_anti")
            sides[k] = written(left)
            discard(s)
