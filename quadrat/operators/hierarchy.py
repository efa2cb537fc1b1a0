"""Nested segments: (id, level, parent_id) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.storage import settling, written


def children(nodes: DataFrame) -> DataFrame:
    """id, n_children."""
    c = nodes.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.select("id").join(c, "id", "left").select("id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


@settling
def ancestors(nodes: DataFrame) -> DataFrame:
    """id, ancestor, steps: a round for each level of the tree."""
    up = written(nodes.where("parent_id IS NOT NULL").select("id", "parent_id"))
    now = up.select("id", F.col("parent_id").alias("ancestor"), F.lit(1).cast("long").alias("steps"))
    out = now
    while True:
        p = up.select(F.col("id").alias("ancestor"), F.col("parent_id").alias("_p"))
        now = written(now.join(p, "ancestor").select("id", F.col("_p").alias("ancestor"), (F.col("steps") + 1).alias("steps")))
        if now.isEmpty():
            return out
        out = out.unionByName(now)


def at_level(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.where(F.col("level") == level)


def new_ids(nodes: DataFrame) -> DataFrame:
    """Ids without a child: those that first appear at their level."""
    return nodes.select("id").join(nodes.select(F.col("parent_id").alias("id")), "id", "left_anti")


@settling
def branch_tops(nodes: DataFrame) -> DataFrame:
    """id, top: from each childless node up while the parent has a single child."""
    single = nodes.groupBy("parent_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1 AND parent_id IS NOT NULL").select(F.col("parent_id").alias("_s"))
    up = written(nodes.join(single, nodes["parent_id"] == F.col("_s"), "left_semi").select(F.col("id").alias("top"), F.col("parent_id").alias("_p")))
    now = written(new_ids(nodes).select("id", F.col("id").alias("top")))
    while True:
        moved = written(now.join(up, "top", "left").select("id", F.coalesce("_p", "top").alias("top"), F.col("_p").isNotNull().alias("_m")))
        now = moved.drop("_m")
        if moved.where("_m").isEmpty():
            return now


def without(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """nodes without the removed ids; children go to their nearest ancestor that stays."""
    removed = removed.select("id").distinct()
    kept = nodes.join(removed, "id", "left_anti")
    a = ancestors(nodes).join(removed.withColumnRenamed("id", "ancestor"), "ancestor", "left_anti")
    nearest = a.groupBy("id").agg(F.min_by("ancestor", "steps").alias("parent_id"))
    return kept.drop("parent_id").join(nearest, "id", "left").select(nodes.columns)


def without_level(nodes: DataFrame, level: int) -> DataFrame:
    out = without(nodes, at_level(nodes, level))
    return out.withColumn("level", F.when(F.col("level") > level, F.col("level") - 1).otherwise(F.col("level")))


def is_flat(nodes: DataFrame) -> DataFrame:
    return nodes.agg((F.countDistinct("level") <= 1).alias("flat"))


def keep(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes with the given ids only; children go to their nearest ancestor that stays."""
    return without(nodes, nodes.select("id").join(ids.select("id"), "id", "left_anti"))


def pop_level(nodes: DataFrame, which: str = "top") -> DataFrame:
    """nodes without their top (highest) or bottom (level 0) level; levels are counted anew from 0."""
    r = nodes.agg(F.min("level").alias("low"), F.max("level").alias("high")).first()
    if r.low is None:
        return nodes
    return without_level(nodes, r.high if which == "top" else r.low)


def only_levels(nodes: DataFrame, low: int, high: int) -> DataFrame:
    """nodes of the levels low to high: all lower and all higher ones are removed, parents outside are null."""
    inside = nodes.where(F.col("level").between(low, high))
    own = inside.select(F.col("id").alias("parent_id"), F.lit(True).alias("_in"))
    return inside.join(own, "parent_id", "left").withColumn("parent_id", F.when(F.col("_in"), F.col("parent_id"))).select(nodes.columns)


def add_level(nodes: DataFrame, segments: DataFrame, overlaps: DataFrame, shift: int = 0) -> DataFrame:
    """nodes with a level more, which holds all others: segments (id) as parents of the nodes without one, by overlaps (id, above). Their ids are shifted."""
    top = nodes.agg(F.max("level")).first()[0]
    new = segments.select((F.col("id") + shift).alias("id"), F.lit((top if top is not None else -1) + 1).cast(nodes.schema["level"].dataType).alias("level"), F.lit(None).cast(nodes.schema["parent_id"].dataType).alias("parent_id"))
    up = overlaps.select("id", (F.col("above") + shift).alias("_p"))
    own = nodes.join(up, "id", "left").withColumn("parent_id", F.coalesce("parent_id", "_p")).select("id", "level", "parent_id")
    return own.unionByName(new)


def lower(nodes: DataFrame, top: DataFrame, depth: int | None = None) -> DataFrame:
    """id, below, steps: the nodes under each of the given ones (id), at most depth steps down."""
    a = ancestors(nodes).join(top.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return (a if depth is None else a.where(F.col("steps") <= depth)).select(F.col("ancestor").alias("id"), F.col("id").alias("below"), "steps")


def distances(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, dist: steps over the nearest common ancestor of each pair (a, b); no row where there is none."""
    up = ancestors(nodes)
    every = up.unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("steps")))
    left = pairs.join(every.select(F.col("id").alias("a"), "ancestor", F.col("steps").alias("_s")), "a")
    both = left.join(every.select(F.col("id").alias("b"), "ancestor", F.col("steps").alias("_t")), ["b", "ancestor"])
    return both.groupBy("a", "b").agg(F.min(F.col("_s") + F.col("_t")).alias("dist"))


def overlap_ids(segments: DataFrame, level: DataFrame, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """keys, id, above, n: the level's segment that shares most voxels with each segment; ties to the least."""
    b = level.where("label > 0").select(*keys, *axes, F.col("label").alias("above"))
    n = segments.where("label > 0").join(b, [*keys, *axes]).groupBy(*keys, F.col("label").alias("id"), "above").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "above"))
    return n.groupBy(*keys, "id").agg(best.alias("_b")).select(*keys, "id", F.col("_b.above").alias("above"), (-F.col("_b.m")).alias("n"))
