"""Greedy suppression and peaks. The order is total (weight, then id), and the result that of the one-by-one sweep.

Rounds instead of a sweep: a point whose better neighbours are all decided is decided at once, so groups of any size run
as joins over the pairs within the scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.points import XYZ, pairs_within
from quadrat.operators.tables import compare
from quadrat.storage import settling, written


def suppressed(points: DataFrame, scale: float, keys: Sequence[str], weight: str | None = None, id_col: str = "part_id", axes: Sequence[str] = XYZ, skip_zero: bool = False) -> DataFrame:
    """The points that a sweep by falling weight (then id) keeps: each one kept suppresses all nearer than scale.

    skip_zero: the graph variant, where 0 < distance <= scale suppresses and coincident points do not.
    """
    w = F.lit(0.0) if weight is None else F.col(weight).cast("double")
    p = points.withColumn("_w", w)
    pairs = pairs_within(p, p, scale, keys, axes, strict=not skip_zero)
    if skip_zero:
        pairs = pairs.where("dist > 0")
    a, b = f"a.{id_col}", f"b.{id_col}"
    better = (F.col("a._w") > F.col("b._w")) | ((F.col("a._w") == F.col("b._w")) & (F.col(a) < F.col(b)))
    vertex = lambda c: F.struct(*keys, F.col(c).alias(id_col))  # noqa: E731  (ids may start anew in each key)
    kept = settled_rounds(pairs.where(better).select(vertex(a).alias("over"), vertex(b).alias("id")), points.select(vertex(id_col).alias("id")))
    return points.join(kept.select("id.*"), [*keys, id_col], "left_semi")


@settling
def settled_rounds(over: DataFrame, items: DataFrame) -> DataFrame:
    """Of (over, id) rows, where over comes first and suppresses id if it stays: the items (id) that a sweep in this order keeps."""
    over = written(over)
    kept, open_ = None, written(items)
    while True:
        # free: no open item comes before; they stay, and what they suppress goes
        live = over.join(open_.withColumnRenamed("id", "over"), "over", "left_semi")
        free = written(open_.join(live.select("id").distinct(), "id", "left_anti"))
        kept = free if kept is None else kept.unionAll(free)
        gone = over.join(free.withColumnRenamed("id", "over"), "over", "left_semi").select("id").distinct()
        open_ = written(open_.join(free, "id", "left_anti").join(gone, "id", "left_anti"))
        if open_.isEmpty():
            return kept


def property_peaks(points: DataFrame, prop: str, least: float, scale: float, n_scale: float, n_least: int, keys: Sequence[str], id_col: str = "part_id") -> DataFrame:
    """Peaks by falling prop: above the threshold, with n_least points (itself too) at most n_scale away, suppressing within scale."""
    near = pairs_within(points, points, n_scale, keys).groupBy(*keys, F.col(f"a.{id_col}").alias(id_col)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n_least).drop("_n")
    return suppressed(points.where(F.col(prop) >= least).join(near, [*keys, id_col], "left_semi"), scale, keys, prop, id_col)


def percentile_cut(df: DataFrame, column: str, p: float, op: str, keys: Sequence[str]) -> DataFrame:
    """Rows that compare with their key's percentile (0 to 100, linear)."""
    cut = df.groupBy(*keys).agg(F.percentile(column, p / 100).alias("_p"))
    return df.join(cut, list(keys)).where(compare(F.col(column), op, F.col("_p"))).select(df.columns)


def cluster_peaks(labelled: DataFrame, weight: str, cluster: str = "cluster", keys: Sequence[str] = ()) -> DataFrame:
    """One point for each cluster (labels of 0 and more): the one with the largest weight, ties to the smaller id."""
    return labelled.where(F.col(cluster) >= 0).groupBy(*keys, cluster).agg(F.min(F.struct(-F.col(weight), "id")).alias("_b")).select(*keys, cluster, F.col("_b.id").alias("id"))
