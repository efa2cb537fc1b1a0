"""Voxel tables: (tomo_id, x, y, z, value, label) rows; neighbours by equi-joins on shifted coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.operators.components import components
from quadrat.operators.points import XYZ
from quadrat.operators.tables import compare


def offsets(connectivity: int, axes: int = 3) -> list[tuple[int, ...]]:
    """Neighbour offsets: connectivity 1 (faces), 2 (and edges), 3 (and corners)."""
    return [d for d in product((-1, 0, 1), repeat=axes) if 0 < sum(map(abs, d)) <= connectivity]


def thresholded(voxels: DataFrame, op: str, value) -> DataFrame:
    return voxels.where(compare(F.col("value"), op, value))


def neighbour_pairs(voxels: DataFrame, connectivity: int = 1, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, a, b: ordered pairs of neighbouring voxel rows. One explode of fixed width and one equi-join."""
    shift = F.explode(F.array(*[F.struct(*[F.lit(s).alias(c) for s, c in zip(d, axes)]) for d in offsets(connectivity, len(axes))]))
    a = voxels.select(*keys, F.struct("*").alias("a"), shift.alias("_d")).select(*keys, "a", *[(F.col(f"a.{c}") + F.col(f"_d.{c}")).alias(c) for c in axes])
    return a.join(voxels.select(*keys, *axes, F.struct("*").alias("b")), [*keys, *axes]).select(*keys, "a", "b")


def contacts(voxels: DataFrame, boundaries: DataFrame, connectivity: int = 1, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, segment_id, boundary_id, n: voxels of labelled segments next to labelled boundaries, each voxel once for each boundary."""
    s = voxels.where("label > 0").withColumn("_kind", F.lit(0))
    both = s.unionByName(boundaries.where("label > 0").withColumn("_kind", F.lit(1)))
    p = neighbour_pairs(both, connectivity, keys, axes).where("a._kind = 0 AND b._kind = 1")
    one = p.select(*keys, F.col("a.label").alias("segment_id"), F.col("b.label").alias("boundary_id"), *[f"a.{c}" for c in axes]).distinct()
    return one.groupBy(*keys, "segment_id", "boundary_id").agg(F.count(F.lit(1)).alias("n"))


def labelled(voxels: DataFrame, connectivity: int = 1, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """voxels with component: the least (coordinates) voxel it is connected to, as a struct."""
    vid = lambda r: F.struct(*[F.col(f"{r}{c}").alias(c) for c in (*keys, *axes)])
    e = neighbour_pairs(voxels, connectivity, keys, axes).select(vid("a.").alias("u"), vid("b.").alias("v")).where("u < v")
    roots = components(e)
    own = voxels.withColumn("u", vid(""))
    return own.join(roots, "u", "left").withColumn("component", F.coalesce("root", "u")).drop("u", "root")


def label_stats(voxels: DataFrame, keys: Sequence[str] = ("label",), total: bool = False) -> DataFrame:
    """keys, mean, std (n - 1), min, max, volume; total: and the row of all labels, under 0."""
    agg = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("volume")]
    out = voxels.groupBy(*keys).agg(*agg)
    return out.unionByName(voxels.agg(*agg).withColumns({k: F.lit(0) for k in keys})) if total else out


def extremum_positions(voxels: DataFrame, keys: Sequence[str] = ("label",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, at_min, at_max: coordinates of each label's extremes, ties to the least ones."""
    at = F.struct(*axes)
    return voxels.groupBy(*keys).agg(F.min(F.struct("value", at.alias("p"))).alias("_a"), F.min(F.struct((-F.col("value")).alias("v"), at.alias("p"))).alias("_b")).select(*keys, F.col("_a.p").alias("at_min"), F.col("_b.p").alias("at_max"))


def merged_stats(stats: DataFrame, keys: Sequence[str], to: str) -> DataFrame:
    """Statistics of merged segments: mean weighted by volume, std pooled (over n)."""
    v, m = F.col("volume"), F.col("mean")
    s = stats.groupBy(to, *[k for k in keys if k != to]).agg(F.sum(v).alias("volume"), (F.sum(v * m) / F.sum(v)).alias("mean"), (F.sum((v - 1) * F.coalesce(F.col("std") * F.col("std"), F.lit(0.0)) + v * m * m) / F.sum(v)).alias("_q"), F.min("min").alias("min"), F.max("max").alias("max"))
    return s.withColumn("std", F.sqrt(F.greatest(F.col("_q") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("_q")


def morphology(voxels: DataFrame, keys: Sequence[str] = ("tomo_id", "label"), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, volume, surface (voxels with a face neighbour outside the label), centre coordinates."""
    p = neighbour_pairs(voxels, 1, keys, axes).groupBy(*keys, *[F.col(f"a.{c}").alias(c) for c in axes]).agg(F.count(F.lit(1)).alias("_n"))
    own = voxels.join(p, [*keys, *axes], "left")
    full = 2 * len(axes)
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("volume"), F.count_if(F.coalesce("_n", F.lit(0)) < full).alias("surface"), *[F.avg(c).alias(f"c{c}") for c in axes])


def euler(voxels: DataFrame, keys: Sequence[str] = ("label",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, euler: of the labels' voxels as closed cubes: sum of (-1)^d over their distinct faces of dimension d."""
    d = len(axes)
    faces = [f for f in product((-1, 0, 1), repeat=d)]
    cell = F.explode(F.array(*[F.struct(*[(2 * F.col(c) + F.lit(s)).alias(c) for c, s in zip(axes, f)], F.lit(f.count(0)).alias("dim")) for f in faces]))
    distinct = voxels.select(*keys, cell.alias("f")).distinct()
    return distinct.groupBy(*keys).agg(F.sum(F.when(F.col("f.dim") % 2 == 0, 1).otherwise(-1)).alias("euler"))


def layers(distances: DataFrame, n: int) -> DataFrame:
    """distances (d1, d2 to two boundaries) with layer: n equal layers from the first boundary, from 1."""
    share = F.col("d1") / F.nullif(F.col("d1") + F.col("d2"), F.lit(0.0))
    return distances.withColumn("layer", F.least(F.floor(share * n), F.lit(n - 1)).cast("long") + 1)


def boundary_distances(voxels: DataFrame, boundary: DataFrame, keys: Sequence[str] = ("tomo_id",), id_col: str = "vid", axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, id, dist: each voxel's distance to its nearest boundary voxel."""
    from quadrat.operators.points import knn

    return knn(voxels, boundary, 1, keys, id_col, id_col, axes).select(*keys, "id", "dist")


def region_distance(voxels: DataFrame, region: DataFrame, mode: str = "min", keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, label, dist of each label to a region: the min or mean over its voxels, or that of its centre."""
    from quadrat.operators.points import knn

    if mode == "center":
        voxels = voxels.groupBy(*keys, "label").agg(*[F.avg(c).alias(c) for c in axes]).withColumn("vid", F.col("label").cast("long"))
    d = knn(voxels, region, 1, keys, "vid", "vid", axes).join(voxels.select(*keys, F.col("vid").alias("id"), "label"), [*keys, "id"])
    return d.groupBy(*keys, "label").agg((F.avg if mode == "mean" else F.min)("dist").alias("dist"))


def normalised(voxels: DataFrame, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """Values less their mean over their standard deviation (population), by tomogram. Sums are map-side."""
    s = voxels.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return voxels.join(s, list(keys)).withColumn("value", (F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def linear_map(voxels: DataFrame, low: float, high: float, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    s = voxels.groupBy(*keys).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    return voxels.join(s, list(keys)).withColumn("value", (F.col("value") - F.col("_a")) * (high - low) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) + low).drop("_a", "_b")


def clipped(voxels: DataFrame, low: float, high: float) -> DataFrame:
    return voxels.withColumn("value", F.greatest(F.least(F.col("value"), F.lit(high)), F.lit(low)))


def binned(voxels: DataFrame, n: int, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """Means of cubes of n voxels a side."""
    return voxels.groupBy(*keys, *[F.floor(F.col(c) / n).alias(c) for c in axes]).agg(F.avg("value").alias("value"))


def cropped(voxels: DataFrame, label: int, margin: int, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """Voxels in the bounding box of a label, with a margin."""
    box = voxels.where(F.col("label") == label).groupBy(*keys).agg(*[f(c).alias(f"{m}{c}") for c in axes for m, f in (("_lo", F.min), ("_hi", F.max))])
    out = voxels.join(box, list(keys))
    for c in axes:
        out = out.where(F.col(c).between(F.col(f"_lo{c}") - margin, F.col(f"_hi{c}") + margin))
    return out.select(voxels.columns)


def decimated_slices(voxels: DataFrame, ratio: int, axis: str = "z", keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """Every ratio-th slice along an axis, by the slices' rank. Ranked over the table of slices."""
    s = voxels.select(*keys, axis).distinct().withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(axis)) - 1).where(F.col("_k") % ratio == 0).drop("_k")
    return voxels.join(s, [*keys, axis], "left_semi")


def threshold_hierarchy(voxels: DataFrame, thresholds: Sequence[float], connectivity: int = 1, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, level, component, volume, parent: segments of value <= threshold at each level; the parent is the segment of the next level that holds them."""
    before, out = None, None
    for level, t in enumerate(sorted(thresholds)):
        own = labelled(voxels.where(F.col("value") <= t), connectivity, keys, axes).select(*keys, *axes, F.col("component").alias("_c"))
        if before is not None:
            up = before.join(own, [*keys, *axes]).groupBy(*keys, F.col("_b").alias("component")).agg(F.count(F.lit(1)).alias("volume"), F.min("_c").alias("parent")).withColumn("level", F.lit(level - 1))
            out = up if out is None else out.unionByName(up)
        before = own.withColumnRenamed("_c", "_b")
    top = before.groupBy(*keys, F.col("_b").alias("component")).agg(F.count(F.lit(1)).alias("volume")).withColumn("parent", F.lit(None)).withColumn("level", F.lit(len(thresholds) - 1))
    return top if out is None else out.unionByName(top.withColumn("parent", F.lit(None).cast(out.schema["parent"].dataType)))


# Labels


def keep_labels(voxels: DataFrame, ids: Sequence[int], keep: bool = True, value: int = 0) -> DataFrame:
    """Voxels with all other labels (or, not keep, these) set to value."""
    inside = F.col("label").isin(list(ids))
    return voxels.withColumn("label", F.when(inside if keep else ~inside, F.col("label")).otherwise(F.lit(value)))


def restricted(voxels: DataFrame, mask: DataFrame, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ, value: int = 0) -> DataFrame:
    """Voxels with the labels outside a mask set to value."""
    m = mask.select(*keys, *axes).distinct().withColumn("_in", F.lit(True))
    return voxels.join(m, [*keys, *axes], "left").withColumn("label", F.when(F.col("_in"), F.col("label")).otherwise(F.lit(value))).drop("_in")


def mask_and(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """Voxels of both masks."""
    return a.join(b.select(*keys, *axes), [*keys, *axes], "left_semi")


def mask_minus(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    return a.join(b.select(*keys, *axes), [*keys, *axes], "left_anti")


def added(old: DataFrame, new: DataFrame, shift: int | None = None, remove_overlap: bool = False, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """Segments of two label tables (label > 0): new ids are shifted (by the greatest old one, by default). Where both have a
    voxel the old one keeps it; remove_overlap: new segments that meet an old one are left out whole."""
    old, new = old.where("label > 0"), new.where("label > 0")
    shift = shift if shift is not None else old.agg(F.max("label")).first()[0] or 0
    meets = new.join(old.select(*keys, *axes), [*keys, *axes], "left_semi")
    kept = new.join(meets.select(*keys, "label").distinct(), [*keys, "label"], "left_anti") if remove_overlap else mask_minus(new, old, keys, axes)
    names = [*keys, *axes, "label"]
    return old.select(names).unionByName(kept.withColumn("label", F.col("label") + shift).select(names))


def magnified(voxels: DataFrame, factor: int, axes: Sequence[str] = XYZ) -> DataFrame:
    """Each voxel as a cube of factor voxels a side."""
    for c in axes:
        voxels = voxels.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(c, F.col(c) * factor + F.col(f"_{c}")).drop(f"_{c}")
    return voxels


def contrast(voxels: DataFrame, n: float, low: float, high: float, keys: Sequence[str] = ("tomo_id",), mask: str | None = None) -> DataFrame:
    """mean - n std to mean + n std (population; of the mask's voxels, if given) mapped to low and high, and cut there."""
    inside = F.col("value") if mask is None else F.when(F.col(mask), F.col("value"))
    s = voxels.groupBy(*keys).agg(F.avg(inside).alias("_m"), F.stddev_pop(inside).alias("_s"))
    v = (F.col("value") - (F.col("_m") - n * F.col("_s"))) / F.nullif(2 * n * F.col("_s"), F.lit(0.0)) * (high - low) + low
    return voxels.join(s, list(keys)).withColumn("value", F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))).drop("_m", "_s")


def log_map(voxels: DataFrame, base: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """log(value) to a base, cut to [low, high] if given; null where value is not positive."""
    v = F.log("value") / math.log(base)
    v = v if low is None else F.greatest(v, F.lit(float(low)))
    return voxels.withColumn("value", F.when(F.col("value") > 0, v if high is None else F.least(v, F.lit(float(high)))))


def labelled_by_bins(voxels: DataFrame, bins: dict[str, Sequence[float]]) -> DataFrame:
    """voxels with label: the number (from 1) of their bin, over the product of all columns' bins, first column slowest; 0 outside."""
    from quadrat.operators.tables import bins as bin_of

    out = F.lit(0)
    for c, edges in bins.items():
        out = out * (len(edges) - 1) + bin_of(F.col(c), edges)
    return voxels.withColumn("label", F.coalesce(out + 1, F.lit(0)).cast("long"))


def by_volume(voxels: DataFrame, low: int | None = None, high: int | None = None, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, label, volume of the labels (> 0) with low to high voxels (ends belong to it; null: open)."""
    n = voxels.where("label > 0").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("volume"))
    return n.where(F.col("volume").between(low if low is not None else 0, high if high is not None else 1 << 62))


def by_surface_ratio(voxels: DataFrame, low: float, high: float, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, label, ratio of the labels whose surface over volume is within [low, high]."""
    m = morphology(voxels.where("label > 0"), [*keys, "label"], axes)
    return m.withColumn("ratio", F.col("surface") / F.col("volume")).where(F.col("ratio").between(low, high)).select(*keys, "label", "ratio")


def classes_by_volume(voxels: DataFrame, edges: Sequence[float], keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, label, class: the bin of each label's volume, null outside."""
    from quadrat.operators.tables import bins as bin_of

    return by_volume(voxels, keys=keys).withColumn("class", bin_of(F.col("volume"), edges)).where("class IS NOT NULL").select(*keys, "label", "class")


def surfaces(voxels: DataFrame, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ, inner: bool = False) -> DataFrame:
    """Voxels of a label with a face neighbour that isn't of it (inner: the others, the interiors)."""
    own = voxels.where("label > 0")
    p = neighbour_pairs(own, 1, [*keys, "label"], axes).groupBy(*keys, "label", *[F.col(f"a.{c}").alias(c) for c in axes]).agg(F.count(F.lit(1)).alias("_n"))
    full = F.coalesce(F.col("_n"), F.lit(0)) == 2 * len(axes)
    return own.join(p, [*keys, "label", *axes], "left").where(full if inner else ~full).select(voxels.columns)


def neighbourhoods(voxels: DataFrame, region: DataFrame, distance: float, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ, remove_overlap: bool = False) -> DataFrame:
    """keys, axes, label: the region's voxels at most distance from each label; remove_overlap: without those of two labels."""
    from quadrat.operators.points import pairs_within

    p = pairs_within(region, voxels.where("label > 0"), distance, keys, axes).select(*keys, *[F.col(f"a.{c}").alias(c) for c in axes], F.col("b.label").alias("label")).distinct()
    if remove_overlap:
        alone = p.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        p = p.join(alone, [*keys, *axes], "left_semi")
    return p


def neighbourhood_density(voxels: DataFrame, region: DataFrame, distance: float, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, label, mean, std, n of the region's values around each label."""
    n = neighbourhoods(voxels, region, distance, keys, axes).join(region.select(*keys, *axes, "value"), [*keys, *axes])
    return n.groupBy(*keys, "label").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))


def free_region(region: DataFrame, voxels: DataFrame, size: float, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """The region's voxels farther than size from all labels."""
    return mask_minus(region, neighbourhoods(voxels, region, size, keys, axes), keys, axes)


def density_in_layers(voxels: DataFrame, layers: DataFrame, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, layer, n, mean, std and the least layer mean's share (relative, of the mean of all): voxels by their layer."""
    j = voxels.select(*keys, *axes, "value").join(layers.select(*keys, *axes, "layer"), [*keys, *axes])
    out = j.groupBy(*keys, "layer").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    every = F.sum(F.col("mean") * F.col("n")).over(W.partitionBy(*keys)) / F.sum("n").over(W.partitionBy(*keys))
    return out.withColumn("relative", F.col("mean") / every)


def layers_by_columns(layers: DataFrame, columns: DataFrame, n_columns: int, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, axes, label: (layer - 1) * n_columns + column for voxels of both."""
    j = layers.select(*keys, *axes, "layer").join(columns.select(*keys, *axes, "column"), [*keys, *axes])
    return j.select(*keys, *axes, ((F.col("layer") - 1) * n_columns + F.col("column")).alias("label"))


def radial_columns(voxels: DataFrame, centres: DataFrame, edges: Sequence[float], keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """voxels with column (from 1): the ring of their distance, in the plane, from their layer's centre (keys, layer, cx, cy); 0 outside."""
    from quadrat.operators.tables import bins as bin_of

    j = voxels.join(centres, [*keys, "layer"])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return j.withColumn("_r", F.sqrt(dx * dx + dy * dy)).withColumn("column", F.coalesce(bin_of(F.col("_r"), edges) + 1, F.lit(0)).cast("long")).drop("_r", "cx", "cy")


def layer_centres(layers: DataFrame, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, layer, cx, cy: the voxel of each layer that is nearest to the mean of them, ties to the least."""
    m = layers.groupBy(*keys, "layer").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    d = (F.col("x") - F.col("_mx")) * (F.col("x") - F.col("_mx")) + (F.col("y") - F.col("_my")) * (F.col("y") - F.col("_my"))
    best = layers.join(m, [*keys, "layer"]).groupBy(*keys, "layer").agg(F.min(F.struct(F.round(d, 9).alias("d"), "x", "y")).alias("_b"))
    return best.select(*keys, "layer", F.col("_b.x").alias("cx"), F.col("_b.y").alias("cy"))


def cleft_width(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ, most: float | None = None) -> DataFrame:
    """keys, width (median), mean, n: distances of one boundary's voxels to the other, up to most."""
    d = boundary_distances(a, b, keys, axes=axes)
    d = d if most is None else d.where(F.col("dist") <= most)
    return d.groupBy(*keys).agg(F.percentile("dist", 0.5).alias("width"), F.avg("dist").alias("mean"), F.count(F.lit(1)).alias("n"))


def randomised(voxels: DataFrame, keys: Sequence[str] = ("tomo_id",), seed: int = 0, axes: Sequence[str] = XYZ) -> DataFrame:
    """Voxels of a mask with their values dealt anew among them: the k-th value by one hash goes to the k-th place by another."""
    at = F.struct(*keys, *axes)
    order = lambda s: [F.xxhash64(F.lit(seed), F.lit(s), at), *[F.col(c) for c in axes]]
    place = voxels.select(*keys, *axes, F.row_number().over(W.partitionBy(*keys).orderBy(*order("place"))).alias("_k"))
    value = voxels.select(*keys, "value", F.row_number().over(W.partitionBy(*keys).orderBy(*order("value"))).alias("_k"))
    return place.join(value, [*keys, "_k"]).drop("_k")


def geodesic(voxels: DataFrame, start: DataFrame, connectivity: int = 1, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, axes, dist: steps within the voxels from the start voxels; those that are not reached have no row."""
    from quadrat.operators.graphs import connectivity_distance

    vid = lambda r: F.struct(*[F.col(f"{r}{c}").alias(c) for c in (*keys, *axes)])
    e = neighbour_pairs(voxels, connectivity, keys, axes).select(vid("a.").alias("src"), vid("b.").alias("dst")).where("src < dst")
    d = connectivity_distance(voxels.select(vid("").alias("vid")), e, mask_and(start, voxels, keys, axes).select(vid("").alias("vid")).distinct())
    return d.where("steps >= 0").select("vid.*", F.col("steps").alias("dist"))


def sampled_points(voxels: DataFrame, distance: float, keys: Sequence[str] = ("tomo_id", "label"), axes: Sequence[str] = XYZ) -> DataFrame:
    """Voxels of each label no two of which are nearer than distance: greedy, by their coordinates."""
    from quadrat.operators.suppression import suppressed

    own = voxels.select(*keys, *axes, F.struct(*axes).alias("part_id"))
    return suppressed(own, distance, list(keys), axes=axes).drop("part_id")


def filled(voxels: DataFrame, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, axes: the voxels and the holes that they enclose: empty voxels of their box that no path of faces leads out of."""
    box = voxels.groupBy(*keys).agg(*[f(c).alias(f"{m}{c}") for c in axes for m, f in (("lo", F.min), ("hi", F.max))])
    for c in axes:
        box = box.withColumn(c, F.explode(F.sequence(F.col(f"lo{c}") - 1, F.col(f"hi{c}") + 1)))
    empty = mask_minus(box, voxels, keys, axes)
    rim = F.lit(False)
    for c in axes:
        rim = rim | (F.col(c) == F.col(f"lo{c}") - 1) | (F.col(c) == F.col(f"hi{c}") + 1)
    out = geodesic(empty.select(*keys, *axes), empty.where(rim).select(*keys, *axes), 1, keys, axes)
    return mask_minus(box.select(*keys, *axes), out, keys, axes)


def homology(voxels: DataFrame, keys: Sequence[str] = ("label",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, euler, objects (b0), loops (b1), holes (b2) of the voxels as closed cubes: cavities are counted in the complement, loops follow."""
    own = voxels.select(*keys, *axes)
    objects = labelled(own, len(axes), keys, axes).groupBy(*keys).agg(F.countDistinct("component").alias("objects"))
    inner = mask_minus(filled(own, keys, axes), own, keys, axes)
    holes = labelled(inner, 1, keys, axes).groupBy(*keys).agg(F.countDistinct("component").alias("holes"))
    out = euler(own, keys, axes).join(objects, list(keys)).join(holes, list(keys), "left").withColumn("holes", F.coalesce("holes", F.lit(0)))
    return out.select(*keys, "euler", "objects", (F.col("objects") + F.col("holes") - F.col("euler")).alias("loops"), "holes")


# Shapes


def balls(centres: DataFrame, shell: float | None = None, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, x, y, z, label: the voxels at most r from each centre (label, x, y, z, r); shell: of the outermost so many units only. A voxel of two is of the nearer centre, ties to the smaller label."""
    c = centres.select(*keys, "label", "r", *[F.col(a).alias(f"_{a}") for a in XYZ])
    for a in XYZ:
        c = c.withColumn(a, F.explode(F.sequence(F.ceil(F.col(f"_{a}") - F.col("r")), F.floor(F.col(f"_{a}") + F.col("r")))))
    d = F.sqrt(sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in XYZ), F.lit(0.0)))
    v = c.withColumn("_d", d).where(F.col("_d") <= F.col("r"))
    v = v if shell is None else v.where(F.col("_d") > F.col("r") - shell)
    return v.groupBy(*keys, *XYZ).agg(F.min(F.struct("_d", "label")).alias("_m")).select(*keys, *XYZ, F.col("_m.label").alias("label"))


def planes(grid: DataFrame, normal: Sequence[float], offset: float, thick: float = 1.0) -> DataFrame:
    """Voxels of a grid within half the thickness of the plane normal * x = offset."""
    n = sum(v * v for v in normal) ** 0.5
    d = sum((F.col(c) * (v / n) for c, v in zip(XYZ, normal)), F.lit(0.0)) - offset / n
    return grid.where((d >= -thick / 2) & (d < thick / 2))


def discs_to_balls(discs: DataFrame, axis: str = "z", keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, label, x, y, z, r: a ball for each label from its widest slice along an axis (ties to the lowest): that disc's centre, and the radius of its area."""
    flat = [c for c in XYZ if c != axis]
    s = discs.where("label > 0").groupBy(*keys, "label", axis).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in flat])
    best = s.groupBy(*keys, "label").agg(F.min(F.struct((-F.col("_n")).alias("m"), axis, *flat)).alias("_b"))
    return best.select(*keys, "label", *[F.col(f"_b.{c}").cast("double").alias(c) for c in XYZ], F.sqrt(-F.col("_b.m") / 3.141592653589793).alias("r"))


# Segmentation by contacts


def segments_by_contact(voxels: DataFrame, boundaries: DataFrame, ids: Sequence[int], mode: str = "at_least", connectivity: int = 1, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """voxels (of one threshold) with component, only of the components that touch the boundaries (labels) exactly, at_least all of them, or at_most them."""
    own = labelled(voxels.select(*keys, *axes), connectivity, keys, axes)
    touch = neighbour_pairs(own.withColumns({"_k": F.lit(0), "label": F.lit(0)}).select(*keys, *axes, "component", "_k", "label").unionByName(boundaries.where("label > 0").select(*keys, *axes, F.lit(None).cast(own.schema["component"].dataType).alias("component"), F.lit(1).alias("_k"), F.col("label").cast("int").alias("label"))), connectivity, keys, axes)
    pairs = touch.where("a._k = 0 AND b._k = 1").select(*keys, F.struct(F.col("a.component").alias("c")).alias("segment_id"), F.col("b.label").alias("boundary_id")).distinct()
    from quadrat.operators.contacts import segments_by_boundaries

    kept = segments_by_boundaries(pairs, ids, mode).select(F.col("segment_id.c").alias("component"))
    return own.join(kept, "component", "left_semi")


def analysis(voxels: DataFrame, thresholds: Sequence[float], least: int = 1, connectivity: int = 1, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """threshold, keys, component, volume, surface, mean, std: the segments (least voxels or more) of value <= threshold, by threshold."""
    out = None
    for t in thresholds:
        own = labelled(voxels.where(F.col("value") <= t), connectivity, keys, axes).withColumn("label", F.col("component"))
        m = morphology(own, [*keys, "label"], axes).select(*keys, "label", "volume", "surface").where(F.col("volume") >= least)
        s = own.groupBy(*keys, "label").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
        one = m.join(s, [*keys, "label"]).select(F.lit(float(t)).alias("threshold"), *keys, F.col("label").alias("component"), "volume", "surface", "mean", "std")
        out = one if out is None else out.unionByName(one)
    return out


def volumes(voxels: DataFrame, size: float = 1.0, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, tomogram (the volume of the box of all voxels), labelled, and the labels with a voxel: volumes in units of size^3."""
    box = F.lit(1.0)
    for c in axes:
        box = box * (F.max(c) - F.min(c) + 1)
    unit = size ** len(axes)
    return voxels.groupBy(*keys).agg((box * unit).alias("tomogram"), (F.count_if(F.col("label") > 0) * unit).alias("labelled"), F.countDistinct(F.when(F.col("label") > 0, F.col("label"))).alias("n_labels"))


def faces(voxels: DataFrame, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, a, b, c: the voxels' surface as triangles (structs of x, y, z), two for each face towards a voxel that isn't set; voxels reach half a unit around their centres."""
    side = []
    for k, c in enumerate(XYZ):
        u, v = XYZ[(k + 1) % 3], XYZ[(k + 2) % 3]
        for s in (-1, 1):
            corner = lambda p, q: {c: 0.5 * s, u: p * s, v: q}  # noqa: B023, E731  (turned so that normals point out)
            square = [corner(-0.5, -0.5), corner(0.5, -0.5), corner(0.5, 0.5), corner(-0.5, 0.5)]
            side.append(({c: s}, [square[:3], [square[0], square[2], square[3]]]))
    at = lambda o: F.struct(*[(F.col(c) + float(o.get(c, 0))).alias(c) for c in XYZ])
    rows = F.explode(F.array(*[F.struct(*[(F.col(c) + F.lit(d.get(c, 0))).alias(f"n{c}") for c in XYZ], F.array(*[F.struct(at(t[0]).alias("a"), at(t[1]).alias("b"), at(t[2]).alias("c")) for t in ts]).alias("t")) for d, ts in side]))
    out = voxels.select(*keys, rows.alias("f"))
    set_ = voxels.select(*keys, *[F.col(c).alias(f"_{c}") for c in XYZ])
    open_ = out.select(*keys, *[F.col(f"f.n{c}").alias(f"_{c}") for c in XYZ], "f.t").join(set_, [*keys, *[f"_{c}" for c in XYZ]], "left_anti")
    return open_.select(*keys, F.inline("t"))


def oriented_membranes(membrane: DataFrame, lumen: DataFrame, limit: float, keys: Sequence[str] = ("tomo_id",), axes: Sequence[str] = XYZ) -> DataFrame:
    """Membrane voxels with component (connected labelling) and lumen: the label of the nearest lumen voxel at most limit away from any of the component's voxels, ties to the least; components without one are left out."""
    from quadrat.operators.points import pairs_within

    own = labelled(membrane, len(axes), keys, axes)
    near = pairs_within(own, lumen.where("label > 0"), limit, keys, axes).groupBy(*keys, F.col("a.component").alias("component")).agg(F.min(F.struct("dist", F.col("b.label").alias("label"))).alias("_m"))
    return own.join(near.select(*keys, "component", F.col("_m.label").alias("lumen")), [*keys, "component"])
