"""Regions and densities: hulls, ball overlaps, local volumes of a volume of interest, interpolation, averages and correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.points import XYZ, pairs_within
from quadrat.storage import written


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of 2-D points, counter-clockwise (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hull_features(points: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """keys, n, area, perimeter, density (n / area), roundness (4 pi area / perimeter^2).

    Each task first takes the hull of its own part of a key, so what meets in one place is corners only.
    """
    names = list(axes)

    def corners(batches):
        for b in batches:
            for k, g in b.groupby(list(keys), dropna=False, sort=False):
                h = hull(g[names].to_numpy(float))
                yield pd.DataFrame({**dict(zip(keys, k)), "n": [len(g)] + [0] * (len(h) - 1), names[0]: h[:, 0], names[1]: h[:, 1]})

    head = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    part = points.select(*keys, *[F.col(a).cast("double").alias(a) for a in names]).mapInPandas(corners, f"{head}, n long, {names[0]} double, {names[1]} double")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[names].to_numpy(float))
        nxt = np.roll(h, -1, axis=0)
        area = abs((h[:, 0] * nxt[:, 1] - h[:, 1] * nxt[:, 0]).sum()) / 2
        around = np.sqrt(((h - nxt) ** 2).sum(1)).sum()
        n = int(pdf["n"].sum())
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "n": [n], "area": [area], "perimeter": [around], "density": [n / area if area else None], "roundness": [4 * np.pi * area / around**2 if around else None]})

    return part.groupBy(*keys).applyInPandas(whole, f"{head}, n long, area double, perimeter double, density double, roundness double")


def overlapping_balls(balls: DataFrame, clearance: float, keys: Sequence[str], id_col: str = "part_id") -> DataFrame:
    """keys, a, b (a < b): balls (radius r) whose centres are nearer than r1 + r2 + clearance. Bucketed by the largest radius."""
    top = balls.agg(F.max("r")).first()[0]
    if top is None:
        return balls.select(*keys, F.col(id_col).alias("a"), F.col(id_col).alias("b")).limit(0)
    p = pairs_within(balls, balls, 2 * top + clearance, keys)
    return p.where((F.col(f"a.{id_col}") < F.col(f"b.{id_col}")) & (F.col("dist") < F.col("a.r") + F.col("b.r") + clearance)).select(*keys, F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b"))


def segment_distances(voxels: DataFrame, limit: float, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, a, b (labels, a < b), dist: least distances between segments up to limit."""
    p = pairs_within(voxels, voxels, limit, keys).where("a.label < b.label")
    return p.groupBy(*keys, F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.min("dist").alias("dist"))


def aligned_pairs(a: DataFrame, b: DataFrame, radius: float, by: str, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, a, b (clusters), n: pairs of points of two cluster sets at most radius apart."""
    p = pairs_within(a, b, radius, keys)
    return p.groupBy(*keys, F.col(f"a.{by}").alias("a"), F.col(f"b.{by}").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def local_volumes(points: DataFrame, voi: DataFrame, radii: Sequence[float], keys: Sequence[str] = ("tomo_id",), id_col: str = "part_id", voxel: float = 1.0) -> DataFrame:
    """keys, id, r, volume: the part of each point's ball inside the volume of interest (occupied voxels)."""
    radii = sorted(radii)
    p = pairs_within(points, voi, radii[-1], keys)
    counts = p.groupBy(*keys, F.col(f"a.{id_col}").alias("id")).agg(*[F.count_if(F.col("dist") <= r).alias(f"_{k}") for k, r in enumerate(radii)])
    rows = F.array(*[F.struct(F.lit(float(r)).alias("r"), (F.col(f"_{k}") * voxel**3).alias("volume")) for k, r in enumerate(radii)])
    return counts.select(*keys, "id", F.inline(rows))


def second_order_in_voi(pair_counts: DataFrame, volumes: DataFrame, density: DataFrame, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """l with edge correction: partners over local volumes, summed over points, relative to the mean density (keys, density)."""
    v = volumes.groupBy(*keys, "r").agg(F.sum("volume").alias("_v"))
    out = pair_counts.join(v, [*keys, "r"]).join(density, list(keys))
    ratio = F.col("pairs") / F.nullif(F.col("_v"), F.lit(0.0)) / F.col("density")
    return out.select(*keys, "r", "pairs", (F.col("r") * (F.pow(ratio, F.lit(1 / 3)) - 1)).alias("l"))


def edge_weights(points: DataFrame, box: Sequence[float], r: float) -> DataFrame:
    """points with weight: area of the circle of radius r about each over its part inside the box (0, 0, a, b)."""
    a, b = box
    x0, x1, y0, y1 = -F.col("x"), a - F.col("x"), -F.col("y"), b - F.col("y")
    inside = _below(x1, y1, r) - _below(x0, y1, r) - _below(x1, y0, r) + _below(x0, y0, r)
    return points.withColumn("weight", 3.141592653589793 * r * r / F.nullif(F.greatest(inside, F.lit(0.0)), F.lit(0.0)))


def _below(u: Column, v: Column, r: float) -> Column:
    """Area of the part x <= u, y <= v of the circle of radius r about 0: the integral of its height over x."""
    u, v = (F.greatest(F.lit(-r), F.least(F.lit(r), c)) for c in (u, v))
    half = lambda x: (x * F.sqrt(F.greatest(r * r - x * x, F.lit(0.0))) + r * r * F.asin(x / r)) / 2  # noqa: E731  (integral of the half circle)
    w = F.sqrt(r * r - v * v)  # where the circle meets y = v
    mid = F.greatest(-w, F.least(w, u))
    # The lower half counts for v >= 0 everywhere; up to v only between -w and w, the whole half circle elsewhere.
    upper = half(F.least(u, -w)) - half(F.lit(-r)) + v * (mid + w) + half(F.greatest(u, w)) - half(w)
    full = half(u) - half(F.lit(-r)) + upper
    part = v * (mid + w) + half(mid) - half(-w)
    return F.when(v >= 0, full).otherwise(part)


def interpolated(points: DataFrame, voxels: DataFrame, keys: Sequence[str] = ("tomo_id",), id_col: str = "part_id") -> DataFrame:
    """keys, id, value: trilinear values of a voxel field at points; null where one of the eight voxels is missing."""
    low = {c: F.floor(F.col(c)) for c in XYZ}
    corner = F.explode(F.array(*[F.struct(*[F.lit(d >> k & 1).alias(c) for k, c in enumerate(XYZ)]) for d in range(8)]))
    p = points.select(*keys, F.col(id_col).alias("id"), *[F.col(c).alias(f"_{c}") for c in XYZ], corner.alias("d"), *[low[c].alias(f"f{c}") for c in XYZ])
    w = F.lit(1.0)
    for c in XYZ:
        t = F.col(f"_{c}") - F.col(f"f{c}")
        w = w * F.when(F.col(f"d.{c}") == 1, t).otherwise(1 - t)
    p = p.withColumn("w", w).where("w > 0").select(*keys, "id", "w", *[(F.col(f"f{c}") + F.col(f"d.{c}")).alias(c) for c in XYZ])
    got = p.join(voxels.select(*keys, *XYZ, "value"), [*keys, *XYZ], "left")
    return got.groupBy(*keys, "id").agg(F.when(F.count_if(F.col("value").isNull()) == 0, F.sum(F.col("w") * F.col("value"))).alias("value"))


def radial_average(voxels: DataFrame, centre: Sequence[float], keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, r, z, value: means over rings about the z axis through a centre."""
    dx, dy = F.col("x") - centre[0], F.col("y") - centre[1]
    return voxels.groupBy(*keys, F.floor(F.sqrt(dx * dx + dy * dy)).alias("r"), "z").agg(F.avg("value").alias("value"))


def average_subvolume(voxels: DataFrame, particles: DataFrame, half: int, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """dx, dy, dz, value, n: the mean of cubes of half-width half about particles. One equi-join on shifted voxels."""
    shift = lambda c: F.explode(F.sequence(F.lit(-half), F.lit(half))).alias(c)
    p = particles.select(*keys, *[F.round(c).cast("long").alias(f"_{c}") for c in XYZ])
    for c in XYZ:
        p = p.select("*", shift(f"d{c}"))
    p = p.select(*keys, "dx", "dy", "dz", *[(F.col(f"_{c}") + F.col(f"d{c}")).alias(c) for c in XYZ])
    return p.join(voxels, [*keys, *XYZ]).groupBy("dx", "dy", "dz").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def moments(points: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """keys, centre and covariance terms (xx, xy, ...) of weighted points: one map-side aggregation."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    s = points.groupBy(*keys).agg(F.sum(w).alias("_w"), *[F.sum(w * F.col(a)).alias(f"_{a}") for a in XYZ], *[F.sum(w * F.col(a) * F.col(b)).alias(f"_{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]])
    mean = lambda a: F.col(f"_{a}") / F.col("_w")
    return s.select(*keys, *[mean(a).alias(f"c{a}") for a in XYZ], *[(F.col(f"_{a}{b}") / F.col("_w") - mean(a) * mean(b)).alias(f"{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]])


def principal_axes(points: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """keys, centre, line (direction of the best-fit line), normal (of the best-fit plane), spreads: from the moments, a row for each key."""
    m = moments(points, keys, weight)
    head = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                c = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
                values, axes = np.linalg.eigh(c)
                axes = axes * np.where(axes[np.abs(axes).argmax(0), range(3)] < 0, -1, 1)
                out.append((*[getattr(r, k) for k in keys], [r.cx, r.cy, r.cz], axes[:, 2].tolist(), axes[:, 0].tolist(), values[::-1].tolist()))
            yield pd.DataFrame(out, columns=[*keys, "centre", "line", "normal", "spreads"])

    return m.mapInPandas(run, f"{head}, centre array<double>, line array<double>, normal array<double>, spreads array<double>")


def rigid_fit(pairs: DataFrame, a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, shift) that carry points a onto b with the least squares: moments in Spark, a 3 x 3 decomposition here."""
    s = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in (*a, *b)], *[F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for p in a for q in b]).first()
    ma, mb = np.array([s[c] for c in a]) / s["n"], np.array([s[c] for c in b]) / s["n"]
    cross = np.array([[s[f"{p}_{q}"] for q in b] for p in a]) / s["n"] - np.outer(ma, mb)
    u, _, v = np.linalg.svd(cross)
    turn = v.T @ np.diag([1, 1, np.sign(np.linalg.det(v.T @ u.T))]) @ u.T
    return turn, mb - turn @ ma


BLOCK = 1024  # vectors of a block of the correlation matrix


def correlations(vectors: DataFrame, blocks: int, id_col: str = "id", column: str = "features") -> DataFrame:
    """a, b (a < b), ncc: the correlation matrix of all vectors, which is the result itself, by pairs of so many blocks, or more
    that hold about BLOCK vectors each. ncc is null where a vector is, holds a null or does not vary, or lengths differ.

    Each block is one row of a written table of about the size of the input. Its partitions are read in pairs, so that no vector
    is shuffled once for each block: but for the result, disk grows as the input and not as its square.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v")).where("id IS NOT NULL")
    blocks = max(blocks, -(-v.count() // BLOCK))
    kind = v.schema["id"].dataType.simpleString()
    v = v.repartitionByRange(blocks, "id").sortWithinPartitions("id")
    made = written(v.mapInArrow(_blocks, f"n long, id array<{kind}>, size array<int>, x binary"))
    left, right = (made.withColumnsRenamed({c: f"{c}_{side}" for c in made.columns}) for side in "ij")
    return left.join(right.hint("shuffle_replicate_nl"), F.col("n_i") <= F.col("n_j")).mapInArrow(_block_correlations, f"a {kind}, b {kind}, ncc double")


def _unit(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Deviations from the means as unit vectors, padded to one length; lengths, -1 for what has no correlation."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values, row = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = np.zeros((len(sizes), max(sizes, default=0)))
    x[row, at] = values.to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", divide="ignore"):
        x[row, at] -= (x.sum(1) / sizes)[row]
        norm = np.sqrt((x * x).sum(1))
        none = (sizes == 0) | (norm == 0)
        none[row[pc.is_null(values).to_numpy(zero_copy_only=False)]] = True
        x /= np.where(none, 1.0, norm)[:, None]
    return x, np.where(none, -1, sizes).astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's vectors as rows of at most BLOCK of them; n numbers the rows in the order of partitions."""
    from pyspark import TaskContext

    n, held = TaskContext.get().partitionId() << 32, []

    def row(t: pa.Table) -> pa.RecordBatch:
        x, size = _unit(t["v"].combine_chunks())
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), a)
        return pa.RecordBatch.from_pydict({"n": pa.array([n]), "id": whole(t["id"].combine_chunks()), "size": whole(pa.array(size)), "x": pa.array([x.tobytes()], pa.binary())})

    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) > BLOCK:
            t = pa.Table.from_batches(held)
            yield row(t.slice(0, BLOCK))
            n, held = n + 1, t.slice(BLOCK).to_batches()
    if sum(map(len, held)):
        yield row(pa.Table.from_batches(held))


STRIP = 256  # vectors of a block whose pairs are sent at a time


def _block_correlations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of two blocks' vectors, or of one block's own; no vector pairs with its own id."""
    for batch in batches:
        for k in range(len(batch)):
            (n, ids, size, x), (m, ids_j, size_j, y) = ([batch[f"{c}_{side}"][k] for c in ("n", "id", "size", "x")] for side in "ij")
            own, ids, ids_j, size, size_j = n == m, ids.values, ids_j.values, size.values.to_numpy(), size_j.values.to_numpy()
            x, y = (np.frombuffer(b.as_buffer()).reshape(len(z), len(b.as_buffer()) // (8 * len(z))) for b, z in ((x, size), (y, size_j)))
            both = min(x.shape[1], y.shape[1])
            alike = len({*size.tolist(), *size_j.tolist()} | {-1}) == 2 and min(size.min(), size_j.min()) >= 0
            p, q = ids.to_numpy(zero_copy_only=False), ids_j.to_numpy(zero_copy_only=False)
            apart = p.max() < q.min()
            for at in range(0, len(p), STRIP):
                here = slice(at, at + STRIP)
                ncc = (x[here, :both] @ y[:, :both].T).ravel()
                i, j = (r.ravel() for r in np.indices((len(p[here]), len(q)), np.int32))
                i += at
                a, b = ids.take(pa.array(i)), ids_j.take(pa.array(j))
                unlike = None if alike else (size[i] < 0) | (size[i] != size_j[j])
                if not apart:
                    less = p[i] < q[j]
                    take = np.flatnonzero(less if own else less | (p[i] > q[j]))
                    less, i, j, ncc, unlike = pa.array(less[take]), i[take], j[take], ncc[take], None if alike else unlike[take]
                    a, b = a.take(pa.array(take)), b.take(pa.array(take))
                    a, b = pc.if_else(less, a, b), pc.if_else(less, b, a)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b, "ncc": pa.array(ncc, mask=unlike)})


def best_templates(vectors: DataFrame, templates: DataFrame, id_col: str = "id", column: str = "features") -> DataFrame:
    """id, template, ncc: exhaustive template matching; a template is a vector for each rotation and shift."""
    from quadrat.operators.clusters import assign_exemplars

    t = templates.select(F.col("template").alias(id_col), F.col(column))
    return assign_exemplars(vectors, t, id_col, column).withColumnRenamed("exemplar", "template")


def nearest_normals(points: DataFrame, surface: DataFrame, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, id, dist, normal of the nearest surface sample (part_id, normal)."""
    from quadrat.operators.points import knn

    n = knn(points, surface, 1, keys).select(*keys, "id", "other", "dist")
    return n.join(surface.select(*keys, F.col("part_id").alias("other"), "normal"), [*keys, "other"]).drop("other")


def crossing(curves: DataFrame, points: DataFrame, radius: float, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, id, curve_id, seq, dist: each point's nearest sample of a curve within radius, by curve."""
    p = pairs_within(points, curves, radius, keys).select(*keys, F.col("a.part_id").alias("id"), F.col("b.curve_id").alias("curve_id"), F.col("b.seq").alias("seq"), "dist")
    return p.groupBy(*keys, "id", "curve_id").agg(F.min(F.struct("dist", "seq")).alias("_m")).select(*keys, "id", "curve_id", F.col("_m.seq").alias("seq"), F.col("_m.dist").alias("dist"))


def second_order_terms(pair_counts: DataFrame, volumes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, r, pairs, volume: numerator and denominator of the second order apart: partners, and local volumes summed over the points."""
    v = volumes.groupBy(*keys, "r").agg(F.sum("volume").alias("volume"))
    return pair_counts.join(v, [*keys, "r"]).select(*keys, "r", "pairs", "volume")


def interior(points: DataFrame, outside: DataFrame, border: float, keys: Sequence[str] = ("tomo_id",), id_col: str = "part_id") -> DataFrame:
    """Points that are farther than border from every voxel outside the volume of interest."""
    near = pairs_within(points, outside, border, keys).select(*keys, F.col(f"a.{id_col}").alias(id_col)).distinct()
    return points.join(near, [*keys, id_col], "left_anti")


def embedded(points: DataFrame, voi: DataFrame, keys: Sequence[str] = ("tomo_id",), size: float = 1.0) -> DataFrame:
    """Points whose voxel (of the given size) is in the volume of interest."""
    at = [F.round(F.col(c) / size).cast("long") for c in XYZ]
    v = voi.select(*keys, *[a.alias(f"_{c}") for a, c in zip(at, XYZ)]).distinct()
    return points.withColumns({f"_{c}": a for a, c in zip(at, XYZ)}).join(v, [*keys, *[f"_{c}" for c in XYZ]], "left_semi").select(points.columns)


def gaussian_density(points: DataFrame, sigma: float, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, x, y, z, value: a density of Gaussian balls about the points, on whole voxels up to 3 sigma away."""
    half = int(3 * sigma + 1)
    p = points.select(*keys, *[F.col(c).alias(f"_{c}") for c in XYZ])
    for c in XYZ:
        p = p.withColumn(c, F.explode(F.sequence(F.floor(F.col(f"_{c}")) - half + 1, F.floor(F.col(f"_{c}")) + half)))
    d2 = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in XYZ), F.lit(0.0))
    return p.withColumn("_d", d2).where(F.col("_d") <= 9 * sigma * sigma).groupBy(*keys, *XYZ).agg(F.sum(F.exp(-F.col("_d") / (2 * sigma * sigma))).alias("value"))


def moments_2d(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, area, x, y, eccentricity of flat objects, from their moments."""
    m = voxels.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"), *[F.avg(c).alias(c) for c in "xy"], F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"), F.covar_pop("x", "y").alias("_xy"))
    root = F.sqrt((F.col("_xx") - F.col("_yy")) * (F.col("_xx") - F.col("_yy")) + 4 * F.col("_xy") * F.col("_xy"))
    big, small = F.col("_xx") + F.col("_yy") + root, F.col("_xx") + F.col("_yy") - root
    return m.select(*keys, "area", "x", "y", F.when(big > 0, F.sqrt(F.greatest(1 - small / big, F.lit(0.0)))).otherwise(0.0).alias("eccentricity"))


def sides(points: DataFrame, surface: DataFrame, keys: Sequence[str] = ("tomo_id",), id_col: str = "part_id", vector: str | None = None) -> DataFrame:
    """keys, id, dist, side (1 where the nearest surface sample's normal points to, 2 on the other side, 0 on it), angle (of the
    points' vector to that normal, where a column is given). surface: part_id, x, y, z, normal (array)."""
    from quadrat.functions import geometry as G
    from quadrat.operators.points import knn

    near = knn(points, surface, 1, keys, id_col, "part_id").select(*keys, "id", F.col("other"), "dist")
    s = surface.select(*keys, F.col("part_id").alias("other"), *[F.col(c).alias(f"_s{c}") for c in XYZ], F.col("normal").alias("_n"))
    p = points.select(*keys, F.col(id_col).alias("id"), *XYZ, *([F.col(vector).alias("_v")] if vector else []))
    out = near.join(s, [*keys, "other"]).join(p, [*keys, "id"])
    dot = sum(((F.col(c) - F.col(f"_s{c}")) * F.col("_n")[k] for k, c in enumerate(XYZ)), F.lit(0.0))
    angle = [G.angle(F.col("_v"), F.col("_n")).alias("angle")] if vector else []
    return out.select(*keys, "id", "dist", F.when(dot > 0, 1).when(dot < 0, 2).otherwise(0).cast("long").alias("side"), *angle)


def inside_surface(points: DataFrame, triangles: DataFrame, cell: float, keys: Sequence[str] = ("tomo_id",), id_col: str = "part_id") -> DataFrame:
    """keys, id of the points inside a closed surface: the ray up from the point crosses an odd number of its triangles.

    triangles: keys and a, b, c (structs of x, y, z). Triangles are dealt over the cells of their shadows in the xy plane; an
    edge counts for the triangle that lies to one side of it, so a ray through an edge or a corner is counted once.
    """
    t = triangles.select(*keys, "a", "b", "c")
    for k, c in enumerate("xy"):
        low, high = F.least(*[F.col(f"{q}.{c}") for q in "abc"]), F.greatest(*[F.col(f"{q}.{c}") for q in "abc"])
        t = t.withColumn(f"_c{k}", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    p = points.select(*keys, F.col(id_col).alias("id"), *XYZ, *[F.floor(F.col(c) / cell).alias(f"_c{k}") for k, c in enumerate("xy")])
    j = p.join(t, [*keys, "_c0", "_c1"])
    # The vertical plane through the point cuts the triangle's outline in two edges (lower end in, upper end out, in y); x of the cuts tells whether the point is between.
    cuts = []
    for q, r in (("a", "b"), ("b", "c"), ("c", "a")):
        y0, y1 = F.col(f"{q}.y"), F.col(f"{r}.y")
        meets = (F.least(y0, y1) <= F.col("y")) & (F.col("y") < F.greatest(y0, y1))
        s = (F.col("y") - y0) / F.nullif(y1 - y0, F.lit(0.0))
        cuts.append(F.when(meets, F.struct((F.col(f"{q}.x") + s * (F.col(f"{r}.x") - F.col(f"{q}.x"))).alias("x"), (F.col(f"{q}.z") + s * (F.col(f"{r}.z") - F.col(f"{q}.z"))).alias("z"))))
    j = j.withColumn("_k", F.array_sort(F.filter(F.array(*cuts), lambda c: c.isNotNull()))).where(F.size("_k") == 2)
    lo, hi = F.get("_k", F.lit(0)), F.get("_k", F.lit(1))
    z = lo["z"] + (F.col("x") - lo["x"]) / F.nullif(hi["x"] - lo["x"], F.lit(0.0)) * (hi["z"] - lo["z"])
    j = j.where((lo["x"] <= F.col("x")) & (F.col("x") < hi["x"]) & (z > F.col("z")))
    return j.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(*keys, "id")


def crossing_curves(curves: DataFrame, radius: float, keys: Sequence[str] = ("tomo_id",)) -> DataFrame:
    """keys, a, b (a < b): curves with samples nearer than 2 * radius."""
    p = pairs_within(curves, curves, 2 * radius, keys, strict=True).where("a.curve_id < b.curve_id")
    return p.select(*keys, F.col("a.curve_id").alias("a"), F.col("b.curve_id").alias("b")).distinct()
