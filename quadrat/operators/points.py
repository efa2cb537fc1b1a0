"""Point patterns: nearest neighbours, distance joins, first- and second-order statistics.

All pair operators bucket points into cubic cells and equi-join neighbouring cells, so the work follows the number of
close pairs. Nearest neighbours widen their cells round by round, and a point leaves as soon as its k-th distance lies
within a cell, which makes the result exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.storage import settling, written

XYZ = ("x", "y", "z")


def distance(a: str, b: str, axes: Sequence[str] = XYZ, metric: str = "euclidean") -> Column:
    """metric: euclidean, manhattan or chebyshev; all are at least the greatest difference along an axis, on which cells rest."""
    if metric != "euclidean":
        parts = [F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in axes]
        return sum(parts, F.lit(0.0)) if metric == "manhattan" else F.greatest(*parts, F.lit(0.0))
    return F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in axes), F.lit(0.0)))


def _cells(axes: Sequence[str], cell: float) -> list[Column]:
    return [F.floor(F.col(c) / cell).alias(f"_c{k}") for k, c in enumerate(axes)]


def _around(cells: DataFrame, n: int, ring: int) -> DataFrame:
    """Each row once for every cell at most ring away."""
    for k in range(n):
        cells = cells.withColumn(f"_c{k}", F.explode(F.sequence(F.col(f"_c{k}") - ring, F.col(f"_c{k}") + ring)))
    return cells


def pairs_within(left: DataFrame, right: DataFrame, radius: float, keys: Sequence[str] = (), axes: Sequence[str] = XYZ, strict: bool = False) -> DataFrame:
    """a (left row), b (right row), dist, keys: pairs at most (strict: less than) radius apart that agree on keys."""
    own = [F.col(k) for k in keys]
    a = _around(left.select(*own, F.struct("*").alias("a"), *_cells(axes, radius)), len(axes), 1)
    b = right.select(*own, F.struct("*").alias("b"), *_cells(axes, radius))
    out = a.join(b, [*keys, *[f"_c{k}" for k in range(len(axes))]]).withColumn("dist", distance("a", "b", axes))
    return out.where(F.col("dist") < radius if strict else F.col("dist") <= radius).select(*keys, "a", "b", "dist")


def cell_size(points: DataFrame, per_cell: float = 4.0, axes: Sequence[str] = XYZ, keys: Sequence[str] = ()) -> float:
    """A cell size at which a cell of a uniform pattern holds about so many points of a key."""
    r = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in axes], F.count(F.lit(1)).alias("_n"), F.approx_count_distinct(F.struct(*keys) if keys else F.lit(1)).alias("_k")).first()
    spans = [r[c] for c in axes if r[c]]
    if not spans or not r["_n"]:
        return 1.0
    volume = 1.0
    for s in spans:
        volume *= s
    return max((volume * per_cell / max(1.0, r["_n"] / max(1, r["_k"]))) ** (1 / len(spans)), max(spans) / 2**20, 1e-300)


@settling
def knn(left: DataFrame, right: DataFrame, k: int = 1, keys: Sequence[str] = (), left_id: str = "part_id", right_id: str = "part_id", axes: Sequence[str] = XYZ, exclude_self: bool = False, cell: float | None = None, metric: str = "euclidean") -> DataFrame:
    """keys, id, other, dist, rank: the k nearest right points of each left point of the same keys, ties to the smaller id.

    Points without a partner give no row. Each round joins the cells around a point; a point whose k-th distance is at most
    the cell's size is done, and the others go on with cells twice as large, until a cell holds the whole pattern.
    """
    n, out = len(axes), None
    least_most = [f(c).alias(f"{m}_{c}") for c in axes for m, f in (("lo", F.min), ("hi", F.max))]
    r = left.select(*axes).unionAll(right.select(*axes)).agg(*least_most).first()
    if r[f"lo_{axes[0]}"] is None:
        return left.select(*keys, F.col(left_id).alias("id"), F.lit(None).cast("long").alias("other"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    span = max(r[f"hi_{c}"] - r[f"lo_{c}"] for c in axes)
    cell = cell or cell_size(right, max(4.0, k), axes, keys)
    names = [f"_c{i}" for i in range(n)]
    b = right.select(*keys, F.col(right_id).alias("other"), F.struct(*axes).alias("b"), *axes)
    open_ = left.select(*keys, F.col(left_id).alias("id"), F.struct(*axes).alias("a"), *axes)
    while True:
        a = _around(open_.select(*keys, "id", "a", *_cells(axes, cell)), n, 1)
        close = a.join(b.select(*keys, "other", "b", *_cells(axes, cell)), [*keys, *names]).withColumn("dist", distance("a", "b", axes, metric))
        close = close.where("id <> other") if exclude_self else close
        best = W.partitionBy(*keys, "id").orderBy("dist", "other")
        close = close.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*keys, "id", "other", "dist", "rank")
        if cell > span:
            return close if out is None else out.unionAll(close)
        close = written(close)
        full = close.where((F.col("rank") == k) & (F.col("dist") <= cell)).select(*keys, "id")
        out = close.join(full, [*keys, "id"], "left_semi") if out is None else out.unionAll(close.join(full, [*keys, "id"], "left_semi"))
        open_ = written(open_.join(full, [*keys, "id"], "left_anti"))
        if open_.isEmpty():
            return out
        cell *= 2


def farthest(points: DataFrame, keys: Sequence[str], axes: Sequence[str] = XYZ, id_col: str = "part_id") -> DataFrame:
    """keys, id, dist: each point's distance to the farthest one of its keys.

    The extreme points along the axes and diagonals bound every point's answer from below. A partner of p at distance d is
    at least d less p's own distance away from the centre, so only points beyond the least such need are joined.
    """
    keys = list(keys)
    centre = points.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{c}") for c in axes])
    radius = F.sqrt(sum(((F.col(c) - F.col(f"_m{c}")) * (F.col(c) - F.col(f"_m{c}")) for c in axes), F.lit(0.0)))
    own = points.join(centre, keys).select(*keys, F.col(id_col).alias("id"), *axes, radius.alias("_r"))
    ways = [d for d in product((-1, 0, 1), repeat=len(axes)) if any(d)]
    ends = own.groupBy(*keys).agg(*[F.max_by(F.struct("id", *axes), sum((F.col(c) * s for c, s in zip(axes, d)), F.lit(0.0))).alias(f"_e{k}") for k, d in enumerate(ways)])
    ends = ends.select(*keys, F.array_distinct(F.array(*[f"_e{k}" for k in range(len(ways))])).alias("_ends"))
    to = lambda e: F.sqrt(sum(((F.col(c) - e[c]) * (F.col(c) - e[c]) for c in axes), F.lit(0.0)))
    low = own.join(ends, keys).withColumn("_low", F.array_max(F.transform("_ends", to))).drop("_ends")
    need = low.groupBy(*keys).agg(F.min(F.col("_low") - F.col("_r")).alias("_need"))
    far = own.join(need, keys).where(F.col("_r") >= F.col("_need") - 1e-9)
    pairs = own.alias("a").join(far.alias("b"), keys).where("a.id <> b.id").withColumn("dist", distance("a", "b", axes))
    return pairs.groupBy(*keys, F.col("a.id").alias("id")).agg(F.max("dist").alias("dist"))


def nn_statistics(nn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean_nnd, var_nnd (population) of nearest-neighbour distances."""
    return nn.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean_nnd"), F.var_pop("dist").alias("var_nnd"))


def ann_zscore(stats: DataFrame, area: str = "area") -> DataFrame:
    """z of the mean nearest-neighbour distance against complete randomness; -1 where the area is not positive."""
    n, a = F.col("n"), F.col(area)
    z = (F.col("mean_nnd") - 0.5 / F.sqrt(n / a)) / (0.26136 / F.sqrt(n * n / a))
    return stats.withColumn("z", F.when(a > 0, z).otherwise(-1.0))


def histogram_cdf(values: DataFrame, keys: Sequence[str], low: float, high: float, n: int, value: str = "dist") -> DataFrame:
    """keys, bin, edge (upper), density, cdf over n equal bins of [low, high]; values outside are passed over, empty bins are zero."""
    width = (high - low) / n
    place = F.least(F.floor((F.col(value) - low) / width), F.lit(n - 1))
    got = values.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*keys, place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    all_bins = values.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    w = W.partitionBy(*keys)
    out = all_bins.join(got, [*keys, "bin"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    total = F.sum("_n").over(w)
    density = F.when(total > 0, F.col("_n") / (total * width)).otherwise(0.0)
    cdf = F.when(total > 0, F.sum("_n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / total).otherwise(0.0)
    return out.select(*keys, "bin", (low + (F.col("bin") + 1) * width).alias("edge"), density.alias("density"), cdf.alias("cdf"))


def fraction_clustered(nn: DataFrame, keys: Sequence[str], samples: Sequence[float]) -> DataFrame:
    """keys, s, fraction: share of points with a neighbour at most s away."""
    shares = nn.groupBy(*keys).agg(*[F.avg((F.col("dist") <= s).cast("double")).alias(f"_{k}") for k, s in enumerate(samples)])
    rows = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.col(f"_{k}").alias("fraction")) for k, s in enumerate(samples)])
    return shares.select(*keys, F.inline(rows))


def pair_counts(left: DataFrame, right: DataFrame, radii: Sequence[float], keys: Sequence[str], axes: Sequence[str] = XYZ, left_id: str = "part_id", right_id: str = "part_id", same: bool = True, strict: bool = False) -> DataFrame:
    """keys, r, pairs: ordered pairs at most (strict: less than) r apart; same: left and right are one pattern and a point is no partner of itself.

    Pairs are counted once into the first radius that holds them, then summed over the radii.
    """
    radii = sorted(radii)
    close = pairs_within(left, right, radii[-1], keys, axes, strict)
    if same:
        close = close.where(F.col(f"a.{left_id}") != F.col(f"b.{right_id}"))
    inside = (lambda r: F.col("dist") < r) if strict else (lambda r: F.col("dist") <= r)
    first = F.lit(None).cast("int")
    for k in range(len(radii) - 1, -1, -1):
        first = F.when(inside(radii[k]), F.lit(k)).otherwise(first)
    got = close.groupBy(*keys, first.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    every = left.select(*keys).distinct().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(radii) - 1))))
    out = every.join(got, [*keys, "_k"], "left")
    total = F.sum(F.coalesce("_n", F.lit(0))).over(W.partitionBy(*keys).orderBy("_k").rowsBetween(W.unboundedPreceding, 0))
    return out.select(*keys, F.element_at(F.array(*[F.lit(float(r)) for r in radii]), F.col("_k") + 1).alias("r"), total.alias("pairs"))


def ripley_2d(counts: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sqrt(area * pairs / n^2) by key and r. sizes: keys, n, area."""
    return counts.join(sizes, list(keys)).withColumn("ripley", F.sqrt(F.col("area") * F.col("pairs") / (F.col("n") * F.col("n"))))


def second_order(counts: DataFrame, sizes: DataFrame, keys: Sequence[str], dims: int = 3) -> DataFrame:
    """k = volume * pairs / (n * m), l = (k / ball of 1)^(1 / dims) - r. sizes: keys, n, m (partners of each point), volume."""
    ball = 4 * 3.141592653589793 / 3 if dims == 3 else 3.141592653589793
    k = F.col("volume") * F.col("pairs") / (F.col("n") * F.col("m"))
    return counts.join(sizes, list(keys)).withColumn("k", k).withColumn("l", F.pow(k / ball, F.lit(1 / dims)) - F.col("r"))


def shell_order(counts: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """o: density of partners in the shell between a radius and the one before, over the mean density."""
    w = W.partitionBy(*keys).orderBy("r")
    shell = F.col("pairs") - F.coalesce(F.lag("pairs").over(w), F.lit(0))
    inner = F.coalesce(F.lag("r").over(w), F.lit(0.0))
    volume = 4 * 3.141592653589793 / 3 * (F.col("r") * F.col("r") * F.col("r") - inner * inner * inner)
    return counts.withColumn("_o", shell / volume).join(sizes, list(keys)).withColumn("o", F.col("_o") / F.col("n") / (F.col("m") / F.col("volume"))).drop("_o")


def j_function(g: DataFrame, f: DataFrame, on: Sequence[str], high: float = 10.0) -> DataFrame:
    """(1 - G) / (1 - F), at most high."""
    out = g.select(*on, F.col("cdf").alias("g")).join(f.select(*on, F.col("cdf").alias("f")), list(on))
    return out.withColumn("j", F.when(F.col("f") >= 1, high).otherwise(F.least((1 - F.col("g")) / (1 - F.col("f")), F.lit(high))))


def shortest_distances(left: DataFrame, right: DataFrame, radius: float, most: int, keys: Sequence[str], left_id: str = "part_id", right_id: str = "part_id") -> DataFrame:
    """keys, id, other, dist, rank: each left point's nearest right points within radius, at most so many (the operator's own limit)."""
    close = pairs_within(left, right, radius, keys).select(*keys, F.col(f"a.{left_id}").alias("id"), F.col(f"b.{right_id}").alias("other"), "dist")
    rank = F.row_number().over(W.partitionBy(*keys, "id").orderBy("dist", "other"))
    return close.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def compressed_plane(points: DataFrame, voxels: DataFrame, drop: str | None = None, axes: Sequence[str] = XYZ) -> DataFrame:
    """points with u (the longer axis) and v: without the axis given, or the one of the least extent in voxels."""
    r = voxels.agg(*[(F.max(c) - F.min(c)).alias(c) for c in axes]).first()
    order = sorted((c for c in axes if c != drop), key=lambda c: -(r[c] or 0))[: len(axes) - 1]
    return points.withColumns({"u": F.col(order[0]), "v": F.col(order[1])})


# Envelopes and empirical p-values over (keys, sim_id, r, value) and (keys, r, value)


def envelope(sims: DataFrame, keys: Sequence[str], p: float = 0.05, weight: str | None = None) -> DataFrame:
    """low, median, high: exact percentiles (linear) of the simulated values by keys; weight: how often a value counts."""
    f = f"percentile(value, array({p}D, 0.5D, {1 - p}D){', ' + weight if weight else ''})"
    return sims.groupBy(*keys).agg(F.expr(f).alias("_p")).select(*keys, F.col("_p")[0].alias("low"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("high"))


def envelope_std(sims: DataFrame, keys: Sequence[str], k: float = 1.0) -> DataFrame:
    m, s = F.avg("value"), F.stddev_pop("value")
    return sims.groupBy(*keys).agg((m - k * s).alias("low"), m.alias("mean"), (m + k * s).alias("high"))


def p_values(observed: DataFrame, sims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p_ge = share of simulations that the observation reaches (second order); p_gt, p_lt strict (first order)."""
    both = observed.withColumnRenamed("value", "_v").join(sims, list(keys))
    share = lambda c: F.avg(c.cast("double"))
    return both.groupBy(*keys).agg(share(F.col("_v") >= F.col("value")).alias("p_ge"), share(F.col("_v") > F.col("value")).alias("p_gt"), share(F.col("_v") < F.col("value")).alias("p_lt"))


def max_percentile(p: DataFrame, keys: Sequence[str]) -> DataFrame:
    """best and r: the largest p_ge over the radii and the first radius that has it; best starts at 0."""
    best = F.max_by(F.struct("p_ge", "r"), F.struct("p_ge", -F.col("r")))
    return p.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.greatest("_b.p_ge", F.lit(0.0)).alias("best"), F.col("_b.r").alias("r"))


def compared(functions: Mapping[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Functions (on, value) of many analyses as one table: on, name, value, and the difference from the mean of all at that place."""
    out = None
    for name, df in functions.items():
        own = df.select(*on, F.lit(name).alias("name"), F.col("value"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("difference", F.col("value") - F.avg("value").over(W.partitionBy(*on)))
