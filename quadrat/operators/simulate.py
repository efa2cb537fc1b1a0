"""Seeded null models. Every draw is a hash of (seed, simulation, tomogram, number), so any partitioning gives the same points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = 2 * 3.141592653589793


def unit(seed: int, *of: Column | str) -> Column:
    """A number in [0, 1) for the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in of]), 11) / float(1 << 53)


def normal(seed: int, *of: Column | str) -> Column:
    return F.sqrt(-2 * F.log(1 - unit(seed, *of, F.lit("r")))) * F.cos(TURN * unit(seed, *of, F.lit("a")))


def csr(boxes: DataFrame, n: str, sims: int, seed: int = 0) -> DataFrame:
    """sim_id, tomo_id, part_id, x, y, z: n (a column) uniform points in each tomogram's box (tomo_id, lo, hi: arrays)."""
    s = boxes.withColumn("sim_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long")))).where(F.col(n) > 0)
    p = s.withColumn("part_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))
    return p.select("sim_id", "tomo_id", "part_id", *[(F.col("lo")[k] + unit(seed, "sim_id", "tomo_id", "part_id", F.lit(k)) * (F.col("hi")[k] - F.col("lo")[k])).alias(c) for k, c in enumerate("xyz")])


def csr_voxels(voxels: DataFrame, counts: DataFrame, sims: int, seed: int = 0) -> DataFrame:
    """sim_id, tomo_id, x, y, z: n distinct voxels of each tomogram's volume of interest, those with the least hashes. counts: tomo_id, n."""
    from pyspark.sql import Window as W

    s = voxels.join(counts, "tomo_id").withColumn("sim_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))))
    k = F.row_number().over(W.partitionBy("sim_id", "tomo_id").orderBy(F.xxhash64(F.lit(seed), "sim_id", "tomo_id", "x", "y", "z"), "x", "y", "z"))
    return s.withColumn("_k", k).where(F.col("_k") <= F.col("n")).select("sim_id", "tomo_id", "x", "y", "z")


def periodic(points: DataFrame, cycles: Sequence[float], size: Sequence[float], threshold: float) -> DataFrame:
    """Points where the mean of three sines is above the threshold."""
    waves = [F.sin(TURN * c / s * F.col(a)) for a, c, s in zip("xyz", cycles, size)]
    return points.where((waves[0] + waves[1] + waves[2]) / 3 > threshold)


def second_pattern(points: DataFrame, mean: float, std: float, seed: int = 0) -> DataFrame:
    """A counterpart of each point at a distance N(mean, std) in a uniform direction."""
    key = [c for c in ("sim_id", "tomo_id", "part_id") if c in points.columns]
    d = mean + std * normal(seed, *key, F.lit("d"))
    z, a = 2 * unit(seed, *key, F.lit("z")) - 1, TURN * unit(seed, *key, F.lit("t"))
    p = points.withColumns({"_d": d, "_z": z, "_a": a})
    r = F.sqrt(1 - F.col("_z") * F.col("_z"))
    return p.withColumns({"x": F.col("x") + F.col("_d") * r * F.cos("_a"), "y": F.col("y") + F.col("_d") * r * F.sin("_a"), "z": F.col("z") + F.col("_d") * F.col("_z")}).drop("_d", "_z", "_a")


def random_rotation(points: DataFrame, seed: int = 0) -> DataFrame:
    """points with uniform random rot, tilt, psi (degrees); centres stay."""
    key = [c for c in ("sim_id", "tomo_id", "part_id") if c in points.columns]
    return points.withColumns({"rot": 360 * unit(seed, *key, F.lit("rot")) - 180, "tilt": F.degrees(F.acos(2 * unit(seed, *key, F.lit("tilt")) - 1)), "psi": 360 * unit(seed, *key, F.lit("psi")) - 180})


def shifted_filaments(curves: DataFrame, boxes: DataFrame, seed: int = 0, key: str = "curve_id") -> DataFrame:
    """Each filament moved so that its first point is uniform in its tomogram's box, and turned about z."""
    first = curves.groupBy("tomo_id", key).agg(F.min_by(F.struct("x", "y", "z"), "seq").alias("_f")).join(boxes, "tomo_id")
    to = [F.col("lo")[k] + unit(seed, "tomo_id", key, F.lit(k)) * (F.col("hi")[k] - F.col("lo")[k]) for k in range(3)]
    moved = first.select("tomo_id", key, "_f", *[t.alias(f"_t{c}") for t, c in zip(to, "xyz")], (TURN * unit(seed, "tomo_id", key, F.lit("turn"))).alias("_a"))
    c = curves.join(moved, ["tomo_id", key])
    dx, dy, dz = (F.col(a) - F.col(f"_f.{a}") for a in "xyz")
    new = {"x": F.col("_tx") + dx * F.cos("_a") - dy * F.sin("_a"), "y": F.col("_ty") + dx * F.sin("_a") + dy * F.cos("_a"), "z": F.col("_tz") + dz}
    return c.withColumns(new).select(curves.columns)


# Models with rejection: every try is a draw of its own, and the first one that holds is taken.


def _tried(points: DataFrame, tries: int) -> DataFrame:
    return points.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))


def _first(tried: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return tried.groupBy(*keys).agg(F.min_by(F.struct(*columns), "_try").alias("_t")).select(*keys, "_t.*")


def csr_in_voi(counts: DataFrame, voi: DataFrame, sims: int, tries: int = 10, seed: int = 0, size: float = 1.0) -> DataFrame:
    """sim_id, tomo_id, part_id, x, y, z: uniform points of the volume of interest's box that fall on its voxels; a point that no try places is left out. counts: tomo_id, n."""
    from quadrat.operators.regions import embedded

    box = voi.groupBy("tomo_id").agg(F.array(*[F.min(c) - size / 2 for c in "xyz"]).alias("lo"), F.array(*[F.max(c) + size / 2 for c in "xyz"]).alias("hi"))
    own = box.join(counts, "tomo_id").withColumn("sim_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long")))).where("n > 0")
    own = _tried(own.withColumn("part_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1))), tries)
    at = [(F.col("lo")[k] + unit(seed, "sim_id", "tomo_id", "part_id", "_try", F.lit(k)) * (F.col("hi")[k] - F.col("lo")[k])).alias(c) for k, c in enumerate("xyz")]
    drawn = own.select("sim_id", "tomo_id", "part_id", "_try", *at)
    return _first(embedded(drawn, voi, size=size), ["sim_id", "tomo_id", "part_id"], ["x", "y", "z"])


def periodic_points(voxels: DataFrame, counts: DataFrame, cycles: Sequence[float], size: Sequence[float], threshold: float, sims: int, seed: int = 0) -> DataFrame:
    """sim_id, tomo_id, x, y, z: n of the voxels where the mean of three sines is above the threshold, by simulation and tomogram."""
    return csr_voxels(periodic(voxels, cycles, size, threshold), counts, sims, seed)


def second_pattern_in_voi(points: DataFrame, voi: DataFrame, mean: float, std: float, tries: int = 10, seed: int = 0, size: float = 1.0) -> DataFrame:
    """A counterpart of each point at a distance N(mean, std) in a uniform direction, on the volume of interest; points that no try places are left out."""
    from quadrat.operators.regions import embedded

    key = [c for c in ("sim_id", "tomo_id", "part_id") if c in points.columns]
    moved = None
    for t in range(tries):
        one = second_pattern(points, mean, std, seed * 1000 + t).withColumn("_try", F.lit(t))
        moved = one if moved is None else moved.unionByName(one)
    return _first(embedded(moved, voi, size=size), key, ["x", "y", "z"])


def turned_filaments(curves: DataFrame, voi: DataFrame, boxes: DataFrame, tries: int = 20, seed: int = 0, size: float = 1.0, key: str = "curve_id") -> DataFrame:
    """Each filament with a random shift and rotation in space at which all its samples are on the volume of interest; filaments that no try places are left out."""
    from quadrat.functions import geometry as G
    from quadrat.operators.regions import embedded

    first = curves.groupBy("tomo_id", key).agg(F.min_by(F.struct("x", "y", "z"), "seq").alias("_f"), F.count(F.lit(1)).alias("_n")).join(boxes, "tomo_id")
    drawn = _tried(first, tries)
    u = lambda name: unit(seed, "tomo_id", key, "_try", F.lit(name))
    turn = G.matrix(360 * u("rot"), F.degrees(F.acos(2 * u("tilt") - 1)), 360 * u("psi"))
    drawn = drawn.select("tomo_id", key, "_try", "_f", "_n", turn.alias("_m"), *[(F.col("lo")[k] + u(c) * (F.col("hi")[k] - F.col("lo")[k])).alias(f"_t{c}") for k, c in enumerate("xyz")])
    c = curves.join(drawn, ["tomo_id", key])
    at = G.rotated(F.col("_m"), [F.col(a) - F.col(f"_f.{a}") for a in "xyz"])
    moved = c.select("tomo_id", key, "seq", "_try", "_n", *[(F.col(f"_t{a}") + v).alias(a) for a, v in zip("xyz", at)])
    good = embedded(moved, voi, size=size).groupBy("tomo_id", key, "_try").agg(F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n")).where("_k = _n")
    best = good.groupBy("tomo_id", key).agg(F.min("_try").alias("_try"))
    return moved.join(best, ["tomo_id", key, "_try"], "left_semi").select("tomo_id", key, "seq", "x", "y", "z")


def inserted(curves: DataFrame, radius: float, key: str = "curve_id") -> DataFrame:
    """Filaments that can be put in one after the other, by id, without one coming nearer than 2 * radius to an earlier one that stays."""
    from quadrat.operators.regions import crossing_curves
    from quadrat.operators.suppression import settled_rounds

    over = crossing_curves(curves.withColumnRenamed(key, "curve_id"), radius)
    vertex = lambda c: F.struct("tomo_id", F.col(c).alias(key))
    kept = settled_rounds(over.select(vertex("a").alias("over"), vertex("b").alias("id")), curves.select(vertex(key).alias("id")).distinct())
    return curves.join(kept.select("id.*"), ["tomo_id", key], "left_semi")


def random_layer(points: DataFrame, layer: int, boxes: DataFrame, seed: int = 0) -> DataFrame:
    """points with one layer's replaced by as many uniform ones of each tomogram: the columns' null model."""
    own = points.where(F.col("layer") == layer)
    n = own.groupBy("tomo_id").agg(F.count(F.lit(1)).alias("n"))
    new = csr(boxes.join(n, "tomo_id"), "n", 1, seed).drop("sim_id").withColumn("layer", F.lit(layer))
    return points.where(F.col("layer") != layer).select("layer", "tomo_id", "part_id", "x", "y", "z").unionByName(new.select(F.col("layer").cast(points.schema["layer"].dataType).alias("layer"), "tomo_id", F.col("part_id").cast(points.schema["part_id"].dataType).alias("part_id"), "x", "y", "z"))


def instances(models: dict[str, DataFrame]) -> DataFrame:
    """The points of many models' instances as one table, under ``model``."""
    out = None
    for name, df in models.items():
        own = df.withColumn("model", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


#: Null models by name; more may be added. Each takes (counts: tomo_id, n, lo, hi; sims; seed) and gives sim_id, tomo_id, part_id, x, y, z.
MODELS = {"csr": lambda counts, sims, seed: csr(counts, "n", sims, seed)}


def generated(model: str, counts: DataFrame, sims: int, seed: int = 0) -> DataFrame:
    """Instances of a registered model."""
    return MODELS[model](counts, sims, seed)


def cap_points(n: DataFrame, axis: Sequence[float], angle: float, radius: float, seed: int = 0) -> DataFrame:
    """id, x, y, z: for each id, a uniform point of a sphere's cap: at most angle (degrees) from an axis."""
    import math

    length = math.sqrt(sum(v * v for v in axis))
    w = [v / length for v in axis]
    helper = [1.0, 0.0, 0.0] if abs(w[0]) < 0.9 else [0.0, 1.0, 0.0]
    u = [w[1] * helper[2] - w[2] * helper[1], w[2] * helper[0] - w[0] * helper[2], w[0] * helper[1] - w[1] * helper[0]]
    length = math.sqrt(sum(v * v for v in u))
    u = [v / length for v in u]
    v = [w[1] * u[2] - w[2] * u[1], w[2] * u[0] - w[0] * u[2], w[0] * u[1] - w[1] * u[0]]
    z = 1 - (1 - math.cos(math.radians(angle))) * unit(seed, "id", F.lit("z"))
    a, r = TURN * unit(seed, "id", F.lit("a")), F.sqrt(1 - z * z)
    return n.select("id", *[(radius * (z * w[k] + r * F.cos(a) * u[k] + r * F.sin(a) * v[k])).alias(c) for k, c in enumerate("xyz")])
