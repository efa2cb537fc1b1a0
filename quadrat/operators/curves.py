"""Space curves: (curve_id, seq, x, y, z) rows; one window over each curve's order gives all its differential features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _norm(v: Sequence[Column]) -> Column:
    return F.sqrt(sum((c * c for c in v), F.lit(0.0)))


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((x * y for x, y in zip(a, b)), F.lit(0.0))


def _w(key: str, seq: str):
    return W.partitionBy(key).orderBy(seq)


def arc_length(curves: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """curves with ds (from the point before; 0 at the first) and s (cumulative)."""
    w = _w(key, seq)
    ds = F.coalesce(_norm([F.col(c) - F.lag(c).over(w) for c in XYZ]), F.lit(0.0))
    return curves.withColumn("ds", ds).withColumn("s", F.sum("ds").over(w.rowsBetween(W.unboundedPreceding, 0)))


def derivatives(curves: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """curves with central differences d1, d2, d3 as arrays (null where the stencil does not fit)."""
    w = _w(key, seq)
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    d1 = F.array(*[(at(c, 1) - at(c, -1)) / 2 for c in XYZ])
    d2 = F.array(*[at(c, 1) - 2 * F.col(c) + at(c, -1) for c in XYZ])
    d3 = F.array(*[(at(c, 2) - 2 * at(c, 1) + 2 * at(c, -1) - at(c, -2)) / 2 for c in XYZ])
    return curves.withColumns({"d1": d1, "d2": d2, "d3": d3})


def curvature(curves: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """curves with curvature |r' x r''| / |r'|^3; null at the ends."""
    d = derivatives(curves, key, seq)
    a, b = [[F.col(n)[k] for k in range(3)] for n in ("d1", "d2")]
    speed = _norm(a)
    return d.withColumn("curvature", _norm(_cross(a, b)) / F.nullif(speed * speed * speed, F.lit(0.0))).drop("d1", "d2", "d3")


def torsion(curves: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """curves with signed torsion (r' x r'') . r''' / |r' x r''|^2; null within two points of the ends."""
    d = derivatives(curves, key, seq)
    a, b, c = [[F.col(n)[k] for k in range(3)] for n in ("d1", "d2", "d3")]
    x = _cross(a, b)
    return d.withColumn("torsion", _dot(x, c) / F.nullif(_dot(x, x), F.lit(0.0))).drop("d1", "d2", "d3")


def features(curves: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """key, n, length, end_to_end, sinuosity, apex (largest distance from the line between the ends' midpoint)."""
    a = arc_length(curves, key, seq).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("ds").alias("length"), F.min_by(F.struct(*XYZ), seq).alias("_a"), F.max_by(F.struct(*XYZ), seq).alias("_b"))
    end = _norm([F.col(f"_b.{c}") - F.col(f"_a.{c}") for c in XYZ])
    return a.withColumn("end_to_end", end).withColumn("sinuosity", F.col("length") / F.nullif(F.col("end_to_end"), F.lit(0.0))).drop("_a", "_b")


def total_curvature(curves: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    return curvature(arc_length(curves, key, seq), key, seq).groupBy(key).agg(F.sum(F.col("curvature") * F.col("ds")).alias("total_curvature"), F.max("curvature").alias("max_curvature"))


def decimated(curves: DataFrame, step: int, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """Every step-th point of each curve, the first one included."""
    return curves.withColumn("_k", F.row_number().over(_w(key, seq)) - 1).where(F.col("_k") % step == 0).drop("_k")


def resampled(curves: DataFrame, step: float, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """key, k, x, y, z: points every step of arc length, interpolated linearly."""
    w = _w(key, seq)
    a = arc_length(curves, key, seq).withColumns({f"_n{c}": F.lead(c).over(w) for c in (*XYZ, "s")})
    first, last = F.ceil(F.col("s") / step), F.ceil(F.col("_ns") / step) - 1
    inner = a.where(F.col("_ns") > F.col("s")).where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("k"))
    t = (F.col("k") * step - F.col("s")) / (F.col("_ns") - F.col("s"))
    return inner.select(key, "k", *[(F.col(c) + t * (F.col(f"_n{c}") - F.col(c))).alias(c) for c in XYZ])


def smoothed(curves: DataFrame, strength: float, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """p + strength * ((previous + next) / 2 - p); the ends stay."""
    w = _w(key, seq)
    move = lambda c: F.coalesce(F.col(c) + strength * ((F.lag(c).over(w) + F.lead(c).over(w)) / 2 - F.col(c)), F.col(c))
    return curves.select([move(c).alias(c) if c in XYZ else F.col(c) for c in curves.columns])


def persistence(curves: DataFrame, max_angle: float, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """key, persistence: -L / ln(cos theta) of the longest beginning whose tangents stay within max_angle (degrees) of the
    first one; theta: its last angle. -1 for curves of two points or fewer, 0 where the logarithm has no value."""
    w = _w(key, seq)
    step = [F.lead(c).over(w) - F.col(c) for c in XYZ]
    t = curves.withColumns({f"_t{k}": v for k, v in enumerate(step)}).withColumn("_l", _norm([F.col(f"_t{k}") for k in range(3)]))
    v = [F.col(f"_t{k}") for k in range(3)]
    first = [F.first(c).over(w) for c in v]
    cos = _dot(v, first) / F.nullif(_norm(v) * _norm(first), F.lit(0.0))
    t = t.where("_l IS NOT NULL").withColumn("_cos", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    t = t.withColumn("_ok", F.min(F.degrees(F.acos("_cos")) <= max_angle).over(w.rowsBetween(W.unboundedPreceding, 0)))
    part = t.where("_ok").groupBy(key).agg(F.sum("_l").alias("_len"), F.max_by("_cos", seq).alias("_c"))
    n = curves.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(part, key, "left")
    value = F.when((F.col("_c") > 0) & (F.col("_c") < 1), -F.col("_len") / F.log("_c")).otherwise(0.0)
    return n.select(key, F.when(F.col("_n") <= 2, -1.0).otherwise(value).alias("persistence"))


def translated(curves: DataFrame, shift: Sequence[float]) -> DataFrame:
    return curves.withColumns({c: F.col(c) + s for c, s in zip(XYZ, shift)})


def straightened(curves: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """Points at their share of the arc length on the line between the curve's ends."""
    ends = curves.groupBy(key).agg(F.min_by(F.struct(*XYZ), seq).alias("_a"), F.max_by(F.struct(*XYZ), seq).alias("_b"))
    a = arc_length(curves, key, seq)
    total = F.max("s").over(W.partitionBy(key))
    share = F.col("s") / F.nullif(total, F.lit(0.0))
    return a.withColumn("_f", F.coalesce(share, F.lit(0.0))).join(ends, key).select([(F.col(f"_a.{c}") + F.col("_f") * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))).alias(c) if c in XYZ else F.col(c) for c in curves.columns])


def turned(curves: DataFrame, matrix: Sequence[float], key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """Curves turned by a matrix (nine numbers) about their first points."""
    first = curves.groupBy(key).agg(F.min_by(F.struct(*XYZ), seq).alias("_f"))
    off = [F.col(c) - F.col(f"_f.{c}") for c in XYZ]
    new = {c: F.col(f"_f.{c}") + sum((matrix[3 * i + k] * off[k] for k in range(3)), F.lit(0.0)) for i, c in enumerate(XYZ)}
    return curves.join(first, key).withColumns(new).select(curves.columns)


def line_points(lines: DataFrame, step: float, id_col: str = "id") -> DataFrame:
    """id, k, x, y, z: points every step from a to b (structs), both ends included."""
    d = _norm([F.col(f"b.{c}") - F.col(f"a.{c}") for c in XYZ])
    n = F.ceil(d / step)
    k = lines.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    t = F.when(F.col("k") == F.col("_n"), F.when(F.col("_n") == 0, 0.0).otherwise(1.0)).otherwise(F.col("k") * step / F.nullif(d, F.lit(0.0)))
    return k.withColumn("_t", t).select(id_col, "k", *[(F.col(f"a.{c}") + F.col("_t") * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in XYZ])


def as_polylines(curves: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """key, points: an array of structs in order."""
    return curves.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("_k"), F.struct(*XYZ).alias("p")))), lambda r: r["p"]).alias("points"))


def as_points(lines: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    return lines.select(key, F.posexplode("points").alias(seq, "_p")).select(key, seq, "_p.*")


def frame_symmetry(curves: DataFrame, key: str = "curve_id", seq: str = "seq") -> DataFrame:
    """key, normal_symmetry, binormal_symmetry: length of the mean unit normal (binormal) along the curve: 1 if it never turns."""
    d = derivatives(curves, key, seq)
    a, b = [[F.col(n)[k] for k in range(3)] for n in ("d1", "d2")]
    bi = _cross(a, b)
    no = _cross(bi, a)
    unit = lambda v: [c / F.nullif(_norm(v), F.lit(0.0)) for c in v]
    mean = lambda v: _norm([F.avg(c) for c in unit(v)])
    return d.where("d2 IS NOT NULL").groupBy(key).agg(mean(no).alias("normal_symmetry"), mean(bi).alias("binormal_symmetry"))
