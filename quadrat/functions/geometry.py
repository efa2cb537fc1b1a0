"""Rotations and angles as column expressions. Angles in degrees; matrices are arrays of nine, row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _product(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)]


def _about(axis: str, angle: Column) -> list[Column]:
    """The passive rotation about an axis."""
    c, s, o, z = F.cos(F.radians(angle)), F.sin(F.radians(angle)), F.lit(1.0), F.lit(0.0)
    return {"z": [c, s, z, -s, c, z, z, z, o], "y": [c, z, -s, z, o, z, s, z, c], "x": [o, z, z, z, c, s, z, -s, c]}[axis]


def matrix(rot: Column, tilt: Column, psi: Column, order: str = "zyz") -> Column:
    """Rotation about the first axis by rot, the second by tilt, the third by psi."""
    a, b, c = order
    return F.array(*_product(_about(c, psi), _product(_about(b, tilt), _about(a, rot))))


def transposed(m: Column) -> Column:
    return F.array(*[F.get(m, F.lit(3 * j + i)) for i in range(3) for j in range(3)])


def rotated(m: Column, v: Sequence[Column]) -> list[Column]:
    return [sum((F.get(m, F.lit(3 * i + k)) * v[k] for k in range(3)), F.lit(0.0)) for i in range(3)]


def angles_zyz(m: Column) -> Column:
    """struct<rot, tilt, psi> of a ZYZ matrix; rot is 0 where the tilt is 0 or 180."""
    g = lambda k: F.get(m, F.lit(k))
    tilt = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g(8)))))
    flat = F.abs(g(8)) > 1 - 1e-12
    rot = F.when(flat, 0.0).otherwise(F.degrees(F.atan2(g(7), g(6))))
    psi = F.when(flat, F.degrees(F.atan2(g(1), F.when(g(8) < 0, -g(0)).otherwise(g(0))))).otherwise(F.degrees(F.atan2(g(5), -g(2))))
    return F.struct(rot.alias("rot"), tilt.alias("tilt"), psi.alias("psi"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Column, b: Column) -> Column:
    c = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def tilt_and_rot(v: Sequence[Column]) -> Column:
    """struct<rot, tilt> that turn the z axis into v."""
    r = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.struct(F.degrees(F.atan2(v[1], v[0])).alias("rot"), F.degrees(F.acos(v[2] / F.nullif(r, F.lit(0.0)))).alias("tilt"))


def unrolled(a: Column) -> Column:
    """An angle in (-180, 180]."""
    r = F.signum(a) * (F.abs(a) % 360)
    return F.when(r > 180, r - 360).when(r <= -180, r + 360).otherwise(r)


def quaternion(rot: Column, tilt: Column, psi: Column) -> Column:
    """struct<w, x, y, z> of a ZYZ rotation."""
    h = lambda a: F.radians(a) / 2
    c, s = F.cos(h(tilt)), F.sin(h(tilt))
    p, m = h(rot) + h(psi), h(rot) - h(psi)
    return F.struct((c * F.cos(p)).alias("w"), (-s * F.sin(m)).alias("x"), (s * F.cos(m)).alias("y"), (c * F.sin(p)).alias("z"))


def quaternion_angle(a: Column, b: Column) -> Column:
    """The angle between two rotations."""
    d = sum((a[k] * b[k] for k in "wxyz"), F.lit(0.0))
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(d))))


def spherical(v: Sequence[Column]) -> Column:
    """struct<r, theta, phi>."""
    r = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.struct(r.alias("r"), F.degrees(F.acos(v[2] / F.nullif(r, F.lit(0.0)))).alias("theta"), F.degrees(F.atan2(v[1], v[0])).alias("phi"))


def affine(m: Sequence[float], shift: Sequence[float], v: Sequence[Column]) -> list[Column]:
    return [sum((m[3 * i + k] * v[k] for k in range(3)), F.lit(float(shift[i]))) for i in range(3)]


def along(v: Sequence[Column], normal: Sequence[Column], d: Column) -> list[Column]:
    return [a + d * n for a, n in zip(v, normal)]


def sphere_distance(a: Column, b: Column, radius: Column) -> Column:
    return radius * F.radians(angle(a, b))


def between_vectors(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The rotation about their common normal that turns a's direction into b's; of opposite vectors, half a turn about a normal of a."""
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    a, b = ([c / F.nullif(length(v), F.lit(0.0)) for c in v] for v in (a, b))
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    c = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    flat = c < -1 + 1e-12
    # Half a turn about the axis that is least along a, made normal to it.
    helper = [F.when(F.abs(a[0]) < 0.6, 1.0).otherwise(0.0), F.when(F.abs(a[0]) < 0.6, 0.0).otherwise(1.0), F.lit(0.0)]
    along_a = sum((h * x for h, x in zip(helper, a)), F.lit(0.0))
    axis = [h - along_a * x for h, x in zip(helper, a)]
    axis = [x / length(axis) for x in axis]
    k = 1 / F.nullif(1 + c, F.lit(0.0))
    out = []
    for i in range(3):
        for j in range(3):
            one = F.lit(1.0 if i == j else 0.0)
            skew = F.lit(0.0) if i == j else cross[3 - i - j] * (1 if (j - i) % 3 == 2 else -1)
            square = cross[i] * cross[j] - (cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) * (1.0 if i == j else 0.0)
            out.append(F.when(flat, 2 * axis[i] * axis[j] - one).otherwise(one + skew + k * square))
    return F.array(*out)


def matrix_of_quaternion(q: Column) -> Column:
    """The rotation of a unit quaternion (w, x, y, z)."""
    w, x, y, z = (q[c] for c in "wxyz")
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def quaternion_of_matrix(m: Column) -> Column:
    """The unit quaternion (w, x, y, z) of a rotation, with w >= 0."""
    g = lambda i, j: F.get(m, F.lit(3 * i + j))
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / 2
    w = root(1 + g(0, 0) + g(1, 1) + g(2, 2))
    x, y, z = root(1 + g(0, 0) - g(1, 1) - g(2, 2)), root(1 - g(0, 0) + g(1, 1) - g(2, 2)), root(1 - g(0, 0) - g(1, 1) + g(2, 2))
    signed = lambda v, d: F.when(d < 0, -v).otherwise(v)
    # Half a turn has no w; then signs follow from the products of the parts.
    turn = w < 1e-9
    sx = F.when(turn, x).otherwise(signed(x, g(2, 1) - g(1, 2)))
    sy = F.when(turn, signed(y, F.when(x > 1e-9, g(0, 1)).otherwise(F.lit(1.0)))).otherwise(signed(y, g(0, 2) - g(2, 0)))
    sz = F.when(turn, signed(z, F.when(x > 1e-9, g(0, 2)).otherwise(g(1, 2)))).otherwise(signed(z, g(1, 0) - g(0, 1)))
    return F.struct(w.alias("w"), sx.alias("x"), sy.alias("y"), sz.alias("z"))


Affine = tuple[Sequence[float], Sequence[float]]  # (nine numbers, shift)


def composed(second: Affine, first: Affine) -> Affine:
    """The map that does first and then second."""
    (m, s), (n, t) = second, first
    return [sum(m[3 * i + k] * n[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)], [sum(m[3 * i + k] * t[k] for k in range(3)) + s[i] for i in range(3)]


def inverse(of: Affine) -> Affine:
    import numpy as np

    m = np.linalg.inv(np.array(of[0], float).reshape(3, 3))
    return m.ravel().tolist(), (-m @ np.array(of[1], float)).tolist()


def decomposed(of: Affine) -> tuple[list[float], list[float], list[float], float]:
    """(rotation, scales, shears xy xz yz, parity): m = rotation * upper triangle of scales and shears; parity -1 mirrors the first axis."""
    import numpy as np

    q, r = np.linalg.qr(np.array(of[0], float).reshape(3, 3))
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    q, r = q * sign, sign[:, None] * r
    parity = float(np.sign(np.linalg.det(q)))
    q[:, 0], r[0] = q[:, 0] * parity, r[0] * parity
    d = np.diag(r)
    return q.ravel().tolist(), d.tolist(), [r[0, 1] / d[0], r[0, 2] / d[0], r[1, 2] / d[1]], parity


def distances_from(points: Column, index: int) -> Column:
    """Distances of an array of points (arrays) from its index-th one."""
    one = F.get(points, F.lit(index))
    return F.transform(points, lambda p: norm(F.zip_with(p, one, lambda a, b: a - b)))


def angles_at(points: Column, index: int) -> Column:
    """Angles at the index-th point between each point and the next (the last and the first)."""
    one, n = F.get(points, F.lit(index)), F.size(points)
    off = F.transform(points, lambda p: F.zip_with(p, one, lambda a, b: a - b))
    return F.transform(off, lambda p, i: angle(p, F.get(off, (i + 1) % n)))
