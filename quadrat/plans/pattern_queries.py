"""Registered queries of point patterns, regions and null models that queries.py does not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import geometry as G
from quadrat.operators import columns, points, regions, simulate, tables
from quadrat.plans.queries import BOTH, DIST, KEYS, NN, PAIR, RADII, P, both_lists, particles, query, rounded, table

#: A volume of interest for each tomogram: voxels of 4 units a side, in a ball about 0.
SIZE, BALL = 4.0, 30.0


def voi(spark, d, inside=True):
    g = spark.range(17**3).select(*[((F.floor(F.col("id") / 17**k) % 17 - 8) * SIZE).alias(c) for k, c in enumerate("xyz")])
    r = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    g = g.where(r <= BALL * BALL if inside else r > BALL * BALL)
    return g.join(F.broadcast(particles(spark, d).select("tomo_id").distinct()), F.lit(True))  # one volume for each tomogram: the table itself


G3 = "g AS (SELECT (a - 8) * 4.0::DOUBLE AS x, (b - 8) * 4.0::DOUBLE AS y, (c - 8) * 4.0::DOUBLE AS z FROM range(17) t(a), range(17) u(b), range(17) v(c))"
VOI = f"{G3}, voi AS (SELECT t.tomo_id, x, y, z FROM g, (SELECT DISTINCT tomo_id FROM p) t WHERE x * x + y * y + z * z <= 900), out AS (SELECT t.tomo_id, x, y, z FROM g, (SELECT DISTINCT tomo_id FROM p) t WHERE x * x + y * y + z * z > 900)"


@query(f"WITH {P}, {VOI} SELECT a.tomo_id, a.part_id AS id, r.r, (count(*) FILTER ({DIST} <= r.r) * 64)::DOUBLE AS volume FROM p a JOIN voi b ON a.tomo_id = b.tomo_id CROSS JOIN (VALUES (6.0::DOUBLE), (9.0)) AS r(r) WHERE {DIST} <= 9 GROUP BY ALL")
def local_volumes(spark, d):
    return regions.local_volumes(particles(spark, d), voi(spark, d), [6.0, 9.0], voxel=SIZE)


VOLUMES = "lv AS (SELECT a.list_id, a.tomo_id, r.r, (count(*) FILTER ({D} <= r.r) * 64)::DOUBLE AS volume FROM p a JOIN voi b ON a.tomo_id = b.tomo_id CROSS JOIN (VALUES (6.0::DOUBLE), (9.0)) AS r(r) WHERE {D} <= 9 GROUP BY ALL)".replace("{D}", DIST)
PAIRS = "pc AS (SELECT g.list_id, g.tomo_id, r.r, count(q.dist) FILTER (q.dist <= r.r) AS pairs FROM (SELECT DISTINCT list_id, tomo_id FROM p) g CROSS JOIN (VALUES (6.0::DOUBLE), (9.0)) AS r(r) LEFT JOIN (SELECT a.list_id, a.tomo_id, {D} AS dist FROM p a JOIN p b ON a.list_id = b.list_id AND a.tomo_id = b.tomo_id AND a.part_id <> b.part_id) q ON q.list_id = g.list_id AND q.tomo_id = g.tomo_id GROUP BY ALL)".replace("{D}", DIST)


def _terms(spark, d):
    p = particles(spark, d)
    return points.pair_counts(p, p, [6.0, 9.0], KEYS), p


@query(f"WITH {P}, {VOI}, {VOLUMES}, {PAIRS}, w AS (SELECT tomo_id, count(*) * 64.0::DOUBLE AS v FROM voi GROUP BY 1), n AS (SELECT list_id, tomo_id, count(*) / any_value(v) AS density FROM p JOIN w USING (tomo_id) GROUP BY ALL) SELECT list_id, tomo_id, r, pairs, round(r * (power(pairs / nullif(volume, 0) / density, 1.0 / 3) - 1), 6) AS l FROM pc JOIN lv USING (list_id, tomo_id, r) JOIN n USING (list_id, tomo_id)")
def second_order_voi(spark, d):
    """L with edge correction by the part of each ball inside the volume of interest."""
    counts, p = _terms(spark, d)
    keyed = voi(spark, d).join(F.broadcast(p.select("list_id").distinct()), F.lit(True))
    volumes = regions.local_volumes(p, keyed, [6.0, 9.0], KEYS, voxel=SIZE)
    whole = voi(spark, d).groupBy("tomo_id").agg((F.count(F.lit(1)) * SIZE**3).alias("v"))
    density = tables.counts(p, *KEYS).join(whole, "tomo_id").select(*KEYS, (F.col("n") / F.col("v")).alias("density"))
    return rounded(regions.second_order_in_voi(counts, volumes, density, KEYS))


@query(f"WITH {P}, {VOI}, l AS (SELECT DISTINCT list_id FROM p), q AS (SELECT a.list_id AS reference, b.list_id AS target, a.tomo_id, {DIST} AS dist FROM {BOTH}), gg AS (SELECT DISTINCT p.list_id AS reference, l.list_id AS target, p.tomo_id FROM p, l WHERE p.list_id <> l.list_id), pc AS (SELECT gg.*, count(q.dist) FILTER (q.dist <= 9) AS pairs FROM gg LEFT JOIN q USING (reference, target, tomo_id) GROUP BY ALL), lv AS (SELECT a.list_id AS reference, a.tomo_id, count(*) * 64.0::DOUBLE AS volume FROM p a JOIN voi b ON a.tomo_id = b.tomo_id WHERE {DIST} <= 9 GROUP BY ALL) SELECT reference, target, tomo_id, 9.0::DOUBLE AS r, pairs, volume FROM pc JOIN lv USING (reference, tomo_id)")
def bi_2nd_order_terms(spark, d):
    """Numerators and denominators apart, for all pairs of lists."""
    left, right = both_lists(spark, d)
    counts = points.pair_counts(left, right, [9.0], PAIR, same=False)
    volumes = regions.local_volumes(particles(spark, d), voi(spark, d), [9.0], voxel=SIZE)
    own = left.select(*PAIR, F.col("part_id").alias("id")).join(volumes, ["tomo_id", "id"])
    return regions.second_order_terms(counts, own, PAIR)


@query(f"WITH {P}, {VOI} SELECT tomo_id, part_id FROM p a WHERE NOT EXISTS (SELECT 1 FROM out b WHERE a.tomo_id = b.tomo_id AND {DIST} <= 7)")
def voi_interior(spark, d):
    return regions.interior(particles(spark, d), voi(spark, d, False), 7.0).select("tomo_id", "part_id")


@query(f"WITH {P}, {VOI} SELECT tomo_id, part_id FROM p WHERE EXISTS (SELECT 1 FROM voi WHERE voi.tomo_id = p.tomo_id AND round(p.x / 4) * 4 = voi.x AND round(p.y / 4) * 4 = voi.y AND round(p.z / 4) * 4 = voi.z)")
def voi_embedded(spark, d):
    return regions.embedded(particles(spark, d), voi(spark, d), size=SIZE).select("tomo_id", "part_id")


@query(f"WITH {P} SELECT s.s AS sim_id, tomo_id, count(*) AS n, true AS inside, true AS apart FROM p, range(3) s(s) GROUP BY ALL")
def csr_voi(spark, d):
    """Random points on the volume of interest: as many as there are particles, all on it, none twice."""
    n, v = tables.counts(particles(spark, d), "tomo_id"), voi(spark, d)
    p = simulate.csr_in_voi(n, v, 3, tries=40, seed=4, size=SIZE)
    inside = regions.embedded(p, v, size=SIZE).withColumn("_in", F.lit(True))
    out = p.join(inside.select("sim_id", "tomo_id", "part_id", "_in"), ["sim_id", "tomo_id", "part_id"], "left")
    return out.groupBy("sim_id", "tomo_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("_in", F.lit(False))).alias("inside"), (F.countDistinct("x", "y", "z") == F.count(F.lit(1))).alias("apart"))


WAVE = "(sin(2 * pi() * x * 2 / 64) + sin(2 * pi() * y * 3 / 64) + sin(2 * pi() * z / 64)) / 3 > 0.2"


@query(f"WITH {P}, {VOI} SELECT s.s AS sim_id, tomo_id, least(any_value(c.n), count(*)) AS n, true AS high FROM voi JOIN (SELECT tomo_id, count(*) AS n FROM p GROUP BY 1) c USING (tomo_id), range(2) s(s) WHERE {WAVE} GROUP BY ALL")
def srpv(spark, d):
    """Random points where a periodic field is high: the number that there is room for, all above the threshold."""
    n = tables.counts(particles(spark, d), "tomo_id")
    p = simulate.periodic_points(voi(spark, d), n, (2, 3, 1), (64, 64, 64), 0.2, 2, seed=9)
    waves = sum((F.sin(2 * 3.141592653589793 * k / 64 * F.col(c)) for c, k in (("x", 2), ("y", 3), ("z", 1))), F.lit(0.0)) / 3
    return p.groupBy("sim_id", "tomo_id").agg(F.countDistinct("x", "y", "z").alias("n"), F.bool_and(waves > 0.2).alias("high"))


@query(f"WITH {P} SELECT tomo_id, count(*) AS n, true AS turned, true AS still FROM p GROUP BY 1")
def rr(spark, d):
    """Random rotations: centres stay, angles are in range and differ."""
    p = particles(spark, d)
    r = simulate.random_rotation(p, seed=2).join(p.select("part_id", *[F.col(c).alias(f"_{c}") for c in "xyz"]), "part_id")
    turned = F.bool_and((F.abs("rot") <= 180) & F.col("tilt").between(0, 180) & (F.abs("psi") <= 180)) & (F.countDistinct("rot") == F.count(F.lit(1)))
    return r.groupBy("tomo_id").agg(F.count(F.lit(1)).alias("n"), turned.alias("turned"), F.bool_and((F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("z") == F.col("_z"))).alias("still"))


@query()
def second_pattern_voi(spark, d):
    """Counterparts on the volume of interest."""
    return simulate.second_pattern_in_voi(particles(spark, d), voi(spark, d), 6.0, 1.0, seed=3, size=SIZE)


def _rods(spark, d):
    """A rod of five samples for each particle."""
    p = particles(spark, d).select("tomo_id", F.col("part_id").alias("curve_id"), *"xyz", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq"))
    return p.withColumn("x", F.col("x") + F.col("seq") * 0.5)


@query()
def rsr(spark, d):
    """Filaments with a random shift and rotation on the volume of interest, put in without meeting."""
    boxes = particles(spark, d).select("tomo_id").distinct().withColumns({"lo": F.array(*[F.lit(-BALL)] * 3), "hi": F.array(*[F.lit(BALL)] * 3)})
    return simulate.inserted(simulate.turned_filaments(_rods(spark, d), voi(spark, d), boxes, seed=1, size=SIZE), 0.5)


RODS = "c AS (SELECT tomo_id, part_id AS curve_id, x + s * 0.5 AS x, y, z FROM p, range(5) t(s))"


@query(f"WITH {P}, {RODS} SELECT DISTINCT a.tomo_id, a.curve_id AS a, b.curve_id AS b FROM c a JOIN c b ON a.tomo_id = b.tomo_id AND a.curve_id < b.curve_id WHERE {DIST} < 3")
def filament_intersections(spark, d):
    return regions.crossing_curves(_rods(spark, d), 1.5)


@query(f"WITH {P} SELECT layer, tomo_id, count(*) AS n, sum(CASE WHEN layer = 2 THEN 0 ELSE part_id END)::BIGINT AS ids FROM (SELECT list_id + 1 AS layer, tomo_id, part_id FROM p WHERE list_id < 3) GROUP BY ALL")
def random_layer(spark, d):
    p = particles(spark, d).where("list_id < 3").withColumn("layer", F.col("list_id") + 1)
    boxes = p.select("tomo_id").distinct().withColumns({"lo": F.array(*[F.lit(-BALL)] * 3), "hi": F.array(*[F.lit(BALL)] * 3)})
    out = simulate.random_layer(p, 2, boxes, seed=6)
    return out.groupBy("layer", "tomo_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("layer") == 2, 0).otherwise(F.col("part_id"))).alias("ids"))


@query(f"WITH {P} SELECT model, tomo_id, count(*) AS n FROM (SELECT 'real' AS model, tomo_id FROM p UNION ALL SELECT 'csr', tomo_id FROM p, range(2)) GROUP BY ALL")
def model_instances(spark, d):
    """Instances of several models as one table."""
    p = particles(spark, d)
    boxes = tables.counts(p, "tomo_id").withColumns({"lo": F.array(*[F.lit(0.0)] * 3), "hi": F.array(*[F.lit(9.0)] * 3)})
    out = simulate.instances({"real": p.select("tomo_id", "part_id", *"xyz"), "csr": simulate.csr(boxes, "n", 2)})
    return out.groupBy("model", "tomo_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P}, v AS (SELECT tomo_id, floor(x) + i - 4 AS vx, floor(y) + j - 4 AS vy, floor(z) + k - 4 AS vz, x, y, z FROM p, range(9) t(i), range(9) u(j), range(9) w(k)), e AS (SELECT *, (vx - x) * (vx - x) + (vy - y) * (vy - y) + (vz - z) * (vz - z) AS q FROM v) SELECT tomo_id, count(DISTINCT (vx, vy, vz)) AS voxels, round(sum(exp(-q / 2)), 4) AS total FROM e WHERE q <= 9 GROUP BY 1")
def synthetic_density(spark, d):
    v = regions.gaussian_density(particles(spark, d), 1.0)
    return rounded(v.groupBy("tomo_id").agg(F.count(F.lit(1)).alias("voxels"), F.sum("value").alias("total")), 4)


@query(f"WITH {P}, s AS (SELECT *, floor(z / 10)::BIGINT AS slab FROM p), nn AS (SELECT a.tomo_id, a.slab, a.part_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS dist FROM s a JOIN s b ON a.tomo_id = b.tomo_id AND a.slab = b.slab AND a.part_id <> b.part_id GROUP BY ALL), h AS (SELECT tomo_id, slab, count(*) FILTER (dist <= 20) AS total FROM nn GROUP BY ALL) SELECT h.tomo_id, h.slab, b AS bin, round(CASE WHEN total > 0 THEN count(nn.dist) / total ELSE 0 END, 6) AS cdf FROM h CROSS JOIN range(10) r(b) LEFT JOIN nn ON nn.tomo_id = h.tomo_id AND nn.slab = h.slab AND nn.dist <= 20 AND least(floor(nn.dist / 2), 9) <= b GROUP BY h.tomo_id, h.slab, b, total")
def stack_g(spark, d):
    """G of the points of each slab of a stack, in its plane."""
    s = particles(spark, d).withColumn("slab", F.floor(F.col("z") / 10))
    nn = points.knn(s, s, 1, ["tomo_id", "slab"], axes=("x", "y"), exclude_self=True)
    return rounded(points.histogram_cdf(nn, ["tomo_id", "slab"], 0.0, 20.0, 10).select("tomo_id", "slab", "bin", "cdf"))


@query(f"WITH {P} SELECT list_id, tomo_id, count(*) AS area, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(sqrt(greatest(1 - (var_pop(x) + var_pop(y) - sqrt(power(var_pop(x) - var_pop(y), 2) + 4 * power(covar_pop(x, y), 2))) / (var_pop(x) + var_pop(y) + sqrt(power(var_pop(x) - var_pop(y), 2) + 4 * power(covar_pop(x, y), 2))), 0)), 5) AS e FROM p GROUP BY ALL HAVING count(*) > 2")
def slice_moments(spark, d):
    m = regions.moments_2d(particles(spark, d), KEYS).where("area > 2")
    return rounded(m.withColumnRenamed("eccentricity", "e").withColumn("e", F.round("e", 5)))


NEAR = f"q AS (SELECT a.tomo_id, a.part_id AS id, arg_min(b, struct_pack(d := {DIST}, i := b.part_id)) AS s, min({DIST}) AS dist, any_value(a) AS a FROM p a JOIN p b ON a.tomo_id = b.tomo_id AND a.list_id > 0 AND b.list_id = 0 GROUP BY ALL)"


@query(f"WITH {P}, {NEAR}, v AS (SELECT *, (a.x - s.x) * s.x + (a.y - s.y) * s.y + (a.z - s.z) * s.z AS dot FROM q) SELECT tomo_id, id, round(dist, 6) AS dist, CASE WHEN dot > 0 THEN 1 WHEN dot < 0 THEN 2 ELSE 0 END::BIGINT AS side, round(degrees(acos((a.y * s.x + a.z * s.y + a.x * s.z) / sqrt((a.x * a.x + a.y * a.y + a.z * a.z) * (s.x * s.x + s.y * s.y + s.z * s.z)))), 5) AS angle FROM v")
def membrane_sides(spark, d):
    """Sides of a surface (the first list's points, with normals away from 0), distances to it and angles to its normals."""
    p = particles(spark, d)
    surface = p.where("list_id = 0").select("tomo_id", "part_id", *"xyz", F.array("x", "y", "z").alias("normal"))
    rest = p.where("list_id > 0").withColumn("v", F.array("y", "z", "x"))
    return rounded(regions.sides(rest, surface, vector="v").withColumn("angle", F.round("angle", 5)))


@query(f"WITH {P} SELECT tomo_id, part_id AS id FROM p WHERE abs(x) + abs(y) + abs(z) < 15")
def inside_surface(spark, d):
    """Points inside a closed surface of eight triangles about 0."""
    corner = lambda x, y, z: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(z)).alias("z"))
    faces = F.array(*[F.struct(corner(15 * a, 0, 0).alias("a"), corner(0, 15 * b, 0).alias("b"), corner(0, 0, 15 * c).alias("c")) for a in (1, -1) for b in (1, -1) for c in (1, -1)])
    p = particles(spark, d)
    return regions.inside_surface(p, p.select("tomo_id").distinct().select("tomo_id", F.inline(faces)), 5.0)


@query(f"WITH {P}, {NN}, h AS (SELECT list_id, CASE WHEN dist <= 4 THEN 4 WHEN dist <= 8 THEN 8 WHEN dist <= 12 THEN 12 END AS e FROM nn), x AS (SELECT a.list_id, min({DIST}) AS dist FROM p a JOIN p b ON a.tomo_id = b.tomo_id AND a.list_id <> b.list_id GROUP BY a.list_id, a.part_id), f AS (SELECT list_id, CASE WHEN dist <= 4 THEN 4 WHEN dist <= 8 THEN 8 WHEN dist <= 12 THEN 12 END AS e FROM x), l AS (SELECT DISTINCT list_id FROM p), c AS (SELECT l.list_id, b, (SELECT count(*) FROM h WHERE h.list_id = l.list_id AND e <= 4 * (b + 1)) / (SELECT count(*) FROM h WHERE h.list_id = l.list_id AND e IS NOT NULL) AS g, (SELECT count(*) FROM f WHERE f.list_id = l.list_id AND e <= 4 * (b + 1)) / (SELECT count(*) FROM f WHERE f.list_id = l.list_id AND e IS NOT NULL) AS f FROM l, range(3) r(b)) SELECT list_id, b AS bin, round(g, 6) AS g, round(f, 6) AS f, round(CASE WHEN f >= 1 THEN 10 ELSE least((1 - g) / (1 - f), 10) END, 6) AS j FROM c")
def j_function(spark, d):
    p = particles(spark, d)
    g = points.knn(p, p, 1, KEYS, exclude_self=True).where("dist > 0")
    left, right = both_lists(spark, d)
    f = points.knn(left, right, 1, PAIR).groupBy(F.col("reference").alias("list_id"), "id").agg(F.min("dist").alias("dist"))
    cdf = lambda x: points.histogram_cdf(x, ["list_id"], 0.0, 12.0, 3)
    return rounded(points.j_function(cdf(g), cdf(f), ["list_id", "bin"]).select("list_id", "bin", "g", "f", "j"))


@query(f"WITH {P} SELECT tomo_id, part_id AS a, other AS b FROM (SELECT a.tomo_id, a.part_id, b.part_id AS other FROM p a JOIN p b ON a.tomo_id = b.tomo_id AND a.part_id < b.part_id WHERE {DIST} < (1 + a.list_id * 0.3) + (1 + b.list_id * 0.3) + 0.5)")
def overlapping_balls(spark, d):
    p = particles(spark, d).withColumn("r", 1 + F.col("list_id") * 0.3)
    return regions.overlapping_balls(p, 0.5, ["tomo_id"])


@query(f"WITH {P} SELECT list_id, tomo_id, round(avg(x), 6) AS cx, round(var_pop(x), 5) AS xx, round(covar_pop(x, y), 5) AS xy, round(covar_pop(y, z), 5) AS yz FROM p GROUP BY ALL")
def point_moments(spark, d):
    m = regions.moments(particles(spark, d), KEYS)
    return m.select(*KEYS, F.round("cx", 6).alias("cx"), *[F.round(c, 5).alias(c) for c in ("xx", "xy", "yz")])


@query(f"WITH {P} SELECT a.tomo_id, a.list_id AS a, b.list_id AS b, round(min({DIST}), 6) AS dist FROM p a JOIN p b ON a.tomo_id = b.tomo_id AND a.list_id < b.list_id GROUP BY ALL HAVING min({DIST}) <= 6")
def surface_distances(spark, d):
    return rounded(regions.segment_distances(particles(spark, d).withColumnRenamed("list_id", "label"), 6.0))


@query(f"WITH {P} SELECT a.tomo_id, a.list_id AS a, b.list_id AS b, count(*) AS n FROM p a JOIN p b ON a.tomo_id = b.tomo_id WHERE {DIST} <= 5 GROUP BY ALL")
def aligned_pairs(spark, d):
    p = particles(spark, d)
    return regions.aligned_pairs(p, p, 5.0, "list_id")


@query(f"WITH {P}, n AS (SELECT tomo_id, part_id AS id, x + 100 AS px, y AS py FROM p WHERE x BETWEEN -3 AND 3 AND y BETWEEN -3 AND 3) SELECT tomo_id, id, round(px * 2 + py, 6) AS value FROM n WHERE py BETWEEN -3 AND 3")
def interpolated_field(spark, d):
    """Trilinear values of a linear field at points."""
    p = particles(spark, d).where("x BETWEEN -3 AND 3 AND y BETWEEN -3 AND 3").withColumn("z", F.lit(0.25)).withColumn("x", F.col("x") + 100)
    grid = spark.range(10 * 10 * 2).select((F.col("id") % 10 + 95).alias("x"), (F.floor(F.col("id") / 10) % 10 - 5).alias("y"), F.floor(F.col("id") / 100).alias("z"))
    v = grid.join(F.broadcast(p.select("tomo_id").distinct()), F.lit(True)).withColumn("value", (F.col("x") * 2 + F.col("y")).cast("double"))
    return rounded(regions.interpolated(p, v))


@query("SELECT l_linenumber AS k, count(*) AS n, round(avg(l_quantity), 6) AS cx, round(avg(l_discount), 6) AS cy FROM lineitem GROUP BY 1")
def cluster_centroids(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    from quadrat.operators import clusters

    return rounded(clusters.centroids(li, ["k"], ("x", "y")))


@query(f"WITH {P} SELECT tomo_id, count(*) FILTER (near) AS n_near, count(*) AS n FROM (SELECT a.tomo_id, a.part_id, bool_or(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4) AS near FROM p a JOIN p b ON a.tomo_id = b.tomo_id AND a.list_id = 5 AND b.list_id = 0 GROUP BY ALL) GROUP BY 1")
def columns_near(spark, d):
    """Particles of one list near another finder's columns (here the first list's points, seen along z)."""
    p = particles(spark, d)
    return columns.near_columns(p.where("list_id = 0"), p.where("list_id = 5"), 4.0).groupBy("tomo_id").agg(F.count_if("near").alias("n_near"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {P} SELECT part_id, round(degrees(acos(least(1, greatest(-1, (x * y + y * z + z * x) / (x * x + y * y + z * z))))), 5) AS a, round(x, 5) AS back FROM p")
def geometry_rotation_between(spark, d):
    """The rotation that carries one vector onto another's direction: its angle, and what its inverse gives back."""
    p = particles(spark, d).select("part_id", *"xyz")
    m = G.between_vectors([F.col(c) for c in "xyz"], [F.col(c) for c in "yzx"])
    p = p.withColumn("m", m).withColumn("f", F.array(*G.rotated(F.col("m"), [F.col(c) for c in "xyz"])))
    back = G.rotated(G.transposed(F.col("m")), [F.col("f")[k] for k in range(3)])
    return rounded(p.select("part_id", G.angle(F.col("f"), F.array("x", "y", "z")).alias("a"), back[0].alias("back")), 5)


@query(f"WITH {P} SELECT part_id, round(3 * (2 * x + 1) - 1, 6) AS c, round(x, 6) AS i, round(6.0, 6) AS s FROM p")
def geometry_transforms(spark, d):
    """Affine maps composed, inverted and decomposed."""
    one, two = ([2, 0, 0, 0, 2, 0, 0, 0, 2], [1, 0, 0]), ([3, 0, 0, 0, 3, 0, 0, 0, 3], [-1, 0, 0])
    both = G.composed(two, one)
    back = G.inverse(both)
    v = [F.col(c) for c in "xyz"]
    p = particles(spark, d).withColumns(dict(zip("uvw", G.affine(*both, v))))
    return rounded(p.select("part_id", F.col("u").alias("c"), G.affine(*back, [F.col(c) for c in "uvw"])[0].alias("i"), F.lit(G.decomposed(both)[1][0]).alias("s")))


MANHATTAN = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)"
CHEBYSHEV = "greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z))"


@query(f"WITH {P} SELECT a.tomo_id, a.part_id AS id, round(min({MANHATTAN}), 6) AS manhattan, round(min({CHEBYSHEV}), 6) AS chebyshev FROM p a JOIN p b ON a.tomo_id = b.tomo_id AND a.part_id <> b.part_id GROUP BY ALL")
def nn_metrics(spark, d):
    """Nearest neighbours by other metrics."""
    p = particles(spark, d)
    nn = lambda m: points.knn(p, p, 1, ["tomo_id"], exclude_self=True, metric=m).select("tomo_id", "id", F.col("dist").alias(m))
    return rounded(nn("manhattan").join(nn("chebyshev"), ["tomo_id", "id"]))


@query(f"WITH {P}, c AS (SELECT tomo_id, part_id // 40 AS cell, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY ALL) SELECT tomo_id, id, cell FROM (SELECT a.tomo_id, a.part_id AS id, arg_min(b.cell, struct_pack(d := {DIST}, c := b.cell)) AS cell FROM p a JOIN c b ON a.tomo_id = b.tomo_id GROUP BY ALL)")
def closest_cells(spark, d):
    """Each point's closest cell, by the cells' centres."""
    from quadrat.operators import clusters

    p = particles(spark, d)
    c = clusters.centroids(p.withColumn("cell", F.floor(F.col("part_id") / 40)), ["tomo_id", "cell"]).select("tomo_id", "cell", *[F.col(f"c{a}").alias(a) for a in "xyz"])
    return points.knn(p, c, 1, ["tomo_id"], right_id="cell").select("tomo_id", "id", F.col("other").alias("cell"))


@query(f"WITH {P}, n AS (SELECT list_id, tomo_id, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT 'a' AS name, tomo_id, sum(n) * 1.0::DOUBLE AS value FROM n GROUP BY 2 UNION ALL SELECT 'b', tomo_id, max(n) FROM n GROUP BY 2) SELECT name, tomo_id, value, round(value - avg(value) OVER (PARTITION BY tomo_id), 6) AS difference FROM q")
def functions_compared(spark, d):
    n = tables.counts(particles(spark, d), *KEYS)
    own = lambda f: n.groupBy("tomo_id").agg(f("n").cast("double").alias("value"))
    return rounded(points.compared({"a": own(F.sum), "b": own(F.max)}, ["tomo_id"]))


@query(f"WITH {P}, s AS (SELECT *, floor(z / 10)::BIGINT AS slab FROM p), q AS (SELECT a.tomo_id, a.slab, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM s a JOIN s b ON a.tomo_id = b.tomo_id AND a.slab = b.slab AND a.part_id <> b.part_id), n AS (SELECT tomo_id, slab, count(*) AS n FROM s GROUP BY ALL) SELECT n.tomo_id, n.slab, r.r, round(sqrt(3600.0 * count(q.dist) FILTER (q.dist < r.r) / (any_value(n) * any_value(n))), 6) AS ripley FROM n CROSS JOIN (VALUES (4.0::DOUBLE), (8.0)) AS r(r) LEFT JOIN q ON q.tomo_id = n.tomo_id AND q.slab = n.slab GROUP BY ALL")
def stack_ripley(spark, d):
    """Ripley's function of the points of each slab of a stack, in its plane."""
    s = particles(spark, d).withColumn("slab", F.floor(F.col("z") / 10))
    keys = ["tomo_id", "slab"]
    counts = points.pair_counts(s, s, [4.0, 8.0], keys, ("x", "y"), strict=True)
    sizes = tables.counts(s, *keys).withColumn("area", F.lit(3600.0))
    return rounded(points.ripley_2d(counts, sizes, keys).select(*keys, "r", "ripley"))


@query(f"WITH {P} SELECT s.s AS sim_id, tomo_id, count(*) AS n, true AS inside FROM p, range(2) s(s) GROUP BY ALL")
def model_registry(spark, d):
    """A registered null model's instances."""
    boxes = tables.counts(particles(spark, d), "tomo_id").withColumns({"lo": F.array(*[F.lit(-3.0)] * 3), "hi": F.array(*[F.lit(5.0)] * 3)})
    out = simulate.generated("csr", boxes, 2, seed=8)
    return out.groupBy("sim_id", "tomo_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.least("x", "y", "z") >= -3).alias("inside"))


@query("SELECT count(*) AS n, true AS on_sphere, true AS in_cap FROM part")
def sphere_cap_points(spark, d):
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    c = simulate.cap_points(ids, [1.0, 2.0, 2.0], 30.0, 5.0, seed=2)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    cos = (F.col("x") + 2 * F.col("y") + 2 * F.col("z")) / 3 / r
    return c.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(r - 5) < 1e-9).alias("on_sphere"), F.bool_and(cos >= 0.8660254).alias("in_cap"))


@query(f"WITH {P} SELECT list_id, n, round(first, 6) AS first, round(last, 6) AS last FROM (SELECT label::BIGINT AS list_id, count(*) AS n, avg(embedding[1]::DOUBLE) AS first, avg(embedding[64]::DOUBLE) AS last FROM embeddings GROUP BY 1)")
def class_averages(spark, d):
    from quadrat.operators import clusters

    v = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("list_id"), F.col("embedding").cast("array<double>").alias("features"))
    a = clusters.class_averages(v, "list_id")
    return rounded(a.select("list_id", "n", F.col("average")[0].alias("first"), F.col("average")[63].alias("last")))


EX = "m AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[])) AS c FROM embeddings), e AS (SELECT label, arg_min(c, vec_id) AS e FROM m GROUP BY 1), s AS (SELECT label, list_inner_product(c, e) / sqrt(list_inner_product(c, c) * list_inner_product(e, e)) AS ncc FROM m JOIN e USING (label))"


@query(f"WITH {EX} SELECT label::BIGINT AS list_id, count(*) AS n, round(avg(ncc), 6) AS mean, round(stddev_samp(ncc), 6) AS std, round(quantile_cont(ncc, 0.05), 6) AS low FROM s GROUP BY 1")
def exemplar_statistics(spark, d):
    from quadrat.operators import clusters

    v = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("list_id"), F.col("embedding").cast("array<double>").alias("features"))
    first = v.groupBy("list_id").agg(F.min_by("features", "vec_id").alias("exemplar"))
    return rounded(clusters.exemplar_statistics(v, "list_id", first))
