"""Registered queries of contacts, labelled voxels, shapes and hierarchies that queries.py does not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import contacts, hierarchy, voxels
from quadrat.plans.queries import CS, DIST, H, P, X, nodes, particles, query, rounded, supplier_contacts, table, voxel_rows

# Contacts


@query(f"WITH {CS} SELECT segment_id, boundary_id, n FROM c WHERE boundary_id NOT IN (1, 2, 3)")
def contact_without_boundaries(spark, d):
    return contacts.without_boundaries(contacts.totals(supplier_contacts(spark, d)), [1, 2, 3])


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"))


@query("SELECT o_orderkey AS segment_id, 'touching' AS kind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2)) UNION ALL SELECT o_orderkey, 'not' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2))")
def contact_touching(spark, d):
    one = lambda yes, name: contacts.touching(orders(spark, d), supplier_contacts(spark, d), [1, 2], yes).withColumn("kind", F.lit(name))
    return one(True, "touching").unionAll(one(False, "not"))


@query("SELECT o_orderkey AS segment_id, count(DISTINCT l_suppkey) AS n_boundaries FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) BETWEEN 0 AND 2")
def contact_by_n_boundaries(spark, d):
    return contacts.by_n_boundaries(orders(spark, d), supplier_contacts(spark, d), 0, 2)


@query(f"WITH {CS} SELECT segment_id, CASE WHEN bool_or(boundary_id IN (4, 5)) THEN 0 WHEN bool_or(boundary_id IN (1, 2, 3)) THEN 1 ELSE -1 END::BIGINT AS class FROM c WHERE segment_id IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def contact_classes(spark, d):
    return rounded(contacts.classified(orders(spark, d), supplier_contacts(spark, d), [[4, 5], [1, 2, 3]], rest=True))


@query(f"WITH {CS}, b AS (SELECT segment_id, list_sort(list(DISTINCT boundary_id)) AS l FROM c GROUP BY 1) SELECT segment_id, row_number() OVER (ORDER BY l, segment_id) AS place FROM b")
def contact_order_by_boundaries(spark, d):
    return contacts.ordered_by_boundaries(supplier_contacts(spark, d))


def thirds(spark, d):
    return supplier_contacts(spark, d).select("boundary_id", (F.col("boundary_id") % 3).alias("cluster")).distinct()


@query(f"WITH {CS} SELECT segment_id, min(boundary_id) % 3 AS cluster FROM c GROUP BY 1 HAVING count(DISTINCT boundary_id) > 1")
def contact_connection_clusters(spark, d):
    return contacts.connection_clusters(supplier_contacts(spark, d), thirds(spark, d))


@query(f"WITH {CS}, p AS (SELECT DISTINCT segment_id, boundary_id % 3 AS k FROM c) SELECT a.segment_id, a.k AS a, b.k AS b FROM p a JOIN p b ON a.segment_id = b.segment_id AND a.k < b.k")
def contact_dual_clusters(spark, d):
    return contacts.dual_clusters(supplier_contacts(spark, d), thirds(spark, d))


@query("SELECT s_suppkey AS boundary_id, count(l_orderkey) AS n_connections, round(coalesce(avg(o_totalprice), -1), 2) AS mean_length FROM supplier LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def contact_features(spark, d):
    ends = table(spark, d, "supplier").select(F.col("s_suppkey").alias("boundary_id"))
    lengths = table(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_totalprice").alias("length"))
    return rounded(contacts.connection_features(ends, supplier_contacts(spark, d), lengths), 2)


@query("WITH e AS (SELECT l_suppkey AS a, l_partkey + 1000000 AS b, min(l_extendedprice) AS dist FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY ALL) SELECT s_suppkey AS id, coalesce(arg_min(b, struct_pack(d := dist, k := b)), -1) AS nearest, round(min(dist), 4) AS dist FROM supplier LEFT JOIN e ON a = s_suppkey GROUP BY 1")
def contact_nearest(spark, d):
    li = table(spark, d, "lineitem").where("l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b")).agg(F.min("l_extendedprice").alias("dist"))
    return rounded(contacts.nearest(li, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))), 4)


@query(f"WITH {P} SELECT tomo_id, list_id AS segment_id FROM (SELECT a.tomo_id, a.part_id // 20 AS list_id, max({DIST}) AS m, count(*) AS n FROM p a JOIN p b ON a.tomo_id = b.tomo_id AND a.part_id // 20 = b.part_id // 20 GROUP BY ALL) WHERE m <= 30 AND n > 1")
def contact_distance_threshold(spark, d):
    p = particles(spark, d).withColumn("segment_id", F.floor(F.col("part_id") / 20))
    return contacts.far_apart(p, 30.0, ["tomo_id"])


# Labels


@query(f"WITH {X} SELECT 'keep' AS kind, CASE WHEN label IN (1, 2) THEN label ELSE 0 END AS label, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'drop', CASE WHEN label IN (1, 2) THEN 0 ELSE label END, count(*) FROM x GROUP BY ALL")
def label_keep(spark, d):
    v = voxel_rows(spark, d)
    one = lambda keep, name: voxels.keep_labels(v, [1, 2], keep).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
    return one(True, "keep").unionByName(one(False, "drop"))


@query(f"WITH {X} SELECT CASE WHEN x < 32 AND y >= 10 THEN label ELSE 0 END AS label, count(*) AS n FROM x GROUP BY 1")
def label_restrict(spark, d):
    v = voxel_rows(spark, d)
    return voxels.restricted(v, v.where("x < 32 AND y >= 10")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X} SELECT 'and' AS kind, count(*) AS n FROM x WHERE x < 32 AND value > 20 UNION ALL SELECT 'minus', count(*) FROM x WHERE x < 32 AND NOT value > 20")
def mask_operations(spark, d):
    v = voxel_rows(spark, d)
    a, b = v.where("x < 32"), v.where("value > 20")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
    return count(voxels.mask_and(a, b), "and").unionByName(count(voxels.mask_minus(a, b), "minus"))


@query(f"WITH {X}, o AS (SELECT * FROM x WHERE label > 0 AND y < 40), w AS (SELECT * FROM x WHERE label > 0 AND y >= 30 AND x < 50) SELECT label, count(*) AS n FROM (SELECT label FROM o UNION ALL SELECT label + (SELECT max(label) FROM o) FROM w WHERE y >= 40) GROUP BY 1")
def label_add_segments(spark, d):
    v = voxel_rows(spark, d)
    return voxels.added(v.where("y < 40"), v.where("y >= 30 AND x < 50")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X}, o AS (SELECT * FROM x WHERE label > 0 AND y < 40), w AS (SELECT *, label * 100 + x AS k FROM x WHERE label > 0 AND y >= 39) SELECT label, count(*) AS n FROM (SELECT label FROM o UNION ALL SELECT k + 1000 FROM w WHERE k NOT IN (SELECT k FROM w WHERE y < 40)) GROUP BY 1")
def label_add_without_overlap(spark, d):
    v = voxel_rows(spark, d)
    new = v.where("label > 0 AND y >= 39").withColumn("label", F.col("label") * 100 + F.col("x"))
    return voxels.added(v.where("y < 40"), new, 1000, True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X} SELECT x * 2 + i AS x, y * 2 + j AS y, count(*) AS n, round(sum(value), 4) AS value FROM x, range(2) t(i), range(2) u(j), range(2) w(k) WHERE x < 4 GROUP BY ALL")
def voxel_magnified(spark, d):
    v = voxels.magnified(voxel_rows(spark, d).where("x < 4").select("x", "y", "z", "value"), 2)
    return rounded(v.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")), 4)


@query(f"WITH {X}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM x), t AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM x WHERE label = 2) SELECT x, y, z, round(greatest(0, least(1, (value - (s.m - 2 * s.s)) / (4 * s.s))), 6) AS a, round(greatest(-1, least(1, (value - (t.m - t.s)) / (2 * t.s) * 2 - 1)), 6) AS b FROM x, s, t")
def voxel_contrast(spark, d):
    v = voxel_rows(spark, d)
    a = voxels.contrast(v, 2.0, 0.0, 1.0).select("x", "y", "z", F.col("value").alias("a"))
    b = voxels.contrast(v.withColumn("m", F.col("label") == 2), 1.0, -1.0, 1.0, mask="m").select("x", "y", "z", F.col("value").alias("b"))
    return rounded(a.join(b, ["x", "y", "z"]))


@query(f"WITH {X} SELECT x, y, z, round(greatest(-2, least(3, ln(value) / ln(2))), 6) AS value FROM x")
def voxel_log_map(spark, d):
    return rounded(voxels.log_map(voxel_rows(spark, d), 2.0, -2.0, 3.0).select("x", "y", "z", "value"))


@query(f"WITH {X}, s AS (SELECT min(value) AS a, max(value) AS b, avg(value) AS m, stddev_pop(value) AS s FROM x) SELECT x, y, z, round((x.value - a) * 10 / (b - a) - 5, 6) AS mapped, round(greatest(least(x.value, 30), 20), 6) AS clipped, round((x.value - m) / s.s, 6) AS normal FROM x, s")
def voxel_maps(spark, d):
    v = voxel_rows(spark, d)
    out = voxels.linear_map(v, -5.0, 5.0).select("x", "y", "z", F.col("value").alias("mapped"))
    out = out.join(voxels.clipped(v, 20.0, 30.0).select("x", "y", "z", F.col("value").alias("clipped")), ["x", "y", "z"])
    return rounded(out.join(voxels.normalised(v).select("x", "y", "z", F.col("value").alias("normal")), ["x", "y", "z"]))


@query(f"WITH {X} SELECT x, y, z FROM x WHERE x BETWEEN (SELECT min(x) FROM x WHERE label = 4) - 1 AND (SELECT max(x) FROM x WHERE label = 4) + 1 AND y BETWEEN (SELECT min(y) FROM x WHERE label = 4) - 1 AND (SELECT max(y) FROM x WHERE label = 4) + 1 AND z BETWEEN (SELECT min(z) FROM x WHERE label = 4) - 1 AND (SELECT max(z) FROM x WHERE label = 4) + 1")
def voxel_cropped(spark, d):
    return voxels.cropped(voxel_rows(spark, d), 4, 1).select("x", "y", "z")


@query(f"WITH {X}, k AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS k FROM (SELECT DISTINCT z FROM x)) SELECT x, y, z FROM x WHERE z IN (SELECT z FROM k WHERE k % 2 = 0)")
def voxel_decimated(spark, d):
    return voxels.decimated_slices(voxel_rows(spark, d), 2).select("x", "y", "z")


@query(f"WITH {X} SELECT label, arg_min(x, struct_pack(v := value, x := x, y := y, z := z)) AS min_x, arg_min(y, struct_pack(v := -value, x := x, y := y, z := z)) AS max_y FROM x GROUP BY 1")
def label_extrema(spark, d):
    e = voxels.extremum_positions(voxel_rows(spark, d))
    return e.select("label", F.col("at_min.x").alias("min_x"), F.col("at_max.y").alias("max_y"))


@query(f"WITH {X} SELECT CASE WHEN value >= 10 AND value <= 50 AND y >= 0 AND y <= 64 THEN (CASE WHEN value < 25 THEN 0 WHEN value < 40 THEN 1 ELSE 2 END) * 2 + (CASE WHEN y < 20 THEN 0 ELSE 1 END) + 1 ELSE 0 END::BIGINT AS label, count(*) AS n FROM x GROUP BY 1")
def label_by_bins(spark, d):
    v = voxels.labelled_by_bins(voxel_rows(spark, d), {"value": [10, 25, 40, 50], "y": [0, 20, 64]})
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


BLOCKS = "b AS (SELECT tomo_id, x, y, z, value, (x // 8) * 8 + y // 8 + 1 AS label FROM x)"


def blocks(spark, d):
    """Labels by blocks of the grid, which are its segments."""
    return voxel_rows(spark, d).withColumn("label", F.floor(F.col("x") / 8) * 8 + F.floor(F.col("y") / 8) + 1)


@query(f"WITH {X}, {BLOCKS} SELECT label, count(*) AS volume FROM b GROUP BY 1 HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM b GROUP BY label))")
def label_by_volume(spark, d):
    b = blocks(spark, d)
    mean = voxels.by_volume(b).agg(F.avg("volume")).first()[0]
    return voxels.by_volume(b, low=int(-(-mean // 1))).select("label", "volume")


@query(f"WITH {X}, {BLOCKS} SELECT label, CASE WHEN count(*) < 100 THEN 0 ELSE 1 END::BIGINT AS class FROM b GROUP BY 1 HAVING count(*) BETWEEN 1 AND 100000")
def label_classes_by_volume(spark, d):
    return rounded(voxels.classes_by_volume(blocks(spark, d), [1, 100, 100000]).select("label", "class"))


INNER = "i AS (SELECT a.tomo_id, a.x, a.y, a.z, a.label, (SELECT count(*) FROM b WHERE b.label = a.label AND ((b.x = a.x AND b.y = a.y AND abs(b.z - a.z) = 1) OR (b.x = a.x AND b.z = a.z AND abs(b.y - a.y) = 1) OR (b.z = a.z AND b.y = a.y AND abs(b.x - a.x) = 1))) AS n FROM b a)"


@query(f"WITH {X}, {BLOCKS}, {INNER} SELECT label, count(*) FILTER (n < 6) AS surface, count(*) FILTER (n = 6) AS inside FROM i GROUP BY 1")
def label_surfaces(spark, d):
    b = blocks(spark, d)
    count = lambda df, name: df.groupBy("label").agg(F.count(F.lit(1)).alias(name))
    out = count(voxels.surfaces(b), "surface").join(count(voxels.surfaces(b, inner=True), "inside"), "label", "full")
    return out.select("label", F.coalesce("surface", F.lit(0)).alias("surface"), F.coalesce("inside", F.lit(0)).alias("inside"))


@query(f"WITH {X}, {BLOCKS}, {INNER}, r AS (SELECT label, count(*) FILTER (n < 6) / count(*) AS ratio FROM i GROUP BY 1) SELECT label, round(ratio, 6) AS ratio FROM r WHERE ratio BETWEEN 0.2 AND 1")
def label_by_surface_ratio(spark, d):
    return rounded(voxels.by_surface_ratio(blocks(spark, d), 0.2, 1.0).select("label", "ratio"))


SEGMENTS = "s AS (SELECT * FROM x WHERE label = 4), g AS (SELECT * FROM x WHERE label <> 4)"
AROUND = f"{SEGMENTS}, q AS (SELECT DISTINCT a.x, a.y, a.z, a.value, b.x // 16 AS label FROM g a JOIN s b ON a.x BETWEEN b.x - 2 AND b.x + 2 AND a.y BETWEEN b.y - 2 AND b.y + 2 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4)"


def around(spark, d):
    v = voxel_rows(spark, d)
    return v.where("label = 4").withColumn("label", F.floor(F.col("x") / 16) + 1), v.where("label <> 4")


@query(f"WITH {X}, {AROUND} SELECT label + 1 AS label, count(*) AS n FROM q GROUP BY 1")
def label_neighbourhoods(spark, d):
    s, region = around(spark, d)
    return voxels.neighbourhoods(s, region, 2.0).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X}, {AROUND} SELECT label + 1 AS label, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM q GROUP BY 1")
def label_neighbourhood_density(spark, d):
    s, region = around(spark, d)
    return rounded(voxels.neighbourhood_density(s, region, 2.0).drop("tomo_id"))


@query(f"WITH {X}, {AROUND} SELECT x, y, z FROM g WHERE (x, y, z) NOT IN (SELECT (x, y, z) FROM q)")
def label_free_region(spark, d):
    s, region = around(spark, d)
    return voxels.free_region(region, s, 2.0).select("x", "y", "z")


LAYERS = "l AS (SELECT *, (least(floor(value / (value + 25) * 4), 3) + 1)::BIGINT AS layer FROM x)"


def layer_rows(spark, d):
    return voxels.layers(voxel_rows(spark, d).withColumns({"d1": F.col("value"), "d2": F.lit(25.0)}), 4)


@query(f"WITH {X}, {LAYERS} SELECT layer, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(avg(value) / (SELECT avg(value) FROM l), 6) AS relative FROM l GROUP BY 1")
def layer_density(spark, d):
    return rounded(voxels.density_in_layers(voxel_rows(spark, d), layer_rows(spark, d)).drop("tomo_id"))


CENTRES = "m AS (SELECT layer, avg(x) AS mx, avg(y) AS my FROM l GROUP BY 1), c AS (SELECT layer, arg_min(x, struct_pack(d := round((x - mx) * (x - mx) + (y - my) * (y - my), 9), x := x, y := y)) AS cx, arg_min(y, struct_pack(d := round((x - mx) * (x - mx) + (y - my) * (y - my), 9), x := x, y := y)) AS cy FROM l JOIN m USING (layer) GROUP BY 1)"


@query(f"WITH {X}, {LAYERS}, {CENTRES} SELECT * FROM c")
def layer_centres(spark, d):
    return voxels.layer_centres(layer_rows(spark, d)).drop("tomo_id")


@query(f"WITH {X}, {LAYERS}, {CENTRES}, r AS (SELECT layer, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r FROM l JOIN c USING (layer)) SELECT (layer - 1) * 3 + CASE WHEN r < 10 THEN 1 WHEN r < 25 THEN 2 WHEN r <= 100 THEN 3 ELSE 0 END AS label, count(*) AS n FROM r GROUP BY 1")
def layers_by_columns(spark, d):
    rows = layer_rows(spark, d)
    columns = voxels.radial_columns(rows, voxels.layer_centres(rows), [0, 10, 25, 100])
    return voxels.layers_by_columns(rows, columns, 3).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X}, q AS (SELECT a.x, a.y, a.z, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS dist FROM x a JOIN x b ON a.label = 4 AND b.label = 1 GROUP BY ALL) SELECT round(median(dist), 6) AS width, round(avg(dist), 6) AS mean, count(*) AS n FROM q WHERE dist <= 20")
def cleft_width(spark, d):
    """Of the one volume; a row even where a boundary has no voxels."""
    v = voxel_rows(spark, d)
    return rounded(voxels.cleft_width(v.where("label = 4"), v.where("label = 1"), (), most=20.0))


@query(f"WITH {X} SELECT count(*) AS n, round(sum(value), 4) AS total, true AS moved FROM x WHERE label > 1")
def voxel_randomised(spark, d):
    """Values dealt anew among a mask's voxels: the same voxels, the same values, elsewhere."""
    v = voxel_rows(spark, d).where("label > 1")
    r = voxels.randomised(v, seed=3).join(v.select("x", "y", "z", F.col("value").alias("_v")), ["x", "y", "z"])
    return rounded(r.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), (F.avg((F.col("value") != F.col("_v")).cast("double")) > 0.5).alias("moved")), 4)


@query(f"WITH {P}, c AS (SELECT tomo_id, part_id AS label, x, y, z, 1.5 + list_id * 0.25 AS r FROM p), v AS (SELECT c.*, ceil(x - r) + i AS vx, ceil(y - r) + j AS vy, ceil(z - r) + k AS vz FROM c, range(9) t(i), range(9) u(j), range(9) w(k)), e AS (SELECT *, sqrt((vx - x) * (vx - x) + (vy - y) * (vy - y) + (vz - z) * (vz - z)) AS d FROM v) SELECT tomo_id, label, count(*) AS n FROM (SELECT tomo_id, arg_min(label, struct_pack(d := d, l := label)) AS label FROM e WHERE d <= r GROUP BY tomo_id, vx, vy, vz) GROUP BY ALL")
def shape_balls(spark, d):
    c = particles(spark, d).select("tomo_id", F.col("part_id").alias("label"), *"xyz", (1.5 + F.col("list_id") * 0.25).alias("r"))
    return voxels.balls(c).groupBy("tomo_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X} SELECT x, y, z FROM x WHERE (x + y) / sqrt(2) - 40 / sqrt(2) >= -1.5 AND (x + y) / sqrt(2) - 40 / sqrt(2) < 1.5")
def shape_plane(spark, d):
    return voxels.planes(voxel_rows(spark, d), [1, 1, 0], 40.0, 3.0).select("x", "y", "z")


@query(f"WITH {X}, {BLOCKS}, s AS (SELECT label, z, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, z) AS k FROM s) SELECT label, round(cx, 6) AS x, round(cy, 6) AS y, z::DOUBLE AS z, round(sqrt(n / pi()), 6) AS r FROM k WHERE k = 1")
def shape_discs_to_balls(spark, d):
    return rounded(voxels.discs_to_balls(blocks(spark, d)).drop("tomo_id"))


@query(f"WITH {X}, {BLOCKS}, a AS (SELECT x, y, z, (x // 3) * 30 + y // 5 + 1 AS k FROM x WHERE label > 0), n AS (SELECT a.k AS id, b.label AS above, count(*) AS n FROM a JOIN b USING (x, y, z) GROUP BY ALL) SELECT id, arg_min(above, struct_pack(m := -n, a := above)) AS above, max(n) AS n FROM n GROUP BY 1")
def label_overlap_ids(spark, d):
    v = voxel_rows(spark, d).where("label > 0").withColumn("label", F.floor(F.col("x") / 3) * 30 + F.floor(F.col("y") / 5) + 1)
    return hierarchy.overlap_ids(v, blocks(spark, d)).drop("tomo_id")


# Hierarchies


@query(f"WITH {H} SELECT id, level::BIGINT AS level, parent_id FROM h WHERE level = 0 UNION ALL SELECT id, level, CASE WHEN level = 3 THEN 2000000000000 + (SELECT c_nationkey FROM customer WHERE c_custkey = parent_id - 3000000000000) ELSE parent_id END FROM h WHERE level IN (1, 3)")
def hier_keep(spark, d):
    n = nodes(spark, d)
    return rounded(hierarchy.keep(n, n.where("level <> 2")))


@query(f"WITH {H} SELECT id, level::BIGINT AS level, parent_id FROM h WHERE level < 3")
def hier_pop_level(spark, d):
    return rounded(hierarchy.pop_level(nodes(spark, d)))


@query(f"WITH {H} SELECT id, level::BIGINT AS level, CASE WHEN level > 1 THEN parent_id END AS parent_id FROM h WHERE level BETWEEN 1 AND 2")
def hier_only_levels(spark, d):
    return rounded(hierarchy.only_levels(nodes(spark, d), 1, 2))


@query(f"WITH {H} SELECT id, level::BIGINT AS level, CASE WHEN level = 0 THEN 9000000000000 + id % 2 ELSE parent_id END AS parent_id FROM h UNION ALL SELECT 9000000000000 + k, 4, NULL FROM range(2) t(k)")
def hier_add_level(spark, d):
    n = nodes(spark, d)
    top = n.where("level = 0").select("id", (F.col("id") % 2).alias("above"))
    return rounded(hierarchy.add_level(n, spark.range(2), top, 9_000_000_000_000))


@query("SELECT 1000000000000 + n_regionkey AS id, 2000000000000 + n_nationkey AS below, 1::BIGINT AS steps FROM nation UNION ALL SELECT 1000000000000 + n_regionkey, 3000000000000 + c_custkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey")
def hier_lower(spark, d):
    n = nodes(spark, d)
    return hierarchy.lower(n, n.where("level = 0"), 2)


@query("SELECT 2000000000000 + a.n_nationkey AS a, 2000000000000 + b.n_nationkey AS b, CASE WHEN a.n_nationkey = b.n_nationkey THEN 0 ELSE 2 END::BIGINT AS dist FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <= b.n_nationkey")
def hier_distances(spark, d):
    n = nodes(spark, d).where("level < 2")
    one = n.where("level = 1").select("id", "parent_id")
    pairs = one.select(F.col("id").alias("a"), "parent_id").join(one.select(F.col("id").alias("b"), "parent_id"), "parent_id").where("a <= b").select("a", "b")
    return hierarchy.distances(n, pairs)


@query(f"WITH {X} SELECT ((max(x) - min(x) + 1) * (max(y) - min(y) + 1) * (max(z) - min(z) + 1) * 8)::DOUBLE AS tomogram, (count(*) FILTER (label > 0) * 8)::DOUBLE AS labelled, count(DISTINCT label) FILTER (label > 0) AS n_labels FROM x")
def voxel_volumes(spark, d):
    return voxels.volumes(voxel_rows(spark, d), 2.0).drop("tomo_id")


@query(f"WITH {X}, s AS (SELECT x, y, z FROM x WHERE label = 4), d AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS t(i, j, k)), f AS (SELECT s.x + i AS nx, s.y + j AS ny, s.z + k AS nz, s.x, s.y, s.z FROM s, d) SELECT x, y, z, 2 * count(*) AS n_triangles, count(*)::DOUBLE AS area FROM f WHERE (nx, ny, nz) NOT IN (SELECT (x, y, z) FROM s) GROUP BY ALL")
def voxel_faces(spark, d):
    """The surface of a label as triangles: their number and area by voxel."""
    f = voxels.faces(voxel_rows(spark, d).where("label = 4"))
    e = lambda p, q: [F.col(f"{q}.{c}") - F.col(f"{p}.{c}") for c in "xyz"]
    u, v = e("a", "b"), e("a", "c")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(sum((c * c for c in cross), F.lit(0.0))) / 2
    inward = [F.round((F.col(f"a.{c}") + F.col(f"b.{c}") + F.col(f"c.{c}")) / 3 - 0.5 * n).cast("long").alias(c) for c, n in zip("xyz", cross)]
    return rounded(f.select(area.alias("_a"), *inward).groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n_triangles"), F.sum("_a").alias("area")))


@query(f"WITH {CS}, k AS (SELECT (SELECT min(boundary_id) FROM c) AS cluster, (SELECT count(DISTINCT boundary_id) FROM c) AS n_boundaries) SELECT DISTINCT segment_id, boundary_id, cluster, n_boundaries FROM c, k")
def contact_multi_cluster(spark, d):
    return contacts.multi_cluster(supplier_contacts(spark, d)).select("segment_id", "boundary_id", "cluster", "n_boundaries")


@query()
def membranes_oriented(spark, d):
    """Components of one label with the label around them."""
    v = voxel_rows(spark, d)
    return voxels.oriented_membranes(v.where("label = 4"), v.where("label < 4"), 2.0).select("x", "y", "z", "lumen")
