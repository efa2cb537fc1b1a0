"""Registered queries of tables and observations that queries.py does not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import geometry as G
from quadrat.operators import observations, points, tables
from quadrat.plans.queries import EDGES, KEYS, P, customers, indexed, particles, query, rounded, table
from quadrat.sources import star
from quadrat.storage import shared_dir


def parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


@query("SELECT p_partkey AS row_id, -1::BIGINT AS mark, round(p_retailprice, 6) AS copy FROM part")
def table_add_column(spark, d):
    t = tables.add_column(parts(spark, d), "mark", F.lit(-1).cast("long"))
    return rounded(tables.copy_column(t, "price", "copy").select("row_id", "mark", "copy"))


@query("SELECT p_partkey AS row_id, round(p_size * 2.0, 6) AS doubled FROM part")
def table_add_list(spark, d):
    t = parts(spark, d)
    return rounded(tables.add_list(t, "doubled", t.select("row_id", (F.col("size") * 2).alias("doubled"))).select("row_id", "doubled"))


@query("SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice / 2, 6) ELSE round(p_retailprice, 6) END AS price FROM part")
def table_replace_column(spark, d):
    t = parts(spark, d)
    new = t.where("row_id % 3 = 0").select("row_id", (F.col("price") / 2).alias("price"))
    return rounded(tables.replaced(t, "price", new).select("row_id", "price"))


@query("SELECT p_partkey AS row_id, p_name AS name FROM part")
def table_drop_column(spark, d):
    return tables.dropped(parts(spark, d), "brand", "size", "price")


@query("SELECT p_partkey AS row_id, round(ln(p_retailprice), 6) AS log_price FROM part")
def table_copy_with_function(spark, d):
    return rounded(tables.copy_column(parts(spark, d), "price", "log_price", F.log).select("row_id", "log_price"))


@query("SELECT count(*) AS n, true AS inside, true AS varied FROM part")
def table_randomise_column(spark, d):
    r = tables.randomised(parts(spark, d), "price", -2.0, 3.0, "row_id", seed=5)
    return r.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("price") >= -2) & (F.col("price") < 3)).alias("inside"), (F.count_distinct("price") * 100 >= 99 * F.count(F.lit(1))).alias("varied"))


@query(f"WITH {P} SELECT part_id, round(x - 0.5, 6) AS x, round(y, 6) AS y, round(z - list_id, 6) AS z FROM p")
def table_shift_by_origin(spark, d):
    p = particles(spark, d).withColumns({"ox": F.lit(0.5), "oy": F.lit(None).cast("double"), "oz": F.col("list_id").cast("double")})
    return rounded(tables.shifted_by_origin(p, [("x", "ox"), ("y", "oy"), ("z", "oz")]).select("part_id", "x", "y", "z"))


@query("SELECT p_partkey AS _rlnGroupNumber, p_retailprice AS _rlnCoordinateX FROM part")
def table_external_columns(spark, d):
    t = parts(spark, d).select(F.col("row_id").alias("_rlnGroupNumber"), F.col("price").alias("_rlnCoordinateX"), "name", F.col("size").alias("_psSegScale"))
    return tables.external_columns(t)


@query(f"WITH {P} SELECT part_id, round(x * 2, 6) AS a, round(x + 1, 6) AS vx, round(y - 2, 6) AS vy, round(z * 1, 6) AS vz FROM p")
def table_property_constant(spark, d):
    p = particles(spark, d).select("part_id", F.col("x").alias("a"), F.array("x", "y", "z").alias("v"))
    p = tables.with_constant(tables.with_constant(p, "a", "mul", 2.0), "v", "add", [1.0, -2.0, 0.0])
    return rounded(p.select("part_id", "a", F.col("v")[0].alias("vx"), F.col("v")[1].alias("vy"), F.col("v")[2].alias("vz")))


@query("SELECT p_partkey AS row_id, CASE WHEN p_partkey = 7 THEN -5.0 ELSE round(p_retailprice, 6) END AS price FROM part")
def table_set_cell(spark, d):
    return rounded(tables.set_cell(parts(spark, d), "price", 7, -5.0).select("row_id", "price"))


@query(f"WITH {P}, v AS (SELECT *, y - x AS a, z - y AS b, x - z AS c FROM p) SELECT part_id, round(a, 6) AS vx, round(b, 6) AS vy, round(c, 6) AS vz, round(sqrt(a * a + b * b + c * c), 6) AS norm, round(degrees(acos((a * x + b * y + c * z) / sqrt((a * a + b * b + c * c) * (x * x + y * y + z * z)))), 6) AS angle FROM v")
def table_vector_between(spark, d):
    p = particles(spark, d).select("part_id", F.array("x", "y", "z").alias("a"), F.array("y", "z", "x").alias("b"))
    p = tables.vector_between(p, "a", "b", "v")
    return rounded(p.select("part_id", *[F.col("v")[k].alias(f"v{c}") for k, c in enumerate("xyz")], G.norm(F.col("v")).alias("norm"), G.angle(F.col("v"), F.col("a")).alias("angle")))


@query(f"WITH {P} SELECT part_id, round(degrees(atan2(y, x)), 6) AS rot, round(degrees(acos(z / sqrt(x * x + y * y + z * z))), 6) AS tilt, round(sqrt(x * x + y * y + z * z), 6) AS r, round(x + 3 * y, 6) AS sx FROM p")
def geometry_vector_angles(spark, d):
    v = [F.col(c) for c in "xyz"]
    p = particles(spark, d)
    a, s = G.tilt_and_rot(v), G.spherical(v)
    return rounded(p.select("part_id", a["rot"].alias("rot"), s["theta"].alias("tilt"), s["r"].alias("r"), G.along(v, [F.col("y"), F.col("z"), F.col("x")], F.lit(3.0))[0].alias("sx")))


@query(f"WITH {P}, r AS (SELECT *, (x * 3.6) % 360 AS a FROM p), u AS (SELECT *, CASE WHEN a > 180 THEN a - 360 WHEN a <= -180 THEN a + 360 ELSE a END AS b FROM r) SELECT part_id, round(b, 6) AS angle, round(x * cos(radians(30)) + y * sin(radians(30)), 6) AS rx, round(-x * sin(radians(30)) + y * cos(radians(30)), 6) AS ry, round(2 * x + y + 1, 6) AS ax FROM u")
def geometry_rotated(spark, d):
    v = [F.col(c) for c in "xyz"]
    turn = G.rotated(G.matrix(F.lit(30.0), F.lit(0.0), F.lit(0.0)), v)
    return rounded(particles(spark, d).select("part_id", G.unrolled(F.col("x") * 3.6).alias("angle"), turn[0].alias("rx"), turn[1].alias("ry"), G.affine([2, 1, 0, 0, 1, 0, 0, 0, 1], [1, 0, 0], v)[0].alias("ax")))


@query("SELECT p_partkey AS row_id, count(*) OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part")
def table_sorted(spark, d):
    return tables.sorted_by(parts(spark, d), "price", False).select("row_id", "place")


@query("SELECT n_nationkey, count(*) OVER (ORDER BY s, n_nationkey) - 1 AS place FROM (SELECT n_nationkey, sum(s_acctbal) AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)")
def table_sorted_by_other(spark, d):
    other = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("s"))
    return tables.sorted_by_other(table(spark, d, "nation").select("n_nationkey"), other, "n_nationkey", "s").select("n_nationkey", "place")


@query("SELECT p_partkey AS row_id FROM part WHERE p_brand = 'Brand#23' ORDER BY p_partkey LIMIT 1")
def table_first_row(spark, d):
    return tables.first_row(parts(spark, d), "brand", "Brand#23").select("row_id")


@query("SELECT url, 'stem' AS mode FROM pages WHERE starts_with(regexp_extract(url, '[^/]*$'), '1') UNION ALL SELECT url, 'not' FROM pages WHERE url <> (SELECT min(url) FROM pages)")
def table_by_file_name(spark, d):
    p = table(spark, d, "pages").select("url")
    least = p.agg(F.min("url")).first()[0]
    stem = tables.by_file_name(p, "url", "1", "stem").withColumn("mode", F.lit("stem"))
    return stem.unionAll(tables.by_file_name(p, "url", least, keep=False).withColumn("mode", F.lit("not")))


@query("SELECT p_partkey AS row_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def table_keep_in_list(spark, d):
    names = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("row_id"))
    return tables.keep_in(parts(spark, d), names, "row_id").select("row_id")


@query("SELECT p_partkey AS row_id FROM part JOIN (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1) USING (p_brand) WHERE p_retailprice / m >= 1.02")
def table_purge_low_correlation(spark, d):
    t = parts(spark, d)
    ref = t.groupBy("brand").agg(F.avg("price").alias("m"))
    return tables.purge_low_correlation(t, ref, "brand", F.col("price") / F.col("m"), 1.02).select("row_id")


@query(f"WITH {P} SELECT part_id FROM p WHERE x BETWEEN -5 AND 10 AND y BETWEEN -8 AND 8 AND z BETWEEN -20 AND 4")
def table_in_bounds(spark, d):
    return tables.in_bounds(particles(spark, d), [-5, -8, -20], [10, 8, 4]).select("part_id")


BOX = "b AS (SELECT part_id AS id, list_id, x - 2 AS lx, x + 1 AS hx, y - 1 AS ly, y + 1 AS hy, z - 3 AS lz, z + 2 AS hz FROM p)"


@query(f"WITH {P}, {BOX} SELECT a.list_id, a.id AS a, c.id AS b FROM b a JOIN b c ON a.list_id = c.list_id AND a.id < c.id AND a.lx <= c.hx AND c.lx <= a.hx AND a.ly <= c.hy AND c.ly <= a.hy AND a.lz <= c.hz AND c.lz <= a.hz")
def table_overlapping_boxes(spark, d):
    p = particles(spark, d)
    b = p.select(F.col("part_id").alias("id"), "list_id", *[(F.col(c) + s).alias(f"{m}_{c}") for c, lo, hi in (("x", -2, 1), ("y", -1, 1), ("z", -3, 2)) for m, s in (("lo", lo), ("hi", hi))])
    return tables.overlapping_boxes(b, b, ["list_id"], 4.0).where("a < b")


@query(f"WITH {P} SELECT tomo_id FROM p WHERE list_id = 0 UNION SELECT tomo_id FROM p WHERE list_id = 3")
def table_distinct_keys(spark, d):
    p = particles(spark, d)
    return tables.distinct_keys("tomo_id", p.where("list_id = 0"), p.where("list_id = 3"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY 1")
def table_with_segmentation(spark, d):
    seg = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("micrograph"), "n_name")
    t = tables.with_segmentation(table(spark, d, "customer").select(F.col("c_nationkey").alias("micrograph")), seg)
    return t.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P} SELECT tomo_id, count(*) FILTER (list_id = 1) AS n_reference, count(*) FILTER (list_id = 4) AS n_target FROM p GROUP BY 1 HAVING n_reference > 0 AND n_target > 0")
def table_reference_target(spark, d):
    return tables.reference_and_target(particles(spark, d), 1, 4)


@query("SELECT printf('%s\t%.2f', n_name, a) AS line FROM (SELECT n_name, round(avg(s_acctbal), 2) AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)")
def table_report(spark, d):
    t = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.avg("s_acctbal"), 2).alias("a"))
    return tables.shown(t, ["n_name", "a"], 2)


@query(f"WITH {P} SELECT tomo_id::VARCHAR AS _rlnMicrographName, list_id AS _rlnClassNumber, count(*) AS n, round(sum(x), 6) AS sx, round(sum(y), 6) AS sy, round(sum(z), 6) AS sz FROM p GROUP BY 1, 2")
def star_round_trip(spark, d):
    """Particles written as STAR, a file for each partition, and read back."""
    star.register(spark)
    path = f"{shared_dir(spark)}/star-round-trip"
    star.from_points(particles(spark, d), classes="list_id").write.format("star").mode("overwrite").save(path)
    back = star.particle_points(spark.read.format("star").load(path))
    total = [F.sum(c).alias(f"s{c}") for c in "xyz"]
    return rounded(back.groupBy("_rlnMicrographName", "_rlnClassNumber").agg(F.count(F.lit(1)).alias("n"), *total))


# Observations


@query("WITH q AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation), s AS (SELECT s_nationkey AS n_nationkey, sum(s_acctbal) AS v FROM supplier GROUP BY 1) SELECT n_nationkey, round(coalesce(v, -1.0), 6) AS v FROM (SELECT unnest(range(40))::BIGINT AS n_nationkey) LEFT JOIN (SELECT n_nationkey::BIGINT AS n_nationkey, v FROM s) USING (n_nationkey)")
def obs_by_new_ids(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("v"))
    return rounded(observations.by_new_ids(s, spark.range(40).withColumnRenamed("id", "n_nationkey"), "n_nationkey", "v"))


@query("SELECT c_mktsegment AS identifier, c_custkey AS id, round(m, 6) AS m FROM customer JOIN (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1) USING (c_mktsegment)")
def obs_add_data(spark, d):
    c = customers(spark, d).select(F.col("grp").alias("identifier"), "id", "v")
    return rounded(observations.add_data(c.drop("v"), c.groupBy("identifier").agg(F.avg("v").alias("m")), ["m"]))


@query("SELECT c_mktsegment AS grp, CASE WHEN c_custkey = 0 THEN 0 ELSE c_custkey + 1000000 END AS id FROM customer")
def obs_shift_ids(spark, d):
    return observations.relabelled(customers(spark, d).select("grp", "id"), "id", 1_000_000)


@query("SELECT o_orderpriority AS grp, count(*) AS n FROM customer JOIN orders ON o_orderkey = c_custkey GROUP BY 1")
def obs_reorder_ids(spark, d):
    to = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("new_id"))
    return observations.relabelled(customers(spark, d).select(F.col("id").alias("k")), "k", mapping=to).groupBy(F.col("k").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS row_id, round(p_size * 0.7, 6) AS length_nm, round(p_retailprice * 0.343, 6) AS volume_nm, round(p_size * p_size * 12.566370614359172::DOUBLE, 6) AS sphere_surface, round(p_size / p_retailprice, 6) AS surface_to_volume FROM part")
def obs_units_and_derived(spark, d):
    t = parts(spark, d).select("row_id", F.col("size").alias("length"), F.col("price").alias("volume"))
    t = observations.derived(observations.in_nm(t, F.lit(0.7)), "length", "length", "volume", "length")
    return rounded(t.select("row_id", "length_nm", "volume_nm", "sphere_surface", "surface_to_volume"))


@query("WITH o AS (SELECT c_mktsegment AS grp, n_name AS identifier, row_number() OVER (PARTITION BY c_mktsegment, n_name ORDER BY c_custkey) - 1 AS pos, c_acctbal * 0.25 AS v FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT grp, pos, count(*) AS n, round(sum(v), 4) AS v FROM o GROUP BY 1, 2")
def obs_split_positions(spark, d):
    i = observations.converted(indexed(spark, d), "v", F.lit(0.5), 2)
    p = observations.split_by_position(i, ["grp", "identifier"], ["v"])
    return rounded(p.groupBy("grp", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")), 4)


@query("SELECT o_orderstatus AS grp, round(sum(o_totalprice), 2) AS total, count(*) AS n, round(median(o_totalprice), 4) AS median, round(max(o_totalprice), 4) AS max FROM orders GROUP BY 1")
def obs_aggregates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("v"))
    out = observations.aggregated(o, ["grp"], "v", "sum", "n", "median", "max")
    return rounded(out, 4).withColumn("sum", F.round("sum", 2)).withColumnRenamed("sum", "total")


@query("SELECT 0::BIGINT AS k, (SELECT count(*) FROM nation)::BIGINT + (SELECT count(*) FROM region) AS n, NULL::DOUBLE AS v UNION ALL SELECT s_nationkey, CASE WHEN s_nationkey % 2 = 0 THEN 7 ELSE count(*) END, round(sum(s_acctbal), 4) FROM supplier WHERE s_nationkey > 0 GROUP BY s_nationkey")
def obs_merged_features(spark, d):
    s = table(spark, d, "supplier").where("s_nationkey > 0").groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("v"))
    total = lambda name: table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("k"), "n", F.lit(None).cast("double").alias("v"))
    new = s.where("k % 2 = 0").select("k", F.lit(7).cast("long").alias("n"), F.lit(None).cast("double").alias("v"))
    out = observations.merged_features(s.unionAll(total("nation")), new.unionAll(total("region")), "k", ["n", "v"])
    return rounded(out.withColumn("v", F.when(F.col("k") > 0, F.col("v"))), 4)


@query("SELECT o_custkey AS cluster, 'min' AS mode, arg_min(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS id, round(min(o_totalprice), 4) AS dist FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'max', arg_min(o_orderkey, struct_pack(a := -o_totalprice, b := o_orderkey)), round(max(o_totalprice), 4) FROM orders GROUP BY 1")
def obs_extreme_per_cluster(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("dist"))
    f = lambda m: observations.extreme_per_cluster(o, "cluster", "dist", "id", m).withColumn("mode", F.lit(m))
    return rounded(f("min").unionByName(f("max")), 4)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def obs_order_by_values(spark, d):
    return observations.order_by_values(table(spark, d, "supplier"), "s_suppkey", "s_acctbal")


@query("SELECT c_custkey AS id, round(c_acctbal * c_acctbal, 4) AS sq, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END::BIGINT AS pos FROM customer")
def obs_applied(spark, d):
    c = observations.applied(customers(spark, d), "v", lambda x: x * x, "sq")
    one = observations.applied(c.select("id", "sq", F.array("v").alias("a")), "a", lambda x: (x > 0).cast("long"), "p")
    return rounded(one.select("id", "sq", F.col("p")[0].alias("pos")), 4)


@query("SELECT l_linestatus AS grp, round(avg((45 >= l_quantity)::INT), 6) AS high, round(avg((45 <= l_quantity)::INT), 6) AS low FROM lineitem GROUP BY 1")
def pvalue_slope(spark, d):
    sims = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("grp"), F.col("l_quantity").alias("value"))
    seen = sims.select("grp").distinct().withColumn("value", F.lit(45.0))
    p = lambda s: observations.p_value(sims, seen, ["grp"], s).withColumnRenamed("p", s)
    return rounded(p("high").join(p("low"), "grp"))


@query("SELECT o_orderpriority AS k, count(*) AS n_projections, round(sum(o_totalprice / 4), 2) AS dose, round(avg(o_totalprice / 4), 4) AS per_projection, round(sum(o_totalprice / 4) / sum(o_custkey % 5 + 2), 4) AS rate FROM orders GROUP BY 1")
def series_dose(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("c"), (F.col("o_custkey") % 5 + 2).alias("s"))
    out = observations.dose(o, ["k"], "c", "s", F.lit(2.0))
    return rounded(out.withColumns({"dose": F.round("dose", 2), "per_projection": F.round("per_projection", 4), "rate": F.round("rate", 4)}))


@query("SELECT 'c' AS \"group\", n_name AS identifier, round(c_acctbal, 4) AS bal, NULL::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 3 UNION ALL SELECT 's', n_name, round(s_acctbal, 4), s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 3")
def obs_experiments(spark, d):
    """Tables of many experiments with different properties, as one."""
    names = {r.n_nationkey: r.n_name for r in table(spark, d, "nation").where("n_nationkey < 3").collect()}
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    own = {"c": {n: c.where(F.col("c_nationkey") == k).select(F.col("c_acctbal").alias("bal")) for k, n in names.items()}, "s": {n: s.where(F.col("s_nationkey") == k).select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("n")) for k, n in names.items()}}
    return rounded(observations.experiments(own, ["bal", "n"]), 4)


@query("SELECT n_name AS grp, c_mktsegment AS identifier, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM customer)) GROUP BY 1, 2")
def obs_transpose(spark, d):
    """Groups and identifiers change places; experiments that are not in every group go before, as it asks."""
    c = customers(spark, d)
    groups = c.select("grp").distinct().count()
    whole = c.groupBy("identifier").agg(F.countDistinct("grp").alias("n")).where(F.col("n") == groups).select("identifier")
    t = observations.transposed(c.join(whole, "identifier", "left_semi"), "grp", "identifier")
    return t.groupBy("grp", "identifier").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, round(100 + 0.3 * (c_acctbal - 100), 6) AS level FROM customer")
def obs_between_references(spark, d):
    return rounded(observations.between_references(customers(spark, d), F.lit(100.0), F.col("v"), 0.3).select("id", "level"))


@query("SELECT list_name, count(*) AS n, round(sum(v), 4) AS v FROM (SELECT 'c' AS list_name, c_acctbal AS v FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) GROUP BY 1")
def obs_joined_lists(spark, d):
    out = observations.joined_lists({"c": table(spark, d, "customer").select(F.col("c_acctbal").alias("v")), "s": table(spark, d, "supplier").select(F.col("s_acctbal").alias("v"))})
    return rounded(out.groupBy("list_name").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")), 4)


@query("SELECT c_mktsegment AS grp, c_custkey AS id FROM customer WHERE c_acctbal > 5000")
def obs_extract(spark, d):
    return observations.extract(customers(spark, d), F.col("v") > 5000).select("grp", "id")


@query("SELECT l_returnflag AS grp, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean, round(sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity) - power(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2), 0) AS variance FROM lineitem GROUP BY 1")
def obs_weighted_variance(spark, d):
    out = observations.weighted_variance(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "grp"), ["grp"], "l_extendedprice", "l_quantity")
    return out.select("grp", F.round("mean", 4).alias("mean"), F.round("variance", 0).alias("variance"))


@query("SELECT c_mktsegment AS grp, bin, count(*) AS n FROM (SELECT c_mktsegment, CASE WHEN c_acctbal >= 7500 THEN 4 WHEN c_acctbal >= 5000 THEN 3 WHEN c_acctbal >= 2500 THEN 2 WHEN c_acctbal >= 0 THEN 1 ELSE 0 END::BIGINT AS bin FROM customer) WHERE bin = 2 GROUP BY 1, 2")
def obs_split_then_restrict(spark, d):
    s = observations.split_by_bins(customers(spark, d), "v", EDGES).withColumn("bin", F.col("bin").cast("long"))
    return tables.keep_in(s, spark.createDataFrame([(2,)], "bin long"), "bin").groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P}, s AS (SELECT list_id, tomo_id, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1), nn AS (SELECT a.list_id, a.tomo_id, a.part_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS dist FROM p a JOIN p b ON a.list_id = b.list_id AND a.tomo_id = b.tomo_id AND a.part_id <> b.part_id GROUP BY ALL), m AS (SELECT list_id, avg(dist) AS m, var_samp(dist) AS v, count(*) AS n FROM nn GROUP BY 1) SELECT a.list_id, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 5) AS t, a.n + b.n - 2 AS dof FROM m a, m b WHERE b.list_id = 0 AND a.list_id <> 0")
def nn_ttest(spark, d):
    """t of each list's nearest-neighbour distances against those of the first."""
    from quadrat.operators import inference

    p = particles(spark, d)
    nn = points.knn(p, p, 1, KEYS, exclude_self=True)
    return rounded(inference.t_independent(nn, "list_id", "dist", 0).drop("p"), 5)
