"""Registered queries of graphs, filaments, clusters and curves that queries.py does not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import clusters, columns, curves, filaments, graphs, regions
from quadrat.plans.predicates import Range
from quadrat.plans.queries import E, GRAPH, P, U, edges, particles, paths, query, rounded, table, vertices


@query(f"WITH {U}, w AS (SELECT seq AS a, lead(seq) OVER (PARTITION BY curve_id ORDER BY seq) AS b FROM u) SELECT least(a, b) AS src, greatest(a, b) AS dst, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)), 6) AS length FROM w JOIN u p ON p.seq = a JOIN u q ON q.seq = b")
def graph_from_cells(spark, d):
    """Each user's events as one polyline of a skeleton."""
    p = paths(spark, d)
    cells = p.groupBy("curve_id").agg(F.array_sort(F.collect_list("seq")).alias("points"))
    return rounded(graphs.from_cells(cells, p.withColumnRenamed("seq", "vid")))


@query(f"WITH {GRAPH} SELECT src, dst FROM e WHERE src % 5 <> 0 AND dst % 5 <> 0")
def graph_remove_vertices(spark, d):
    v = vertices(spark, d)
    return graphs.remove_vertices(v, edges(spark, d), v.where("vid % 5 = 0").select("vid"))[1].select("src", "dst")


@query(f"WITH {E} SELECT src, dst FROM e WHERE (src, dst) NOT IN (SELECT (src, dst) FROM e WHERE length > 10)")
def graph_difference(spark, d):
    e = edges(spark, d)
    return graphs.difference(e, e.where("length > 10")).select("src", "dst")


@query(f"WITH {GRAPH}, c AS (SELECT vid FROM v WHERE value > 5000), s AS (SELECT vid, 0.0::DOUBLE AS d FROM c UNION ALL SELECT dst, length FROM f JOIN c ON src = vid WHERE length <= 3 UNION ALL SELECT b.dst, a.length + b.length FROM f a JOIN c ON a.src = vid JOIN f b ON a.dst = b.src WHERE a.length + b.length <= 3 UNION ALL SELECT g.dst, 3 FROM f a JOIN c ON a.src = vid JOIN f b ON a.dst = b.src JOIN f g ON b.dst = g.src WHERE a.length + b.length + g.length <= 3) SELECT vid, min(d) AS dist FROM s GROUP BY 1")
def graph_extension(spark, d):
    """The core of valuable vertices and what lies at most 3 along edges from it."""
    return graphs.extension(vertices(spark, d), edges(spark, d), "value", "gt", 5000, 3.0)


@query(f"WITH {GRAPH}, c AS (SELECT vid FROM v WHERE value > 5000), s AS (SELECT vid, 0.0::DOUBLE AS d, vid % 7 AS l FROM c UNION ALL SELECT dst, length, vid % 7 FROM f JOIN c ON src = vid WHERE length <= 2 UNION ALL SELECT b.dst, 2, vid % 7 FROM f a JOIN c ON a.src = vid JOIN f b ON a.dst = b.src WHERE a.length + b.length <= 2) SELECT vid, arg_min(l, struct_pack(d := d, l := l)) AS label, min(d) AS dist FROM s GROUP BY 1")
def graph_grown(spark, d):
    """Each vertex with its nearest seed's label, by a visitor."""
    seeds = vertices(spark, d).where("value > 5000").select("vid", (F.col("vid") % 7).alias("label"))
    return graphs.grown(edges(spark, d), seeds, 2.0)


@query(f"WITH {GRAPH}, s AS (SELECT min(value) AS a, max(value) AS b FROM v), t AS (SELECT min(length) AS a, max(length) AS b FROM e) SELECT src, dst, round((1 - (length - t.a) / (t.b - t.a)) * ((p.value - s.a) + (q.value - s.a)) / (s.b - s.a) / 2, 6) AS affinity FROM e JOIN v p ON p.vid = src JOIN v q ON q.vid = dst, s, t")
def graph_affinity(spark, d):
    return rounded(graphs.affinity(vertices(spark, d), edges(spark, d), "value", "length"))


@query(f"WITH {GRAPH} SELECT vid FROM v WHERE vid % 3 = 0 AND value >= 950")
def graph_slice_threshold(spark, d):
    v = vertices(spark, d)
    return graphs.slice_threshold(v, v.where("vid % 3 = 0"), "value", "ge", 950).select("vid")


@query(f"WITH {GRAPH} SELECT src, dst, CASE WHEN p.value <= 3000 AND q.value <= 3000 THEN -1 ELSE length END AS length FROM e JOIN v p ON p.vid = src JOIN v q ON q.vid = dst")
def graph_protected(spark, d):
    v = vertices(spark, d)
    return graphs.protected(edges(spark, d), v, "value", 3000, "length", -1.0)


@query()
def graph_annealed_communities(spark, d):
    return graphs.annealed_communities(vertices(spark, d), edges(spark, d), 6)


@query()
def graph_pseudo_diameter(spark, d):
    return graphs.pseudo_diameter(edges(spark, d), vertices(spark, d).agg(F.min("vid").alias("vid")), 6.0)


# Filaments: the parts of each order, in the order of its lines


def order_paths(spark, d):
    li = table(spark, d, "lineitem")
    p = li.groupBy(F.col("l_orderkey").alias("fil_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("v")))), lambda r: r["v"]).alias("path"), F.sum("l_quantity").alias("dist"), F.max("l_extendedprice").alias("strength"))
    return p.withColumns({"sinuosity": F.col("dist") / 20, "source": F.get("path", F.lit(0)), "target": F.element_at("path", -1)})


F_ = "o AS (SELECT l_orderkey AS fil_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS path, sum(l_quantity) AS dist, max(l_extendedprice) AS strength FROM lineitem GROUP BY 1)"


@query(f"WITH {F_} SELECT v AS vid, count(*) AS n FROM (SELECT DISTINCT fil_id, unnest(path) AS v FROM o) GROUP BY 1")
def filament_centrality(spark, d):
    return filaments.centrality(order_paths(spark, d))


@query(f"WITH {F_} SELECT v AS vid, round(max(strength), 4) AS strength FROM (SELECT unnest(path) AS v, strength FROM o WHERE dist BETWEEN 20 AND 120 AND dist / 20 BETWEEN 2 AND 5) GROUP BY 1")
def filament_strongest(spark, d):
    return rounded(filaments.strongest(order_paths(spark, d), "strength", Range(20, 120), Range(2, 5)), 4)


@query(f"WITH {F_} SELECT fil_id FROM o WHERE dist BETWEEN 30 AND 60")
def filament_thresholds(spark, d):
    return filaments.thresholded(order_paths(spark, d), {"dist": Range(30, 60)}).select("fil_id")


@query(f"WITH {F_}, k AS (SELECT * FROM o WHERE dist BETWEEN 60 AND 400), b AS (SELECT DISTINCT unnest(path) AS v FROM o WHERE NOT dist BETWEEN 60 AND 400) SELECT fil_id FROM k WHERE fil_id NOT IN (SELECT fil_id FROM (SELECT fil_id, unnest(path) AS v FROM k) WHERE v IN (SELECT v FROM b))")
def filament_thresholds_complete(spark, d):
    return filaments.thresholded(order_paths(spark, d), {"dist": Range(60, 400)}, complete=True).select("fil_id")


@query(f"WITH {F_} SELECT path[1] AS source, count(DISTINCT path[-1]) AS n FROM o WHERE dist BETWEEN 20 AND 150 GROUP BY 1 HAVING count(DISTINCT path[-1]) BETWEEN 2 AND 40")
def filament_linkers(spark, d):
    return filaments.linked(order_paths(spark, d), {"dist": Range(20, 150)}, Range(2, 40))


CROSS = "r AS (SELECT fil_id, len(path) AS n, unnest(path) AS vid, generate_subscripts(path, 1) - 1 AS seq FROM o), f AS (SELECT fil_id, arg_min(vid % 2, seq) AS s FROM r GROUP BY 1), x AS (SELECT fil_id, n, min(seq) AS seq, arg_min(vid, seq) AS vid FROM r JOIN f USING (fil_id) WHERE vid % 2 <> s GROUP BY ALL)"


@query(f"WITH {F_}, {CROSS} SELECT fil_id, vid, round((n - seq) / n, 6) AS penetration FROM x")
def filament_contacts(spark, d):
    sides = table(spark, d, "part").select(F.col("p_partkey").alias("vid"), (F.col("p_partkey") % 2).alias("side"))
    return rounded(filaments.contacts(order_paths(spark, d), sides))


@query(f"WITH {F_}, {CROSS} SELECT vid, count(DISTINCT fil_id) AS n FROM x GROUP BY 1")
def filament_cardinality(spark, d):
    sides = table(spark, d, "part").select(F.col("p_partkey").alias("vid"), (F.col("p_partkey") % 2).alias("side"))
    return filaments.contact_cardinality(filaments.contacts(order_paths(spark, d), sides))


@query(f"WITH {F_} SELECT v AS vid, count(*) AS n FROM (SELECT DISTINCT fil_id, unnest(path) AS v FROM o) GROUP BY 1")
def filament_redundancy(spark, d):
    return graphs.redundancy(order_paths(spark, d), "path", "vid")


@query(f"WITH {F_} SELECT vid, round(min(dist), 4) AS dist FROM (SELECT unnest(path) AS vid, dist FROM o) GROUP BY 1")
def filament_vertex_property(spark, d):
    return rounded(graphs.vertex_by_filament(order_paths(spark, d), "path", "dist", "min"), 4)


@query(f"WITH {F_}, s AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT unnest(path[:-2]) AS a, unnest(path[2:]) AS b FROM o WHERE len(path) > 1)), e AS (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey) SELECT src, dst FROM e WHERE (src, dst) IN (SELECT (src, dst) FROM s)")
def filament_restricted(spark, d):
    """Of the pairs of parts that meet in an order, those next to each other in one."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    pairs = li.alias("a").join(li.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey").select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).distinct()
    return filaments.restricted(pairs, order_paths(spark, d).where(F.size("path") > 1))


@query(f"WITH {E}, i AS (SELECT *, (max(length) OVER w - length) / (max(length) OVER w - min(length) OVER w) AS i FROM e WINDOW w AS (PARTITION BY dst)) SELECT src, dst, round(sum(i) OVER (PARTITION BY dst ORDER BY i, length RANGE UNBOUNDED PRECEDING) / nullif(sum(i) OVER (PARTITION BY dst), 0), 6) AS relevance FROM i WHERE (SELECT count(DISTINCT length) FROM e g WHERE g.dst = i.dst) > 1")
def arc_relevance(spark, d):
    e = edges(spark, d)
    own = e.join(e.groupBy("dst").agg(F.countDistinct("length").alias("n")).where("n > 1").select("dst"), "dst", "left_semi")
    return rounded(graphs.arc_relevance(own, "length", ["dst"]).select("src", "dst", "relevance"))


# Clusters


def tens(spark, d):
    """Particles in groups of twenty: sets that fit a task."""
    return particles(spark, d).withColumn("tomo_id", F.floor(F.col("part_id") / 20))


@query()
def cluster_ward(spark, d):
    return clusters.agglomerative(tens(spark, d), ["tomo_id"], method="ward", n=4)


@query()
def cluster_cophenetic(spark, d):
    return clusters.cophenetic(tens(spark, d), ["tomo_id"])


@query()
def affinity_by_subsets(spark, d):
    return clusters.affinity_by_subsets(tens(spark, d), ["tomo_id"], 2)


@query()
def graph_modular_communities(spark, d):
    """Communities of each nation's suppliers and parts, a graph that fits a task."""
    return graphs.modular_communities(nation_graphs(spark, d), key="graph_id")


@query()
def graph_spectral(spark, d):
    return graphs.spectral(nation_graphs(spark, d), 3, key="graph_id")


def nation_graphs(spark, d):
    """A graph for each supplier and brand: its parts, joined in the order of their keys, with a chord."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("graph_id"), F.col("l_partkey").alias("v"), F.col("l_quantity").alias("q")).groupBy("graph_id", "v").agg(F.max("q").alias("q"))
    li = li.withColumn("graph_id", F.col("graph_id") * 1000 + F.col("v") % 50)
    a, b = li.alias("a"), li.alias("b")
    return a.join(b, "graph_id").where("a.v < b.v").select("graph_id", F.col("a.v").alias("src"), F.col("b.v").alias("dst"), (1 / (1 + F.abs(F.col("a.q") - F.col("b.q")))).alias("length"))


@query()
def pairwise_ncc(spark, d):
    """The correlation matrix of the vectors of each tenth id, which is the result itself."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return regions.correlations(v, 8)


@query()
def graph_max_flow(spark, d):
    """Flow between the least and the greatest vertex of each small graph."""
    g = nation_graphs(spark, d)
    ends = g.groupBy("graph_id").agg(F.min("src").alias("_a"), F.max("dst").alias("_b"))
    named = g.join(ends, "graph_id")
    rename = lambda c: F.when(F.col(c) == F.col("_a"), -1).when(F.col(c) == F.col("_b"), -2).otherwise(F.col(c))
    return graphs.max_flow(named.select("graph_id", rename("src").alias("src"), rename("dst").alias("dst"), "length"), -1, -2)


# Columns


def layer_points(spark, d):
    return particles(spark, d).where("list_id < 3").withColumn("layer", F.col("list_id") + 1)


@query()
def columns_exclusive(spark, d):
    return columns.exclusive_sub_columns(columns.layer_clusters(layer_points(spark, d), 0.0), 8.0)


@query(f"WITH {P}, a AS (SELECT b.tomo_id, a.part_id AS c, b.part_id AS k, b.list_id AS l FROM p a JOIN p b ON a.tomo_id = b.tomo_id AND a.list_id = 0 AND b.list_id IN (1, 2) AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 8), m AS (SELECT tomo_id, l, k, min(c) AS c FROM a GROUP BY ALL), w AS (SELECT tomo_id, c, count(*) AS n FROM m GROUP BY ALL HAVING count(DISTINCT l) = 2) SELECT tomo_id, count(*) FILTER (n >= 2) AS n FROM w GROUP BY 1")
def columns_count_where(spark, d):
    """Columns of single points with two points or more below."""
    c = columns.build(columns.layer_clusters(layer_points(spark, d), 0.0), 8.0)
    per = c.where("layer > 1").groupBy("tomo_id", "column").agg(F.count(F.lit(1)).alias("n"))
    return columns.count_where(per, F.col("n") >= 2)


# Curves


@query(f"WITH {U} SELECT curve_id, seq, round(f.x - (u.y - f.y), 6) AS x, round(f.y + (u.x - f.x), 6) AS y, round(u.z, 6) AS z FROM u JOIN (SELECT curve_id, arg_min(x, seq) AS x, arg_min(y, seq) AS y FROM u GROUP BY 1) f USING (curve_id)")
def curve_turned(spark, d):
    return rounded(curves.turned(paths(spark, d), [0, -1, 0, 1, 0, 0, 0, 0, 1]))


@query(f"WITH {P}, l AS (SELECT part_id AS id, x, y, z, sqrt(x * x + y * y + z * z) AS d FROM p), k AS (SELECT *, unnest(range(ceil(d / 4)::BIGINT + 1)) AS k FROM l), t AS (SELECT *, CASE WHEN k = ceil(d / 4) THEN 1 ELSE k * 4 / d END AS t FROM k) SELECT id, k, round(t * x, 6) AS x, round(t * y, 6) AS y, round(t * z, 6) AS z FROM t")
def curve_line_points(spark, d):
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    return rounded(curves.line_points(particles(spark, d).select(F.col("part_id").alias("id"), zero.alias("a"), F.struct(*"xyz").alias("b")), 4.0))


@query(f"WITH {U} SELECT curve_id, row_number() OVER (PARTITION BY curve_id ORDER BY seq) - 1 AS seq, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM u")
def curve_polylines(spark, d):
    """Points to polylines and back."""
    return rounded(curves.as_points(curves.as_polylines(paths(spark, d))))


@query(f"WITH {U} SELECT curve_id, round(avg(x) + 2, 6) AS x, round(avg(y) - 1, 6) AS y FROM u GROUP BY 1")
def curve_translated(spark, d):
    return rounded(curves.translated(paths(spark, d), (2.0, -1.0, 0.0)).groupBy("curve_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))


STEPS = "s AS (SELECT fil_id, least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT fil_id, unnest(path[:-2]) AS a, unnest(path[2:]) AS b FROM o WHERE len(path) > 1)), w AS (SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, max(l_quantity) AS v FROM lineitem GROUP BY ALL)"


@query(f"WITH {F_}, {STEPS} SELECT fil_id, count(*) AS n, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, round(min(v), 4) AS low, round(max(v), 4) AS high FROM s JOIN w USING (src, dst) GROUP BY 1")
def filament_statistics(spark, d):
    """A value of the graph's edges along each filament."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("v"))
    return rounded(filaments.path_statistics(order_paths(spark, d), e, "v"))


@query(f"WITH {F_}, k AS (SELECT fil_id, len(path) AS n, unnest(path) AS vid, generate_subscripts(path, 1) - 1 AS k FROM o) SELECT fil_id, count(*) AS n FROM k WHERE k % 3 = 0 OR k = n - 1 GROUP BY 1")
def filament_downsampled(spark, d):
    return filaments.every_nth(order_paths(spark, d), 3).select("fil_id", F.size("path").cast("long").alias("n"))


@query()
def contact_point_clusters(spark, d):
    """Contacts (the first list's particles) within 6 of each other."""
    return filaments.contact_clusters(particles(spark, d).where("list_id = 0").withColumnRenamed("part_id", "vid"), radius=6.0)


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 = 1 AND p_size BETWEEN 5 AND 30 AND p_retailprice BETWEEN 900 AND 1500")
def synapse_slice_predicate(spark, d):
    from quadrat.plans.predicates import synapse_slices

    xml = "<set><syn_slice name='a' segment='1'><eu_dst low='5' high='30' sign='+'/><geo_dst low='900' high='1500' sign='+'/><sin low='8' high='9' sign='-'/></syn_slice></set>"
    part = table(spark, d, "part").withColumns({"segment": F.col("p_partkey") % 3, "eu_dst": F.col("p_size"), "geo_dst": F.col("p_retailprice"), "sin": F.lit(0)})
    return part.where(synapse_slices(xml)[0].where()).select("p_partkey")


@query("SELECT o_orderkey, round(sum(l_quantity + 1), 4) AS total, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def array_helpers(spark, d):
    """Nested arrays mapped, added to and flattened."""
    from quadrat.functions import arrays

    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    a = li.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.collect_list("l_quantity").alias("a")).groupBy("o_orderkey").agg(F.collect_list("a").alias("a"))
    f = arrays.flattened(arrays.added(a, "a", 1.0), "a")
    return rounded(f.select("o_orderkey", F.aggregate("a", F.lit(0.0), lambda s, v: s + v).alias("total"), F.size("a").cast("long").alias("n")), 4)
