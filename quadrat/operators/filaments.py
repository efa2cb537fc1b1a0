"""Filaments: paths of a graph (fil_id, path: array of vertices, dist), their thresholds, centralities and membranes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators import graphs
from quadrat.plans.predicates import Range
from quadrat.storage import settling, written


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, limit: float) -> DataFrame:
    """fil_id, source, target, dist, path: one shortest path for each reachable pair at most limit apart, with the least predecessor at every step."""
    d = written(graphs.bounded_distances(edges, sources, limit, strict=False))
    e = graphs.both_ways(edges)
    near = d.select("source", F.col("vid").alias("src"), F.col("dist").alias("_b"))
    back = near.join(e, "src").join(d.withColumnRenamed("vid", "dst"), ["source", "dst"]).where(F.abs(F.col("_b") + F.col("length") - F.col("dist")) < 1e-9)
    before = written(back.groupBy("source", F.col("dst").alias("at")).agg(F.min("src").alias("before")))
    t = d.join(targets.select("vid"), "vid", "left_semi").where("source <> vid")
    now = t.select("source", F.col("vid").alias("target"), "dist", F.col("vid").alias("at"), F.array("vid").alias("path"))
    done = None
    while True:
        now = written(now.join(before, ["source", "at"]).select("source", "target", "dist", F.col("before").alias("at"), F.concat(F.array("before"), "path").alias("path")))
        arrived = now.where("at = source").drop("at")
        done = arrived if done is None else done.unionByName(arrived)
        now = now.where("at <> source")
        if now.isEmpty():
            return done.withColumn("fil_id", F.xxhash64("source", "target"))


def centrality(paths: DataFrame) -> DataFrame:
    """vid, n: paths through each vertex."""
    return paths.select(F.explode(F.array_distinct("path")).alias("vid")).groupBy("vid").agg(F.count(F.lit(1)).alias("n"))


def strongest(paths: DataFrame, strength: str, length: Range, sinuosity: Range) -> DataFrame:
    """vid, strength of the strongest filament through each vertex, of those whose length and sinuosity are in range."""
    kept = paths.where(length.test(F.col("dist")) & sinuosity.test(F.col("sinuosity")))
    return kept.select(F.explode("path").alias("vid"), strength).groupBy("vid").agg(F.max(strength).alias(strength))


def with_sinuosity(paths: DataFrame, vertices: DataFrame) -> DataFrame:
    """paths with euclid (between their ends) and sinuosity."""
    at = lambda end: vertices.select(F.col("vid").alias(end), F.struct("x", "y", "z").alias(f"_{end}"))
    p = paths.join(at("source"), "source").join(at("target"), "target")
    euclid = F.sqrt(sum(((F.col(f"_source.{c}") - F.col(f"_target.{c}")) * (F.col(f"_source.{c}") - F.col(f"_target.{c}")) for c in "xyz"), F.lit(0.0)))
    return p.withColumn("euclid", euclid).withColumn("sinuosity", F.col("dist") / F.nullif(F.col("euclid"), F.lit(0.0))).drop("_source", "_target")


def thresholded(paths: DataFrame, ranges: Mapping[str, Range], complete: bool = False) -> DataFrame:
    """Filaments with every measure in range; complete: without those that share a vertex with one that is dropped."""
    test = F.lit(True)
    for k, r in ranges.items():
        test = test & F.coalesce(r.test(F.col(k)), F.lit(False))
    kept = paths.where(test)
    if not complete:
        return kept
    bad = paths.where(~test).select(F.explode("path").alias("vid")).distinct()
    hit = kept.select("fil_id", F.explode("path").alias("vid")).join(bad, "vid", "left_semi").select("fil_id").distinct()
    return kept.join(hit, "fil_id", "left_anti")


def restricted(edges: DataFrame, paths: DataFrame, inside: bool = True) -> DataFrame:
    """Edges of the graph along filaments, or all others."""
    steps = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))).alias("s"))
    steps = steps.select(F.least("s.a", "s.b").alias("src"), F.greatest("s.a", "s.b").alias("dst")).distinct()
    own = edges.withColumns({"_s": F.least("src", "dst"), "_d": F.greatest("src", "dst")})
    return own.join(steps.withColumnsRenamed({"src": "_s", "dst": "_d"}), ["_s", "_d"], "left_semi" if inside else "left_anti").select(edges.columns)


def linked(paths: DataFrame, ranges: Mapping[str, Range], neighbours: Range) -> DataFrame:
    """source, n: sources whose number of targets in range is in range."""
    test = F.lit(True)
    for k, r in ranges.items():
        test = test & r.test(F.col(k))
    n = paths.where(test).groupBy("source").agg(F.countDistinct("target").alias("n"))
    return n.where(neighbours.test(F.col("n")))


def contacts(paths: DataFrame, sides: DataFrame) -> DataFrame:
    """fil_id, vid, penetration: where a filament first changes side (vid, side), and the share of its vertices beyond."""
    rows = paths.select("fil_id", F.size("path").alias("n"), F.posexplode("path").alias("seq", "vid")).join(sides, "vid")
    first = rows.groupBy("fil_id", "n").agg(F.min_by("side", "seq").alias("_s"))
    over = rows.join(first, ["fil_id", "n"]).where("side <> _s").groupBy("fil_id", "n").agg(F.min(F.struct("seq", "vid")).alias("_f"))
    return over.select("fil_id", F.col("_f.vid").alias("vid"), ((F.col("n") - F.col("_f.seq")) / F.col("n")).alias("penetration"))


def contact_cardinality(contact_rows: DataFrame) -> DataFrame:
    return contact_rows.groupBy("vid").agg(F.countDistinct("fil_id").alias("n"))


def path_statistics(paths: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """fil_id, n, total, mean, low, high of an edge value along each filament; steps that are no edge are passed over."""
    steps = paths.where(F.size("path") > 1).select("fil_id", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("s"))
    steps = steps.select("fil_id", F.least("s.a", "s.b").alias("src"), F.greatest("s.a", "s.b").alias("dst"))
    own = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max(value).alias("_v"))
    return steps.join(own, ["src", "dst"]).groupBy("fil_id").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.avg("_v").alias("mean"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def every_nth(paths: DataFrame, n: int) -> DataFrame:
    """Filaments with every n-th vertex, the first and the last one included."""
    last = F.size("path") - 1
    return paths.withColumn("path", F.filter("path", lambda _, k: (k % n == 0) | (k == last)))


def contact_clusters(contact_points: DataFrame, radius: float | None = None, edges: DataFrame | None = None, preference: float | None = None) -> DataFrame:
    """vid, cluster: of contact vertices (vid, x, y, z): within radius of each other (linkage), or connected by edges among them, or by affinity propagation of their places."""
    from quadrat.operators import clusters

    p = contact_points.select("vid", "x", "y", "z", F.lit(0).alias("_g"))
    if edges is not None:
        return graphs.subgraph_ids(p.select("vid"), graphs.induced(edges, p.select("vid"))).withColumnRenamed("component", "cluster")
    if radius is not None:
        return clusters.single_linkage(p, radius, ["_g"], "vid").select(F.col("id").alias("vid"), "cluster")
    return clusters.affinity_propagation(p, ["_g"], preference, id_col="vid").select(F.col("id").alias("vid"), F.col("exemplar").alias("cluster"))
