"""Contacts between segments and boundaries: (segment_id, boundary_id, n) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.components import components


def totals(contacts: DataFrame) -> DataFrame:
    """One row for each pair, n summed."""
    return contacts.groupBy("segment_id", "boundary_id").agg(F.sum("n").alias("n"))


def merge(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return totals(out)


def by_segment(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("segment_id").agg(F.sum("n").alias("n"), F.countDistinct("boundary_id").alias("n_boundaries"))


def segments_by_boundaries(contacts: DataFrame, boundaries: Sequence[int], mode: str) -> DataFrame:
    """Segments that touch exactly, at_least (all of), or at_most (some, but no others than) the boundaries."""
    wanted = list(dict.fromkeys(boundaries))
    r = contacts.groupBy("segment_id").agg(F.countDistinct(F.when(F.col("boundary_id").isin(wanted), F.col("boundary_id"))).alias("_in"), F.countDistinct("boundary_id").alias("_all"))
    test = {"exact": (F.col("_in") == len(wanted)) & (F.col("_all") == len(wanted)), "at_least": F.col("_in") == len(wanted), "at_most": (F.col("_in") == F.col("_all")) & (F.col("_in") > 0)}[mode]
    return r.where(test).select("segment_id")


def linked_boundaries(contacts: DataFrame) -> DataFrame:
    """a < b, n_segments: boundaries that share a segment. Bounded by the pairs of boundaries of each segment."""
    p = contacts.select("segment_id", "boundary_id").distinct()
    a, b = p.withColumnRenamed("boundary_id", "a"), p.withColumnRenamed("boundary_id", "b")
    return a.join(b, "segment_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_segments"))


def linked_at(contacts: DataFrame, steps: int, exact: bool = True) -> DataFrame:
    """a, b (a <> b): boundaries at that many links from each other (exact), or at most so many."""
    one = linked_boundaries(contacts)
    link = one.select("a", "b").unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = now = link
    for _ in range(steps - 1):
        now = now.alias("x").join(link.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b").where("a <> b").distinct()
        now = now.join(seen, ["a", "b"], "left_anti")
        seen = seen.unionAll(now)
    return (now if exact else seen).distinct()


def boundary_clusters(contacts: DataFrame) -> DataFrame:
    """boundary_id, cluster: boundaries that segments connect, named by the least. A segment links its boundaries to its least one."""
    p = contacts.select("segment_id", "boundary_id").distinct()
    least = p.groupBy("segment_id").agg(F.min("boundary_id").alias("v"))
    roots = components(p.join(least, "segment_id").select(F.col("boundary_id").alias("u"), "v")).withColumnRenamed("u", "boundary_id")
    return p.select("boundary_id").distinct().join(roots, "boundary_id", "left").select("boundary_id", F.coalesce("root", "boundary_id").alias("cluster"))


def cluster_topology(contacts: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, n_boundaries, n_connections (segments with two boundaries or more), n_links (pairs), euler, loops, link_loops, branches, redundancy.

    A connection of k boundaries counts as k - 1 edges; branches: the sum of k - 2 over those of k > 2.
    """
    p = contacts.select("segment_id", "boundary_id").distinct().join(clusters, "boundary_id")
    k = p.groupBy("cluster", "segment_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    per = k.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_connections"), F.sum(F.col("k") - 1).alias("_edges"), F.sum(F.greatest(F.col("k") - 2, F.lit(0))).alias("branches"))
    links = linked_boundaries(contacts).join(clusters.withColumnRenamed("boundary_id", "a"), "a").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_links"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_boundaries")).join(per, "cluster", "left").join(links, "cluster", "left")
    out = out.select("cluster", "n_boundaries", zero("n_connections").alias("n_connections"), zero("n_links").alias("n_links"), zero("branches").alias("branches"), (F.col("n_boundaries") - zero("_edges")).alias("euler"))
    out = out.withColumns({"loops": 1 - F.col("euler"), "link_loops": F.col("n_links") - F.col("n_boundaries") + 1})
    return out.withColumn("redundancy", F.when(F.col("n_connections") > 0, F.col("loops") / F.col("n_connections")).otherwise(0.0))


def connected(segments: DataFrame, contacts: DataFrame, yes: bool = True) -> DataFrame:
    """Segments with (or without) a contact."""
    return segments.join(contacts.select("segment_id").distinct(), "segment_id", "left_semi" if yes else "left_anti")


def surface_density(contacts: DataFrame, areas: DataFrame) -> DataFrame:
    """boundary_id, n_contacts, density per area."""
    c = contacts.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("n_contacts"))
    return areas.join(c, "boundary_id", "left").select("boundary_id", F.coalesce("n_contacts", F.lit(0)).alias("n_contacts"), (F.coalesce("n_contacts", F.lit(0)) / F.col("area")).alias("density"))


# Segments by their contacts


def without_boundaries(contacts: DataFrame, boundaries: Sequence[int]) -> DataFrame:
    """Contacts less those with the boundaries; segments left with none are gone with them."""
    return contacts.where(~F.col("boundary_id").isin(list(boundaries)))


def touching(segments: DataFrame, contacts: DataFrame, boundaries: Sequence[int], yes: bool = True) -> DataFrame:
    """Segments that touch any of the boundaries (or none)."""
    hit = contacts.where(F.col("boundary_id").isin(list(boundaries))).select("segment_id").distinct()
    return segments.join(hit, "segment_id", "left_semi" if yes else "left_anti")


def with_n_boundaries(segments: DataFrame, contacts: DataFrame) -> DataFrame:
    """segments with n_boundaries, 0 where a segment touches none."""
    n = contacts.groupBy("segment_id").agg(F.countDistinct("boundary_id").alias("n_boundaries"))
    return segments.join(n, "segment_id", "left").withColumn("n_boundaries", F.coalesce("n_boundaries", F.lit(0)))


def by_n_boundaries(segments: DataFrame, contacts: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Segments with low to high boundaries (ends belong to it; null: open)."""
    n = with_n_boundaries(segments, contacts)
    return n.where(F.col("n_boundaries").between(low if low is not None else -1, high if high is not None else 1 << 62))


def classified(segments: DataFrame, contacts: DataFrame, ids: Sequence[Sequence[int]], rest: bool = False) -> DataFrame:
    """segment_id, class: the first group of boundaries (from 0) that holds one the segment touches; rest: -1 for the others that touch something."""
    k = F.lit(None).cast("int")
    for i in range(len(ids) - 1, -1, -1):
        k = F.when(F.col("boundary_id").isin(list(ids[i])), F.lit(i)).otherwise(k)
    out = contacts.join(segments.select("segment_id"), "segment_id", "left_semi").groupBy("segment_id").agg(F.min(k).alias("class"))
    return out.withColumn("class", F.coalesce("class", F.lit(-1))) if rest else out.where("class IS NOT NULL")


def ordered_by_boundaries(contacts: DataFrame) -> DataFrame:
    """segment_id, place (from 1): segments in the order of their sorted boundary lists, ties by id."""
    from quadrat.operators.tables import numbered

    b = contacts.groupBy("segment_id").agg(F.array_sort(F.collect_set("boundary_id")).alias("_b"))
    return numbered(b, "_b", "segment_id", to="_k").select("segment_id", (F.col("_k") + 1).alias("place"))


def connection_clusters(contacts: DataFrame, clusters: DataFrame) -> DataFrame:
    """segment_id, cluster: segments that join two boundaries or more, in the cluster of their least one."""
    p = contacts.select("segment_id", "boundary_id").distinct()
    least = p.groupBy("segment_id").agg(F.min("boundary_id").alias("boundary_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return least.join(clusters, "boundary_id").select("segment_id", "cluster")


def dual_clusters(contacts: DataFrame, clusters: DataFrame) -> DataFrame:
    """segment_id, a, b (clusters, a < b): connections between boundaries of two clusters."""
    p = contacts.select("segment_id", "boundary_id").distinct().join(clusters, "boundary_id").select("segment_id", "cluster").distinct()
    return p.alias("x").join(p.alias("y"), "segment_id").where("x.cluster < y.cluster").select("segment_id", F.col("x.cluster").alias("a"), F.col("y.cluster").alias("b"))


def connection_features(boundaries: DataFrame, contacts: DataFrame, lengths: DataFrame, default: float = -1.0) -> DataFrame:
    """boundary_id, n_connections, mean_length (default where there is none): of the segments at each boundary. lengths: segment_id, length."""
    p = contacts.select("segment_id", "boundary_id").distinct().join(lengths, "segment_id", "left")
    s = p.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("n_connections"), F.avg("length").alias("mean_length"))
    return boundaries.join(s, "boundary_id", "left").select("boundary_id", F.coalesce("n_connections", F.lit(0)).alias("n_connections"), F.coalesce("mean_length", F.lit(default)).alias("mean_length"))


def nearest(distances: DataFrame, ids: DataFrame, default: int = -1) -> DataFrame:
    """id, nearest, dist: of (a, b, dist) rows, each id's nearest partner; default and null where there is none."""
    both = distances.select(F.col("a").alias("id"), F.col("b").alias("o"), "dist").unionAll(distances.select(F.col("b").alias("id"), F.col("a").alias("o"), "dist"))
    m = both.groupBy("id").agg(F.min(F.struct("dist", "o")).alias("_m"))
    return ids.join(m, "id", "left").select("id", F.coalesce("_m.o", F.lit(default)).alias("nearest"), F.col("_m.dist").alias("dist"))


def far_apart(points: DataFrame, limit: float, keys: Sequence[str], id_col: str = "segment_id") -> DataFrame:
    """keys, id of the segments whose contact points (two rows or more) are all at most limit apart from each other."""
    from quadrat.operators.points import XYZ

    # The widest pair of a segment's few contacts: pairs within a segment only.
    p = points.select(*keys, id_col, F.struct(*XYZ).alias("p"))
    a, b = p.withColumnRenamed("p", "a"), p.withColumnRenamed("p", "b")
    d = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in XYZ), F.lit(0.0)))
    return a.join(b, [*keys, id_col]).groupBy(*keys, id_col).agg(F.max(d).alias("_d"), F.count(F.lit(1)).alias("_n")).where((F.col("_d") <= limit) & (F.col("_n") > 1)).select(*keys, id_col)


def multi_cluster(contacts: DataFrame) -> DataFrame:
    """segment_id, boundary_id, cluster and its topology (see cluster_topology): the connectivity analysis as one table, a row for each contact."""
    c = boundary_clusters(contacts)
    return contacts.select("segment_id", "boundary_id").distinct().join(c, "boundary_id").join(cluster_topology(contacts, c), "cluster")
