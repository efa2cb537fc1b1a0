"""Ids that start anew in each tomogram, as simulations and most particle tables have them."""

from pyspark.sql import functions as F

from quadrat.operators import clusters, columns, graphs, suppression
from quadrat.storage import discard, settled, written

ROWS = [(t, k, float(x), 0.0, 0.0, float(w)) for t in (0, 1) for k, x, w in ((0, 0 + 50 * t, 1 + t), (1, 1 + 50 * t, 5), (2, 10, 3))]
SCHEMA = "tomo_id long, part_id long, x double, y double, z double, w double"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_single_linkage(spark):
    p = spark.createDataFrame(ROWS, SCHEMA)
    assert rows(clusters.single_linkage(p, 1.5, ["tomo_id"]), "tomo_id", "id", "cluster") == [(0, 0, 0), (0, 1, 0), (0, 2, 2), (1, 0, 0), (1, 1, 0), (1, 2, 2)]


def test_dbscan(spark):
    p = spark.createDataFrame(ROWS, SCHEMA)
    assert rows(clusters.dbscan(p, 1.5, 2, ["tomo_id"]), "tomo_id", "id", "cluster") == [(0, 0, 0), (0, 1, 0), (0, 2, -1), (1, 0, 0), (1, 1, 0), (1, 2, -1)]


def test_suppressed_and_peaks(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 9.0), (0, 1, 100.0, 0.0, 0.0, 1.0), (1, 0, 0.0, 0.0, 0.0, 1.0), (1, 1, 1.0, 0.0, 0.0, 9.0)], SCHEMA)
    assert rows(suppression.suppressed(p, 5.0, ["tomo_id"], "w"), "tomo_id", "part_id") == [(0, 0), (0, 1), (1, 1)]
    assert rows(suppression.property_peaks(p, "w", 0.0, 5.0, 5.0, 2, ["tomo_id"]), "tomo_id", "part_id") == [(1, 1)]


def test_layer_clusters(spark):
    p = spark.createDataFrame(ROWS, SCHEMA)
    layers = p.withColumn("layer", F.lit(1)).unionAll(p.withColumn("layer", F.lit(2)))
    got = rows(columns.layer_clusters(layers, 1.5), "layer", "tomo_id", "part_id", "cluster")
    assert got == [(n, t, k, 0 if k < 2 else 2) for n in (1, 2) for t in (0, 1) for k in (0, 1, 2)]


def test_pendant_joins_its_clique(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a < b] + [(0, 4, 1.0)], "src long, dst long, length double")
    v = spark.range(5).withColumnRenamed("id", "vid")
    assert len({r.community for r in graphs.communities(v, e, 20).collect()}) == 1


def test_settled_tables_go(spark, tmp_path):
    made = []

    def build():
        made.append(written(spark.range(3)))
        return made[0].where("id > 0")

    out = settled(build)
    assert rows(out, "id") == [(1,), (2,)]
    exists = lambda t: spark._jvm.org.apache.hadoop.fs.Path(t._written_to).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(t._written_to))
    assert exists(out) and not exists(made[0])
    discard(out)
    assert not exists(out)
