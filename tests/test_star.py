"""Round trips of STAR tables."""

from pyspark.sql import functions as F

from quadrat.sources import star

SCHEMA = "_rlnMicrographName string, _rlnCoordinateX double, _rlnClassNumber int"
ROWS = [(None, None, None), ("a b", 1.5, 2), ("", -2.0, None), ("?", 0.1, 3), ('q"x', None, 4), ("é", 1e300, 5)]


def test_every_value_reads_back(spark, tmp_path):
    star.register(spark)
    p = str(tmp_path / "a")
    back = lambda: sorted(map(tuple, spark.read.format("star").load(p).collect()), key=repr)
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.format("star").mode("overwrite").save(p)
    assert back() == sorted(ROWS, key=repr)
    spark.createDataFrame(ROWS[:1], SCHEMA).write.format("star").mode("append").save(p)
    assert back() == sorted(ROWS + ROWS[:1], key=repr)
    spark.createDataFrame(ROWS[:2], SCHEMA).coalesce(1).write.format("star").mode("overwrite").save(p)
    assert back() == sorted(ROWS[:2], key=repr)
    spark.createDataFrame([], SCHEMA).write.format("star").mode("overwrite").save(p)
    assert back() == [] and spark.read.format("star").load(p).columns == ["_rlnMicrographName", "_rlnCoordinateX", "_rlnClassNumber"]


def test_a_file_for_each_micrograph(spark, tmp_path):
    star.register(spark)
    t = spark.range(20).select((F.col("id") % 3).alias("tomo_id"), F.col("id").alias("x"), F.lit(1).alias("y"), F.lit(2).alias("z"), F.lit(7).alias("k"))
    listed = star.save_by_micrograph(star.from_points(t, classes="k"), str(tmp_path)).collect()
    assert sorted(r.n for r in listed) == [6, 7, 7]
    assert spark.read.format("star").load(str(tmp_path)).count() == 20
    one = spark.read.format("star").load(next(r._psStarFile for r in listed if r.n == 6))
    assert star.particle_points(one, "2").count() == 6
