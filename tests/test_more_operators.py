"""Operators that SQL does not express, against plain Python on small inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import geometry as G
from quadrat.operators import clusters, columns, curves, graphs, regions, simulate, tables, voxels
from quadrat.operators.suppression import settled_rounds
from quadrat.sources import files

EDGE = "graph_id long, src long, dst long, length double"


def two_cliques():
    return [(0, a + s, b + s, 1.0) for s in (0, 10) for a in range(5) for b in range(a + 1, 5)] + [(0, 4, 10, 0.1)]


def groups(df, item, label):
    out = {}
    for r in df.collect():
        out.setdefault(r[label], set()).add(r[item])
    return sorted(map(sorted, out.values()))


CLIQUES = [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]


def test_communities(spark):
    e = spark.createDataFrame(two_cliques(), EDGE)
    v = e.select(F.col("src").alias("vid")).union(e.select("dst")).distinct()
    assert groups(graphs.modular_communities(e), "vid", "community") == CLIQUES
    assert groups(graphs.spectral(e, 2), "vid", "cluster") == CLIQUES
    assert groups(graphs.annealed_communities(v, e.drop("graph_id"), 12, seed=3), "vid", "community") == CLIQUES
    assert len(groups(graphs.modular_communities(e, 4), "vid", "community")) == 4
    apart = e.drop("graph_id").withColumn("length", F.when(F.col("dst") - F.col("src") > 5, 5.0).otherwise(F.col("length")))
    assert groups(graphs.geodesic_clusters(apart, v, 9.0, -2.5), "vid", "exemplar") == CLIQUES


def test_too_large_graphs_raise(spark, monkeypatch):
    monkeypatch.setattr(graphs, "MOST", 3)
    monkeypatch.setattr(clusters, "MOST", 3)
    with pytest.raises(ValueError):
        graphs.spectral(spark.createDataFrame(two_cliques(), EDGE), 2)
    with pytest.raises(ValueError):
        clusters.agglomerative(spark.range(5).selectExpr("0 tomo_id", "id part_id", "id x", "id y", "id z"), ["tomo_id"], 1.0)


def blobs(spark, n=3, each=8, seed=0):
    rnd = random.Random(seed)
    rows = [(0, 100 * k + i, *(50.0 * k + rnd.gauss(0, 1) for _ in range(3))) for k in range(n) for i in range(each)]
    return rows, spark.createDataFrame(rows, "tomo_id long, part_id long, x double, y double, z double")


def test_linkage(spark):
    rows, p = blobs(spark)
    want = [[100 * k + i for i in range(8)] for k in range(3)]
    for method in ("single", "complete", "average", "ward"):
        assert groups(clusters.agglomerative(p, ["tomo_id"], n=3, method=method), "id", "cluster") == want
    assert clusters.cophenetic(blobs(spark, 2)[1], ["tomo_id"]).first().correlation > 0.99
    for preference in (None, -500.0):
        assert groups(clusters.affinity_by_subsets(p, ["tomo_id"], 2, preference), "id", "exemplar") == want


def ward_cost(groups_):
    return sum(((g - g.mean(0)) ** 2).sum() for g in groups_)


def test_ward_joins_what_costs_least():
    x = np.random.default_rng(4).standard_normal((9, 2))
    parts = [[i] for i in range(9)]
    for i, j, height in clusters._merges(x, "ward"):
        costs = {(a, b): ward_cost([x[parts[a] + parts[b]]]) - ward_cost([x[parts[a]], x[parts[b]]]) for a, b in itertools.combinations([k for k, p in enumerate(parts) if p], 2)}
        best = min(costs.values())
        assert math.isclose(costs[i, j], best, rel_tol=1e-9) and math.isclose(height**2 / 2, best, rel_tol=1e-9)
        parts[i], parts[j] = parts[i] + parts[j], []


def cube(n, label=1, holes=(), at=(0, 0, 0)):
    return [(label, x + at[0], y + at[1], z + at[2]) for x in range(n) for y in range(n) for z in range(n) if (x, y, z) not in holes]


def test_homology(spark):
    ring = [(2, x, y, 0) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    two = cube(1, 4) + cube(1, 4, at=(5, 5, 5))
    rows = cube(3) + ring + cube(3, 3, holes={(1, 1, 1)}) + two
    got = {r.label: (r.euler, r.objects, r.loops, r.holes) for r in voxels.homology(spark.createDataFrame(rows, "label long, x long, y long, z long")).collect()}
    assert got == {1: (1, 1, 0, 0), 2: (0, 1, 1, 0), 3: (2, 1, 0, 1), 4: (2, 2, 0, 0)}


def test_filled_and_geodesic(spark):
    v = spark.createDataFrame(cube(4, holes={(1, 1, 1), (2, 1, 1), (0, 2, 2)}), "tomo_id long, x long, y long, z long")
    got = {(r.x, r.y, r.z) for r in voxels.filled(v).collect()}
    assert got == {(x, y, z) for x in range(4) for y in range(4) for z in range(4)} - {(0, 2, 2)}
    maze = [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 2, 0), (2, 2, 0), (2, 1, 0), (2, 0, 0), (9, 9, 9)]
    m = spark.createDataFrame([(0, *c) for c in maze], "tomo_id long, x long, y long, z long")
    d = {(r.x, r.y, r.z): r.dist for r in voxels.geodesic(m, m.where("x = 0 AND y = 0")).collect()}
    assert d == {c: k for k, c in enumerate(maze[:-1])}
    s = voxels.sampled_points(m.withColumn("label", F.lit(1)), 2.5).collect()
    kept = [(r.x, r.y, r.z) for r in s]
    assert all(math.dist(a, b) >= 2.5 for a, b in itertools.combinations(kept, 2)) and (0, 0, 0) in kept and (9, 9, 9) in kept


def test_segments_by_contact(spark):
    # a rod between two plates, and a rod at one plate
    rows = [(0, 5, 5, z, 1.0) for z in range(1, 5)] + [(0, 1, 1, z, 1.0) for z in range(1, 3)] + [(0, 8, 8, 2, 1.0)]
    v = spark.createDataFrame(rows, "tomo_id long, x long, y long, z long, value double")
    plates = spark.createDataFrame([(0, x, y, z, lab) for x in range(10) for y in range(10) for z, lab in ((0, 1), (5, 2))], "tomo_id long, x long, y long, z long, label long")
    n = lambda ids, mode: voxels.segments_by_contact(v, plates, ids, mode).count()
    assert (n([1, 2], "exact"), n([1], "exact"), n([1], "at_least"), n([1, 2], "at_most")) == (4, 2, 6, 6)
    a = voxels.analysis(v.withColumn("value", F.col("z").cast("double")), [2.0, 4.0], least=2).collect()
    assert sorted((r.threshold, r.volume, r.mean) for r in a) == [(2.0, 2, 1.5), (2.0, 2, 1.5), (4.0, 2, 1.5), (4.0, 4, 2.5)]


def test_circle_in_box(spark):
    rnd = random.Random(1)
    pts = [(k, rnd.uniform(0, 10), rnd.uniform(0, 7)) for k in range(40)] + [(100, 0.0, 0.0), (101, 10.0, 3.5), (102, 5.0, 3.5)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    grid = (np.arange(2000) + 0.5) / 1000 - 1
    gx, gy = np.meshgrid(grid, grid)
    for r in (0.5, 2.0, 6.0):
        for row in regions.edge_weights(df, (10, 7), r).collect():
            x, y = gx * r + row.x, gy * r + row.y
            disc = gx * gx + gy * gy <= 1
            share = (disc & (x >= 0) & (x <= 10) & (y >= 0) & (y <= 7)).sum() / disc.sum()
            assert row.weight == pytest.approx(1 / share, rel=5e-3)


def test_inside_a_sphere(spark):
    """A ball of triangles with corners on whole coordinates: rays through edges and corners count once."""
    def split(t):
        a, b, c = (np.array(p) for p in t)
        mid = lambda p, q: (p + q) / np.linalg.norm(p + q)
        ab, bc, ca = mid(a, b), mid(b, c), mid(c, a)
        return [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]

    faces = [((s, 0, 0), (0, t, 0), (0, 0, u)) for s in (1, -1) for t in (1, -1) for u in (1, -1)]
    for _ in range(2):
        faces = [x for f in faces for x in split(f)]
    corner = lambda p: tuple(float(10 * v) for v in p)
    t = spark.createDataFrame([(0, corner(a), corner(b), corner(c)) for a, b, c in faces], "tomo_id long, a struct<x: double, y: double, z: double>, b struct<x: double, y: double, z: double>, c struct<x: double, y: double, z: double>")
    rnd = random.Random(3)
    pts = [(0, k, *(rnd.uniform(-12, 12) for _ in range(3))) for k in range(400)] + [(0, 1000 + k, float(x), 0.0, 0.0) for k, x in enumerate((-11, -5, 0, 5, 11))]
    p = spark.createDataFrame(pts, "tomo_id long, part_id long, x double, y double, z double")
    got = {r.id for r in regions.inside_surface(p, t, 3.0).collect()}
    for _, k, *at in pts:
        d = math.hypot(*at)
        assert (k in got) == (d < 10) or 9.0 < d < 10.01, (k, at)
    assert {1001, 1002, 1003} <= got and not {1000, 1004} & got


def test_rotations_and_quaternions(spark):
    rnd = np.random.default_rng(2)
    angles = [(k, *rnd.uniform(-180, 180, 3).tolist()) for k in range(30)] + [(100, 0.0, 180.0, 0.0), (101, 0.0, 0.0, 0.0), (102, 90.0, 180.0, 0.0), (103, 0.0, 180.0, 180.0)]
    df = spark.createDataFrame(angles, "k long, rot double, tilt double, psi double").withColumn("m", G.matrix(F.col("rot"), F.col("tilt"), F.col("psi")))
    df = df.withColumn("q", G.quaternion_of_matrix(F.col("m"))).withColumn("back", G.matrix_of_quaternion(F.col("q"))).withColumn("e", G.angles_zyz(F.col("m")))
    for r in df.withColumn("again", G.matrix(F.col("e.rot"), F.col("e.tilt"), F.col("e.psi"))).collect():
        assert np.allclose(r.m, r.back, atol=1e-7) and np.allclose(r.m, r.again, atol=1e-6), r
        assert math.isclose(sum(v * v for v in r.q), 1, abs_tol=1e-9)
    pairs = [(k, *rnd.standard_normal(6).tolist()) for k in range(20)] + [(50, 1.0, 2.0, 3.0, -1.0, -2.0, -3.0), (51, 1.0, 0.0, 0.0, -2.0, 0.0, 0.0), (52, 1.0, 1.0, 0.0, 2.0, 2.0, 0.0)]
    v = spark.createDataFrame(pairs, "k long, ax double, ay double, az double, bx double, by double, bz double")
    for r in v.withColumn("m", G.between_vectors([F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"])).collect():
        m, a, b = np.array(r.m).reshape(3, 3), np.array([r.ax, r.ay, r.az]), np.array([r.bx, r.by, r.bz])
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9) and math.isclose(np.linalg.det(m), 1, abs_tol=1e-9)
        assert np.allclose(m @ a / np.linalg.norm(a), b / np.linalg.norm(b), atol=1e-9)


def test_transforms_and_point_arrays(spark):
    rnd = np.random.default_rng(8)
    one, two = ((rnd.standard_normal(9).tolist(), rnd.standard_normal(3).tolist()) for _ in range(2))
    x = rnd.standard_normal(3)
    do = lambda t, v: np.array(t[0]).reshape(3, 3) @ v + np.array(t[1])
    assert np.allclose(do(G.composed(two, one), x), do(two, do(one, x))) and np.allclose(do(G.inverse(one), do(one, x)), x)
    q, d, (xy, xz, yz), parity = G.decomposed(one)
    q = np.array(q).reshape(3, 3)
    upper = np.array([[d[0], d[0] * xy, d[0] * xz], [0, d[1], d[1] * yz], [0, 0, d[2]]])
    assert np.allclose(q @ upper, np.array(one[0]).reshape(3, 3)) and math.isclose(np.linalg.det(q), 1) and parity in (1, -1) and d[1] > 0 < d[2]
    r = spark.createDataFrame([([[0.0, 0.0], [3.0, 4.0], [0.0, 2.0]],)], "p array<array<double>>").select(G.distances_from(F.col("p"), 0).alias("d"), G.angles_at(F.col("p"), 0).alias("a")).first()
    assert r.d == [0, 5, 2] and r.a[1] == pytest.approx(math.degrees(math.acos(0.8)))


def test_null_models(spark):
    grid = [(0, float(x), float(y), float(z)) for x in range(-4, 5) for y in range(-4, 5) for z in range(-4, 5) if x * x + y * y + z * z <= 16]
    voi = spark.createDataFrame(grid, "tomo_id long, x double, y double, z double")
    inside = {g[1:] for g in grid}
    at = lambda r: tuple(float(np.rint(v)) for v in (r.x, r.y, r.z))
    n = spark.createDataFrame([(0, 50)], "tomo_id long, n long")
    one = simulate.csr_in_voi(n, voi, 2, 40, seed=1).collect()
    assert len(one) == 100 and all(at(r) in inside for r in one)
    assert sorted(map(tuple, simulate.csr_in_voi(n, voi.repartition(7), 2, 40, seed=1).collect())) == sorted(map(tuple, one))
    p = spark.createDataFrame([(0, k, 0.0, 0.0, 0.0) for k in range(60)], "tomo_id long, part_id long, x double, y double, z double")
    second = simulate.second_pattern_in_voi(p, voi, 2.0, 0.0, seed=2).collect()
    assert all(math.isclose(math.dist((r.x, r.y, r.z), (0, 0, 0)), 2, abs_tol=1e-9) for r in second) and len(second) > 50
    assert min(r.x for r in second) < -1 and min(r.y for r in second) < -1
    rods = spark.createDataFrame([(0, k, s, 0.5 * s, 0.0, 0.0) for k in range(12) for s in range(4)], "tomo_id long, curve_id long, seq long, x double, y double, z double")
    boxes = spark.createDataFrame([(0, [-4.0] * 3, [4.0] * 3)], "tomo_id long, lo array<double>, hi array<double>")
    turned = simulate.turned_filaments(rods, voi, boxes, 40, seed=5)
    got = {}
    for r in turned.collect():
        got.setdefault(r.curve_id, []).append((r.seq, (r.x, r.y, r.z)))
        assert at(r) in inside
    assert len(got) > 8
    for rows in got.values():
        pts = [q for _, q in sorted(rows)]
        assert len(pts) == 4 and all(math.isclose(math.dist(a, b), 0.5, abs_tol=1e-9) for a, b in zip(pts, pts[1:]))
    kept = {r.curve_id for r in simulate.inserted(turned, 1.0).collect()}
    want = []
    for k in sorted(got):
        if all(math.dist(a, b) >= 2 for j in want for _, a in got[j] for _, b in got[k]):
            want.append(k)
    assert kept == set(want)


def test_settled_rounds_is_the_sweep(spark):
    rnd = random.Random(7)
    over = [(a, b) for a in range(60) for b in range(a + 1, 60) if rnd.random() < 0.08]
    kept = []
    for k in range(60):
        if not any((j, k) in set(over) for j in kept):
            kept.append(k)
    got = settled_rounds(spark.createDataFrame(over, "over long, id long"), spark.range(60))
    assert sorted(r.id for r in got.collect()) == kept


def test_exclusive_sub_columns(spark):
    rnd = random.Random(2)
    rows = [(layer, 0, 100 * layer + k, rnd.uniform(0, 20), rnd.uniform(0, 20), 0.0) for layer in (1, 2, 3) for k in range(8)]
    p = spark.createDataFrame(rows, "layer int, tomo_id long, part_id long, x double, y double, z double")
    at = {r[2]: r[3:5] for r in rows}
    near = lambda a, b: math.dist(at[a], at[b]) <= 7
    every = sorted(((-2, a, b, c) for a in range(100, 108) for b in range(200, 208) for c in range(300, 308) if near(a, b) and near(a, c)))
    used, want = set(), []
    for _, a, b, c in every:
        if not used & {a, b, c}:
            used |= {a, b, c}
            want.append((a, b, c))
    got = columns.exclusive_sub_columns(columns.layer_clusters(p, 0.0), 7.0).collect()
    assert sorted((r.c1, r.c2, r.c3) for r in got) == sorted(want) and want


def test_frame_symmetry(spark):
    circle = [(0, k, math.cos(k / 10), math.sin(k / 10), 0.0) for k in range(63)]
    r = curves.frame_symmetry(spark.createDataFrame(circle, "curve_id long, seq long, x double, y double, z double")).first()
    assert r.binormal_symmetry == pytest.approx(1) and r.normal_symmetry < 0.1


def test_list_lengths_are_checked(spark):
    df = spark.range(3).withColumnRenamed("id", "row_id")
    with pytest.raises(ValueError):
        tables.add_list(df, "v", spark.range(2).selectExpr("id row_id", "id v"))


def test_vtk_images_and_polydata(spark, tmp_path):
    v = np.arange(24, dtype=float).reshape(2, 3, 4) / 3
    (tmp_path / "a.vti").write_text(files.vti_text(v))
    got = {(r.x, r.y, r.z): r.value for r in files.vtk_images(spark, str(tmp_path / "a.vti")).collect()}
    assert got == {at: v[at] for at in np.ndindex(v.shape)}
    mrc = files.converted(spark, str(tmp_path / "a.vti"), "mrc").first()
    assert mrc.file.endswith("a.mrc") and np.allclose(files.decode_volume("a.mrc", mrc.content), v)
    (tmp_path / "b.mrc").write_bytes(mrc.content)
    back = files.converted(spark, str(tmp_path / "b.mrc"), "vti").first()
    assert np.allclose(files.decode_vti(bytes(back.content).decode()), v)
    points, cells = [(0.0, 0.0, 0.0), (1.0, 0.5, 0.0), (0.0, 1.0, 2.0)], [[0, 1, 2], [1, 2]]
    (tmp_path / "s.vtp").write_text(files.polydata_text(points, cells))
    rows = files.polydata(spark, str(tmp_path / "s.vtp"))
    files.write_polydata(rows, str(tmp_path / "out"))
    one = lambda df: sorted((r.kind, r.id, r.x, r.y, r.z, tuple(r.points or ())) for r in df.collect())
    assert one(files.polydata(spark, str(tmp_path / "out" / "part-*"))) == one(rows)
    assert files.surface_voxels(rows.where("kind = 'point'")).count() == 3


def test_domain_tables(spark, tmp_path):
    (tmp_path / "ves1.dat").write_text("# a table\n# id mean\n1 0.5 0.1 0 1 12.5 3 99\n2 nan 1e-3 . 2 -4.5\nrest\n")
    (tmp_path / "ves2.dat").write_text("3 1 1 1 1 1 1\n")
    got = {(r.identifier, r.id): (r["mean"], r["std"], r["min"], r.radius, r.distance) for r in files.domain_table(spark, str(tmp_path / "*.dat"), "vesicles").collect()}
    assert got == {("ves1", 1): (0.5, 0.1, 0.0, 12.5, 3.0), ("ves1", 2): (None, 1e-3, None, -4.5, None), ("ves2", 3): (1.0, 1.0, 1.0, 1.0, 1.0)}
    for k in (1, 2):
        (tmp_path / f"c{k}.py").write_text(f"identifier = 'e{k}'\ncategory = 'g'\nvesicles = '{tmp_path}/ves{k}.dat'\n")
    e = files.experiments(spark, files.catalogs(spark, str(tmp_path / "c*.py")), "vesicles", "vesicles").collect()
    assert sorted((r.group, r.identifier, r.id) for r in e) == [("g", "e1", 1), ("g", "e1", 2), ("g", "e2", 3)]
    (tmp_path / "x.log").write_text("# shifts\n1 2 3\n-1 -2 -3\n")
    assert [(r.frame, r.dx, r.dy) for r in files.frame_shifts(spark, str(tmp_path / "x.log")).collect()] == [(0, 1, -1), (1, 2, -2), (2, 3, -3)]
    (tmp_path / "t.tlt").write_text("-60.0\n0\n 3.5 x\n\n")
    assert [r.angle for r in files.tilt_angles(spark, str(tmp_path / "t.tlt")).orderBy("k").collect()] == [-60, 0, 3.5]
    (tmp_path / "m.csv").write_text("id,a,b,c\n1,0,0,0\n1,1,0,0\n2.0,5,5,5\n")
    assert {r.mt_id: len(r.points) for r in files.microtubules(spark, str(tmp_path / "m.csv"), ("a", "b", "c"), "id").collect()} == {1: 2, 2: 1}
    files.coordinates_csv(spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "k long, x double, y double, z double"), str(tmp_path / "o"), True)
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).collect()[0].asDict() == {"x": "1.0", "y": "2.0", "z": "3.0"}


def test_balls_and_planes(spark):
    c = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 2.0), (0, 2, 3.0, 0.0, 0.0, 2.0)], "tomo_id long, label long, x double, y double, z double, r double")
    own = {(r.x, r.y, r.z): r.label for r in voxels.balls(c).collect()}
    for at in itertools.product(range(-3, 7), range(-3, 4), range(-3, 4)):
        d = [(math.dist(at, q), k) for k, q in ((1, (0, 0, 0)), (2, (3, 0, 0)))]
        near = min(x for x in d)
        assert own.get(at) == (near[1] if near[0] <= 2 else None)
    shell = {(r.x, r.y, r.z) for r in voxels.balls(c.where("label = 1"), 1.0).collect()}
    assert shell == {at for at in itertools.product(range(-2, 3), repeat=3) if 1 < math.dist(at, (0, 0, 0)) <= 2}


def test_visitor(spark):
    """The least state that travels: a bottleneck search by a step function of its own."""
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (1, 3, 2.0), (3, 4, 4.0)], "src long, dst long, length double")
    start = spark.createDataFrame([(1, 0.0)], "vid long, state double")
    got = {r.vid: r.state for r in graphs.propagated(e, start, lambda s, d: F.greatest(s, d)).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 4}


def test_slices():
    from quadrat.functions import arrays

    assert arrays.intersected([(0, 5), (2, 9)], [(3, 8), (0, 4)]) == [(3, 5), (2, 4)] and arrays.intersected([(0, 2)], [(2, 4)]) is None
    assert arrays.trimmed([(-2, 3), (1, 9)], (2, 4)) == [(0, 2), (1, 4)]
    a, b = np.arange(12).reshape(3, 4), np.arange(20).reshape(4, 5)
    p, q = arrays.placed(a.shape, b.shape, (1, 2), (0, 4))
    cut = lambda x, s: x[tuple(slice(*r) for r in s)]
    assert cut(a, p).tolist() == [[2, 3], [6, 7], [10, 11]] and cut(b, q).tolist() == [[5, 6], [10, 11], [15, 16]]


def test_blobs_and_homogenised():
    from quadrat.operators import fields

    at = np.stack(np.indices((24, 24, 24)), -1)
    v = sum(np.exp(-((at - np.array(c)) ** 2).sum(-1) / 8) for c in ((6, 6, 6), (17, 12, 15)))
    s = fields.blobs(v, 1.5, 0.1)
    assert sorted(map(tuple, np.argwhere(s > 0).tolist())) == [(6, 6, 6), (17, 12, 15)]
    flat = fields.homogenised(v, 0.1)
    slices = fields.homogenised(v, 0.1, whole=False)
    assert flat.sum() == pytest.approx(v.sum()) and np.allclose(slices.sum((0, 1)), v.sum((0, 1))) and flat.max() < v.max()


def test_faces_close_a_surface(spark):
    """Voxel faces as a closed surface: its points are inside it, those of other voxels are not."""
    rnd = random.Random(5)
    cells = [c for c in itertools.product(range(4), repeat=3) if rnd.random() < 0.6]
    v = spark.createDataFrame([(0, *c) for c in cells], "tomo_id long, x long, y long, z long")
    pts = [(0, k, *(c + rnd.uniform(-0.4, 0.4) for c in at)) for k, at in enumerate(itertools.product(range(-1, 5), repeat=3))]
    p = spark.createDataFrame(pts, "tomo_id long, part_id long, x double, y double, z double")
    got = {r.id for r in regions.inside_surface(p, voxels.faces(v), 1.0).collect()}
    assert got == {k for k, at in enumerate(itertools.product(range(-1, 5), repeat=3)) if at in set(cells)}


def test_catalogs_by_category(spark):
    from quadrat.operators import observations

    c = spark.createDataFrame([("a", {"category": "x", "pixel": "2.5"}), ("b", {"pixel": "1"})], "identifier string, values map<string,string>")
    assert [(r.identifier, r.category) for r in observations.in_categories(c, "category").collect()] == [("a", "x")]
    assert {r.identifier: (r.pixel, r.category) for r in observations.with_values(c, ["pixel", "category"]).collect()} == {"a": ("2.5", "x"), "b": ("1", None)}


SF = "/root/testdata/sf0.001"


def test_components_of_the_whole_graph(spark):
    from quadrat.plans import queries as plans

    e = [(r.src, r.dst) for r in plans.edges(spark, SF).where("length <= 2").collect()]
    root = {r.vid: r.vid for r in plans.vertices(spark, SF).collect()}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in e:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r.vid: r.component for r in plans.QUERIES["graph_components_whole"](spark, SF).collect()} == {v: find(v) for v in root}


def test_correlation_matrix(spark):
    from quadrat.plans import queries as plans

    t = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    want = np.corrcoef(np.array(t.embedding.tolist(), float))
    at = {v: k for k, v in enumerate(t.vec_id)}
    got = plans.QUERIES["pairwise_ncc"](spark, SF).toPandas()
    assert len(got) == len(t) * (len(t) - 1) // 2
    assert np.allclose(got.ncc, [want[at[a], at[b]] for a, b in zip(got.a, got.b)], atol=1e-9)


def test_pca_and_kmeans(spark):
    rnd = np.random.default_rng(6)
    x = np.concatenate([rnd.standard_normal((60, 4)) * [5, 2, 1, 0.1] + c for c in ([0, 0, 0, 0], [60, 0, 0, 0])])
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, features array<double>")
    p = np.array([r.projected for r in clusters.pca(v, 2).orderBy("id").collect()])
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs(p), np.abs(x @ axes), atol=1e-6)
    got = np.array([r.prediction for r in clusters.kmeans(v, 2).orderBy("id").collect()])
    assert len(set(got[:60])) == len(set(got[60:])) == 1 and got[0] != got[60]


def test_persistence(spark):
    rnd = random.Random(9)
    lines = {k: [(float(i), rnd.gauss(0, 0.3) * k, rnd.gauss(0, 0.3) * k) for i in range(2 + k)] for k in range(8)}

    def want(pts):
        if len(pts) <= 2:
            return -1.0
        t = [np.subtract(b, a) for a, b in zip(pts, pts[1:])]
        cos = [min(1.0, max(-1.0, float(v @ t[0] / np.linalg.norm(v) / np.linalg.norm(t[0])))) for v in t]
        n = next((k for k, c in enumerate(cos) if math.degrees(math.acos(c)) > 40), len(t))
        length, c = sum(np.linalg.norm(v) for v in t[:n]), cos[n - 1]
        return -length / math.log(c) if 0 < c < 1 else 0.0

    df = spark.createDataFrame([(k, i, *p) for k, pts in lines.items() for i, p in enumerate(pts)], "curve_id long, seq long, x double, y double, z double")
    got = {r.curve_id: r.persistence for r in curves.persistence(df, 40.0).collect()}
    assert got == pytest.approx({k: want(p) for k, p in lines.items()}, rel=1e-6)


def test_column_overlap(spark):
    rnd = random.Random(4)
    schema = "layer int, tomo_id long, part_id long, x double, y double, z double"
    one, two = ([(rnd.choice((1, 2)), t, k, rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.uniform(0, 20)) for t in (0, 1) for k in range(15)] for _ in range(2))
    got = {(r.tomo_id, r.part_id): r.overlaps for r in columns.overlap(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), 4.0).collect()}
    assert got == {(a[1], a[2]): any(b[0] == 1 and b[1] == a[1] and math.dist(a[3:], b[3:]) <= 4 for b in two) for a in one if a[0] == 1}


def test_envelopes_of_simulations(spark):
    """Percentiles of the simulated curves, by numpy from the curves themselves."""
    from quadrat.operators import points

    boxes = spark.createDataFrame([(t, 12, [0.0] * 3, [10.0] * 3) for t in (0, 1)], "tomo_id long, n long, lo array<double>, hi array<double>")
    sims = simulate.csr(boxes, "n", 19, seed=2)
    k = points.pair_counts(sims, sims, [2.0, 4.0], ["sim_id", "tomo_id"]).withColumnRenamed("pairs", "value")
    rows = k.toPandas()
    at = sims.toPandas()
    for (s, t, r), g in rows.groupby(["sim_id", "tomo_id", "r"]):
        x = at[(at.sim_id == s) & (at.tomo_id == t)][["x", "y", "z"]].to_numpy()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        assert g.value.iloc[0] == (d <= r).sum() - len(x)
    for e in points.envelope(k, ["tomo_id", "r"]).collect():
        v = rows[(rows.tomo_id == e.tomo_id) & (rows.r == e.r)].value
        assert [e.low, e.median, e.high] == pytest.approx(np.percentile(v, [5, 50, 95]).tolist())


def test_oriented_membranes(spark):
    mb = [(0, x, y, 0) for x in range(3) for y in range(2)] + [(0, x, 9, 9) for x in range(2)] + [(0, 30, 0, 0)]
    lumen = [(0, 1, 1, 2, 5), (0, 2, 1, 1, 4), (0, 0, 9, 7, 6)]
    m = spark.createDataFrame(mb, "tomo_id long, x long, y long, z long")
    got = {(r.x, r.y, r.z): r.lumen for r in voxels.oriented_membranes(m, spark.createDataFrame(lumen, "tomo_id long, x long, y long, z long, label long"), 2.0).collect()}
    assert got == {(x, y, 0): 4 for x in range(3) for y in range(2)} | {(x, 9, 9): 6 for x in range(2)}
