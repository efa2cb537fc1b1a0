"""Queries against their SQL on tables made for a finding of round 2; operators against plain Python."""

import random

import duckdb
import numpy as np
import pytest

from quadrat.operators import columns, graphs, regions
from quadrat.plans import queries as plans


@pytest.fixture
def against_sql(spark, tmp_path):
    """Writes tables given as SQL and compares a query with its SQL on them."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.sql(f"CREATE TABLE {t} AS {sql}")
            con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        want = con.sql(plans.ORACLE_SQL[name])
        got = plans.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
        key = lambda r: tuple((v is None, v) for v in r)
        assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
        return got

    return run


@pytest.mark.parametrize("quantities", [(25,), (45,), (15,), (15, 45)])
def test_cleft_width_without_voxels(against_sql, quantities):
    """Both boundaries, each alone and none: one row in any case."""
    rows = " UNION ALL ".join(f"SELECT k::BIGINT AS l_partkey, (k % 5)::BIGINT AS l_suppkey, 1::INT AS l_linenumber, {q + 0.5}::DOUBLE AS l_quantity FROM range({9 * i}, {9 * i + 9}) t(k)" for i, q in enumerate(quantities))
    (got,) = against_sql("cleft_width", lineitem=rows)
    assert (got.n > 0) == (len(quantities) == 2)


def test_connectivity_distance_beyond_three_steps(against_sql):
    """A chain of suppliers and parts from supplier 1, whose row stands twice."""
    got = against_sql(
        "graph_connectivity_distance",
        lineitem="SELECT (k // 2)::BIGINT AS l_partkey, ((k + 1) // 2 + 1)::BIGINT AS l_suppkey, 1.0::DOUBLE AS l_quantity FROM range(8) t(k)",
        part="SELECT k::BIGINT AS p_partkey, 1.0::DOUBLE AS p_retailprice FROM range(4) t(k)",
        supplier="SELECT unnest([1, 1, 2, 3, 4, 5, 6])::BIGINT AS s_suppkey, 1.0::DOUBLE AS s_acctbal",
    )
    steps = {r.vid: r.steps for r in got}
    assert len(got) == 11 and steps[-2] == 0 and steps[1] == 3 and steps[-4] == -1


@pytest.mark.parametrize("most", [columns.MOST, 0])
def test_exclusive_sub_columns_of_crowded_layers(spark, monkeypatch, most):
    """All 27,000 combinations of three crowded layers, and clusters of several points in a second tomogram; by the sweep and by rounds."""
    monkeypatch.setattr(columns, "MOST", most)
    rnd = random.Random(4)
    rows = [(layer, 0, 100 * layer + k, 0, rnd.random(), rnd.random(), 0.0) for layer in (1, 2, 3) for k in range(30)]
    rows += [(layer, 1, 100 * layer + k, 100 * layer + k % 7, rnd.uniform(0, 9), rnd.uniform(0, 9), 0.0) for layer in (1, 2, 3) for k in range(28)]
    rows = [(*r[:3], r[3] or r[2], *r[4:]) for r in rows]
    p = spark.createDataFrame(rows, "layer int, tomo_id long, part_id long, cluster long, x double, y double, z double")
    want, used = set(), set()
    n = {}
    for a in rows:
        for b in rows:
            if a[0] == 1 and b[0] > 1 and a[1] == b[1] and (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2 <= 9:
                n[a[1], a[3], b[3]] = n.get((a[1], a[3], b[3]), 0) + 1
    every = sorted((-m - w, t, a, b, c) for (t, a, b), m in n.items() if b < 300 for (u, d, c), w in n.items() if (t, a) == (u, d) and c >= 300)
    for _, t, *cs in every:
        if not used & {(t, c) for c in cs}:
            used |= {(t, c) for c in cs}
            want.add((t, *cs))
    assert {tuple(r) for r in columns.exclusive_sub_columns(p, 3.0).collect()} == want and len(want) > 30


def test_correlations_of_odd_vectors(spark, monkeypatch):
    """Blocks grow in number with the vectors; a constant, a null, one with a null and a shorter vector have no correlation."""
    monkeypatch.setattr(regions, "BLOCK", 5)
    x = np.random.default_rng(1).standard_normal((40, 6))
    rows = [(k, r.tolist()) for k, r in enumerate(x)] + [(40, [2.0] * 6), (41, None), (42, [None, 1.0, 2.0, 3.0, 4.0, 5.0]), (43, [1.0, 2.0])]
    got = regions.correlations(spark.createDataFrame(rows, "id long, features array<double>"), 2).collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(44) for b in range(a + 1, 44)]
    want = np.corrcoef(x)
    assert all(r.ncc is None if r.b >= 40 else abs(r.ncc - want[r.a, r.b]) < 1e-12 for r in got)


@pytest.mark.parametrize("share", [7, 200_000])
def test_spectral_of_many_graphs(spark, monkeypatch, share):
    """Graphs of three cliques of several sizes, shuffled, some of them with a self edge or an edge twice; in many shares and in one."""
    monkeypatch.setattr(graphs, "SHARE", share)
    rnd, rows, want = random.Random(5), [], set()
    for g in range(30):
        at = 0
        for _ in range(3):
            members = [1000 - 7 * v for v in range(at, at + rnd.randint(2, 5))]
            at += len(members)
            rows += [(g, a, b, 1.0) for a in members for b in members if a < b]
            want.add((g, *sorted(members)))
        rows += [(g, 1000, 1000, 0.1), rows[-1]]
    rnd.shuffle(rows)
    got = {}
    for r in graphs.spectral(spark.createDataFrame(rows, "graph_id long, src long, dst long, length double"), 3).collect():
        got.setdefault((r.graph_id, r.cluster), []).append(r.vid)
    assert {(g, *sorted(v)) for (g, _), v in got.items()} == want


def test_betweenness_in_turns(spark, monkeypatch):
    """A path and a cycle in several turns; a turn holds no pairs beyond its own, and its tables go."""
    monkeypatch.setattr(graphs, "PAIRS", 30)
    held = []
    real = graphs.bounded_distances
    monkeypatch.setattr(graphs, "bounded_distances", lambda *a: held.append(real(*a)) or held[-1])
    rows = [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0), (10, 11, 1.0), (11, 12, 1.0), (12, 13, 1.0), (10, 13, 1.0)]
    got = graphs.betweenness_waves(spark.createDataFrame(rows, "src long, dst long, length double"))
    want = {0: 0, 1: 2, 2: 2, 3: 0, 10: 0.5, 11: 0.5, 12: 0.5, 13: 0.5}
    assert {r.vid: r.betweenness for r in got.collect()} == pytest.approx(want)
    assert len(held) == 3
    for t in held:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_to)
        assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
