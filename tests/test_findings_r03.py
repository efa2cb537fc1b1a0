"""Queries and operators against plain Python on tables made for a finding of round 3."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import graphs, regions


def lattice(rnd, n, m, base, length):
    """A connected graph of n vertices, and m edges besides."""
    out = [(base + k, base + rnd.randrange(k), length()) for k in range(1, n)]
    return out + [(base + a, base + b, length()) for a, b in (rnd.sample(range(n), 2) for _ in range(m))]


@pytest.mark.parametrize("sizes", [{}, {"SMALL": 20, "WORK": 5_000, "FEW": 5}, {"SMALL": 20, "WORK": 5_000, "FEW": 5, "ROUNDS": 2, "LEVELS": 4}])
def test_betweenness_in_shares(spark, monkeypatch, sizes):
    """Components with many paths of one length, with real lengths and as a path, without tables of all pairs: whole ones, in shares, and by either way of walking."""
    for k, v in sizes.items():
        monkeypatch.setattr(graphs, k, v)
    monkeypatch.setattr(graphs, "bounded_distances", None)
    rnd = random.Random(3)
    rows = lattice(rnd, 60, 300, 0, lambda: float(rnd.randint(1, 9))) + lattice(rnd, 40, 60, 1000, rnd.random) + [(2000 + k, 2001 + k, 1.0) for k in range(90)]
    rows += [(3000 + 3 * k, 3001 + 3 * k, 2.0) for k in range(30)] + [(5000, 5000, 1.0)]
    e = spark.createDataFrame(rows, "src long, dst long, length double")
    want = {r.vid: r.betweenness for r in graphs.betweenness(graphs.simple(e).withColumn("graph_id", F.lit(1))).collect()}
    got = {r.vid: r.betweenness for r in graphs.betweenness_shares(e).collect()}
    assert got == pytest.approx(want, abs=1e-6) and max(want.values()) > 100 and len(want) == 251


def test_betweenness_of_large_components(spark, monkeypatch):
    """A component beyond LARGE goes by waves beside others; vertices may be strings, and a null length is no edge."""
    monkeypatch.setattr(graphs, "LARGE", 5)
    monkeypatch.setattr(graphs, "SMALL", 2)
    rows = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 1.0), ("x", "y", None)] + [(f"p{k}", f"p{k + 1}", 1.0) for k in range(7)]
    got = {r.vid: r.betweenness for r in graphs.betweenness_shares(spark.createDataFrame(rows, "src string, dst string, length double")).collect()}
    assert got == pytest.approx({**dict.fromkeys("abcd", 0.5), "x": 0, "y": 0, **{f"p{k}": k * (7 - k) for k in range(8)}})


def test_query_of_betweenness_makes_no_pairs(spark, monkeypatch):
    """As in test_betweenness_waves, without its rounds."""
    from quadrat.plans import queries as plans

    monkeypatch.setattr(graphs, "bounded_distances", None)
    got = {r.vid: r.betweenness for r in plans.QUERIES["graph_betweenness"](spark, "/root/testdata/sf0.001").collect()}
    want = graphs.betweenness(plans.edges(spark, "/root/testdata/sf0.001").withColumn("graph_id", F.lit(1))).collect()
    assert got == pytest.approx({r.vid: r.betweenness for r in want}, abs=1e-6) and np.max(list(got.values())) > 0


def test_correlations_shuffle_no_vector_for_each_block(spark, monkeypatch):
    """Blocks that are read in pairs, of ids out of order, one id twice, strings, and a block of nothing but nulls; the plan deals no vectors."""
    monkeypatch.setattr(regions, "BLOCK", 8)
    monkeypatch.setattr(regions, "STRIP", 3)
    x = np.random.default_rng(2).standard_normal((90, 5))
    ids = [f"v{(k * 37) % 90:02}" for k in range(90)]
    ids[ids.index("v41")] = "v40"
    rows = [(i, r.tolist()) for i, r in zip(ids, x)] + [(f"w{k}", None) for k in range(20)] + [(None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    df = regions.correlations(spark.createDataFrame(rows, "id string, features array<double>").repartition(5), 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    got, ncc = {}, np.corrcoef(x)
    for r in df.collect():
        got.setdefault((r.a, r.b), []).append(r.ncc)
    want = {}
    for i, (a, _) in enumerate(rows[:-1]):
        for j, (b, _) in enumerate(rows[:-1]):
            if a < b:
                want.setdefault((a, b), []).append(ncc[i, j] if max(i, j) < 90 else None)
    key = lambda v: (v is None, v)
    assert got.keys() == want.keys()
    assert all(sorted(got[k], key=key) == (v if None in v else pytest.approx(sorted(v), abs=1e-12)) for k, v in want.items())
