"""Partitions (item_id, cluster_id), their comparison, and clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions import stats as S
from quadrat.operators.components import components
from quadrat.operators.inference import with_tail
from quadrat.operators.points import XYZ, pairs_within
from quadrat.storage import settling, written


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: the non-zero cells."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def matched(cells: DataFrame) -> DataFrame:
    """a, match, tp: each cluster's largest class, ties to the least."""
    best = F.min(F.struct(-F.col("n"), "b"))
    return cells.groupBy("a").agg(best.alias("_m")).select("a", F.col("_m.b").alias("match"), (-F.col("_m.col1")).alias("tp"))


def matched_scores(cells: DataFrame) -> DataFrame:
    """b, tp, fp, fn, precision, recall, f1 of each class, with clusters merged by their match; classes without a match have tp 0."""
    m = cells.join(matched(cells).select("a", "match"), "a")
    tp = m.where("b = match").groupBy("b").agg(F.sum("n").alias("tp"))
    fp = m.where("b <> match").groupBy(F.col("match").alias("b")).agg(F.sum("n").alias("fp"))
    out = cells.groupBy("b").agg(F.sum("n").alias("_all")).join(tp, "b", "left").join(fp, "b", "left").na.fill(0, ["tp", "fp"])
    out = out.select("b", "tp", "fp", (F.col("_all") - F.col("tp")).alias("fn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _sides(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))


def rand_index(cells: DataFrame) -> DataFrame:
    """rand, adjusted."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    na, nb = _sides(cells)
    r = cells.agg(pairs("n").alias("_s"), F.sum("n").alias("_n")).join(na.agg(pairs("na").alias("_a")), F.lit(True)).join(nb.agg(pairs("nb").alias("_b")), F.lit(True))  # single rows
    t, expected = F.col("_n") * (F.col("_n") - 1) / 2, F.col("_a") * F.col("_b") / (F.col("_n") * (F.col("_n") - 1) / 2)
    return r.select(((t + 2 * F.col("_s") - F.col("_a") - F.col("_b")) / t).alias("rand"), ((F.col("_s") - expected) / F.nullif((F.col("_a") + F.col("_b")) / 2 - expected, F.lit(0.0))).alias("adjusted"))


def entropy(sizes: DataFrame, n: str) -> DataFrame:
    """entropy of cluster sizes, in nats."""
    w = F.sum(n)
    return sizes.agg((F.log(w) - F.sum(F.col(n) * F.log(n)) / w).alias("entropy"))


def variation_of_information(cells: DataFrame) -> DataFrame:
    """vi = H(a | b) + H(b | a), mutual: the mutual information."""
    na, nb = _sides(cells)
    h = lambda df, c: df.agg((F.log(F.sum(c)) - F.sum(F.col(c) * F.log(c)) / F.sum(c)).alias(f"_h{c}"))
    r = h(cells, "n").join(h(na, "na"), F.lit(True)).join(h(nb, "nb"), F.lit(True))  # single rows
    return r.select((2 * F.col("_hn") - F.col("_hna") - F.col("_hnb")).alias("vi"), (F.col("_hna") + F.col("_hnb") - F.col("_hn")).alias("mutual"))


def g_test(cells: DataFrame) -> DataFrame:
    """g, dof, p of independence."""
    na, nb = _sides(cells)
    total = F.sum("n").over(W.partitionBy())
    c = cells.join(na, "a").join(nb, "b").withColumn("_t", total)
    out = c.agg((2 * F.sum(F.col("n") * F.log(F.col("n") * F.col("_t") / (F.col("na") * F.col("nb"))))).alias("g"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("dof"))
    return with_tail(out, S.chi2_sf, "g", "dof")


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """cluster, n, fraction."""
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy()))


def centroids(df: DataFrame, keys: Sequence[str], axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, n, and the mean of each axis as c<axis>."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c{c}") for c in axes])


@settling
def single_linkage(points: DataFrame, radius: float, keys: Sequence[str], id_col: str = "part_id", axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, id, cluster (least id): flat single linkage, the components of pairs at most radius apart; each point its own if radius is 0 or less."""
    own = points.select(*keys, F.col(id_col).alias("id"))
    if radius <= 0:
        return own.withColumn("cluster", F.col("id"))
    # Ids may start anew in each key, so a vertex is its keys and id.
    end = lambda p: F.struct(*keys, F.col(f"{p}.{id_col}").alias("id"))
    pairs = pairs_within(points, points, radius, keys, axes).select(end("a").alias("u"), end("b").alias("v")).where("u < v")
    roots = components(pairs).select(*[F.col(f"u.{k}").alias(k) for k in [*keys, "id"]], F.col("root.id").alias("cluster"))
    return own.join(roots, [*keys, "id"], "left").select(*keys, "id", F.coalesce("cluster", "id").alias("cluster"))


@settling
def dbscan(points: DataFrame, eps: float, least: int, keys: Sequence[str], id_col: str = "part_id", axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, id, cluster (least core id of it; -1 is noise). A point is core with that many points, itself too, at most eps away;
    a border point goes to the cluster of its nearest core, ties to the smaller id."""
    pairs = pairs_within(points, points, eps, keys, axes).select(*keys, F.col(f"a.{id_col}").alias("id"), F.col(f"b.{id_col}").alias("other"), "dist")
    own, far = [*keys, "id"], [*keys, "other"]
    core = pairs.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*own)
    near = pairs.join(core.withColumnRenamed("id", "other"), far, "left_semi")
    links = near.join(core, own, "left_semi").where("id < other").select(F.struct(*own).alias("u"), F.struct(*keys, F.col("other").alias("id")).alias("v"))
    roots = components(links).select(*[F.col(f"u.{k}").alias(k) for k in own], F.col("root.id").alias("root"))
    roots = core.join(roots, own, "left").select(*keys, F.col("id").alias("other"), F.coalesce("root", "id").alias("cluster"))
    nearest = near.groupBy(*own).agg(F.min(F.struct("dist", "other")).alias("_b")).select(*own, F.col("_b.other").alias("other")).join(roots, far).select(*own, "cluster")
    return points.select(*keys, F.col(id_col).alias("id")).join(nearest, own, "left").select(*own, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


MOST = 5000  # rows of a group that one task takes with an n x n matrix


def _per_group(df: DataFrame, keys: Sequence[str], run, schema: str) -> DataFrame:
    """run on each key's rows, at most MOST of them; raises otherwise."""
    if not df.groupBy(*keys).count().where(F.col("count") > MOST).isEmpty():
        raise ValueError(f"a group has more than {MOST} rows, which one task would hold as a matrix")
    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *[x.split()[0] for x in schema.split(", ")]]]

    return df.groupBy(*keys).applyInPandas(one, f"{head}, {schema}")


def mean_shift(points: DataFrame, bandwidth: float, keys: Sequence[str], rounds: int = 100, id_col: str = "part_id", axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, id, cluster: flat-kernel mean shift of each key's points (a tomogram's, which fit a task); modes closer than the bandwidth are one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        x = pdf[list(axes)].to_numpy(float)
        m = x.copy()
        for _ in range(rounds):
            new = np.array([x[((x - p) ** 2).sum(1) <= bandwidth**2].mean(0) for p in m])
            moved = np.abs(new - m).max()
            m = new
            if moved < 1e-9:
                break
        ids, out, modes = pdf[id_col].to_numpy(), [], []
        for p, i in zip(m, ids):
            hit = next((c for q, c in modes if ((q - p) ** 2).sum() < bandwidth**2), None)
            if hit is None:
                modes.append((p, hit := i))
            out.append(hit)
        return pd.DataFrame({"id": ids, "cluster": out})

    return _per_group(points, keys, run, "id long, cluster long")


def exemplars(s: np.ndarray, preference: float | None = None, damping: float = 0.9, rounds: int = 400) -> np.ndarray:
    """Each row's exemplar, by message passing on similarities s; preference (by default the median) goes on the diagonal. Ties to the smaller row."""
    s = s.astype(float).copy()
    n = len(s)
    if n > 1:
        np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if preference is None else preference)
    s -= np.arange(n)[None] * 1e-12 * max(1.0, np.abs(s).max())
    r, a, at = np.zeros((n, n)), np.zeros((n, n)), np.arange(n)
    for _ in range(rounds):
        t = a + s
        best = t.argmax(1)
        first = t[at, best].copy()
        t[at, best] = -np.inf
        new = s - first[:, None]
        new[at, best] = s[at, best] - (t.max(1) if n > 1 else 0)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[at, at] = r[at, at]
        new = p.sum(0)[None] - p
        own = new[at, at].copy()
        new = np.minimum(new, 0)
        new[at, at] = own
        a = damping * a + (1 - damping) * new
    centre = np.flatnonzero((a + r)[at, at] > 0)
    centre = centre if len(centre) else np.array([int((a + r)[at, at].argmax())])
    pick = centre[s[:, centre].argmax(1)]
    pick[centre] = centre
    return pick


def affinity_propagation(points: DataFrame, keys: Sequence[str], preference: float | None = None, damping: float = 0.9, rounds: int = 400, id_col: str = "part_id", axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, id, exemplar: message passing on negative squared distances of each key's points (MOST at most); preference: by default the median."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        x, ids = pdf[list(axes)].to_numpy(float), pdf[id_col].to_numpy()
        return pd.DataFrame({"id": ids, "exemplar": ids[exemplars(-((x[:, None] - x[None]) ** 2).sum(2), preference, damping, rounds)]})

    return _per_group(points, keys, run, "id long, exemplar long")


@settling
def affinity_by_subsets(points: DataFrame, keys: Sequence[str], subsets: int, preference: float | None = None, id_col: str = "part_id", axes: Sequence[str] = XYZ, seed: int = 0) -> DataFrame:
    """keys, id, exemplar: affinity propagation in subsets (by hash), then among the subsets' exemplars, and each point to the
    nearest of the last ones: for keys whose points are too many for one matrix."""
    from quadrat.operators.points import knn

    dealt = points.withColumn("_s", F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(subsets)))
    first = affinity_propagation(dealt, [*keys, "_s"], preference, id_col=id_col, axes=axes).select(*keys, F.col("exemplar").alias(id_col)).distinct()
    centres = points.join(written(first), [*keys, id_col], "left_semi")
    last = written(affinity_propagation(centres, keys, preference, id_col=id_col, axes=axes).select(*keys, F.col("exemplar").alias(id_col)).distinct())
    near = knn(points, points.join(last, [*keys, id_col], "left_semi"), 1, keys, id_col, id_col, axes)
    return near.select(*keys, "id", F.col("other").alias("exemplar"))


def _merges(x: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """(kept, joined, height) of hierarchical clustering, n - 1 of them, by rows."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(n), []
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        height = float(d[i, j])
        a, b, k = size[i], size[j], size
        with np.errstate(invalid="ignore"):
            row = {
                "single": lambda: np.minimum(d[i], d[j]),
                "complete": lambda: np.maximum(d[i], d[j]),
                "average": lambda: (a * d[i] + b * d[j]) / (a + b),
                "ward": lambda: np.sqrt(np.maximum(((a + k) * d[i] ** 2 + (b + k) * d[j] ** 2 - k * height**2) / (a + b + k), 0)),
            }[method]()
        row[[i, j]] = np.inf
        row[np.isinf(d[i]) | np.isinf(d[j])] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        out.append((i, j, height))
    return out


def agglomerative(points: DataFrame, keys: Sequence[str], cut: float | None = None, method: str = "average", id_col: str = "part_id", axes: Sequence[str] = XYZ, n: int | None = None) -> DataFrame:
    """keys, id, cluster: hierarchical clustering (single, complete, average, ward) of each key's points (MOST at most), cut at a distance or at n clusters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        ids, root = pdf[id_col].to_numpy(), np.arange(len(pdf))
        for k, (i, j, height) in enumerate(_merges(pdf[list(axes)].to_numpy(float), method)):
            if (n is not None and len(pdf) - k <= n) or (cut is not None and height > cut):
                break
            root[root == j] = i
        return pd.DataFrame({"id": ids, "cluster": ids[root]})

    return _per_group(points, keys, run, "id long, cluster long")


def cophenetic(points: DataFrame, keys: Sequence[str], method: str = "average", id_col: str = "part_id", axes: Sequence[str] = XYZ) -> DataFrame:
    """keys, n, correlation of the points' distances (MOST points at most) with the heights at which they come together; null below three points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(id_col)[list(axes)].to_numpy(float)
        root, height = np.arange(len(x)), np.zeros((len(x), len(x)))
        for i, j, h in _merges(x, method):
            a, b = np.flatnonzero(root == i), np.flatnonzero(root == j)
            height[np.ix_(a, b)] = height[np.ix_(b, a)] = h
            root[b] = i
        up = np.triu_indices(len(x), 1)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        return pd.DataFrame({"n": [len(x)], "correlation": [float(np.corrcoef(d[up], height[up])[0, 1]) if len(x) > 2 else None]})

    return _per_group(points, keys, run, "n long, correlation double")


def kmeans(vectors: DataFrame, k: int, column: str = "features", seed: int = 1) -> DataFrame:
    """vectors with prediction (MLlib, seeded). column: array<double>."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.withColumn("_v", array_to_vector(column))
    return KMeans(k=k, seed=seed, featuresCol="_v").fit(v).transform(v).drop("_v")


def pca(vectors: DataFrame, k: int, column: str = "features") -> DataFrame:
    """vectors with projected (MLlib)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.withColumn("_v", array_to_vector(column))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("projected", vector_to_array("_p")).drop("_v", "_p")


def normalised_dot(a, b):
    """Normalised cross-correlation of two arrays: of their deviations from their means."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    centred = lambda x: F.transform(F.array(mean(x)), lambda m: F.transform(x, lambda v: v - m))[0]
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.transform(F.array(F.struct(centred(a).alias("a"), centred(b).alias("b"))), lambda z: dot(z["a"], z["b"]) / F.sqrt(dot(z["a"], z["a"]) * dot(z["b"], z["b"])))[0]


def assign_exemplars(vectors: DataFrame, exemplars: DataFrame, id_col: str, column: str) -> DataFrame:
    """id, exemplar, ncc: the exemplar (id, column; a table of at most some thousands, which is checked) with the largest correlation, ties to the smaller id."""
    if exemplars.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 exemplars")
    e = exemplars.select(F.col(id_col).alias("exemplar"), F.col(column).alias("_e"))
    table = e.agg(F.array_sort(F.collect_list(F.struct("exemplar", "_e"))).alias("_t"))
    scored = vectors.join(F.broadcast(table), F.lit(True)).select(F.col(id_col).alias("id"), F.transform("_t", lambda t: F.struct((-normalised_dot(F.col(column), t["_e"])).alias("s"), t["exemplar"].alias("e"))).alias("_s"))
    return scored.select("id", F.array_min("_s").alias("_b")).select("id", F.col("_b.e").alias("exemplar"), (-F.col("_b.s")).alias("ncc"))


def class_averages(vectors: DataFrame, klass: str, column: str = "features") -> DataFrame:
    """class, n, average: the mean of each element over the class's vectors."""
    e = vectors.select(klass, F.posexplode(column).alias("_k", "_v")).groupBy(klass, "_k").agg(F.avg("_v").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return e.groupBy(klass).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda r: r["_m"]).alias("average"))


def exemplar_statistics(vectors: DataFrame, klass: str, exemplars: DataFrame, column: str = "features", p: float = 5.0) -> DataFrame:
    """class, n, mean, std, low (the p-th percentile): correlations of each class's vectors with its exemplar (class, exemplar)."""
    c = vectors.join(exemplars.select(klass, F.col("exemplar").alias("_e")), klass).withColumn("_c", normalised_dot(F.col(column), F.col("_e")))
    return c.groupBy(klass).agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("mean"), F.stddev_samp("_c").alias("std"), F.percentile("_c", p / 100).alias("low"))
