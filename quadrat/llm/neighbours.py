"""Approximate nearest neighbours by learned partitions.

A sample of vectors (``SAMPLE`` at most, those with about the least hashes) gets its neighbour graph, which is cut into
balanced partitions: recursive halving gives equal parts, and rounds of swaps then move vectors to the parts of most of
their neighbours, one against one, so that parts stay equal. A small network learns where a vector's neighbours lie.
It places every vector of the table in its most probable partition and sends each query to the ``probes`` most probable
ones, as many as held-out sample queries need for a recall of ``RECALL``; there all vectors are reranked exactly.

Partitions grow in number with the table: one for about ``LEAF`` entries, ``PARTS`` at least and ``FAN`` at most. A
partition that still holds more than ``SPLIT`` entries is learned and cut in the same way by itself, from a sample of its
own entries, in a task for each; a query then takes the most probable partitions within each of its partitions. Where
the table is so large that all partitions are cut again, either level's probes are chosen for the root of the recall. So
a query's work follows its probes and LEAF until FAN * FAN partitions (65,536) hold more than LEAF each.

Only the sample, the networks (FAN of some 100 KB each) and counts reach the driver. Vectors that are equal are one
entry of the index with their least TOP + 1 ids, which is all that an answer of TOP can use. Partitions are searched in
blocks of at most about ``BLOCK`` entries and ``BLOCK`` queries; a query that finds fewer than TOP goes through all
partitions in a second pass.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows without an id; of rows that repeat an id, the one with the least vector counts; ties go to the
smaller id; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm import common as C

SAMPLE, PARTS, TOP, RECALL, BLOCK = 8192, 32, 20, 0.96, 16_384
LEAF, FAN, SPLIT = 4096, 256, 16_384
GRAPH, HIDDEN, EPOCHS, ROUNDS = 10, 64, 20, 12
PER_PART = 16


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product."""
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        y = x[s : s + 1024] @ x.T
        y[np.arange(len(y)), np.arange(s, s + len(y))] = -np.inf
        out[s : s + 1024] = np.argpartition(-y, k - 1, axis=1)[:, :k]
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """The part of each row: a balanced partition of the graph that cuts few edges. parts: a power of two."""
    part = np.zeros(len(x), np.int64)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            own = np.flatnonzero(part == p)
            if len(own) < 2:
                continue
            y = x[own] - x[own].mean(0)
            axis = rng.standard_normal(x.shape[1])
            for _ in range(8):  # towards the main axis
                axis = y.T @ (y @ axis)
                axis /= max(np.linalg.norm(axis), 1e-30)
            part[own[np.argsort(y @ axis, kind="stable")[len(own) // 2 :]]] += 1 << level
    n = len(x)
    both = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    of = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    for _ in range(ROUNDS):
        votes = np.zeros((n, parts))
        np.add.at(votes, (of, part[both]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        movers = np.flatnonzero((gain > 0) & (rng.random(n) < 0.7))
        order = movers[np.argsort(-gain[movers], kind="stable")]
        waiting: dict[tuple[int, int], list[int]] = {}
        moved = 0
        for i in order.tolist():
            a, b = int(part[i]), int(want[i])
            if waiting.get((b, a)):  # a swap keeps both sizes
                j = waiting[b, a].pop()
                part[i], part[j] = b, a
                moved += 2
            else:
                waiting.setdefault((a, b), []).append(i)
        if not moved:
            break
    return part


class Router:
    """A network with one hidden layer: the probability of each partition."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator):
        self.w = [rng.standard_normal((dim, HIDDEN)) / np.sqrt(dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """x: vectors; y: the share of each one's neighbours in each partition. Adam on the cross entropy."""
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.tanh(x[own] @ self.w[0] + self.w[1])
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = (p - y[own]) / len(own)
                e = d @ self.w[2].T * (1 - h * h)
                t += 1
                for k, g in enumerate((x[own].T @ e, e.sum(0), h.T @ d, d.sum(0))):
                    g = g + 1e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)


def learned(x: np.ndarray, parts: int = PARTS, top: int = TOP, recall: float = RECALL, seed: int = 7) -> tuple[Router, np.ndarray, int]:
    """(router, scale of its input, probes) from a sample of vectors."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    scale = np.full(dim, max(float(np.sqrt((x * x).mean())), 1e-30))
    parts = max(1, min(parts, 1 << max(0, (n // PER_PART).bit_length() - 1)))
    router = Router(dim, parts, rng)
    if parts == 1:
        return router, scale, 1
    k = min(GRAPH, n - 1)
    near = graph(x, k)
    part = balanced(x, near, parts, rng)
    share = np.zeros((n, parts))
    np.add.at(share, (np.repeat(np.arange(n), k), part[near].ravel()), 1 / (k + 1))
    share[np.arange(n), part] += 1 / (k + 1)
    test = rng.permutation(n)[: max(1, min(n // 5, 1000))]
    train = np.setdiff1d(np.arange(n), test)
    router.fit(x[train] / scale, share[train], rng)
    # Held-out queries against the whole sample, placed as the index will be.
    place = router.scores(x / scale).argmax(1)
    truth = place[graph_of(x, test, min(top, n - 1))]
    rank = np.argsort(np.argsort(-router.scores(x[test] / scale), axis=1), axis=1)
    needed = np.take_along_axis(rank, truth, axis=1)
    probes = next(m for m in range(1, parts + 1) if (needed < m).mean() >= recall)
    return router, scale, probes


def graph_of(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    y = x[rows] @ x.T
    y[np.arange(len(rows)), rows] = -np.inf
    return np.argpartition(-y, k - 1, axis=1)[:, :k]


def _ranked(queries: pd.DataFrame, index: pd.DataFrame, top: int) -> pd.DataFrame:
    """Each query's best top of these entries, with the entries' ids spelt out."""
    out = []
    x = np.array(index["x"].tolist(), np.float64)
    ids = index["ids"].tolist()
    keep = min(len(ids), top + 1)
    for s in range(0, len(queries), 512):
        part = queries.iloc[s : s + 512]
        scores = np.array(part["x"].tolist(), np.float64) @ x.T
        cut = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
        for q, row, limit in zip(part["query_id"], scores, cut):
            best = [(-row[k], i) for k in np.flatnonzero(row >= limit) for i in ids[k] if i != q]
            out += [(q, i, -score) for score, i in sorted(best)[:top]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def searched(index: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """index: part, x, ids; queries: part, query_id, x -> query_id, vec_id, score: the best top over all their parts."""
    count = lambda df: df.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).alias("_n"))
    a, b = count(index).withColumnRenamed("_n", "_a"), count(queries).withColumnRenamed("_n", "_b")
    blocks = F.broadcast(a.join(b, "part"))  # a row for each partition
    left = index.join(blocks, "part").withColumn("_i", F.pmod(F.xxhash64("x"), F.col("_a"))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1))).drop("_a", "_b")
    right = queries.join(blocks, "part").withColumn("_j", F.pmod(F.xxhash64("query_id"), F.col("_b"))).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_a") - 1))).drop("_a", "_b")

    def rank(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _ranked(asked, entries, top) if len(entries) and len(asked) else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    keys = ("part", "_i", "_j")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (array<double>): the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    dim = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("x") == (dim["d"] if dim else 0))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x"))


def _parts(entries: int, parts: int, leaf: int) -> int:
    """A power of two: a partition for about leaf entries."""
    return min(FAN, max(parts, 1 << (max(1, -(-entries // leaf)) - 1).bit_length()))


def _sampled(index: DataFrame, share: Column) -> DataFrame:
    """About that share of index, by the hash of the vector."""
    return index.where(F.pmod(F.xxhash64(F.lit(11), "x"), F.lit(1 << 40)) < share * float(1 << 40))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, parts: int = PARTS, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF, split: int = SPLIT) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: over vec_id."""
    spark = vectors.sparkSession
    rows = C.written(usable(vectors, id_col, vector_col), "neighbour-vectors")
    # Equal vectors: their least ids. The window's limit is applied before the shuffle too.
    least = rows.withColumn("_k", F.row_number().over(W.partitionBy("x").orderBy("vec_id"))).where(F.col("_k") <= top + 1)
    index = C.written(least.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "neighbour-entries")
    entries = index.count()
    if not entries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = C.written(_sampled(index, F.lit(sample / entries)).select("x").orderBy(F.xxhash64("x"), "x").limit(sample), "neighbour-sample").collect() if entries > sample else index.select("x").collect()
    aim = recall**0.5 if entries > split * _parts(entries, parts, leaf) // 2 else recall  # a second level
    router, scale, probes = learned(np.array(sorted(r.x for r in drawn), np.float64), _parts(entries, parts, leaf), top, aim)

    @F.pandas_udf("array<long>")
    def route(x: pd.Series, most: pd.Series) -> pd.Series:
        s = router.scores(np.array(x.tolist(), np.float64) / scale)
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, : int(most.iloc[0])])) if len(x) else pd.Series([], dtype=object)

    index = C.written(index.withColumn("part", route("x", F.lit(1))[0]), "neighbour-index")
    sizes = {r.part: r.n for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    within = _refined(index, {p: n for p, n in sizes.items() if n > split}, top, aim, sample, leaf)

    @F.pandas_udf("array<long>")
    def leaves(x: pd.Series, part: pd.Series, probe: pd.Series) -> pd.Series:
        """part * FAN and the partitions within it: the best one, or as many as are to be searched; or every one (probe 2)."""
        out = pd.Series([[p * FAN] for p in part], dtype=object)
        for p, own in part.groupby(part):
            if p in within:
                inner, by, most = within[p]
                s = inner.scores(np.array(x[own.index].tolist(), np.float64) / by)
                most = (1, most, s.shape[1])[int(probe.iloc[0])]
                for i, row in zip(own.index, np.argsort(-s, axis=1, kind="stable")[:, :most]):
                    out[i] = [p * FAN + int(k) for k in row]
        return out

    lead = lambda df, probe: df.withColumn("part", F.explode(leaves("x", "part", F.lit(probe)))) if within else df.withColumn("part", F.col("part") * FAN)
    index = C.written(lead(index, 0), "neighbour-placed") if within else lead(index, 0)
    asked = C.written(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "x"), "neighbour-queries")
    found = C.written(searched(index, lead(asked.withColumn("part", F.explode(route("x", F.lit(probes)))), 1), top), "neighbour-found")
    if probes == len(router.w[3]) and not within:
        return found
    short = asked.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id", "left").where(F.coalesce("_n", F.lit(0)) < top).select("query_id", "x")
    again = C.written(searched(index, lead(short.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(router.w[3]) - 1).cast("long")))), 2), top), "neighbour-again")
    return found.join(short.select("query_id"), "query_id", "left_anti").unionAll(again)


def _refined(index: DataFrame, sizes: dict[int, int], top: int, recall: float, sample: int, leaf: int) -> dict[int, tuple[Router, np.ndarray, int]]:
    """What is learned within each of these partitions (sizes: their entries), a task for each: router, scale, probes."""
    if not sizes:
        return {}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        router, scale, probes = learned(np.array(sorted(map(list, rows["x"]))[:sample], np.float64), _parts(sizes[part], 2, leaf), top, recall)
        router.w = [w.astype(np.float32) for w in router.w]
        return pd.DataFrame({"part": [part], "model": [pickle.dumps((router, scale, probes))]})

    shares = F.create_map(*[F.lit(v) for p, n in sizes.items() for v in (p, min(1.0, sample / n))])
    drawn = _sampled(index.where(F.col("part").isin(list(sizes))), shares[F.col("part")])
    return {r.part: pickle.loads(r.model) for r in C.written(drawn.groupBy("part").applyInPandas(fit, "part long, model binary"), "neighbour-routers").collect()}


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    return C.settled(lambda: nearest(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0), "op3")
