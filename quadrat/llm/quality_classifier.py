"""Quality classifier with hierarchical empirical Bayes.

A logistic model over a few text measurements gives each document's own evidence. Hosts and paths get posteriors: the
mean evidence of their documents, shrunk toward the level above (path to host, host to all) as if that level had added
``kappa`` documents; kappa comes from the data by moments (spread between sites beyond what their sizes explain), so
sparse sites stay near the prior. A document's posterior log odds are its own evidence plus its path's shift against
the base rate. All of it is grouped aggregation with map-side sums: a hot host is a row a task.

The model is fitted on the driver to at most ``SAMPLE`` labelled ids (those with about the least hashes; of rows that share
one, the least measurements count); every other number covers all rows. Features and scores are JVM expressions.

Defined results: null texts measure as empty; null hosts and paths are sites of their own; without labels of both
classes every document's own evidence is 1/2; rows that repeat count each for itself; an empty table gives no rows;
very long texts are measured whole; other columns are passed over by ``classify`` and kept by ``accepted``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import common as C

SAMPLE, THRESHOLD, RIDGE, KAPPA_MAX = 20_000, 0.5, 1.0, 1e6
MAX_BROADCAST = 100_000
FEATURES = ("log_words", "symbols", "bars", "capitals", "exclamations", "repeats", "distinct", "word_length", "digits", "repeated_lines")


def features(text: Column) -> Column:
    """The measurements, in FEATURES' order, as array<double>."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        grams = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        share = lambda a: C.let(a, lambda g: 1 - F.size(F.array_distinct(g)) / F.greatest(F.size(g), F.lit(1)))
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(C.SPACE)) != "")
        values = (
            F.log1p(F.size(w)), C.count_of(text, "#*$%&<>") / n, C.count_of(text, "|") / n, F.regexp_count(text, F.lit(r"\p{Lu}{2}")) / n, C.count_of(text, "!") / n,
            F.when(F.size(w) < 3, F.lit(0.0)).otherwise(share(grams)), 1 - share(w), (F.length(text) - C.count_of(text, C.SPACE)) / n, C.count_of(text, "0123456789") / n,
            F.when(F.trim(text) == "", F.lit(0.0)).otherwise(share(lines)),
        )
        return F.array(*[v.cast("double") for v in values])

    return C.let(C.words(text), of)


@dataclass(frozen=True)
class Model:
    """Weights over standardised features. base: share of good rows among those it was fitted to."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    base: float

    def log_odds(self, x: Column) -> Column:
        terms = [(F.get(x, F.lit(i)) - m) / s * w for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights))]
        return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), sum(terms, F.lit(self.bias))))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps."""
    k = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return Model((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0, 0.5)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.c_[np.clip((x - mean) / scale, -20, 20), np.ones(len(x))]
    w, ridge = np.zeros(k + 1), np.diag([RIDGE] * k + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:k].tolist()), float(w[k]), float(np.clip(y.mean(), 0.01, 0.99)))


def trained(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """measured: id, x. labels: doc_id, quality."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("double").alias("y"))
    n = known.count()
    # Drawn by hash before any join: no partition holds much more than its share, and the limit only cuts what chance adds.
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    drawn = known.where(place < math.ceil((1 << 40) * min(1.0, 0.95 * sample / max(1, n)))) if n > sample else known
    drawn = C.written(drawn.orderBy(place, "id").limit(sample), "quality-labels")
    rows = measured.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    rows = C.written(rows, "quality-sample").toPandas().sort_values("id")
    return fit(np.array(rows.x.tolist(), float).reshape(-1, len(FEATURES)), rows.y.to_numpy(float))


def kappa(sites: DataFrame, mean: str) -> float:
    """By moments: how many documents the level above counts for. sites: n, total (sum of evidence), and the mean above."""
    m, within = F.col("total") / F.col("n"), F.col(mean) * (1 - F.col(mean))
    r = sites.agg(F.sum(F.col("n") * (m - F.col(mean)) ** 2).alias("spread"), F.sum(within).alias("chance"), F.sum(F.col("n")).alias("n"), F.avg(within).alias("v")).first()
    if not r.n or r.v is None:
        return 1.0
    between = (r.spread - r.chance) / r.n
    return KAPPA_MAX if between <= r.v / KAPPA_MAX else max(1.0, r.v / between - 1)


def posteriors(evidence: DataFrame) -> DataFrame:
    """Of (host, path, p) rows, a row for each path: host, path, n, host_quality, path_quality (posterior means)."""
    paths = C.written(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    r = paths.agg(F.sum("total").alias("t"), F.sum("n").alias("n")).first()
    mu = r.t / r.n if r.n else 0.5
    mu = min(max(mu, 1e-4), 1 - 1e-4)
    k = kappa(hosts.withColumn("_mu", F.lit(mu)), "_mu")
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("total") + k * mu) / (F.col("n") + k)).alias("host_quality"))
    own = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    k = kappa(own, "host_quality")
    return own.select("host", "path", "n", "host_quality", ((F.col("total") + k * F.col("host_quality")) / (F.col("n") + k)).alias("path_quality"))


def _evidence(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str, text_col: str, *more: Column) -> tuple[DataFrame, Model, DataFrame]:
    """(measured documents, the model, the sites' posteriors)."""
    measured = C.written(docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), features(F.col(text_col)).alias("x"), *more), "quality-features")
    model = trained(measured, labels)
    sites = C.written(posteriors(measured.select("host", "path", _sigmoid(model.log_odds(F.col("x"))).alias("p"))), "quality-sites")
    few = sites.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    sites = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("host_quality").alias("_hq"), F.col("path_quality").alias("_pq"))
    return measured, model, F.broadcast(sites) if few else sites


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _judged(rows: DataFrame, model: Model, sites: DataFrame, x: Column, threshold: float) -> DataFrame:
    """rows (with host and path) and q: struct of p_document, host_quality, path_quality, posterior, kept."""
    odds = lambda p: F.log(p / (1 - p))
    own = rows.withColumn("_z", model.log_odds(x)).join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    posterior = _sigmoid(F.col("_z") + odds(F.least(F.greatest("_pq", F.lit(1e-4)), F.lit(1 - 1e-4))) - odds(F.lit(model.base)))
    return own.withColumn("q", F.struct(_sigmoid(F.col("_z")).alias("p_document"), F.col("_hq").alias("host_quality"), F.col("_pq").alias("path_quality"), posterior.alias("posterior"), (posterior >= threshold).alias("kept")))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, p_document, host_quality, path_quality, posterior, kept: a row for each document."""
    measured, model, sites = _evidence(docs, labels, host, path, id_col, text_col)
    return _judged(measured, model, sites, F.col("x"), threshold).select(F.col("id").alias(id_col), "q.*")


def accepted(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns, which go along with their measurements."""
    measured, model, sites = _evidence(docs, labels, host, path, id_col, text_col, F.struct(*docs.columns).alias("row"))
    return _judged(measured, model, sites, F.col("x"), threshold).where("q.kept").select("row.*")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Hosts are the sources, and a source's languages its paths."""
    return C.settled(lambda: classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), F.col("source"), F.col("lang")), "op10")
