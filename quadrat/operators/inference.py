"""Hypothesis tests and correlations. The statistics are grouped aggregations; only their few rows meet Python, for the tails."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions import stats as S
from quadrat.storage import written


def with_tail(df: DataFrame, tail, *columns: str, to: str = "p") -> DataFrame:
    """df with tail(*columns) as p: an Arrow-batched call on aggregated rows."""

    @F.pandas_udf("double")
    def p(*xs: pd.Series) -> pd.Series:
        return pd.Series([tail(*v) if all(pd.notna(x) for x in v) else None for v in zip(*xs)], dtype="float64")

    return df.withColumn(to, p(*[F.col(c).cast("double") for c in columns]))


def mid_ranks(df: DataFrame, value: str) -> DataFrame:
    """df with rank (mean rank of equal values) and ties (how many are equal). Ranked over the distinct values' running counts."""
    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("ties"))
    # Written, since ranges are drawn from samples: a second run of the exchange may cut them elsewhere.
    parts = written(n.repartitionByRange(F.col(value)).withColumn("_p", F.spark_partition_id()))
    base = parts.groupBy("_p").agg(F.sum("ties").alias("_n"))
    base = base.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_base"))  # a row for each range
    below = F.sum("ties").over(W.partitionBy("_p").orderBy(value)) - F.col("ties")
    ranked = parts.withColumn("_below", below).join(F.broadcast(base), "_p").select(value, "ties", (F.col("_base") + F.col("_below") + (F.col("ties") + 1) / 2).alias("rank"))
    return df.join(ranked, value)


def t_independent(df: DataFrame, group: str, value: str, reference) -> DataFrame:
    """group, t, dof, p of each group against the reference group: equal variances."""
    s = df.groupBy(group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    r = s.where(F.col(group) == reference).select(F.col("m").alias("m0"), F.col("v").alias("v0"), F.col("n").alias("n0"))
    both = s.where(F.col(group) != reference).join(F.broadcast(r), F.lit(True))  # r is one row
    dof = F.col("n") + F.col("n0") - 2
    pooled = ((F.col("n") - 1) * F.col("v") + (F.col("n0") - 1) * F.col("v0")) / dof
    out = both.select(group, ((F.col("m") - F.col("m0")) / F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("n0")))).alias("t"), dof.alias("dof"))
    return with_tail(out, S.t_two_sided, "t", "dof")


def t_related(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Paired test of two columns."""
    d = F.col(a) - F.col(b)
    s = df.groupBy(*keys).agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.count(d).alias("n"))
    return with_tail(s.select(*keys, (F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("dof")), S.t_two_sided, "t", "dof")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """h (corrected for ties), dof, p over all groups."""
    r = mid_ranks(df, value)
    per = r.groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("k"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    n = F.sum("k")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("k")) - 3 * (n + 1)
    out = per.agg((h / (1 - F.sum("t") / (n * n * n - n))).alias("h"), (F.count(F.lit(1)) - 1).alias("dof"))
    return with_tail(out, S.chi2_sf, "h", "dof")


def mann_whitney(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """u of group a, z (normal, ties and continuity corrected), p two-sided."""
    r = mid_ranks(df.where(F.col(group).isin([a, b])), value)
    is_a = F.col(group) == a
    s = r.agg(F.sum(F.when(is_a, F.col("rank"))).alias("r"), F.count_if(is_a).alias("na"), F.count_if(~is_a).alias("nb"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    u = F.col("r") - F.col("na") * (F.col("na") + 1) / 2
    n = F.col("na") + F.col("nb")
    sd = F.sqrt(F.col("na") * F.col("nb") / 12.0 * (n + 1 - F.col("t") / (n * (n - 1))))
    mean = F.col("na") * F.col("nb") / 2.0
    out = s.select(u.alias("u"), (F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)) / sd).alias("z"))
    return with_tail(out, S.normal_two_sided, "z")


def chi2_two_sample(counts: DataFrame, bin_: str, a: str, b: str, yates: bool = False) -> DataFrame:
    """chi2, dof (bins - 1), p for two columns of counts."""
    n = counts.agg(F.sum(a).alias("_a"), F.sum(b).alias("_b"))
    d = F.col(a) * F.col("_b") - F.col(b) * F.col("_a")
    d = F.greatest(F.abs(d) - F.lit(0.5) * (F.col("_a") + F.col("_b")), F.lit(0.0)) if yates else d.cast("double")
    rows = counts.join(F.broadcast(n), F.lit(True)).where(F.col(a) + F.col(b) > 0)  # n is one row
    out = rows.agg((F.sum(d * d / (F.col(a) + F.col(b))) / F.nullif(F.first("_a") * F.first("_b") * F.lit(1.0), F.lit(0.0))).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))
    return with_tail(out, S.chi2_sf, "chi2", "dof")


def pearson(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """r, slope, intercept, n and p of the regression of b on a."""
    out = df.groupBy(*keys).agg(F.corr(a, b).alias("r"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_count(b, a).alias("n"))
    t = out.withColumn("_t", F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))).withColumn("_d", F.col("n") - 2)
    return with_tail(t, S.t_two_sided, "_t", "_d").drop("_t", "_d")


def kendall(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """keys, tau (tau-b). Pairs of distinct (a, b) values are counted, so repeats cost nothing; for groups of few thousand values."""
    v = df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("m"))
    x, y = v.alias("x"), v.alias("y")
    # each pair once: ordered by (a, b)
    pairs = x.join(y, list(keys)).where((F.col("x.a") < F.col("y.a")) | ((F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b"))))
    sign = F.signum(F.col("y.a") - F.col("x.a")) * F.signum(F.col("y.b") - F.col("x.b"))
    s = pairs.groupBy(*keys).agg(F.sum(sign * F.col("x.m") * F.col("y.m")).alias("s"))
    n = v.groupBy(*keys).agg(F.sum("m").alias("n"))
    ties = lambda c, to: v.groupBy(*keys, c).agg(F.sum("m").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(to))
    out = n.join(s, list(keys), "left").join(ties("a", "ta"), list(keys)).join(ties("b", "tb"), list(keys))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    return out.select(*keys, (F.coalesce("s", F.lit(0.0)) / F.nullif(F.sqrt((n0 - F.col("ta")) * (n0 - F.col("tb"))), F.lit(0.0))).alias("tau"))
