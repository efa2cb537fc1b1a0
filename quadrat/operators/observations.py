"""Grouped observations: group -> experiment -> scalar or indexed (array) properties; pooling, histograms, statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.operators.tables import bins


def _field(structs: str, name: str) -> Column:
    return F.transform(structs, lambda s: s[name])


def long_form(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Indexed properties as rows: keys, pos (from 0) and one column for each array."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_z")).select(*keys, F.col("pos").cast("long").alias("pos"), *[F.col(f"_z.{a}").alias(a) for a in arrays])


def nested_form(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Rows as indexed properties, in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("_s")).select(*keys, *[_field("_s", v).alias(v) for v in (order, *values)])


def value_of(df: DataFrame, identifier, name: str, id_: int | None = None) -> DataFrame:
    """One scalar, or the element of an indexed property whose id is id_."""
    one = df.where(F.col("identifier") == identifier)
    return one.select(name) if id_ is None else one.select(F.element_at(name, F.array_position("ids", id_).cast("int")).alias(name))


def by_new_ids(df: DataFrame, ids: DataFrame, key: str, value: str, default: float = -1.0) -> DataFrame:
    """ids with each one's value, and the default where it has none."""
    return ids.join(df.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def stats(df: DataFrame, keys: Sequence[str], value: str, ddof: int = 1) -> DataFrame:
    """keys, mean, std, n, sem; NaN and null are left out, std and sem are null unless n > ddof."""
    v = F.when(~F.isnan(value), F.col(value))
    n, std = F.count(v), (F.stddev_samp(v) if ddof == 1 else F.stddev_pop(v))
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"), std.alias("_s"), n.alias("n"))
    std = F.when(F.col("n") > ddof, F.col("_s"))
    return out.select(*keys, "mean", std.alias("std"), "n", (std / F.sqrt("n")).alias("sem"))


def stats_by_index(df: DataFrame, keys: Sequence[str], array: str, ddof: int = 1) -> DataFrame:
    """Statistics of each array position over the experiments."""
    return stats(long_form(df, keys, [array]), [*keys, "pos"], array, ddof)


def histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """keys, bin, n, probability for every bin; values outside the edges are passed over."""
    got = df.withColumn("bin", bins(F.col(value), edges).cast("long")).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(edges) - 2).cast("long"))))
    out = every.join(got, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(*keys))
    return out.withColumn("probability", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def fraction_of_bin(hist: DataFrame, keys: Sequence[str], bin_: int) -> DataFrame:
    return hist.where(F.col("bin") == bin_).select(*keys, F.col("probability").alias("fraction"))


def pooled(df: DataFrame, group: str, identifier: str, value: str, mode: str, edges: Sequence[float] | None = None) -> DataFrame:
    """Experiments of a group as one. join: all values; mean: each experiment's mean; mean_bin: each one's share of every bin."""
    if mode == "join":
        return df.select(group, identifier, value)
    if mode == "mean":
        return df.groupBy(group, identifier).agg(F.avg(value).alias(value))
    return histogram(df, [group, identifier], value, edges).select(group, identifier, "bin", F.col("probability").alias(value))


def pooled_stats(df: DataFrame, group: str, identifier: str, value: str, mode: str, edges: Sequence[float] | None = None) -> DataFrame:
    return stats(pooled(df, group, identifier, value, mode, edges), [group, *["bin"] * (mode == "mean_bin")], value)


def count_histogram(df: DataFrame, group: str, identifier: str) -> DataFrame:
    """n by group and identifier, total over the groups that have the identifier, fraction."""
    out = df.groupBy(group, identifier).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(identifier))
    return out.withColumn("total", total).withColumn("fraction", F.col("n") / F.col("total"))


def split_by_bins(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    return df.withColumn("bin", bins(F.col(value), edges)).where("bin IS NOT NULL")


def extract(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def extract_indexed(df: DataFrame, arrays: Sequence[str], condition) -> DataFrame:
    """Elements of the arrays that meet condition(element struct), in place."""
    kept = df.withColumn("_z", F.filter(F.arrays_zip(*arrays), condition))
    return kept.withColumns({a: _field("_z", a) for a in arrays}).drop("_z")


def element_counts(df: DataFrame, ids: str = "ids", layer: Column | None = None, factor: float = 1.0, inverse: bool = False) -> Column:
    """Elements, per layer area if layer is given."""
    n = F.size(ids) if layer is None else F.size(ids) / (layer * factor)
    return 1 / n if inverse else n


def n_positive(array: str) -> Column:
    return F.size(F.filter(array, lambda x: x > 0))


def extremes(df: DataFrame, array: str) -> DataFrame:
    return df.agg(F.max(F.array_max(array)).alias("max"), F.min(F.array_min(array)).alias("min"))


def rebinned(df: DataFrame, keys: Sequence[str], array: str, edges: Sequence[float]) -> DataFrame:
    """Histogram arrays (bin k covers k to k + 1) summed into other bins; a bin that an edge cuts counts by the part inside."""
    rows = df.select(*keys, F.posexplode(array).alias("pos", "_v"))
    parts = [F.struct(F.lit(k).cast("long").alias("bin"), F.greatest(F.lit(0.0), F.least(F.col("pos") + 1.0, F.lit(float(b))) - F.greatest(F.col("pos") + 0.0, F.lit(float(a)))).alias("w")) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    out = rows.select(*keys, "_v", F.inline(F.array(*parts)))
    return out.groupBy(*keys, "bin").agg(F.sum(F.col("_v") * F.col("w")).alias("value"))


def normalised(df: DataFrame, keys: Sequence[str], value: str, mode: str = "relative", reference: DataFrame | None = None) -> DataFrame:
    """absolute: v - m; relative: (v - m) / m; 0to1: (v - low) / (high - low). reference: keys, m (or low, high); by default each key's own."""
    if reference is None:
        reference = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.min(value).alias("low"), F.max(value).alias("high"))
    out, v = df.join(reference, list(keys)), F.col(value)
    result = {"absolute": lambda: v - F.col("m"), "relative": lambda: (v - F.col("m")) / F.col("m"), "0to1": lambda: (v - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))}[mode]()
    return out.withColumn("normalised", result).drop("m", "low", "high")


def between_references(df: DataFrame, low: Column, high: Column, fraction: float) -> DataFrame:
    return df.withColumn("level", low + fraction * (high - low))


def pool_categories(df: DataFrame, group: str, categories: Sequence, name) -> DataFrame:
    """df and its rows of the categories once more under the new name."""
    return df.unionByName(df.where(F.col(group).isin(list(categories))).withColumn(group, F.lit(name)))


def transposed(df: DataFrame, group: str, identifier: str) -> DataFrame:
    """Groups become identifiers and the reverse. Raises unless all groups have the same identifiers."""
    a = df.select(group, identifier).distinct()
    r = a.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("g"), F.countDistinct(identifier).alias("i")).first()
    if r.n != r.g * r.i:
        raise ValueError("the groups' identifiers differ")
    return df.withColumns({group: F.col(identifier), identifier: F.col(group)})


def regrouped(df: DataFrame, group: str, by: str) -> DataFrame:
    return df.withColumn(group, F.col(by))


def joined_lists(groups: Mapping[str, DataFrame]) -> DataFrame:
    """Groups of several lists as one table, with list_name."""
    out = None
    for name, df in groups.items():
        df = df.withColumn("list_name", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def add_data(df: DataFrame, source: DataFrame, names: Sequence[str], key: str = "identifier") -> DataFrame:
    return df.join(source.select(key, *names), key, "left")


def converted(df: DataFrame, value: str, factor: Column, power: int = 1) -> DataFrame:
    """A length (power 1), area (2) or volume (3) in other units; arrays element by element."""
    f = F.pow(factor, F.lit(power))
    is_array = df.schema[value].dataType.simpleString().startswith("array")
    return df.withColumn(value, F.transform(value, lambda v: v * f) if is_array else F.col(value) * f)


def weighted_variance(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    w, v = F.col(weight), F.col(value)
    out = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * v).alias("_s"), F.sum(w * v * v).alias("_q"))
    m = F.col("_s") / F.col("_w")
    return out.select(*keys, m.alias("mean"), (F.col("_q") / F.col("_w") - m * m).alias("variance"))


def scalar_form(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys and the scalar properties among names (arrays are left out)."""
    return df.select(*keys, *[n for n in names if not df.schema[n].dataType.simpleString().startswith("array")])


def relabelled(df: DataFrame, id_col: str, shift: int = 0, mapping: DataFrame | None = None) -> DataFrame:
    """Ids shifted, or taken from a (id, new_id) table; ids that it lacks are left out. 0 is background and stays."""
    if mapping is None:
        return df.withColumn(id_col, F.when(F.col(id_col) == 0, F.col(id_col)).otherwise(F.col(id_col) + shift))
    return df.join(mapping.select(F.col("id").alias(id_col), "new_id"), id_col).withColumn(id_col, F.col("new_id")).drop("new_id")


#: Units: which properties of a domain are lengths (1), areas (2) or volumes (3).
POWERS = {"length": 1, "distance": 1, "radius": 1, "mean_distance": 1, "surface": 2, "area": 2, "volume": 3}


def in_nm(df: DataFrame, pixel: Column, powers: Mapping[str, int] = POWERS) -> DataFrame:
    """df with <name>_nm (and, by its power, _nm2 or _nm3 in value) for each property of a domain that has a unit."""
    for name in [c for c in df.columns if c in powers]:
        df = converted(df.withColumn(f"{name}_nm", F.col(name)), f"{name}_nm", pixel, powers[name])
    return df


def derived(df: DataFrame, radius: str | None = None, surface: str | None = None, volume: str | None = None, length: str | None = None) -> DataFrame:
    """df with sphere_surface and sphere_volume of a radius, surface_to_volume, and cross_section (volume over length)."""
    turn = 4 * 3.141592653589793
    out = {}
    if radius:
        r = F.col(radius)
        out |= {"sphere_surface": turn * r * r, "sphere_volume": turn / 3 * r * r * r}
    if surface and volume:
        out["surface_to_volume"] = F.col(surface) / F.nullif(F.col(volume), F.lit(0.0))
    if volume and length:
        out["cross_section"] = F.col(volume) / F.nullif(F.col(length), F.lit(0.0))
    return df.withColumns(out)


def split_by_position(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """A table for each array position: rows of long_form under ``pos``."""
    return long_form(df, keys, arrays)


def add_experiment(df: DataFrame, experiment: DataFrame) -> DataFrame:
    """df and another experiment's rows; properties that one of them lacks are null."""
    return df.unionByName(experiment, allowMissingColumns=True)


def merged_features(old: DataFrame, new: DataFrame, ids: str, names: Sequence[str], mode: str = "replace", totals: str = "add") -> DataFrame:
    """Feature tables as one. mode: replace (new values where there are some) or add (sums). Row 0 holds totals: replace, or add them up."""
    a, b = old.select(ids, *names), new.select(ids, *[F.col(n).alias(f"_{n}") for n in names])
    both = a.join(b, ids, "full")
    add = lambda n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_{n}"), F.lit(0))
    swap = lambda n: F.coalesce(F.col(f"_{n}"), F.col(n))
    pick = {"add": add, "replace": swap}
    return both.select(ids, *[F.when(F.col(ids) == 0, pick[totals](n)).otherwise(pick[mode](n)).alias(n) for n in names])


def extreme_per_cluster(items: DataFrame, cluster: str, distance: str, id_col: str, mode: str = "min") -> DataFrame:
    """cluster, id, distance of each cluster's nearest (or farthest) item; ties to the smaller id."""
    sign = 1 if mode == "min" else -1
    return items.groupBy(cluster).agg(F.min(F.struct((sign * F.col(distance)).alias("d"), F.col(id_col).alias("id"))).alias("_m")).select(cluster, F.col("_m.id").alias(id_col), (sign * F.col("_m.d")).alias(distance))


def order_by_values(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """id, place: segments in falling order of a value, from 1; ties by id."""
    from quadrat.operators.tables import numbered

    return numbered(df.select(id_col, value), F.col(value).desc(), F.col(id_col), to="_k").select(id_col, (F.col("_k") + 1).alias("place"))


def applied(df: DataFrame, name: str, f, to: str) -> DataFrame:
    """A function of a property, scalar or indexed: f is a column expression of one value."""
    indexed = df.schema[name].dataType.simpleString().startswith("array")
    return df.withColumn(to, F.transform(name, f) if indexed else f(F.col(name)))


#: Aggregates by name; more may be added.
AGGREGATES: dict[str, object] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5), "std": F.stddev_samp, "n": F.count}


def aggregated(df: DataFrame, keys: Sequence[str], value: str, *names: str) -> DataFrame:
    """keys and an aggregate for each name, from AGGREGATES."""
    return df.groupBy(*keys).agg(*[AGGREGATES[n](value).alias(n) for n in names])


def p_value(sims: DataFrame, observed: DataFrame, keys: Sequence[str], slope: str = "high") -> DataFrame:
    """keys, p: the share of simulations that an observed value reaches from above (high: value >= sim) or from below (low)."""
    both = sims.join(observed.withColumnRenamed("value", "_v"), list(keys))
    hit = F.col("_v") >= F.col("value") if slope == "high" else F.col("_v") <= F.col("value")
    return both.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("p"))


def dose(series: DataFrame, keys: Sequence[str], counts: str, seconds: str, pixel: Column) -> DataFrame:
    """keys, n_projections, dose (counts over the area of a pixel, summed over the series), per_projection, rate (by second)."""
    d = F.col(counts) / (pixel * pixel)
    out = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_projections"), F.sum(d).alias("dose"), F.sum(seconds).alias("_s"))
    return out.select(*keys, "n_projections", "dose", (F.col("dose") / F.col("n_projections")).alias("per_projection"), (F.col("dose") / F.nullif(F.col("_s"), F.lit(0.0))).alias("rate"))


def experiments(experiments: Mapping[str, Mapping[str, DataFrame]], columns: Sequence[str]) -> DataFrame:
    """group, identifier and the columns of many experiments' tables, as one; columns that a table lacks are null."""
    out = None
    for group, by_id in experiments.items():
        for identifier, df in by_id.items():
            own = df.select([c for c in columns if c in df.columns]).withColumns({"group": F.lit(group), "identifier": F.lit(identifier)})
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.select("group", "identifier", *[F.col(c) if c in out.columns else F.lit(None).alias(c) for c in columns])


def in_categories(catalogs: DataFrame, by: str) -> DataFrame:
    """Catalogs (identifier, values) with their category: the value under ``by``; those without one are left out."""
    return catalogs.withColumn("category", F.element_at("values", by)).where("category IS NOT NULL")


def with_values(catalogs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Catalogs with named values as columns, null where one lacks it."""
    return catalogs.select("*", *[F.element_at("values", n).alias(n) for n in names])
