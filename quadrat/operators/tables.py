"""Typed tables: projections, filters, subsets and counts of particle rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.storage import written

OPERATORS = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}


def compare(column: Column, op: str, value) -> Column:
    return getattr(column, OPERATORS[op])(value)


def numbered(df: DataFrame, *order: str, to: str = "row_id") -> DataFrame:
    """df with gapless row numbers in the order given. One range exchange, then per-range counts and local numbers: no global window."""
    # Written, since ranges are drawn from samples: a second run of the exchange may cut them elsewhere.
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    first = ranged.groupBy("_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    base = first.select("_p", "_first", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_base"))  # a row for each partition
    return ranged.join(F.broadcast(base), "_p").withColumn(to, F.col("_base") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_base")


def count_conjunctive(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """n: rows with every column equal to its value; 0 if a column is missing."""
    if any(c not in df.columns for c in wanted):
        return df.agg(F.lit(0).cast("long").alias("n"))
    return df.agg(F.count_if(reduce(Column.__and__, [F.col(c) == v for c, v in wanted.items()], F.lit(True))).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def add_column(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def copy_column(df: DataFrame, source: str, to: str, f=lambda c: c) -> DataFrame:
    return df.withColumn(to, f(F.col(source)))


def randomised(df: DataFrame, column: str, low: float, high: float, key: str, seed: int = 0) -> DataFrame:
    """A column drawn from U(low, high) by the row's key, so that reruns and other partitionings agree."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)) / float(1 << 53)
    return df.withColumn(column, unit * (high - low) + low)


def scaled(df: DataFrame, factor: float, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in columns if c in df.columns})


def swapped(df: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    return df.withColumns({a: F.col(b), b: F.col(a)})


def shifted_by_origin(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Coordinates less their origins; a missing origin is 0."""
    return df.withColumns({c: F.col(c) - F.coalesce(F.col(o), F.lit(0.0)) for c, o in columns})


def external_columns(df: DataFrame, prefix: str = "_rln") -> DataFrame:
    return df.select([c for c in df.columns if c.startswith(prefix)])


def delete_rows(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(ids, key, "left_anti")


def subset_rows(df: DataFrame, places: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows by a (place, key) table; order and repeats of the table are kept in ``place``."""
    return places.join(df, key)


def random_subset(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n draws with replacement, in ``draw``; a copy of all rows if n is no less than their number. Needs gapless ``key`` from 0."""
    total = df.count()
    if n >= total:
        return df.withColumn("draw", F.col(key))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(total)).alias(key))
    return draws.join(df, key)


def first_row(df: DataFrame, column: str, value, order: str = "row_id") -> DataFrame:
    return df.where(F.col(column) == value).orderBy(order).limit(1)


def drop_where(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Rows are removed where the comparison is true, and kept where it is false; nulls go, as no comparison holds."""
    return df.where(~compare(F.col(column), op, value))


def keep_in(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return df.join(names, key, "left_semi")


def by_file_name(df: DataFrame, column: str, name: str, mode: str = "full", keep: bool = True) -> DataFrame:
    """mode full: equal; stem: the file's base name starts with name."""
    hit = F.col(column) == name if mode == "full" else F.startswith(F.substring_index(F.col(column), "/", -1), F.lit(name))
    return df.where(hit if keep else ~hit)


def purge_small_classes(df: DataFrame, klass: str, least: int) -> DataFrame:
    """Rows of classes with that many members. Counted with map-side sums and joined, so a large class is no single task."""
    return df.join(df.groupBy(klass).count().where(F.col("count") >= least).select(klass), klass, "left_semi")


def purge_low_correlation(df: DataFrame, references: DataFrame, klass: str, cc: Column, least: float) -> DataFrame:
    return df.join(references, klass).where(cc >= least).select(df.columns)


def align_tables(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], order: str, missing: float = -1.0) -> DataFrame:
    """left with |left - right| of each column as d_<column>, from the first right row with the key; missing where there is none."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_r"))
    out = left.join(first, key, "left")
    return out.withColumns({f"d_{c}": F.when(F.col("_r").isNull(), F.lit(missing)).otherwise(F.abs(F.col(c) - F.col(f"_r.{c}"))) for c in columns}).drop("_r")


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """same: whether both tables hold the same set of keys."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full").agg(F.coalesce(F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()), F.lit(True)).alias("same"))


def merge_small_groups(df: DataFrame, group: str, size: int, most: int = 100_000) -> DataFrame:
    """group -> merged: the smallest group joins the next smallest until each has more than size rows. The driver sees the
    table of groups only, at most ``most`` of them."""
    import heapq

    rows = df.groupBy(group).count().orderBy("count", group).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups")
    heap = [(r["count"], k, [r[group]]) for k, r in enumerate(rows)]
    heapq.heapify(heap)
    while len(heap) > 1 and heap[0][0] <= size:
        (n, _, a), (m, k, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n + m, k, a + b))
    lut = [(g, min(gs)) for _, _, gs in heap for g in gs]
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(lut, f"{group} {kind}, merged {kind}")


# Tomogram x list


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def grid(df: DataFrame) -> DataFrame:
    """n for every list and tomogram, 0 where a list has no particle there. Both key tables are small; their product is the result itself."""
    cells = df.select("list_id").distinct().join(df.select("tomo_id").distinct(), F.lit(True))
    return cells.join(counts(df, "list_id", "tomo_id"), ["list_id", "tomo_id"], "left").select("list_id", "tomo_id", F.coalesce("n", F.lit(0)).alias("n"))


def proportions(df: DataFrame, within: str = "tomo_id") -> DataFrame:
    """Each list's share of a tomogram's particles (within list_id: each tomogram's share of a list's); 0 where there are none."""
    total = F.sum("n").over(W.partitionBy(within))
    return grid(df).select("list_id", "tomo_id", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("proportion"))


def densities(df: DataFrame, volumes: DataFrame) -> DataFrame:
    """n / volume by tomogram; tomograms without particles have density 0."""
    return volumes.join(counts(df, "tomo_id"), "tomo_id", "left").select("tomo_id", (F.coalesce("n", F.lit(0)) / F.col("volume")).alias("density"))


def drop_sparse(df: DataFrame, least: int) -> DataFrame:
    """A list loses the tomograms where it has fewer particles."""
    return df.join(counts(df, "list_id", "tomo_id").where(F.col("n") >= least).drop("n"), ["list_id", "tomo_id"], "left_semi")


def drop_sparse_any(df: DataFrame, least: int | Mapping[object, int]) -> DataFrame:
    """All lists lose a tomogram where any list that is in it has fewer than its minimum; lists that are not in it don't count."""
    limit = F.lit(least) if isinstance(least, int) else reduce(lambda c, kv: F.when(F.col("list_id") == kv[0], kv[1]).otherwise(c), least.items(), F.lit(0))
    bad = counts(df, "list_id", "tomo_id").where(F.col("n") < limit).select("tomo_id").distinct()
    return df.join(bad, "tomo_id", "left_anti")


def drop_sparse_total(df: DataFrame, least: int) -> DataFrame:
    return df.join(counts(df, "tomo_id").where(F.col("n") >= least).drop("n"), "tomo_id", "left_semi")


def keep_top_tomograms(df: DataFrame, n: int) -> DataFrame:
    """The n tomograms with most particles; ties to the smaller id."""
    return df.join(counts(df, "tomo_id").orderBy(F.desc("n"), "tomo_id").limit(n).drop("n"), "tomo_id", "left_semi")


def merge_lists(df: DataFrame, to) -> DataFrame:
    return df.withColumn("list_id", F.lit(to))


def combinations(df: DataFrame, key: str, k: int = 2, repeats: bool = False) -> DataFrame:
    """Sets of k distinct values, in columns c0, c1, ...: range joins on one ordered key. For small key tables."""
    out = df.select(F.col(key).alias("c0")).distinct()
    for i in range(1, k):
        nxt = df.select(F.col(key).alias(f"c{i}")).distinct()
        out = out.join(nxt, F.col(f"c{i}") >= F.col(f"c{i - 1}") if repeats else F.col(f"c{i}") > F.col(f"c{i - 1}"))
    return out


def bins(column: Column, edges: Sequence[float]) -> Column:
    """The bin of a value, from 0: lower edges belong to it, upper ones do not, but for the last; null outside."""
    last = len(edges) - 2
    out = F.when(column == edges[-1], F.lit(last))
    for k in range(last, -1, -1):
        out = out.when((column >= edges[k]) & (column < edges[k + 1]), F.lit(k))
    return out


# Cells, columns and rows by number


def add_list(df: DataFrame, name: str, values: DataFrame, key: str = "row_id") -> DataFrame:
    """df with a column from (key, name) rows, one for each of its rows; raises if the numbers differ."""
    if df.count() != values.count():
        raise ValueError("the list's length is not that of the table")
    return df.drop(name).join(values.select(key, name), key)


def replaced(df: DataFrame, name: str, values: DataFrame, key: str = "row_id") -> DataFrame:
    """df with a column's data taken from (key, name) rows; rows without one keep theirs."""
    return df.join(values.select(key, F.col(name).alias("_new"), F.lit(True).alias("_has")), key, "left").withColumn(name, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(name))).drop("_new", "_has")


def dropped(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


ARITHMETIC = {"add": "__add__", "sub": "__sub__", "mul": "__mul__", "div": "__truediv__"}


def with_constant(df: DataFrame, name: str, op: str, value) -> DataFrame:
    """A property and a constant; arrays element by element, with one constant or a list of them."""
    f = ARITHMETIC[op]
    if not df.schema[name].dataType.simpleString().startswith("array"):
        return df.withColumn(name, getattr(F.col(name), f)(value))
    if isinstance(value, (list, tuple)):
        return df.withColumn(name, F.zip_with(name, F.array(*[F.lit(v) for v in value]), lambda a, b: getattr(a, f)(b)))
    return df.withColumn(name, F.transform(name, lambda a: getattr(a, f)(value)))


def set_cell(df: DataFrame, name: str, row, value, key: str = "row_id") -> DataFrame:
    return df.withColumn(name, F.when(F.col(key) == row, F.lit(value)).otherwise(F.col(name)))


def vector_between(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """to: the vector from array property a to b."""
    return df.withColumn(to, F.zip_with(b, a, lambda x, y: x - y))


def sorted_by(df: DataFrame, column: str, ascending: bool = True, key: str = "row_id") -> DataFrame:
    """df with its place in the order (from 0, ties by key) as ``place``."""
    return numbered(df, F.col(column).asc() if ascending else F.col(column).desc(), key, to="place")


def sorted_by_other(df: DataFrame, other: DataFrame, key: str, column: str, reverse: bool = False) -> DataFrame:
    """df in the order of another table's column, by key; rows without one are left out."""
    return sorted_by(df.join(other.select(key, column), key), column, not reverse, key)


def in_bounds(points: DataFrame, low: Sequence[float], high: Sequence[float], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Points within a closed box."""
    return points.where(reduce(Column.__and__, [F.col(c).between(a, b) for c, a, b in zip(axes, low, high)]))


def overlapping_boxes(left: DataFrame, right: DataFrame, keys: Sequence[str], size: float, axes: Sequence[str] = ("x", "y", "z"), id_col: str = "id") -> DataFrame:
    """keys, a, b: boxes (columns lo_x, hi_x, ...) that share a point. size: the side of the cells they are dealt over; a pair counts in the first cell of its overlap."""
    cell = lambda c: F.floor(c / size).cast("long")
    box = [f"{m}_{c}" for c in axes for m in ("lo", "hi")]

    def dealt(df: DataFrame, name: str) -> DataFrame:
        out = df.select(*keys, F.col(id_col).alias(name), F.struct(*box).alias(f"_{name}"))
        for c in axes:
            out = out.withColumn(f"_c{c}", F.explode(F.sequence(cell(F.col(f"_{name}.lo_{c}")), cell(F.col(f"_{name}.hi_{c}")))))
        return out

    out = dealt(left, "a").join(dealt(right, "b"), [*keys, *[f"_c{c}" for c in axes]])
    for c in axes:
        first = F.greatest(f"_a.lo_{c}", f"_b.lo_{c}")
        out = out.where((first <= F.least(f"_a.hi_{c}", f"_b.hi_{c}")) & (cell(first) == F.col(f"_c{c}")))
    return out.select(*keys, "a", "b")


def distinct_keys(key: str, *dfs: DataFrame) -> DataFrame:
    """The keys of any of the tables, once each."""
    return reduce(DataFrame.unionAll, [df.select(key) for df in dfs]).distinct()


def with_segmentation(particles: DataFrame, segmentations: DataFrame, key: str = "micrograph") -> DataFrame:
    """Particles with their micrograph's segmentation; those without one are left out."""
    return particles.join(segmentations, key)


def reference_and_target(points: DataFrame, reference, target) -> DataFrame:
    """tomo_id, n_reference, n_target of the tomograms that hold both lists."""
    own = points.groupBy("tomo_id").agg(F.count_if(F.col("list_id") == reference).alias("n_reference"), F.count_if(F.col("list_id") == target).alias("n_target"))
    return own.where("n_reference > 0 AND n_target > 0")


def shown(df: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    """line: each row's columns as a line of text, for reports."""
    kinds = dict(df.dtypes)
    return df.select(F.concat_ws("\t", *[F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in names]).alias("line"))
