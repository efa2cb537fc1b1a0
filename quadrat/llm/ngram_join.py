"""N-gram Jaccard join: MinHash banding, then every candidate pair verified on the full n-gram sets.

Documents with equal n-gram sets are one class (grouped with map-side sums); one set for each class goes on. ``banding``
picks bands and rows for a target recall at the threshold. A shuffle on band hashes links each class to the least class
of its bucket, which is linear in the bucket. The components of these links are the candidate groups; each class's set is
shipped once to its group, where all pairs are verified as integer inequalities on a sparse incidence matrix. Groups
above ``BLOCK_SETS`` sets or ``BLOCK_ITEMS`` n-grams are split into blocks, one task for each pair of blocks; tasks
return each class's number of links and a spanning forest of its links, never the pairs.

Defined results: words are those of the contracts, as written; a text of 1 to n - 1 words has one n-gram, all its words;
null, empty and blank texts have the empty set and are copies of each other; documents with the same class count each
other as links; rows that repeat are copies too; null ids are kept; an empty table gives no rows; other columns are
passed over. N-grams are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm import common as C

N, THRESHOLD, RECALL = 5, (4, 5), 0.9999
BLOCK_SETS, BLOCK_ITEMS, TASK_ITEMS = 1024, 1_000_000, 2_000_000
SLAB_ITEMS, SLAB_ROWS = 250_000, 256  # worked on at a time, which bounds the memory of a pair of blocks
MAX_HASHES = 160


def banding(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, at which a pair at the threshold shares a band with the
    probability recall and bands * rows <= most."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def shingles(text: Column, n: int = N) -> Column:
    """The distinct n-grams of a text, as hashes."""

    def of(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(long)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return C.let(C.words(text), of)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(items, bounds) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


def minhashed(sets: DataFrame, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """id, text_hash, items -> id, text_hash, n, key (a digest of the set), bands (a hash for each)."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rnd = np.random.default_rng(seed)
        a, b = rnd.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(0, 2**63, bands * rows, np.uint64)
        mix = rnd.integers(0, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            items, bounds = _sets(batch.column("items"))
            items = items.view(np.uint64)
            n = np.diff(bounds)
            sig = np.zeros((len(n), bands * rows), np.uint64)
            ids = np.flatnonzero(n)
            step = np.searchsorted(bounds, np.arange(0, bounds[-1] + 1, 200_000))  # documents for about 200,000 items at a time stay in the cache
            cuts = np.unique(np.concatenate([step, [len(n)]]))
            for lo, hi in zip(np.concatenate([[0], cuts[:-1]]), cuts):
                own = ids[(ids >= lo) & (ids < hi)]
                if len(own):
                    x, at = items[bounds[lo] : bounds[hi]], bounds[own] - bounds[lo]
                    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                    x ^= x >> np.uint64(29)
                    for k in range(bands * rows):
                        sig[own, k] = np.minimum.reduceat(x * a[k] + b[k], at)
            sig ^= sig >> np.uint64(31)
            code = (sig.reshape(len(n), bands, rows) * mix).sum(2, dtype=np.uint64)
            code ^= code >> np.uint64(32)
            keys = [hashlib.blake2b(np.sort(items[s:e]).tobytes(), digest_size=16).digest() for s, e in zip(bounds[:-1], bounds[1:])]
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(code.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), out], ["id", "text_hash", "n", "key", "bands"])

    return sets.mapInArrow(run, f"id {kind}, text_hash long, n long, key binary, bands array<long>")


def _count_shared(flat: np.ndarray, owner: np.ndarray, m: int, a: slice, b: slice, common: np.ndarray) -> None:
    """Adds to common, for each set in a and each in b, how many of these n-grams both hold."""
    by_gram = np.argsort(flat, kind="stable")
    flat, owner = flat[by_gram], owner[by_gram]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
    count = np.diff(np.append(np.flatnonzero(new), len(flat)))
    shared = np.repeat(count > 1, count)  # n-grams of one set only meet nothing
    owner, column = owner[shared], (np.cumsum(new) - 1)[shared]
    if not len(column):
        return
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    width = max(64, 2_000_000 // m)
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
        if e > s:
            x = np.zeros((m, min(width, column[-1] + 1 - k * width)), np.float32)
            x[owner[s:e], column[s:e] - k * width] = 1
            np.add(common, x[a] @ x[b].T, out=common, casting="unsafe")


def _verified(sets: list[np.ndarray], left: np.ndarray, weights: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each set, a spanning forest of them). left: whether a set is of the task's first block; None: all pairs count."""
    m = len(sets)
    order = np.arange(m) if left is None else np.argsort(~left, kind="stable")
    a, b = (slice(0, m), slice(0, m)) if left is None else (slice(0, int(left.sum())), slice(int(left.sum()), m))
    sets, weights = [sets[k] for k in order], weights[order]
    n = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m, dtype=np.int32), n)
    common = np.zeros((a.stop - a.start, b.stop - b.start), np.int32)
    slabs = max(1, -(-len(flat) // SLAB_ITEMS))  # of n-grams by their hash
    slab = np.concatenate([(s.view(np.uint64) % np.uint64(slabs)).astype(np.int32) for s in sets])
    for k in range(slabs):
        _count_shared(flat[slab == k], owner[slab == k], m, a, b, common)
    p, q = threshold
    linked = np.zeros((m, m), bool)
    for s in range(a.start, a.stop, SLAB_ROWS):
        own = slice(s, min(s + SLAB_ROWS, a.stop))
        inter = common[own].astype(np.int64)
        linked[own, b] = q * inter >= p * (n[own, None] + n[None, b] - inter)
    np.fill_diagonal(linked, False)
    if left is not None:
        linked[b, a] = linked[a, b].T
    links, forest, seen = np.zeros(m, np.int64), [], np.zeros(m, bool)
    for s in range(0, m, SLAB_ROWS):
        links[order[s : s + SLAB_ROWS]] = linked[s : s + SLAB_ROWS].astype(np.int64) @ weights
    for start in range(m):
        if not seen[start]:
            seen[start], queue = True, [start]
            while queue:
                at = queue.pop()
                more = np.flatnonzero(linked[at] & ~seen)
                seen[more] = True
                forest += [(int(order[at]), int(order[x])) for x in more]
                queue += more.tolist()
    return links, forest


def near_duplicates(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, class_id (the least id among all that links reach), n_links (other documents at the threshold or above),
    first (true for one row of each class): a row for each row of docs."""
    bands, rows = banding(threshold[0] / threshold[1], recall)
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    seen = C.written(minhashed(docs.select("id", "text_hash", shingles(F.col("text"), n).alias("items")), bands, rows), "ngram-signatures")
    classes = C.written(seen.groupBy("key").agg(F.min(F.struct("id", "text_hash")).alias("_r"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "ngram-classes")
    banded = classes.where("n > 0").select("key", F.posexplode("bands").alias("band", "code"))
    heads = banded.groupBy("band", "code").agg(F.min("key").alias("v"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    groups = C.components(banded.join(heads, ["band", "code"]).where("key <> v").select(F.col("key").alias("u"), "v"))

    # Each candidate group to a task, or its pairs of blocks each to a task.
    own = C.written(groups.withColumnRenamed("u", "key").join(classes.select("key", "n", "copies", "_r"), "key"), "ngram-candidates")
    sizes = own.groupBy("root").agg(F.sum("n").alias("_items"), F.count(F.lit(1)).alias("_sets"))
    parts = F.greatest(F.ceil(F.col("_items") / BLOCK_ITEMS), F.ceil(F.col("_sets") / BLOCK_SETS))
    sizes = sizes.select("root", parts.alias("_parts"))
    total = own.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-total // TASK_ITEMS), C.partitions(docs.sparkSession))
    own = own.join(sizes, "root").withColumn("_b", F.pmod(F.xxhash64("key"), F.col("_parts")))
    pairs = F.when(F.col("_parts") == 1, F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("i"), F.lit(-1).cast("long").alias("j"))))
    pairs = pairs.otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda x: F.struct(F.least(x, F.col("_b")).alias("i"), F.greatest(x, F.col("_b")).alias("j"))))
    wanted = own.select(F.col("_r.id").alias("_id"), F.col("_r.text_hash").alias("_hash"), "key", "root", "copies", "_b", "_parts", pairs.alias("_tasks"))
    texts = docs.join(wanted, docs["id"].eqNullSafe(F.col("_id")) & (docs["text_hash"] == F.col("_hash"))).select("text", "key", "root", "copies", "_b", "_parts", "_tasks")
    ready = texts.withColumn("items", shingles(F.col("text"), n)).drop("text").select("*", F.inline("_tasks")).drop("_tasks")
    ready = ready.withColumn("_group", F.when(F.col("_parts") > 1, F.col("root")).otherwise(F.lit(b"")))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        split = pdf["j"].iloc[0] >= 0
        for _, g in [(None, pdf)] if split else pdf.groupby("root", sort=False):
            g = g.drop_duplicates("key")  # rows that repeat
            left = None if not split or g["i"].iloc[0] == g["j"].iloc[0] else (g["_b"] == g["i"]).to_numpy()
            keys = g["key"].tolist()
            links, forest = _verified([np.asarray(x, np.int64) for x in g["items"]], left, g["copies"].to_numpy(np.int64), threshold)
            out += [(k, None, int(x)) for k, x in zip(keys, links) if x] + [(keys[a], keys[b], 0) for a, b in forest]
        return pd.DataFrame(out, columns=["u", "v", "links"])

    found = C.written(ready.groupBy("_group", "i", "j").applyInPandas(verify, "u binary, v binary, links long"), "ngram-links")
    links = found.groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("_links"))
    roots = C.components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("u", "key")

    classes = classes.select("key", "copies", "_r").join(links, "key", "left").join(roots, "key", "left")
    classes = classes.select("key", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"), "_r")
    classes = C.written(classes, "ngram-result")
    firsts = classes.groupBy("root").agg(F.min("_r").alias("_first"))
    classes = classes.join(firsts, "root").select("key", "n_links", "_first")
    out = seen.select("id", "text_hash", "key").join(classes, "key")
    first = F.col("id").eqNullSafe(F.col("_first.id")) & (F.col("text_hash") == F.col("_first.text_hash"))
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("_first.id").alias("class_id"), "n_links", first.alias("first"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each class, the one with the least doc_id; of rows that repeat it, one stays."""
    firsts = near_duplicates(docs).where("first").select("doc_id", "text_hash").distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("code"))
    own = own.join(firsts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("code") == F.col("text_hash")), "left_semi")
    return own.withColumn("k", F.row_number().over(W.partitionBy("id", "code").orderBy(F.lit(0)))).where("k = 1").select("row.*")


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return C.settled(lambda: near_duplicates(C.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links"), "op7")
