"""Mixing sources to target weights (native).

Each source is a stream of words, cut into blocks of ``BLOCK`` words (the last one may be shorter). A source's target
says how often its blocks are taken: as many full passes as fit, then a part of one more pass. Each take is a slot, and
``SHARD_SLOTS`` slots are an output shard.

* Draw: every slot of a shard draws its source, with the sources' shares of all slots as chances, so the counts of a
  shard are one multinomial draw.
* Index: a source's slots are numbered over all shards, by sums of the shards' counts and then within the shard.
* Correction: a source drawn more often than its target gives the slots of the numbers beyond it to sources that were
  drawn too seldom. About one slot in the root of a source's slots changes hands, every target is met to the word, and
  no document is taken a fourth time, which free draws cannot promise.
* Block: within a pass a pseudorandom permutation of the source's full blocks maps the number to a block (a swap-or-not
  shuffle: plain arithmetic for any length, without a sort), and blocks are joined by their index.

Offsets in the stream come from sums in buckets of about ``BUCKET`` documents and then over the buckets, so a source
with a third of all rows is no single task; shards are summed in the same way. Nothing but the table of sources is ever
broadcast (its ranges as at most ``CELLS`` rows more), and that only up to ``MAX_BROADCAST`` rows, which is counted first.

Defined results: null and blank texts have size 0 and are never taken; null sources are one source, the last; rows that
repeat, or share a doc_id, or have none, count each for itself; an empty table gives an empty mix; other columns are
passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm import common as C

BLOCK, BUCKET, SHARD_SLOTS, MAX_REPEATS = 64, 4096, 1024, 3
CELLS, MAX_BROADCAST = 4096, 10_000
ROUNDS = 20


def permuted(x: Column, n: Column, *salt: Column | int, seed: int = 0) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n - 1, another one for each salt."""
    keys = [s if isinstance(s, Column) else F.lit(s) for s in (seed, *salt)]

    def swap(a: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - a, n)
        return F.when(F.xxhash64(*keys, r, F.greatest(a, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def targets(sizes: DataFrame) -> DataFrame:
    """Of (source, size) rows, a row for each source: s (its place from 0), weight, source_size, target, and its slots.

    The share of a source is level * weight, at most MAX_REPEATS * its size, for the one level at which all shares sum
    to the total. Of the sources by cap / weight, let the first k - 1 stop at their caps: the rest then has
    (total - caps) / weights as its level, and the level wanted is the largest that no later cap is below.
    """
    every, by_name, by_cap = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("_ratio", "s")
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    src = src.withColumn("s", F.row_number().over(by_name).cast("long") - 1).withColumn("weight", F.col("s") % 3 + 1)
    src = src.withColumn("_ratio", MAX_REPEATS * F.col("source_size") / F.col("weight"))
    caps = F.coalesce(F.sum(MAX_REPEATS * F.col("source_size")).over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(every) - caps) / F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    src = src.withColumn("_level", level)
    src = src.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every))
    src = src.withColumn("target", F.least(F.col("_level") * F.col("weight"), (MAX_REPEATS * F.col("source_size")).cast("double")))
    words = F.least(F.round("target").cast("long"), MAX_REPEATS * F.col("source_size"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    src = src.withColumn("words", words).withColumn("passes", F.floor(F.col("words") / size)).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)).withColumn("full_blocks", F.floor(F.col("source_size") / BLOCK))
    src = src.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK))
    before = F.coalesce(F.sum("slots").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return src.withColumn("first_slot", before).withColumn("all_slots", F.sum("slots").over(every)).drop("_ratio", "_level")


def spread(ranges: DataFrame, total: int) -> DataFrame:
    """ranges ([lo, hi) of whole numbers below total) once for each of CELLS equal cells that they meet, so that numbers find their range by a join on _cell."""
    cell = lambda x: F.floor(x / max(1, -(-total // CELLS)))
    return ranges.where("lo < hi").withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))


def located(rows: DataFrame, x: Column, ranges: DataFrame, total: int, few: bool) -> DataFrame:
    """rows with the columns of the one range that holds x, and _x."""
    cells = spread(ranges, total)
    rows = rows.withColumn("_x", x).withColumn("_cell", F.floor(F.col("_x") / max(1, -(-total // CELLS))))
    return rows.join(F.broadcast(cells) if few else cells, "_cell").where("lo <= _x AND _x < hi").drop("_cell", "lo", "hi")


def shard_counts(src: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(slots: shard, slot, s: what each slot draws; counts: shard, s, n, first: a source's slots in a shard, and those in all shards before)."""
    spark, total = src.sparkSession, src.agg(F.max("all_slots")).first()[0] or 0
    few = src.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    shards = spark.range(0, -(-total // SHARD_SLOTS), 1, C.partitions(spark)).withColumnRenamed("id", "shard")
    last = F.least(F.lit(SHARD_SLOTS), total - F.col("shard") * SHARD_SLOTS)
    own = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)).alias("slot"))
    chances = src.select("s", F.col("first_slot").alias("lo"), (F.col("first_slot") + F.col("slots")).alias("hi"))
    drawn = located(own, F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(1, total))), chances, total, few).drop("_x")
    counts = drawn.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.floor(F.col("shard") / BUCKET))
    counts = C.written(counts.withColumn("_at", F.sum("n").over(W.partitionBy("s", "_b").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")), "mix-counts")
    base = counts.groupBy("s", "_b").agg(F.sum("n").alias("_n"))
    base = base.select("s", "_b", (F.sum("_n").over(W.partitionBy("s").orderBy("_b")) - F.col("_n")).alias("_base"))
    return drawn, counts.join(base, ["s", "_b"]).select("shard", "s", "n", (F.col("_base") + F.col("_at")).alias("first"))


def slots(src: DataFrame, seed: int = 0) -> DataFrame:
    """s, block, pass, n_take and the place (shard, slot) of each take of a block."""
    few = src.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    drawn, counts = shard_counts(src, seed)
    got = src.join(counts.groupBy("s").agg(F.sum("n").alias("_got")), "s", "left").select("s", "slots", F.coalesce("_got", F.lit(0)).alias("_got"))
    over, under = F.greatest(F.col("_got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("_got"), F.lit(0))
    before = lambda c: F.sum(c).over(W.orderBy("s")) - c  # noqa: E731  (a row for each source)
    got = C.written(got.select("s", "slots", "_got", before(over).alias("_over"), before(under).alias("lo"), (before(under) + under).alias("hi")), "mix-drawn")
    moved = got.agg(F.max("hi")).first()[0] or 0
    # Both grow with the input, so neither is broadcast; the window has dealt the slots by the same keys.
    own = drawn.withColumn("_k", F.row_number().over(W.partitionBy("shard", "s").orderBy("slot")) - 1).hint("merge").join(counts.drop("n"), ["shard", "s"])
    small = got.select("s", "slots", "_over")
    own = own.join(F.broadcast(small) if few else small, "s").withColumn("j", F.col("first") + F.col("_k"))
    place = ["shard", "slot"]
    kept = own.where("j < slots").select(*place, "s", "j")
    # The number of a slot that changes hands, among all such, is its place in the ranges of what is missing.
    given = own.where("j >= slots").select(*place, (F.col("_over") + F.col("j") - F.col("slots")).alias("_r"))
    taken = located(given, F.col("_r"), got.select("s", "_got", "lo", "hi", F.col("lo").alias("_lo")), moved, few)
    out = kept.unionByName(taken.select(*place, "s", (F.col("_got") + F.col("_x") - F.col("_lo")).alias("j")))
    known = src.select("s", "slots", "blocks", "full_blocks", "rest")
    out = out.join(F.broadcast(known) if few else known, "s")
    out = out.withColumn("pass", F.floor(F.col("j") / F.col("blocks"))).withColumn("i", F.col("j") % F.col("blocks"))
    block = F.when(F.col("i") < F.col("full_blocks"), permuted(F.col("i"), F.col("full_blocks"), F.col("s"), F.col("pass"), seed=seed)).otherwise(F.col("i"))
    last = (F.col("j") == F.col("slots") - 1) & (F.col("rest") % BLOCK > 0)
    return out.select("s", block.alias("block"), "pass", F.when(last, F.col("rest") % BLOCK).otherwise(BLOCK).alias("n_take"), "shard", "slot")


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): documents with size, s and start, their first word's place in the source; both are written tables.
    row_col names each row and is kept as row_id; rows of one doc_id and size are then told apart by their texts."""
    own = [F.col(row_col).alias("row_id"), F.xxhash64(text_col).alias("_h")] if row_col else []
    key = ["doc_id", "size", *(["_h"] if row_col else [])]
    sizes = C.written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), C.n_words(F.col(text_col)).alias("size"), *own), "mix-sizes")
    src = C.written(targets(sizes), "mix-sources")
    few = src.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    small = src.select(F.col("source").alias("_source"), "s", "source_size", "target", F.greatest(F.ceil(F.col("n_docs") / BUCKET), F.lit(1)).alias("_buckets"))
    own = sizes.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    own = own.withColumn("_b", F.pmod(F.xxhash64(*key), F.col("_buckets"))).drop("_buckets")
    own = own.withColumn("_at", F.sum("size").over(W.partitionBy("s", "_b").orderBy(*key).rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    base = own.groupBy("s", "_b").agg(F.sum("size").alias("_n"))
    base = base.select("s", "_b", (F.sum("_n").over(W.partitionBy("s").orderBy("_b")) - F.col("_n")).alias("_base"))
    return C.written(own.join(base, ["s", "_b"]).withColumn("start", F.col("_base") + F.col("_at")).drop("_b", "_base", "_at", "_h"), "mix-index"), src


def mix(index: DataFrame, src: DataFrame, seed: int = 0) -> DataFrame:
    """The mix: a row for each run of a document's words in an output slot: shard, slot, place of the run in it, doc_id,
    s and start (which name the document's row), row_id where index has it, pass, from_word, n_words."""
    row = [c for c in ("row_id",) if c in index.columns]
    end = F.col("start") + F.col("size")
    parts = index.where("size > 0").select("doc_id", "s", "start", *row, "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    first = F.col("block") * BLOCK
    out = slots(src, seed).hint("merge").join(parts, ["s", "block"])  # both grow with the input, so neither is broadcast
    out = out.withColumn("_from", F.greatest("start", first)).withColumn("n_words", F.least(end, first + F.col("n_take")) - F.col("_from"))
    return out.where("n_words > 0").select("shard", "slot", (F.col("_from") - first).alias("place"), "doc_id", "s", "start", *row, "pass", (F.col("_from") - F.col("start")).alias("from_word"), "n_words")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, with docs' own columns: a row for each pass that takes words of a document, with those
    words as its text (the text unchanged, where all are taken). Rows are named by a written row id, so those that share a
    doc_id, or have none, are documents of their own."""
    rows = C.written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("row")), "mix-rows")
    index, src = indexed(rows.select("_row", "row.doc_id", "row.text", "row.source"), row_col="_row")
    runs = mix(index, src, seed).groupBy("row_id", "pass").agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias("runs"), F.sum("n_words").alias("n"))
    out = rows.join(runs, F.col("_row") == F.col("row_id"))
    text = F.col("row.text")
    part = C.let(C.words(text), lambda w: F.array_join(F.flatten(F.transform(F.col("runs"), lambda r: F.slice(w, r["from_word"].cast("int") + 1, r["n_words"].cast("int")))), " "))
    out = out.withColumn("text", F.when(F.col("n") == C.n_words(text), text).otherwise(part))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select([new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def takes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each row of docs."""
    index, src = indexed(docs)
    taken = mix(index, src).groupBy("s", "start").agg(F.sum("n_words").alias("_taken"))
    out = index.withColumn("_key", F.when(F.col("size") > 0, F.col("start"))).join(taken.withColumnRenamed("start", "_key"), ["s", "_key"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return C.settled(lambda: takes(C.table(spark, sf_dir, "documents")), "op2")
