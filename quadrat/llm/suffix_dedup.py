"""Suffix-array dedup: which bytes of a corpus are covered by a string of ``WINDOW`` bytes that also starts earlier.

1. Candidates: each document's windows are winnowed to anchors, 32-byte grams of which equal windows select the same
   one. Anchors are counted over all documents with map-side sums; windows whose anchor occurs once cannot repeat.
2. Shards: documents' candidate stretches, up to ``SHARD`` bytes of them, get a suffix array (Larsson-Sadakane) and common
   prefixes (Kasai). Windows that repeat in the shard are settled there; only the first of each class goes on.
3. Merging: what is first in its shard and has its anchor in other shards goes to a bucket by its anchor. Stretches of
   several shards are merged by binary search in their sorted order, first whole, then window by window. A passage that
   a third of all documents hold is thus a stretch a shard; above ``FAN`` shards the merge runs in several rounds.

Defined results: null texts are empty; ids are in order of (id, digest of the text), null ids first; rows that repeat an
id and its text are one document and each get its result; documents shorter than the window lose nothing; an empty
table gives no rows; documents of any length are cut into stretches that overlap by a window; other columns are
passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm import common as C
from quadrat.llm.suffix_arrays import anchors, common_prefixes, suffix_array, words8

WINDOW, SHARD, FAN = 100, 2_000_000, 4096
CHUNK, SECTION, PIECES, SEARCH = 131_072, 4_000_000, 40_000, 200_000
MAX_BROADCAST = 32_000_000
FOUND = "kind int, id long, digest long, hash long, start long, stop long, bytes binary"


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, bounds) of a string column without nulls."""
    column = column.cast(pa.large_binary()).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _sections(bounds: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first document, offset in it, bounds) of stretches of about CHUNK bytes; a long document comes in overlapping sections."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        j = min(j, n)
        size = bounds[j] - bounds[i]
        if size <= SECTION:
            yield i, 0, bounds[i : j + 1]
        else:
            for at in range(0, int(size) - window + 1, SECTION - window + 1):
                yield i, at, np.array([bounds[i] + at, min(bounds[i] + at + SECTION, bounds[j])])
        i = j


def anchored(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, digest, text -> id, digest, hash, first, last: every document's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = _texts(b.column("text"))
            ids, digests = b.column("id").to_numpy(), b.column("digest").to_numpy()
            for i, at, own in _sections(bounds, window):
                h, d, first, last = anchors(data[own[0] : own[-1]], own - own[0], window)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + d]), pa.array(digests[i + d]), pa.array(h.view(np.int64)), pa.array(first + at), pa.array((last - first).astype(np.int32))], ["id", "digest", "hash", "first", "more"])

    return docs.mapInArrow(run, "id long, digest long, hash long, first long, more int")


def _runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places of the runs of set flags within equal groups."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (group[at[1:]] != group[at[:-1]])])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1]


def _settle(parts: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """A shard. parts: (id, digest, start, bytes, hash, first, last, count) of stretches, the latter arrays over its anchors, inside it."""
    parts = sorted(parts, key=lambda x: x[:3])
    sizes = np.array([len(x[3]) for x in parts])
    data, begin = np.concatenate([x[3] for x in parts]), np.concatenate([[0], np.cumsum(sizes)])
    part = np.repeat(np.arange(len(parts)), sizes)
    order, _ = suffix_array(data, begin[1:][part], window)
    same = common_prefixes(data, order, window) >= window
    later = np.zeros(len(data), bool)
    later[order[same]] = True  # ties are in document order, so the first of a class is its earliest

    number = [len(x[4]) for x in parts]
    shift = np.repeat(begin[:-1] - [x[2] for x in parts], number)
    hashes, first, last, count = (np.concatenate([x[k] for x in parts]) for k in (4, 5, 6, 7))
    first, last = first + shift, last + shift
    anchor = np.full(len(data), -1, np.int64)
    lengths = last - first + 1
    anchor[np.repeat(first - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())] = np.repeat(np.arange(len(first)), lengths)
    _, inverse, own = np.unique(hashes, return_inverse=True, return_counts=True)
    abroad = count > own[inverse]  # the anchor occurs in other shards too

    ids, digests = np.array([x[0] for x in parts], np.int64), np.array([x[1] for x in parts], np.int64)
    start = np.array([x[2] for x in parts], np.int64) - begin[:-1]
    for kind, flags, group in ((0, later, part), (1, ~later & (anchor >= 0) & abroad[anchor], anchor)):
        s, e = _runs(flags, group)
        p = part[s]
        texts = [data[a : b + window].tobytes() for a, b in zip(s, e)] if kind else [None] * len(s)
        code = hashes[anchor[s]] if kind else np.zeros(len(s), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), kind, np.int32)), pa.array(ids[p]), pa.array(digests[p]), pa.array(code), pa.array(s + start[p]), pa.array(e + window + start[p]), pa.array(texts, pa.binary())], [x.split()[0] for x in FOUND.split(", ")])


def settled(candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, digest, text, found (anchors: first, hash, more, n) -> FOUND: kind 0 is settled (bytes start to stop repeat), kind 1 is first in its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0
        for b in batches:
            data, bounds = _texts(b.column("text"))
            ids, digests, found = b.column("id").to_pylist(), b.column("digest").to_pylist(), b.column("found")
            at, flat = found.offsets.to_numpy(), found.values
            first, code, more, count = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "hash", "more", "n"))
            for i in range(len(ids)):
                f, h, m, c = (x[at[i] : at[i + 1]] for x in (first, code, more, count))
                o = np.argsort(f, kind="stable")
                f, h, c, last = f[o], h[o], c[o], f[o] + m[o]
                gap = np.flatnonzero(f[1:] > last[:-1] + 1) + 1  # candidate windows that do not go on are another stretch
                for s, e in zip(np.concatenate([[0], gap]), np.append(gap, len(f))):
                    while s < e:
                        k = min(e, s + max(1, int(np.searchsorted(last[s:e], f[s] + SHARD))))
                        a, z = int(f[s]), int(last[k - 1]) + window
                        shard.append((ids[i], digests[i], a, data[bounds[i] + a : bounds[i] + z], h[s:k], f[s:k], last[s:k], c[s:k]))
                        size += z - a
                        s = k
                        if size >= SHARD:
                            shard[:] = [(*x[:3], x[3].copy(), *x[4:]) for x in shard]
                            yield from _settle(shard, window)
                            shard, size = [], 0
            shard = [(*x[:3], x[3].copy(), *x[4:]) for x in shard]
        if shard:
            yield from _settle(shard, window)

    return candidates.mapInArrow(run, FOUND)


def _merge(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Stretches of several shards: FOUND rows, kind 0 for bytes that start earlier elsewhere, kind 1 for stretches that are still first."""
    pdf = pdf.sort_values(["id", "digest", "start"], kind="stable", ignore_index=True)
    texts = pdf["bytes"].to_numpy()
    known = np.sort(np.unique(texts))
    place = np.searchsorted(known, texts)
    first = np.full(len(known), len(texts))
    np.minimum.at(first, place, np.arange(len(texts)))
    copy = first[place] < np.arange(len(texts))

    own = np.flatnonzero(~copy)
    code = pdf["hash"].to_numpy()[own]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    own = own[count[inverse] > 1]  # the others have no partner left
    removed = [pdf.loc[copy, ["id", "digest", "start", "stop"]]]
    if len(own):
        sizes = np.array([len(texts[k]) for k in own])
        data, begin = np.frombuffer(b"".join(texts[own]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        number = sizes - window + 1
        which = np.repeat(np.arange(len(own)), number)
        at = np.arange(number.sum()) - np.repeat(np.concatenate([[0], np.cumsum(number)[:-1]]), number)
        place = begin[which] + at
        view = np.lib.stride_tricks.sliding_window_view(data, window)
        passes = -(-len(place) // SEARCH)
        key = words8(data)[place] % np.uint64(max(1, passes * 7 + 1 if passes > 1 else 1))
        later = np.zeros(len(place), bool)
        rounds = np.argsort(key, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(key.astype(np.int64)))])
        for s, e in zip(bounds[:-1], bounds[1:]):
            mine = rounds[s:e]
            if len(mine) > 1:
                # A last byte of 1, since numpy passes over zero bytes at the end of strings.
                strings = np.concatenate([view[place[mine]], np.ones((len(mine), 1), np.uint8)], axis=1).view(f"S{window + 1}").ravel()
                order = np.argsort(strings, kind="stable")
                ranked = strings[order]
                earliest = order[np.searchsorted(ranked, strings, "left")]  # equal strings are in document order
                later[mine] = earliest < np.arange(len(mine))
        s, e = _runs(later, which)
        base = pdf.loc[own[which[s]], ["id", "digest", "start"]].to_numpy(np.int64)
        removed.append(pd.DataFrame({"id": base[:, 0], "digest": base[:, 1], "start": base[:, 2] + at[s], "stop": base[:, 2] + at[e] + window}))
    out = pd.concat(removed, ignore_index=True).assign(kind=0, hash=0, bytes=None)
    return pd.concat([out, pdf[~copy].assign(kind=1)], ignore_index=True)[[x.split()[0] for x in FOUND.split(", ")]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document's stretches, their union: starts, stops."""
    for b in batches:
        starts, stops = [], []
        for s, e in zip(b.column("starts").to_pylist(), b.column("stops").to_pylist()):
            s, e = np.array(s, np.int64), np.array(e, np.int64)
            o = np.argsort(s, kind="stable")
            s, e = s[o], np.maximum.accumulate(e[o])
            new = np.concatenate([[True], s[1:] > e[:-1]])
            at = np.flatnonzero(new)
            starts.append(s[at])
            stops.append(e[np.append(at[1:], len(s)) - 1])
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))], ["id", "digest", "starts", "stops"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with id, digest and text for the steps above."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*[docs[c].alias(f"_{k}") for k, c in enumerate(docs.columns)], F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, digest, starts, stops: the maximal byte runs of each document (id, digest, text) that are covered by repeats."""
    spark = docs.sparkSession
    docs = docs.select("id", "digest", "text")
    marks = C.written(anchored(docs, window), "suffix-anchors")
    # Each of these is a table of its own, so that its shuffles are gone before the next, and so that both sides of the
    # join on anchors are plain exchanges, which a skew join can split.
    often = C.written(marks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-repeated")
    found = marks.hint("merge").join(often, "hash").groupBy("id", "digest").agg(F.collect_list(F.struct("first", "hash", "more", "n")).alias("found"))
    found = C.written(found, "suffix-found")
    C.discard(marks, often)
    texts = docs.groupBy("id", "digest").agg(F.first("text").alias("text"))
    done = C.written(settled(texts.join(found, ["id", "digest"]), window), "suffix-shards")
    C.discard(found)
    results, stretches = [done.where("kind = 0")], done.where("kind = 1")
    count = stretches.count()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, size // SHARD)
    names = [x.split()[0] for x in FOUND.split(", ")]
    while True:
        salts = -(-shards // FAN)
        buckets = max(C.partitions(spark), -(-count // PIECES))
        bucket, salt = F.pmod(F.xxhash64("hash"), F.lit(buckets)), F.pmod(F.xxhash64("id", "digest"), F.lit(salts))
        merged = stretches.withColumn("_b", bucket).withColumn("_s", salt).groupBy("_b", "_s").applyInPandas(lambda pdf: _merge(pdf[names], window), FOUND)
        merged = C.written(merged if salts > 1 else merged.where("kind = 0"), "suffix-merged")
        results.append(merged.where("kind = 0"))
        if salts == 1:
            break
        stretches, shards = merged.where("kind = 1"), salts
    every = results[0]
    for r in results[1:]:
        every = every.unionAll(r)
    lists = every.groupBy("id", "digest").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    out = C.written(lists.mapInArrow(_joined, "id long, digest long, starts array<long>, stops array<long>"), "suffix-spans")
    C.discard(done)
    return out


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns of docs as _0, _1, ..., text (not null), starts, stops (null where nothing repeats)."""
    own = keyed(docs, id_col, text_col)
    spans = repeats(own, window)
    r = spans.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("starts")).alias("s")).first()
    small = 64 * r.n + 16 * (r.s or 0) <= MAX_BROADCAST
    return own.join(F.broadcast(spans) if small else spans, ["id", "digest"], "left").drop("id", "digest")


def _kept(text: bytes, starts, stops) -> bytes:
    if starts is None:
        return text
    ends = [0, *stops.tolist()]
    return b"".join(text[a:b] for a, b in zip(ends, [*starts.tolist(), len(text)]))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256."""
    at = docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = _texts(b.column("text"))
            starts, stops = ([x.values.to_numpy() if x.is_valid else None for x in b.column(c)] for c in ("starts", "stops"))
            n, removed, spans, codes = np.diff(bounds), [], [], []
            whole = memoryview(data)
            for i, (s, e) in enumerate(zip(starts, stops)):
                text = bytes(whole[bounds[i] : bounds[i + 1]])
                codes.append(hashlib.sha256(_kept(text, s, e)).hexdigest())
                removed.append(0 if s is None else int((e - s).sum()))
                spans.append(0 if s is None else len(s))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(codes, pa.string())], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = with_spans(docs, id_col, text_col, window).select(F.col(f"_{at}").alias("_id"), "text", "starts", "stops")
    kind = docs.schema[id_col].dataType.simpleString()
    return own.mapInArrow(run, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("_id", id_col)


def trimmed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated bytes cut out of text (parts of a character that a cut leaves go too); documents without a word left are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            starts, stops = ([x.values.to_numpy() if x.is_valid else None for x in b.column(c)] for c in ("starts", "stops"))
            out = [t if s is None else _kept(t.encode(), s, e).decode("utf-8", "ignore") for t, s, e in zip(texts, starts, stops)]
            yield pa.RecordBatch.from_arrays([*[c for c, name in zip(b.columns, b.schema.names) if name not in ("text", "starts", "stops")], pa.array(out, pa.string())], [*[x for x in b.schema.names if x not in ("text", "starts", "stops")], "text"])

    own = with_spans(docs, window=window)
    names, at = docs.columns, docs.columns.index("text")
    schema = ", ".join(f"_{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)) + ", text string"
    out = own.mapInArrow(run, schema).where(F.btrim("text", F.lit(C.SPACE)) != "")
    columns = [F.col("text" if k == at else f"_{k}").alias(c) for k, c in enumerate(names)]
    if "n_chars" in names:
        columns[names.index("n_chars")] = F.length("text").cast("long").alias("n_chars")
    return out.select(columns)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return C.settled(lambda: report(C.table(spark, sf_dir, "documents")), "op5")
