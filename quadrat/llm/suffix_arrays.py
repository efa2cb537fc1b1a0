"""Suffix arrays in numpy: winnowed anchors, Larsson-Sadakane refinement, Kasai common prefixes. No Spark here."""

from __future__ import annotations

import numpy as np

U = np.uint64
_TABLE = np.random.default_rng(20240601).integers(0, 2**63, 256, U) * U(2) + U(1)
_STEP = np.random.default_rng(20240602).integers(0, 2**63, 8, U) * U(2) + U(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position, by doubling; the last 31 positions are left out."""
    h, width = _TABLE[data], 1
    for k in range(5):
        h = h[:-width] * _STEP[k] + h[width:]
        h ^= h >> U(29)
        width *= 2
    h *= _STEP[5]
    return h ^ (h >> U(32))


GRAM = 32


def anchors(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first, last): the winnowed 32-byte grams of documents data[bounds[i]:bounds[i + 1]].

    Each window of so many bytes selects its gram of least hash, the first of equals; a row is a run of windows, by the
    starts of the first and last one in the document, that select the same gram. Equal windows select the same gram, so
    every window that occurs twice has its gram in two rows or in one row's run twice selected.
    """
    span = window - GRAM + 1
    if len(data) < window:
        return (np.empty(0, U), *(np.empty(0, np.int64),) * 3)
    hashes = gram_hashes(data)
    assert len(data) < 1 << 24
    at = np.arange(len(hashes), dtype=U)
    key = (hashes & ~U((1 << 24) - 1)) | at
    reach, low = 1, key
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    chosen = (low & U((1 << 24) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(chosen)]
    valid = np.arange(len(chosen)) + window <= bounds[doc + 1]
    new = np.empty(len(chosen), bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(chosen)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    d = doc[first]
    return hashes[chosen[first]], d, first - bounds[d], last - bounds[d]


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; behind the end come zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), U)
    for k in range(8):
        out = (out << U(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the positions p with p + depth <= ends[p], by their first depth bytes (64 < depth <= 128), ties by position.

    ends: for each position, where its piece ends. Larsson-Sadakane refinement: positions are first grouped by eight
    bytes, then each group of several is refined by the groups of the positions h further, h doubling; a position whose
    group has become single is left alone.
    """
    n = len(data)
    rest = (ends - np.arange(n)).astype(np.int32)  # a shard has some millions of positions: half the bytes to gather
    live = np.flatnonzero(rest >= 8).astype(np.int32)
    rank = np.full(n, -1, np.int32)
    if len(live):
        key = words8(data)[live]
        order = np.argsort(key)  # equal keys are one group, in any order
        live, key = live[order], key[order]
        index = np.arange(len(live), dtype=np.int32)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[live] = np.maximum.accumulate(np.where(new, index, 0))
    known = 8
    while known < depth:
        shift = min(known, depth - known)
        live = live[rest[live] >= known + shift]
        own = rank[live]
        if not len(live):
            break
        new = np.concatenate([[True], own[1:] != own[:-1]])  # live is in rank order
        single = new & np.append(new[1:], True)
        live, own = live[~single], own[~single]
        key = (own.astype(U) << U(32)) | rank[live + shift].astype(U)
        order = np.argsort(key)
        live, key = live[order], key[order]
        if len(live):
            index = np.arange(len(live), dtype=np.int32)
            group = np.concatenate([[True], (key[1:] >> U(32)) != (key[:-1] >> U(32))])
            part = np.concatenate([[True], key[1:] != key[:-1]])
            rank[live] += np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        known += shift
    whole = np.flatnonzero(rest >= depth)
    both = np.sort((rank[whole].astype(U) << U(32)) | whole.astype(U))
    return (both & U((1 << 32) - 1)).astype(np.int64), rank


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int, lane: int = 1024) -> np.ndarray:
    """For each place k > 0 of order, the length, at most limit, of the common prefix of positions order[k - 1] and order[k].

    Kasai's rule: a prefix of l < limit bytes leaves l - 1 for the next position; one cut at the limit leaves limit - 1
    if the predecessor moves along, and else is counted anew, as where the position behind the predecessor is not in
    order. Stretches of ``lane`` positions go in step, vectorised.
    """
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    before = np.full(len(data) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    found = np.zeros(len(data) + 1, np.int64)
    ordered = np.zeros(len(data) + 2, bool)
    ordered[order] = True
    word = np.concatenate([words8(data), np.zeros(limit + 8, U)])
    starts = np.arange(0, len(data), lane)
    length, previous = np.zeros(len(starts), np.int64), np.full(len(starts), -2, np.int64)
    for j in range(lane):
        p = np.minimum(starts + j, len(data))
        q = before[p]
        length = np.where(length < limit, np.where(ordered[np.maximum(previous + 1, 0)], np.maximum(length - 1, 0), 0), np.where(q == previous + 1, limit - 1, 0))
        previous = q
        length[q < 0] = 0
        going = np.flatnonzero(q >= 0)
        while len(going):
            x = word[p[going] + length[going]] ^ word[q[going] + length[going]]
            same = x == 0
            length[going[same]] += 8
            left = going[~same]
            if len(left):  # equal leading bytes of a word that differs
                length[left] += 7 - (np.frexp(x[~same].astype(np.float64))[1] - 1) // 8
            going = going[same]
            going = going[length[going] < limit]
        np.minimum(length, limit, out=length)
        found[p] = length
    out[1:] = found[order[1:]]
    return out
