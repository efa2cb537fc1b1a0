"""Stencils on dense volumes: a block of a tomogram (binary rows) to a task, with a halo, in numpy.

blocks: (tomo_id, bx, by, bz, shape, data) rows: float32 volumes in C order. ``cut`` makes them from voxel rows with a
halo wide enough for the filter, so that blocks are independent and a tomogram of any size is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian(v: np.ndarray, sigma: float | tuple[float, float, float]) -> np.ndarray:
    """Separable Gaussian up to 4 sigma, edges repeated."""
    for axis, s in enumerate(np.broadcast_to(sigma, 3)):
        if s > 0:
            n = int(4 * s + 0.5)
            k = np.exp(-0.5 * (np.arange(-n, n + 1) / s) ** 2)
            k /= k.sum()
            p = np.pad(v, [(n, n) if a == axis else (0, 0) for a in range(3)], mode="edge")
            v = sum(w * np.take(p, np.arange(i, i + v.shape[axis]), axis=axis) for i, w in enumerate(k))
    return v


def hessian(v: np.ndarray) -> np.ndarray:
    """Second derivatives, 3 x 3 at every voxel."""
    g = np.gradient(v)
    return np.stack([np.stack(np.gradient(g[i]), -1) for i in range(3)], -2)


def surfaceness(v: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(strength, normal) of dark planar structures: the largest curvature less the mean of the others, where it is positive."""
    h = hessian(gaussian(v, sigma))
    values, axes = np.linalg.eigh((h + np.swapaxes(h, -1, -2)) / 2)
    s = values[..., 2] - np.abs(values[..., :2]).mean(-1)
    return np.maximum(s, 0), axes[..., 2]


def tensor_vote(strength: np.ndarray, normal: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Stick votes summed as smoothed outer products of normals: (planar saliency, normal)."""
    t = strength[..., None, None] * normal[..., :, None] * normal[..., None, :]
    out = np.empty_like(t)
    for i in range(3):
        for j in range(i, 3):
            out[..., i, j] = out[..., j, i] = gaussian(t[..., i, j], sigma)
    values, axes = np.linalg.eigh(out)
    return values[..., 2] - values[..., 1], axes[..., 2]


def non_maximum(strength: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Strength where it is no less than at the two voxels along the normal, else 0."""
    step = np.rint(normal / np.maximum(np.abs(normal).max(-1, keepdims=True), 1e-30)).astype(int)
    at = np.stack(np.indices(strength.shape), -1)
    top = np.array(strength.shape) - 1
    pick = lambda p: strength[tuple(np.moveaxis(np.clip(p, 0, top), -1, 0))]
    return np.where((strength >= pick(at + step)) & (strength >= pick(at - step)), strength, 0)


def butterworth(v: np.ndarray, cut: float, order: int = 2, high: bool = False) -> np.ndarray:
    """Low pass (high pass) at cut cycles a voxel."""
    f = np.sqrt(sum(np.square(x) for x in np.meshgrid(*map(np.fft.fftfreq, v.shape), indexing="ij", sparse=True)))
    w = 1 / (1 + (f / cut) ** (2 * order))
    return np.fft.ifftn(np.fft.fftn(v) * (1 - w if high else w)).real


def missing_wedge(v: np.ndarray, max_tilt: float) -> np.ndarray:
    """Without the Fourier terms that tilts about y up to max_tilt degrees do not reach."""
    x, _, z = np.meshgrid(*map(np.fft.fftfreq, v.shape), indexing="ij", sparse=True)
    seen = np.abs(z) <= np.abs(x) * np.tan(np.radians(max_tilt)) + 1e-12
    return np.fft.ifftn(np.fft.fftn(v) * np.broadcast_to(seen, v.shape)).real


def equalised(v: np.ndarray, bins: int = 256, clip: float = 0.01) -> np.ndarray:
    """Contrast-limited histogram equalisation of a block, to 0 .. 1."""
    n, edges = np.histogram(v, bins)
    n = np.minimum(n, max(1, int(clip * v.size)))
    cdf = np.cumsum(n) / n.sum()
    return np.interp(v, edges[1:], cdf)


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Distance of each voxel to the nearest set voxel, exact: lower envelopes of parabolas, axis by axis."""
    d = np.where(mask, 0.0, np.inf)
    for axis in range(3):
        n = d.shape[axis]
        m = np.moveaxis(d, axis, -1)
        i = np.arange(n)
        out = np.full_like(m, np.inf)
        for j in range(n):
            out = np.minimum(out, m[..., j : j + 1] + (i - j) ** 2)
        d = np.moveaxis(out, -1, axis)
    return np.sqrt(d)


def cut(voxels: DataFrame, size: int, halo: int, key: str = "tomo_id") -> DataFrame:
    """Blocks of size^3 voxels with a halo: a voxel goes to each block that it or its halo is in, at most eight if halo < size / 2."""
    out = voxels.select(key, "x", "y", "z", "value")
    for c in "xyz":
        lo, hi = F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)
        out = out.withColumn(f"b{c}", F.explode(F.sequence(lo, hi)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        b = pdf[["bx", "by", "bz"]].iloc[0].to_numpy()
        v = np.zeros((size + 2 * halo,) * 3, "f4")
        at = pdf[["x", "y", "z"]].to_numpy() - b * size + halo
        v[tuple(at.T)] = pdf["value"]
        own = ((at >= halo) & (at < halo + size)).all(1).any()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "bx": [b[0]], "by": [b[1]], "bz": [b[2]], "own": [bool(own)], "data": [v.tobytes()]})

    kind = voxels.schema[key].dataType.simpleString()
    return out.groupBy(key, "bx", "by", "bz").applyInPandas(pack, f"{key} {kind}, bx long, by long, bz long, own boolean, data binary").where("own").drop("own")


def filtered(blocks: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int, halo: int, key: str = "tomo_id", keep: float = 0.0) -> DataFrame:
    """key, x, y, z, value: f of every block, without its halo; values of at most keep are left out."""
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for t, bx, by, bz, data in zip(b[key], b["bx"], b["by"], b["bz"], b["data"]):
                v = f(np.frombuffer(data, "f4").reshape((size + 2 * halo,) * 3).astype(float))
                v = v[halo : halo + size, halo : halo + size, halo : halo + size]
                x, y, z = np.nonzero(np.abs(v) > keep)
                yield pd.DataFrame({key: t, "x": x + bx * size, "y": y + by * size, "z": z + bz * size, "value": v[x, y, z]})

    return blocks.mapInPandas(run, f"{key} {kind}, x long, y long, z long, value double")


def membranes(blocks: DataFrame, size: int, halo: int, sigma: float = 1.5, vote: float = 3.0, least: float = 0.0) -> DataFrame:
    """Membrane voxels: surfaceness, tensor voting, non-maximum suppression; small components go with voxels.labelled and a size filter."""

    def detect(v: np.ndarray) -> np.ndarray:
        s, n = tensor_vote(*surfaceness(v, sigma), vote)
        return non_maximum(s, n)

    return filtered(blocks, detect, size, halo, keep=least)


def homogenised(v: np.ndarray, cut_at: float, whole: bool = True) -> np.ndarray:
    """Density of a stack of points, smoothed by a low pass of order 5: in space, or each slice along z by itself."""
    return butterworth(v, cut_at, 5) if whole else np.concatenate([butterworth(v[:, :, z : z + 1], cut_at, 5) for z in range(v.shape[2])], 2)


def blobs(v: np.ndarray, sigma: float, least: float) -> np.ndarray:
    """Strength (negated Laplacian of the Gaussian, times sigma^2) where it is a maximum among its 26 neighbours and at least ``least``, else 0: bright balls of about sigma * sqrt(3)."""
    g = gaussian(v, sigma)
    p = np.pad(g, 1, mode="edge")
    mid = p[1:-1, 1:-1, 1:-1]
    lap = sum(p[tuple(slice(1 + d * (a == k), p.shape[a] - 1 + d * (a == k)) for a in range(3))] - mid for k in range(3) for d in (-1, 1))
    s = -lap * sigma**2
    q = np.pad(s, 1, constant_values=-np.inf)
    top = np.max([q[x : x + s.shape[0], y : y + s.shape[1], z : z + s.shape[2]] for x in range(3) for y in range(3) for z in range(3) if (x, y, z) != (1, 1, 1)], 0)
    return np.where((s >= least) & (s > top), s, 0)
