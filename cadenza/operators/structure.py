"""Structural segmentation from structure features: embed, recur, lag, smooth, and pick peaks of the novelty curve.

After Serra, Mueller, Grosche and Arcos, "Unsupervised Detection of Music Boundaries by Time Series Structure Features" (AAAI 2012).
One track is one NumPy computation; its matrices have (frames)^2 cells, of which ``cells`` or so are held at a time, so time grows with the square of a track but memory does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cadenza.operators.sequential import per_group

GROUP = ["file_id", "track_id"]


@dataclass(frozen=True)
class StructureConfig:
    """Smoothing width, embedding length, neighbours per frame, peak window, offset of the threshold, normalisation, matrix cells held at a time."""

    gaussian: int = 27
    embedded: int = 3
    nearest: float = 0.04
    peak_window: int = 28
    offset: float = 0.05
    norm: str | None = "inf"
    cells: int = 4_000_000


def normalise(x: np.ndarray, norm: str | None) -> np.ndarray:
    """Rows divided by their largest or smallest magnitude, scaled to [0, 1], or logged."""
    if norm is None or not x.size:
        return x
    if norm == "log":
        return np.log1p(np.maximum(x, 0))
    if norm == "min_max":
        low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
        return (x - low) / np.where(high > low, high - low, 1)
    size = np.abs(x).max(axis=1, keepdims=True) if norm == "inf" else np.abs(x).min(axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def chroma(start: np.ndarray, end: np.ndarray, pitch: np.ndarray, frame: float, frames: int) -> np.ndarray:
    """frames x 12: how long each pitch class sounds in each frame."""
    out = np.zeros((frames, 12))
    for a, b, p in zip(start, end, pitch, strict=True):
        first, last = int(a // frame), min(frames - 1, int(b // frame))
        for f in range(first, last + 1):
            out[f, int(p) % 12] += max(0.0, min(b, (f + 1) * frame) - max(a, f * frame))
    return out


def self_similarity_matrix(x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all frames."""
    square = (x**2).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))


def embed(x: np.ndarray, m: int) -> np.ndarray:
    """Each frame with the ``m - 1`` before it; the first ones repeat the first frame."""
    return np.hstack([np.vstack([np.repeat(x[:1], k, axis=0), x[: len(x) - k]]) for k in range(m)])


def recurrence(x: np.ndarray, share: float) -> np.ndarray:
    """1 where two frames are among each other's nearest ``share`` of all frames."""
    d = self_similarity_matrix(x)
    k = max(1, int(np.ceil(share * len(x))))
    near = d <= np.partition(d, min(k, len(x) - 1), axis=1)[:, [min(k, len(x) - 1)]]
    return (near & near.T).astype(float)


def time_lag(r: np.ndarray) -> np.ndarray:
    """Row i shifted by i, so that repeats become vertical."""
    n = len(r)
    i = np.arange(n)
    return r[i[:, None], (i[:, None] + i[None, :]) % n]


def gaussian_smooth(x: np.ndarray, width: int) -> np.ndarray:
    """Along time with a Gaussian of ``width`` frames; edges are repeated."""
    half = max(1, width // 2)
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / (width / 6 or 1)) ** 2)
    padded = np.pad(x, ((half, half), (0, 0)), mode="edge")
    return sum(w * padded[k : k + len(x)] for k, w in enumerate(kernel / kernel.sum()))


def novelty(sf: np.ndarray) -> np.ndarray:
    """Distance of neighbouring structure features, scaled to at most 1."""
    if len(sf) < 2:
        return np.zeros(len(sf))
    n = np.concatenate([[0.0], (np.diff(sf, axis=0) ** 2).sum(axis=1)])
    return n / n.max() if n.max() > 0 else n


def peaks(curve: np.ndarray, window: int, offset: float) -> np.ndarray:
    """Local maxima above the mean of their window plus ``offset``; of a plateau the first frame."""
    if len(curve) < 3:
        return np.zeros(0, dtype=int)
    padded = np.concatenate([[0], np.cumsum(np.pad(curve, window // 2, mode="edge"))])
    size = 2 * (window // 2) + 1
    mean = (padded[size:] - padded[:-size])[: len(curve)] / size
    inner = np.arange(1, len(curve) - 1)
    return inner[(curve[inner] > curve[inner - 1]) & (curve[inner] >= curve[inner + 1]) & (curve[inner] > mean[inner] + offset)]


def prominent_peaks(curve: np.ndarray, distance: int = 10, prominence: float = 0.1) -> np.ndarray:
    """Peaks that rise ``prominence`` above the higher of the two valleys beside them, highest first, ``distance`` apart."""
    inner = [i for i in range(1, len(curve) - 1) if curve[i] > curve[i - 1] and curve[i] >= curve[i + 1]]
    kept: list[int] = []
    for i in sorted(inner, key=lambda k: (-curve[k], k)):
        left = curve[:i][::-1]
        right = curve[i + 1 :]
        higher = lambda side: next((k for k, v in enumerate(side) if v > curve[i]), len(side))  # noqa: B023, E731
        valley = max(left[: higher(left)].min(initial=curve[i]), right[: higher(right)].min(initial=curve[i]))
        if curve[i] - valley >= prominence and all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return np.array(sorted(kept), dtype=int)


def diagonal_novelty(ssm: np.ndarray, half: int = 3) -> np.ndarray:
    """A checkerboard kernel along the main diagonal of a distance matrix, normalised by its size."""
    n = len(ssm)
    side = np.concatenate([-np.ones(half), np.ones(half)])
    kernel = -np.outer(side, side)  # distances across the boundary count for it
    padded = np.pad(ssm, half, mode="edge")
    return np.array([(padded[i : i + 2 * half, i : i + 2 * half] * kernel).sum() for i in range(n)]) / (2 * half) ** 2


def striped_novelty(x: np.ndarray, config: StructureConfig) -> np.ndarray:
    """``novelty(gaussian_smooth(time_lag(recurrence(x))))`` by stripes of rows; the same whatever their height, as distances are summed in one order."""
    n = len(x)
    rows = max(32, min(n, config.cells // n))
    half = max(1, config.gaussian // 2)
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / (config.gaussian / 6 or 1)) ** 2)
    at = min(max(1, int(np.ceil(config.nearest * n))), n - 1)

    def squared(a: int, b: int) -> np.ndarray:
        out = np.zeros((b - a, n))
        for column in x.T:
            out += (column[a:b, None] - column[None, :]) ** 2
        return out

    reach = np.concatenate([np.partition(squared(a, min(a + rows, n)), at, axis=1)[:, at] for a in range(0, n, rows)])
    curve = np.zeros(n)
    for a in range(0, n, rows):
        b, first = min(a + rows, n), max(a - 1, 0)
        low, high = max(first - half, 0), min(b + half, n)
        near = squared(low, high) <= np.minimum(reach[low:high, None], reach[None, :])
        i = np.arange(low, high)
        lagged = near[i[:, None] - low, (i[:, None] + np.arange(n)[None, :]) % n].astype(float)
        smooth = sum(w * lagged[np.clip(np.arange(first, b) + k - half, 0, n - 1) - low] for k, w in enumerate(kernel / kernel.sum()))
        curve[first + 1 : b] = (np.diff(smooth, axis=0) ** 2).sum(axis=1)
    return curve / curve.max() if curve.max() > 0 else curve


def boundaries(features: np.ndarray, config: StructureConfig) -> np.ndarray:
    """Frames at which a new section begins."""
    if len(features) < 3:
        return np.zeros(0, dtype=int)
    x = embed(normalise(features, config.norm), config.embedded)
    return peaks(striped_novelty(x, config), config.peak_window, config.offset)


def structure_segments(notes: DataFrame, frame: float, config: StructureConfig | None = None, group: list[str] = GROUP) -> DataFrame:
    """(group, segment_id, start, end): sections of each track, in frames of ``frame`` however long it is."""
    config = config or StructureConfig()

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        start, end, pitch = (pdf[c].to_numpy(dtype=float) for c in ("start", "end", "pitch"))
        origin, length = start.min(), end.max() - start.min()
        count = max(1, int(np.ceil(length / frame)))
        cuts = boundaries(chroma(start - origin, end - origin, pitch, frame, count), config)
        marks = [origin, *(origin + cuts * frame), max(end.max(), origin)]
        for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False)):
            yield k, float(a), float(b)

    return per_group(notes, group, ["note_id", "start", "end", "pitch"], "segment_id int, start double, end double", run)


def boundary_f1(found: list[float], truth: list[float], tolerance: float) -> float:
    """F-measure of boundaries, each matched once within ``tolerance``."""
    left, hit = sorted(truth), 0
    for f in sorted(found):
        near = next((t for t in left if abs(t - f) <= tolerance), None)
        if near is not None:
            left.remove(near)
            hit += 1
    return 2 * hit / (len(found) + len(truth)) if found or truth else 1.0
