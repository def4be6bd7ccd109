"""Distances between sequences: time warping, shared blocks, bar vectors, and repeats under a distance."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.expr import match_ratio
from cadenza.operators.sequential import per_group
from cadenza.operators.structure import prominent_peaks

GROUP = ["file_id", "track_id"]


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Exact time-warping distance with absolute or Euclidean steps; the cells of an anti-diagonal depend only on the two before it."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0 if n == m else float("inf")
    a, b = (np.asarray(x, dtype=float).reshape(len(x), -1) for x in (a, b))
    inf = np.inf
    before, last = np.full(n + 1, inf), np.full(n + 1, inf)
    before[0] = 0.0  # the corner (0, 0)
    for s in range(2, n + m + 1):
        now = np.full(n + 1, inf)
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        step = np.sqrt(((a[i - 1] - b[s - i - 1]) ** 2).sum(axis=1))
        now[i] = step + np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1])
        before, last = last, now
    return float(last[n])


#: Pairs whose warping distances are computed at a time.
_PAIRS = 1 << 16


def dtw_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``dtw`` of each row of one matrix of numbers to the same row of another; every cell is computed for all rows at once."""
    row = [np.zeros(len(a)), *[np.full(len(a), np.inf)] * b.shape[1]]
    for i in range(a.shape[1]):
        now = [np.full(len(a), np.inf)]
        for j in range(b.shape[1]):
            now.append(np.abs(a[:, i] - b[:, j]) + np.minimum(np.minimum(row[j], row[j + 1]), now[j]))
        row = now
    return row[-1]


def dtw_repeats(notes: DataFrame, width: int, threshold: float, group: list[str] = GROUP) -> DataFrame:
    """(group, i, j, distance): non-overlapping windows of ``width`` pitches whose time-warping distance is below ``threshold``.

    The first and last cells are on every path, so pairs for which their steps alone reach the threshold are left out before the rest is computed.
    """

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        x = pdf["pitch"].to_numpy(dtype=float)
        if len(x) <= 2 * width:
            return
        windows = np.lib.stride_tricks.sliding_window_view(x, width)[:-1]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for i in range(len(windows) + 1):
            if i < len(windows):
                j = np.arange(i + width, len(windows))
                ends = np.abs(x[j] - x[i]) + (np.abs(x[j + width - 1] - x[i + width - 1]) if width > 1 else 0)
                j = j[ends < threshold]
                held.append((np.full(len(j), i), j))
                size += len(j)
            if held and (size >= _PAIRS or i == len(windows)):
                first, second = (np.concatenate(c) for c in zip(*held, strict=True))
                d = dtw_pairs(windows[first], windows[second])
                near = d < threshold
                yield from zip(first[near].tolist(), second[near].tolist(), d[near].tolist(), strict=True)
                held, size = [], 0

    return per_group(notes, group, ["note_id", "start", "pitch"], "i int, j int, distance double", run)


def cluster_similarity(clusters: DataFrame, threshold: float = 0.8, group: list[str] = GROUP) -> DataFrame:
    """(group, a, b, similarity) of clusters of onsets: 1 - warping distance / longer length, where at least ``threshold``."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        parts = {k: g[["pitch", "dur"]].to_numpy(dtype=float) for k, g in pdf[pdf["cluster"] >= 0].groupby("cluster")}
        for a, x in parts.items():
            for b, y in parts.items():
                if a < b and (s := 1 - dtw(x, y) / max(len(x), len(y))) >= threshold:
                    yield int(a), int(b), float(s)

    return per_group(clusters, group, ["note_id", "start", "pitch", "dur", "cluster"], "a int, b int, similarity double", run)


def shared_ratio(a: list, b: list) -> float:
    """Twice the matched elements by all elements; 1 for two empty sequences, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return SequenceMatcher(None, list(a), list(b), autojunk=False).ratio()


def sequence_similarity(a: dict[str, list], b: dict[str, list]) -> float:
    """0.4 of the pitches' shared ratio, and 0.2 each of the closeness of durations, place by place, and of the intervals' and the durations' shared ratio.

    1 for two empty sequences, 0 for one; durations that are all 0 are as close as can be.
    """
    if not len(a["pitch"]) or not len(b["pitch"]):
        return float(len(a["pitch"]) == len(b["pitch"]))
    durations, total = list(zip(a["dur"], b["dur"], strict=False)), sum(a["dur"]) + sum(b["dur"])
    close = 1 - sum(abs(x - y) for x, y in durations) / total if total else 1.0
    parts = [(0.4, a["pitch"], b["pitch"]), (0.2, np.diff(a["pitch"]).tolist(), np.diff(b["pitch"]).tolist()), (0.2, a["dur"], b["dur"])]
    return float(0.2 * close + sum(w * SequenceMatcher(None, x, y).ratio() for w, x, y in parts))


def adjacent_sequence_similarity(bars: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, bar, previous, similarity): ``sequence_similarity`` of neighbouring non-empty bars, batch by batch."""
    w = Window.partitionBy(*group).orderBy("bar")
    parts = {"__p": F.transform("notes", lambda n: n["pitch"].cast("double")), "__d": F.transform("notes", lambda n: n["dur"].cast("double"))}
    pairs = bars.withColumns(parts).withColumns({"previous": F.lag("bar").over(w), "__q": F.lag("__p").over(w), "__e": F.lag("__d").over(w)}).where("previous is not null")

    def run(p: pd.Series, d: pd.Series, q: pd.Series, e: pd.Series) -> pd.Series:
        rows = zip(p, d, q, e, strict=True)
        return pd.Series([sequence_similarity({"pitch": list(w), "dur": list(x)}, {"pitch": list(y), "dur": list(z)}) for w, x, y, z in rows], dtype="float64")

    return pairs.select(*group, "bar", "previous", F.pandas_udf(run, "double")("__q", "__e", "__p", "__d").alias("similarity"))


def shared_ratio_of(a: Column | str, b: Column | str) -> Column:
    """``shared_ratio`` of two array columns, batch by batch."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([shared_ratio(list(u), list(v)) for u, v in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def bar_vectors(bars: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """``bars`` with ``vec``: pitches, onsets within the bar, durations and velocities, each padded with 0 to the fullest bar of the track."""
    most = F.max(F.size("notes")).over(Window.partitionBy(*group))
    padded = lambda f: F.slice(F.concat(F.transform("notes", f), F.array_repeat(F.lit(0.0), F.col("__most"))), F.lit(1), F.col("__most"))
    parts = [padded(lambda n: n["pitch"].cast("double")), padded(lambda n: (n["start"] - F.col("start")).cast("double")), padded(lambda n: n["dur"].cast("double")), padded(lambda n: n["velocity"].cast("double"))]
    return bars.withColumn("__most", most).withColumn("vec", F.concat(*parts)).drop("__most")


def vector_similarity(a: Column, b: Column) -> Column:
    """1 - Euclidean distance / the largest there could be for values up to 127."""
    d2 = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 - F.sqrt(d2) / (F.sqrt(F.size(a)) * 127)


def adjacent_bar_similarity(bars: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, bar, previous, similarity) of neighbouring non-empty bars."""
    w = Window.partitionBy(*group).orderBy("bar")
    pairs = bar_vectors(bars, group).withColumns({"previous": F.lag("bar").over(w), "__before": F.lag("vec").over(w)}).where("previous is not null")
    return pairs.select(*group, "bar", "previous", vector_similarity(F.col("vec"), F.col("__before")).alias("similarity"))


def adjacent_match_ratio(bars: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, bar, previous, ratio): share of positions at which neighbouring non-empty bars have the same pitch."""
    w = Window.partitionBy(*group).orderBy("bar")
    pitches = bars.withColumn("__p", F.transform("notes", lambda n: n["pitch"]))
    pairs = pitches.withColumns({"previous": F.lag("bar").over(w), "__before": F.lag("__p").over(w)}).where("previous is not null")
    return pairs.select(*group, "bar", "previous", match_ratio("__p", "__before").alias("ratio"))


def close_bars(bars: DataFrame, threshold: float = 0.9, group: list[str] = GROUP) -> DataFrame:
    """(group, bar, other, similarity): pairs of bars of one track, ``bar`` first, similar beyond 1 - ``threshold``."""
    v = bar_vectors(bars, group).select(*group, "bar", "vec")
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(b, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [F.col("a.bar") < F.col("b.bar")])
    scored = pairs.select(*[F.col(f"a.{g}").alias(g) for g in group], F.col("a.bar").alias("bar"), F.col("b.bar").alias("other"), vector_similarity(F.col("a.vec"), F.col("b.vec")).alias("similarity"))
    return scored.where(F.col("similarity") > 1 - threshold)


def self_similarity(rows: DataFrame, key: str, columns: list[str], group: list[str]) -> DataFrame:
    """(group, i, j, distance) with i < j: the upper half of the distance matrix of the rows' vectors, group by group; a group is one track's frames."""
    vec = F.array(*[F.col(c).cast("double") for c in columns])
    a = rows.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(key).alias("i"), vec.alias("__a"))
    b = rows.select(*group, F.col(key).alias("j"), vec.alias("__b"))
    on = [F.col(f"__{g}") == F.col(g) for g in group] + [F.col("i") < F.col("j")]
    d2 = F.aggregate(F.zip_with("__a", "__b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, on).select(*group, "i", "j", F.sqrt(d2).alias("distance"))


def chroma_frames(notes: DataFrame, frame: float, group: list[str] = GROUP) -> DataFrame:
    """(group, frame, c0..c11): the velocities of each pitch class's onsets in every frame that has any."""
    return notes.groupBy(*group, F.floor(F.col("start") / frame).alias("frame")).agg(*[F.sum(F.when(F.pmod("pitch", F.lit(12)) == k, F.col("velocity")).otherwise(0)).alias(f"c{k}") for k in range(12)])


def moving_kernel(rows: DataFrame, value: str, at: str, weights: tuple[float, ...] = (0.5, 1, 1, 1, 1, 1, 0.5), group: list[str] = GROUP) -> DataFrame:
    """``rows`` with ``novelty``: the weighted sum of ``value`` about each row in the order of ``at``; 0 where the kernel reaches over an end."""
    w, half = Window.partitionBy(*group).orderBy(at), len(weights) // 2
    parts = [x * (F.lag(value, half - k).over(w) if k < half else F.lead(value, k - half).over(w) if k > half else F.col(value)) for k, x in enumerate(weights)]
    return rows.withColumn("novelty", F.coalesce(sum(parts[1:], parts[0]), F.lit(0.0)))


def novelty_peaks(rows: DataFrame, at: str, distance: int = 10, prominence: float = 0.1, group: list[str] = GROUP) -> DataFrame:
    """(group, at) of the prominent peaks of ``novelty`` in the order of ``at``, one track a call."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        yield from ((int(pdf["note_id"].iloc[k]),) for k in prominent_peaks(pdf["novelty"].to_numpy(dtype=float), distance, prominence))

    return per_group(rows.withColumns({"note_id": F.col(at), "start": F.col(at)}), group, ["note_id", "start", "novelty"], f"{at} long", run)
