"""Operators whose result depends on the order of decisions: one Python call per track or segment, over NumPy arrays.

Each group is one track or one segment of it; that bound is in the data, not in the size of the corpus.  Rows are sorted inside the call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["file_id", "track_id"]


def per_group(df: DataFrame, keys: list[str], columns: list[str], made: str, run: Callable[[pd.DataFrame], Iterator[tuple]]) -> DataFrame:
    """``run`` on each group's rows, sorted by (start, note_id); its tuples follow the keys."""
    names = [x.strip().split(" ")[0] for x in made.split(",")]
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), made])

    def call(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(run(pdf.sort_values(["start", "note_id"], kind="stable")))
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, *names])

    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(call, schema)


def repeated_patterns(start: np.ndarray, end: np.ndarray, pitch: np.ndarray, dur: np.ndarray, bar: float | np.ndarray, tolerance: float = 10, mode: str = "repeat", neighbours: int = 0) -> Iterator[tuple[int, int]]:
    """(first, length) of the patterns of one segment.

    Notes agree if their pitches are equal and their durations differ by at most ``tolerance``.  From note i, a copy may begin at note j > i
    that agrees with it and ends a bar or more after i begins.  The pattern reaches from i up to the first note that shares j's onset and has more than
    two notes.  ``repeat``: it counts if it and the note after it agree, note for note, with what begins at j (so a third copy has begun); the first
    such j counts and the search goes on after the second copy.  ``run``: for every such j, what agrees note for note from i and j on, up to the
    pattern's end, counts where it stops before the segment does.  ``neighbours``: a note also agrees with j if one of so many notes before or after j has its
    pitch and j's onset, so that the order within a chord does not matter.
    """
    n = len(start)
    bars = np.broadcast_to(np.asarray(bar, dtype=float), (n,)) if n else np.zeros(0)
    onset = np.searchsorted(start, start, side="left")  # first note of each onset

    def agree(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        hit = pitch[i] == pitch[j]
        for step in [s * k for k in range(1, neighbours + 1) for s in (-1, 1)]:
            k = np.clip(j + step, 0, n - 1)
            hit |= (j + step == k) & (start[k] == start[j]) & (pitch[k] == pitch[i])
        return hit & (np.abs(dur[i] - dur[j]) <= tolerance)

    def agreeing(i: int, j: int, most: int) -> int:
        """How many notes from i and from j on agree, ``most`` at most."""
        most = min(most, n - j)
        same = agree(np.arange(i, i + most), np.arange(j, j + most))
        return most if same.all() else int(np.argmin(same))

    i = 0
    while i < n:
        later = np.arange(i + 1, n)
        heads = later[agree(i, later) & (end[later] - start[i] >= bars[i]) & (onset[later] - i > 2)]
        after = i + 1
        for j in heads.tolist():
            length = int(onset[j]) - i
            run = agreeing(i, j, length + 1)
            if mode == "repeat":
                if run > length:
                    yield i, length
                    after = i + 2 * length
                    break
            elif 2 < min(run, length) and j + run < n:
                yield i, min(run, length)
        i = after


def repeat_detector(notes: DataFrame, bar: float | str, tolerance: float = 10, mode: str = "repeat", group: list[str] | None = None, neighbours: int = 0) -> DataFrame:
    """(group, pattern_no, first, length, start, end, pitches) of each segment's patterns; ``group`` ends in the segment.

    ``bar`` is a length or the column that holds the one in force at each note.  A call handles a whole track, since most segments are too short for a call of
    their own; patterns never cross segments.
    """
    *keys, segment = group or [*GROUP, "segment_id"]
    own = [bar] if isinstance(bar, str) else []

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        start, end, pitch, dur, number = (pdf[c].to_numpy() for c in ("start", "end", "pitch", "dur", segment))
        bars = pdf[bar].to_numpy(dtype=float) if own else np.full(len(pdf), float(bar))
        order = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.diff(number[order])) + 1
        for at in np.split(order, cuts):
            if len(at) < 4:  # three notes and what repeats the first of them
                continue
            for k, (first, length) in enumerate(repeated_patterns(start[at], end[at], pitch[at], dur[at], bars[at], tolerance, mode, neighbours)):
                part = at[first : first + length]
                yield int(number[at[0]]), k, first, length, float(start[part[0]]), float(end[part].max()), ",".join(map(str, pitch[part]))

    return per_group(notes, keys, ["note_id", "start", "end", "pitch", "dur", segment, *own], f"{segment} long, pattern_no int, first int, length int, start double, end double, pitches string", run)


def dedupe_in_segment(patterns: DataFrame, segment: list[str], compat: bool = False) -> DataFrame:
    """The first of equal patterns of a segment; ``compat``: the first of each length."""
    same = ["length"] if compat else ["pitches"]
    firsts = patterns.groupBy(*segment, *same).agg(F.min_by(F.struct("*"), F.struct("first", "length", "pitches")).alias("p"))
    return firsts.select("p.*")


def dedupe_across_segments(patterns: DataFrame, track: list[str], segment: str = "segment_id") -> DataFrame:
    """Patterns that no earlier segment of the track has; equal ones within the first segment all stay."""
    firsts = patterns.groupBy(*track, "pitches").agg(F.min(segment).alias("__first"))
    return patterns.join(firsts, [*track, "pitches"]).where(F.col(segment) == F.col("__first")).drop("__first")


def motif_positions(tokens: list, least: int, most: int) -> dict[tuple, list[int]]:
    """Repeated windows of ``least`` to ``most`` tokens with their positions.

    A longer window repeats only where its first part does, so only windows that repeat at one length go on to the next.
    """
    found: dict[tuple, list[int]] = {}
    alive = list(range(len(tokens) - least + 1))
    for length in range(least, min(most, len(tokens)) + 1):
        level: dict[tuple, list[int]] = {}
        for i in alive:
            if i + length <= len(tokens):
                level.setdefault(tuple(tokens[i : i + length]), []).append(i)
        level = {k: v for k, v in level.items() if len(v) > 1}
        if not level:
            break
        found |= level
        alive = sorted(i for v in level.values() for i in v)
    return found


def long_motifs(notes: DataFrame, token: Column, least: int, most: int, group: list[str] = GROUP, order: str = "note_id") -> DataFrame:
    """(group, n, gram, positions, count, score): windows of ``least`` to ``most`` tokens that a track repeats, for ranges too wide to write out every window."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        for gram, positions in motif_positions(pdf["__token"].tolist(), least, most).items():
            yield len(gram), list(map(str, gram)), positions, len(positions), len(positions) * len(gram)

    rows = notes.withColumn("__token", token)
    rows = rows if order == "note_id" else rows.withColumn("note_id", F.col(order))
    return per_group(rows, group, ["note_id", "start", "__token"], "n int, gram array<string>, positions array<int>, count long, score long", run)


def greedy_cover(tokens: list, least: int, most: int) -> list[tuple[int, int, int, int]]:
    """(position, length, occurrences, motif_id) of accepted occurrences: longest motifs first, then commonest, then earliest; no note is used twice."""
    found = motif_positions(tokens, least, most)
    used = np.zeros(len(tokens), dtype=bool)
    out = []
    order = sorted(found.items(), key=lambda x: (-len(x[0]), -len(x[1]), x[1][0]))
    for motif_id, (motif, positions) in enumerate(order):
        for p in positions:
            if not used[p : p + len(motif)].any():
                used[p : p + len(motif)] = True
                out.append((p, len(motif), len(positions), motif_id))
    return sorted(out)


def cover_segments(notes: DataFrame, least: int = 4, most: int = 30, group: list[str] = GROUP) -> DataFrame:
    """(group, start, end, repetitions, length, motif_id): the greedy cover by pitch motifs, with fillers (-1) for stretches between them in time order."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        start, end = pdf["start"].to_numpy(dtype=float), pdf["end"].to_numpy(dtype=float)
        at = 0.0
        for p, length, n, motif in greedy_cover(pdf["pitch"].tolist(), least, most):
            if start[p] > at:
                yield at, float(start[p]), 1, 0, -1
            yield float(start[p]), float(end[p + length - 1]), n, length, motif
            at = max(at, float(end[p + length - 1]))
        if len(end) and at < end.max():
            yield at, float(end.max()), 1, 0, -1

    return per_group(notes, group, ["note_id", "start", "end", "pitch"], "start double, end double, repetitions int, length int, motif_id int", run)


def bar_aligned_segments(notes: DataFrame, bar: float, least: int = 4, most: int = 100, unit: float = 30, group: list[str] = GROUP) -> DataFrame:
    """(group, start, end, repetitions, length, motif_id): chord motifs, commonest first, stretched to bars; gaps filled with -1.

    A motif is skipped if its stretch lies within an accepted one or an onset of it is in use.
    """

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        onsets, first = np.unique(pdf["start"].to_numpy(dtype=float), return_index=True)
        if not len(onsets):
            return
        near = lambda v: int(np.round(v / unit)) * unit
        pitches, durs = np.split(pdf["pitch"].to_numpy(), first[1:]), np.split(pdf["dur"].to_numpy(), first[1:])
        pairs = [tuple(sorted((int(p), near(d)) for p, d in zip(a, b, strict=True))) for a, b in zip(pitches, durs, strict=True)]
        gaps = [near(g) for g in np.diff(onsets)] + [0]
        tokens = list(zip(pairs, gaps, strict=True))
        found = sorted(motif_positions(tokens, least, most).items(), key=lambda x: (-len(x[1]), -len(x[0]), x[1][0]))
        used, kept = np.zeros(len(tokens), dtype=bool), []
        for motif_id, (motif, positions) in enumerate(found):
            length = sum(g for _, g in motif)
            for p in positions:
                a, b = np.floor(onsets[p] / bar) * bar, np.ceil((onsets[p] + length) / bar) * bar
                if not used[p : p + len(motif)].any() and not any(s <= a and b <= e for s, e, *_ in kept):
                    used[p : p + len(motif)] = True
                    kept.append((float(a), float(b), len(positions), len(motif), motif_id))
        at = 0.0
        for s in sorted(kept):
            if (gap_end := np.floor(s[0] / bar) * bar) > (gap_start := np.floor(at / bar) * bar) and s[0] > at:
                yield float(gap_start), float(gap_end), 1, 0, -1
            yield s
            at = max(at, s[1])
        if at < onsets[-1]:
            yield float(np.floor(at / bar) * bar), float(np.ceil(onsets[-1] / bar) * bar), 1, 0, -1

    return per_group(notes, group, ["note_id", "start", "end", "pitch", "dur"], "start double, end double, repetitions int, length int, motif_id int", run)


def octave_segments(notes: DataFrame, least: int = 3, most: int = 20, min_duration: float = 2.0, min_gap: float = 1.0, group: list[str] = GROUP) -> DataFrame:
    """(group, start, end): occurrences of octave patterns, commonest and then longest first, that last long enough and whose ends are free; then joined over small gaps."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        start, end = pdf["start"].to_numpy(dtype=float), pdf["end"].to_numpy(dtype=float)
        tokens = np.round(pdf["pitch"].to_numpy() / 12).astype(int).tolist()
        found = sorted(motif_positions(tokens, least, most).items(), key=lambda x: (-len(x[1]), -len(x[0]), x[1][0]))
        used, kept = np.zeros(len(tokens), dtype=bool), []
        for motif, positions in found:
            for p in positions:
                q = p + len(motif) - 1
                if not used[p] and not used[q] and end[q] - start[p] >= min_duration:
                    used[p : q + 1] = True
                    kept.append((start[p], end[q]))
        joined: list[list[float]] = []
        for a, b in sorted(kept):
            if joined and a - joined[-1][1] <= min_gap:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        yield from ((float(a), float(b)) for a, b in joined)

    return per_group(notes, group, ["note_id", "start", "end", "pitch"], "start double, end double", run)


def earworms(notes: DataFrame, least: int = 4, most: int = 16, max_silence: float = 1000, k: int = 500, group: list[str] = GROUP) -> DataFrame:
    """(group, start, end, occurrences, length, score, rank): greedy longest motifs without a long silence inside, the ``k`` best by occurrences times length over all groups."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        start, end, tokens = pdf["start"].to_numpy(dtype=float), pdf["end"].to_numpy(dtype=float), pdf["pitch"].tolist()
        quiet = np.concatenate([[0], np.cumsum(start[1:] - end[:-1] > max_silence)]) if len(start) else np.zeros(0)
        used = np.zeros(len(tokens), dtype=bool)
        for motif, positions in sorted(motif_positions(tokens, least, most).items(), key=lambda x: (-len(x[0]), -len(x[1]), x[1][0])):
            for p in positions:
                q = p + len(motif) - 1
                if not used[p : q + 1].any() and quiet[q] == quiet[p]:
                    used[p : q + 1] = True
                    yield float(start[p]), float(end[q]), len(positions), len(motif), len(positions) * len(motif)

    found = per_group(notes, group, ["note_id", "start", "end", "pitch"], "start double, end double, occurrences int, length int, score int", run)
    order = [F.col("score").desc(), *group, "start"]
    return found.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def leader_groups(bars: DataFrame, threshold: float = 0.9, length: int = 1, group: list[str] = GROUP) -> DataFrame:
    """(group, bar, leader): windows of ``length`` bars join the first leader that every bar of theirs resembles, else lead a group themselves."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        pdf = pdf.sort_values("start")
        most = max(map(len, pdf["notes"]), default=0)
        vectors = np.zeros((len(pdf), 4 * most))
        for r, (notes, at) in enumerate(zip(pdf["notes"], pdf["start"], strict=True)):
            for i, x in enumerate(notes):
                vectors[r, [i, most + i, 2 * most + i, 3 * most + i]] = x["pitch"], x["start"] - at, x["dur"], x["velocity"]
        scale = np.sqrt(4 * most) * 127 if most else 1.0
        leaders: list[int] = []
        for i in range(len(pdf) - length + 1):
            for k in leaders:
                if all(1 - np.linalg.norm(vectors[i + j] - vectors[k + j]) / scale > 1 - threshold for j in range(length)):
                    yield int(pdf["bar"].iloc[i]), int(pdf["bar"].iloc[k])
                    break
            else:
                leaders.append(i)
                yield int(pdf["bar"].iloc[i]), int(pdf["bar"].iloc[i])

    return per_group(bars.withColumn("note_id", F.col("bar")), group, ["bar", "note_id", "start", "notes"], "bar long, leader long", run)


def dp_boundaries(points: np.ndarray, segments: int) -> list[int]:
    """Ends of at most ``segments`` hops from the first to the last note of least total distance, with the back-pointers of the last round."""
    n = len(points)
    if n < 2 or segments < 2:
        return []
    reach, back = np.zeros(n), np.zeros(n, dtype=int)
    for _ in range(1, segments):
        best = np.zeros(n)
        for i in range(1, n):  # distances to earlier notes, a row at a time
            total = reach[:i] + np.sqrt(((points[:i] - points[i]) ** 2).sum(axis=1))
            back[i] = int(np.argmin(total))
            best[i] = total[back[i]]
        reach = best
    path, i = [], n - 1
    while i > 0:
        path.append(i)
        i = int(back[i])
    return path[::-1]


def dp_segments(notes: DataFrame, segments: int = 5, group: list[str] = GROUP) -> DataFrame:
    """(group, boundary, start): boundaries by dynamic programming over (start, pitch, duration)."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        points = pdf[["start", "pitch", "dur"]].to_numpy(dtype=float)
        for i in dp_boundaries(points, segments):
            yield i, float(points[i, 0])

    return per_group(notes, group, ["note_id", "start", "pitch", "dur"], "boundary int, start double", run)
