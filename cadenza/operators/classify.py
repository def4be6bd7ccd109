"""Bar tokens, repeated bar patterns, phrases, and the classification of a track's bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.expr import octave_bucket
from cadenza.operators.cluster import agglomerate
from cadenza.operators.ngrams import grams
from cadenza.operators.sequential import per_group
from cadenza.operators.timeline import runs

GROUP = ["file_id", "track_id"]


def mean_octave(notes: Column) -> Column:
    """The rounded octave of a bar's mean pitch."""
    total = F.aggregate(notes, F.lit(0.0), lambda s, n: s + n["pitch"])
    return octave_bucket(total / F.size(notes))


def bar_sequences(bars: DataFrame, token: Column, group: list[str] = GROUP) -> DataFrame:
    """(group, bars, tokens): a track's non-empty bars in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("bar"), token.alias("t"))))
    return bars.groupBy(*group).agg(pairs.alias("__s")).select(*group, F.transform("__s", lambda s: s["bar"]).alias("bars"), F.transform("__s", lambda s: s["t"]).alias("tokens"))


def bar_patterns(seqs: DataFrame, least: int = 2, most: int = 8, group: list[str] = GROUP) -> DataFrame:
    """(group, n, gram, positions, count): exact token patterns of bars that occur twice or more; not longer than half the track."""
    half = F.floor(F.size("tokens") / 2).cast("int")
    each = grams(seqs.withColumn("__half", half), least, most, [*group, "__half"]).where(F.col("n") <= F.col("__half"))
    return each.groupBy(*group, "n", "gram").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count(F.lit(1)).alias("count")).where("count > 1")


def _alike(pdf: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a track's bars in order: how many bars in a row agree from each pair of non-empty bars on, the number of non-empty bars before each place, and the first bar."""
    bars = pdf["bar"].to_numpy()
    pitches = [[n["pitch"] for n in x] for x in pdf["notes"]]
    n, most = len(bars), max(map(len, pitches))
    table, size = np.full((n, most), np.nan), np.array(list(map(len, pitches)))
    for k, x in enumerate(pitches):
        table[k, : len(x)] = x
    run = np.zeros((n + 1, n + 1), dtype=np.int32)
    for i in range(n - 1, -1, -1):  # a row at a time
        same = (table == table[i]).sum(axis=1) / np.maximum(size, size[i]) >= least
        run[i, :n] = np.where(same, run[i + 1, 1 : n + 1] + 1, 0)
    grid = np.arange(bars[0], bars[-1] + 2)
    return run, np.searchsorted(bars, grid), grid


def similar_bar_patterns(bars: DataFrame, least: int = 2, most: int = 8, ratio: float = 0.8, group: list[str] = GROUP) -> DataFrame:
    """(group, n, bar, copy): windows of ``least`` to ``most`` bars, at most half the track, and the first later window that resembles each.

    Empty bars are left out of both; what is left must be as many bars, and agree bar by bar in at least ``ratio`` of their pitches, place by place.
    """

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        run, before, grid = _alike(pdf, ratio)
        whole = len(grid) - 1
        for n in range(least, min(most, whole // 2) + 1):
            first, held = before[: whole - n + 1], before[n : whole + 1] - before[: whole - n + 1]
            for i in np.flatnonzero(held):
                later = np.flatnonzero((held[i + 1 :] == held[i]) & (run[first[i], first[i + 1 :]] >= held[i]))
                if len(later):
                    yield n, int(grid[i]), int(grid[i + 1 + later[0]])

    return per_group(bars.withColumn("note_id", F.col("bar")), group, ["bar", "note_id", "start", "notes"], "n int, bar long, copy long", rows)


def fixed_bar_patterns(bars: DataFrame, n: int, ratio: float = 0.1, compat: bool = False, group: list[str] = GROUP) -> DataFrame:
    """(group, bar, copies): windows of ``n`` bars with all later ones that resemble them as in ``similar_bar_patterns``; bars of a pattern begin no other, but for ``compat``."""

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        run, before, grid = _alike(pdf, ratio)
        whole = len(grid) - 1
        first, held = before[: max(0, whole - n + 1)], before[n : whole + 1] - before[: max(0, whole - n + 1)]
        used = np.zeros(whole + n, dtype=bool)
        for i in np.flatnonzero(held):
            if used[i]:
                continue
            later = i + 1 + np.flatnonzero((held[i + 1 :] == held[i]) & (run[first[i], first[i + 1 :]] >= held[i]))
            later = later[~used[later]]
            if len(later):
                yield int(grid[i]), [int(grid[j]) for j in later]
                for j in () if compat else (i, *later):
                    used[j : j + n] = True

    return per_group(bars.withColumn("note_id", F.col("bar")), group, ["bar", "note_id", "start", "notes"], "bar long, copies array<long>", rows)


def merge_patterns(patterns: DataFrame, seqs: DataFrame, bars: DataFrame, cut: float = 0.2, places: int = 100, group: list[str] = GROUP) -> DataFrame:
    """``patterns`` with ``family``: average linkage over the cosine distance of the pitches and durations of each pattern's first occurrence, ``places`` of each, filled up with 0.

    A family is numbered by its first pattern in the order of (n, gram); a track's patterns are one call, and their distances one matrix.
    """
    first = patterns.select(*group, "n", "gram", F.explode(F.slice("positions", 1, 1)).alias("pos")).join(seqs, group)
    at = first.select(*group, "n", "gram", F.posexplode(F.transform(F.expr("slice(bars, int(pos) + 1, int(n))"), lambda x: x)).alias("place", "bar"))
    notes = at.join(bars.select(*group, "bar", "notes"), [*group, "bar"]).groupBy(*group, "n", "gram").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "notes"))), lambda x: x["notes"])).alias("notes"))
    filled = lambda f: F.slice(F.concat(F.transform("notes", lambda x: x[f].cast("double")), F.array_repeat(F.lit(0.0), places)), 1, places)
    vectors = notes.select(*group, "n", "gram", F.concat(filled("pitch"), filled("dur")).alias("vec"))

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        pdf = pdf.assign(__key=[(n, tuple(g)) for n, g in zip(pdf["n"], pdf["gram"], strict=True)]).sort_values("__key")
        x = np.array(pdf["vec"].tolist(), dtype=float)
        size = np.linalg.norm(x, axis=1)
        d = 1 - (x @ x.T) / np.maximum(size[:, None] * size[None, :], 1e-300)
        for n, gram, family in zip(pdf["n"], pdf["gram"], agglomerate(np.round(d, 12), cut, "average"), strict=True):
            yield int(n), list(gram), int(family)

    made = per_group(vectors.withColumns({"start": F.lit(0), "note_id": F.lit(0)}), group, ["n", "gram", "vec", "start", "note_id"], f"n int, gram {dict(patterns.dtypes)['gram']}, family int", rows)
    return patterns.join(made, [*group, "n", "gram"])


def repeating_bars(patterns: DataFrame, seqs: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, bar): bars inside an occurrence of a pattern."""
    places = patterns.select(*group, "n", F.explode("positions").alias("pos")).select(*group, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos")).distinct()
    numbered = seqs.select(*group, F.posexplode("bars").alias("pos", "bar"))
    return numbered.join(places, [*group, "pos"], "left_semi").select(*group, "bar")


def phrases(bars: DataFrame, repeating: DataFrame, least: int = 2, group: list[str] = GROUP) -> DataFrame:
    """(group, first, last, n): runs of consecutive bars outside all patterns."""
    return runs(bars.select(*group, "bar").join(repeating, [*group, "bar"], "left_anti"), "bar", group, least)


def continuous_phrases(bars: DataFrame, least: int = 2, most: int = 8, step: int = 2, ratio: float = 2.0, group: list[str] = GROUP) -> DataFrame:
    """(group, first, last, n): runs of neighbouring bars whose last and first notes are near in pitch or alike in length."""
    w = Window.partitionBy(*group).orderBy("bar")
    edge = bars.select(*group, "bar", F.element_at("notes", 1).alias("head"), F.element_at("notes", -1).alias("tail"))
    near = F.abs(F.col("head.pitch") - F.lag("tail.pitch").over(w)) <= step
    a, b = F.col("head.dur"), F.lag("tail.dur").over(w)
    alike = (F.least(a, b) > 0) & (F.greatest(a, b) <= ratio * F.least(a, b))
    joined = F.coalesce((F.col("bar") - F.lag("bar").over(w) == 1) & (near | alike), F.lit(False))
    run = edge.withColumn("__new", ~joined).withColumn("__run", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*group, "__run").agg(F.min("bar").alias("first"), F.max("bar").alias("last"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("n") <= most)).drop("__run")


def classify(bars: DataFrame, empty: DataFrame, patterns: DataFrame, seqs: DataFrame, bar: int, least_phrase: int = 1, group: list[str] = GROUP) -> DataFrame:
    """(group, type, start, end, length): repeating patterns, melodic phrases, empty bars, whatever is left, and the first and last moment."""
    spots = F.transform("positions", lambda p: F.struct(F.get("bars", p.cast("int")).alias("a"), F.get("bars", (p + F.col("n") - 1).cast("int")).alias("b")))
    placed = patterns.join(seqs.select(*group, "bars"), group).select(*group, "n", F.explode(spots).alias("o"))
    repeated = placed.select(*group, F.lit("Repeating Pattern").alias("type"), (F.col("o.a") * bar).alias("start"), ((F.col("o.b") + 1) * bar).alias("end"), F.col("n").cast("long").alias("length"))
    inside = repeating_bars(patterns, seqs, group)
    spans = phrases(bars, inside, least_phrase, group)
    phrase = spans.select(*group, F.lit("Melodic Phrase").alias("type"), (F.col("first") * bar).alias("start"), ((F.col("last") + 1) * bar).alias("end"), F.col("n").alias("length"))
    silent = empty.select(*group, F.lit("Empty").alias("type"), (F.col("bar") * bar).alias("start"), ((F.col("bar") + 1) * bar).alias("end"), F.lit(1).cast("long").alias("length"))
    covered = inside.unionByName(spans.select(*group, F.explode(F.sequence("first", "last")).alias("bar")))
    other = bars.select(*group, "bar").join(covered, [*group, "bar"], "left_anti").select(*group, F.lit("Other").alias("type"), (F.col("bar") * bar).alias("start"), ((F.col("bar") + 1) * bar).alias("end"), F.lit(1).cast("long").alias("length"))
    edges = bars.groupBy(*group).agg(F.min("bar").alias("a"), F.max("bar").alias("b"))
    first = edges.select(*group, F.lit("Start").alias("type"), (F.col("a") * bar).alias("start"), (F.col("a") * bar).alias("end"), F.lit(0).cast("long").alias("length"))
    last = edges.select(*group, F.lit("End").alias("type"), ((F.col("b") + 1) * bar).alias("start"), ((F.col("b") + 1) * bar).alias("end"), F.lit(0).cast("long").alias("length"))
    made = repeated
    for part in (phrase, silent, other, first, last):
        made = made.unionByName(part)
    return made
