"""Feature sets per file, track or instrument; column expressions and one grouped aggregate each.

Both orders of a group's notes, by onset and as listed, come from windows over the same partitioning, so a feature set costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.expr import syncopated
from cadenza.schema import DEFAULT_TEMPO, FEATURES8, FEATURES10

GROUP = ["file_id", "track_id"]


def _lagged(notes: DataFrame, group: list[str], listed: list[str], tempo: Column | float, beats_per_bar: Column | float) -> DataFrame:
    by_onset = Window.partitionBy(*group).orderBy("start", *listed)
    as_listed = Window.partitionBy(*group).orderBy(*listed)
    return notes.withColumns(
        {
            "__ioi": F.col("start") - F.lag("start").over(by_onset),
            "__step": F.col("pitch") - F.lag("pitch").over(as_listed),
            "__start_step": F.col("start") - F.lag("start").over(as_listed),
            "__dur_ratio": F.col("dur") / F.nullif(F.lag("dur").over(as_listed), F.lit(0)),
            "__off": syncopated("start", tempo, beats_per_bar).cast("int"),
        }
    )


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def features10(notes: DataFrame, group: list[str] = GROUP, listed: tuple[str, ...] = ("note_id",), tempo: Column | float = DEFAULT_TEMPO, min_notes: int = 2) -> DataFrame:
    """The search features of each group with ``min_notes`` or more notes; ``listed`` is the order for intervals and contour."""
    t = tempo if isinstance(tempo, Column) else F.lit(float(tempo))
    made = _lagged(notes.withColumn("__tempo", t), group, list(listed), F.col("__tempo"), 4.0).groupBy(*group).agg(
        F.avg("pitch").alias("pitch_mean"), F.stddev_pop("pitch").alias("pitch_std"), F.avg("dur").alias("duration_mean"), F.stddev_pop("dur").alias("duration_std"), _zero(F.avg("__ioi")).alias("ioi_mean"), _zero(F.stddev_pop("__ioi")).alias("ioi_std"),
        F.avg("__off").alias("syncopation_ratio"), F.first("__tempo").alias("tempo"), _zero(F.stddev_pop(F.abs("__step"))).alias("interval_std"), (_zero(F.sum(F.signum("__step"))) / F.count(F.lit(1))).alias("contour_slope"), F.count(F.lit(1)).alias("n_notes"),
    )
    return made.where(F.col("n_notes") >= min_notes).select(*group, *FEATURES10, "n_notes")


def features8(notes: DataFrame, group: list[str] = GROUP, tempo: Column | float = DEFAULT_TEMPO, numerator: Column | float | None = 4.0) -> DataFrame:
    """The first eight features; without a time signature (``numerator`` None) nothing counts as syncopated."""
    t = tempo if isinstance(tempo, Column) else F.lit(float(tempo))
    made = _lagged(notes.withColumn("__tempo", t), group, ["note_id"], F.col("__tempo"), 4.0 if numerator is None else numerator)
    ratio = F.lit(0.0) if numerator is None else F.avg("__off")
    return made.groupBy(*group).agg(
        F.first("__tempo").alias("tempo"), F.avg("pitch").alias("pitch_mean"), F.stddev_pop("pitch").alias("pitch_std"), F.avg("dur").alias("duration_mean"), F.stddev_pop("dur").alias("duration_std"), _zero(F.avg("__ioi")).alias("ioi_mean"), _zero(F.stddev_pop("__ioi")).alias("ioi_std"), ratio.alias("syncopation_ratio"),
        F.min("pitch").alias("pitch_min"), F.max("pitch").alias("pitch_max"), F.min("dur").alias("duration_min"), F.max("dur").alias("duration_max"),
    ).select(*group, *FEATURES8, "pitch_min", "pitch_max", "duration_min", "duration_max")


def instrument_features(notes: DataFrame, group: list[str], tempo: Column | float = DEFAULT_TEMPO) -> DataFrame:
    """29 descriptive features per instrument; moments of constant durations and ratios over zero time are null."""
    pitches = notes.groupBy(*group, "pitch").agg(F.count(F.lit(1)).alias("n"))
    entropy = pitches.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*group))).groupBy(*group).agg((-F.sum(F.col("p") * F.log("p"))).alias("pitch_entropy"), F.count(F.lit(1)).alias("note_variety"))
    whole = Window.partitionBy(*group)
    marked = _lagged(notes, group, ["note_id"], tempo, 4.0).withColumns({"__mid": F.min("pitch").over(whole) + (F.max("pitch").over(whole) - F.min("pitch").over(whole)) / 2, "__median": F.median("dur").over(whole)})
    n, last = F.count(F.lit(1)), F.nullif(F.max("start"), F.lit(0).cast("double"))
    chords = _zero(F.sum((F.col("__start_step") == 0).cast("int"))) / n
    short, long = F.sum((F.col("dur") < F.col("__median")).cast("int")), F.sum((F.col("dur") >= F.col("__median")).cast("int"))
    t = tempo if isinstance(tempo, Column) else F.lit(float(tempo))
    made = marked.withColumn("__tempo", t).groupBy(*group).agg(
        F.avg("pitch").alias("avg_pitch"), F.stddev_pop("pitch").alias("pitch_std"), F.median("pitch").alias("median_pitch"), F.avg("velocity").alias("avg_velocity"), F.stddev_pop("velocity").alias("velocity_std"),
        F.avg("dur").alias("avg_duration"), F.stddev_pop("dur").alias("duration_std"), F.median("dur").alias("median_duration"), n.alias("note_count"), (F.max("pitch") - F.min("pitch")).alias("pitch_range"), F.sum("dur").alias("track_duration"),
        chords.alias("chord_frequency"), F.first("__tempo").alias("tempo"), _zero(F.avg("__start_step")).alias("avg_interval"), (1 - F.sum("dur") / last).alias("silence_ratio"),
        (F.sum((F.col("pitch") > F.col("__mid")).cast("int")) / n).alias("upper_half_ratio"), (F.sum((F.col("pitch") <= F.col("__mid")).cast("int")) / n).alias("lower_half_ratio"), chords.alias("avg_chord_size"), chords.alias("chord_time_ratio"), (n / last).alias("note_density"),
        F.skewness("dur").alias("duration_skewness"), F.kurtosis("dur").alias("duration_kurtosis"), F.min("dur").alias("duration_min"), F.max("dur").alias("duration_max"), (F.max("dur") - F.min("dur")).alias("duration_range"),
        (F.percentile("dur", F.lit(0.75)) - F.percentile("dur", F.lit(0.25))).alias("duration_iqr"), (short / long).alias("short_long_ratio"),
    )
    return made.join(entropy, group)


def jump_features(notes: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Pitch range, signed jumps and size of a pattern or track."""
    step = F.col("pitch") - F.lag("pitch").over(Window.partitionBy(*group).orderBy("start", "note_id"))
    return notes.withColumn("__jump", step).groupBy(*group).agg(
        F.min("pitch").alias("min_pitch"), F.max("pitch").alias("max_pitch"), (F.max("pitch") - F.min("pitch")).alias("pitch_range"), F.min("__jump").alias("min_jump"), F.max("__jump").alias("max_jump"), F.count(F.lit(1)).alias("note_count")
    )


def extra_features(notes: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Mean and skewness of interval sizes, peak to mean pitch, mean ratio of consecutive durations."""
    return _lagged(notes, group, ["note_id"], DEFAULT_TEMPO, 4.0).groupBy(*group).agg(
        F.avg(F.abs("__step")).alias("mean_interval"), F.skewness(F.abs("__step")).alias("interval_skewness"), (F.max("pitch") / F.nullif(F.avg("pitch"), F.lit(0.0))).alias("peak_to_mean"), F.avg("__dur_ratio").alias("duration_ratio")
    )


def nearest_beat(notes: DataFrame, beats: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """``notes`` with the distance to the closest row of ``beats`` (group, beat), null without beats: one union and two running values, no range join."""
    points = notes.withColumn("__beat", F.lit(None).cast("double")).withColumn("__at", F.col("start").cast("double"))
    marks = beats.select(*group, F.col("beat").cast("double").alias("__beat"), F.col("beat").cast("double").alias("__at"))
    order = Window.partitionBy(*group).orderBy("__at", F.col("__beat").asc_nulls_last())
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    # beats at the very onset are behind it, so the rest lies ahead
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    both = points.unionByName(marks, allowMissingColumns=True)
    found = both.withColumns({"__before": F.last("__beat", True).over(back), "__after": F.first("__beat", True).over(ahead)}).where("__beat is null")
    return found.withColumn("beat_distance", F.least(F.col("__at") - F.col("__before"), F.col("__after") - F.col("__at"))).drop("__beat", "__at", "__before", "__after")


def beat_syncopation(notes: DataFrame, beats: DataFrame, group: list[str] = GROUP, tolerance: float = 0.1) -> DataFrame:
    """Share of onsets more than ``tolerance`` from the closest beat."""
    return nearest_beat(notes, beats, group).groupBy(*group).agg(F.avg((F.col("beat_distance") > tolerance).cast("int")).alias("syncopation_ratio"))


def estimate_tempo(notes: DataFrame, group: list[str], first_tempo: Column | None = None, low: float = 60.0, high: float = 200.0, unit: float = 0.01) -> DataFrame:
    """(group, tempo): the commonest gap between onsets, on a grid of ``unit`` seconds, as beats a minute, folded by octaves into [low, high).

    Ties take the shorter gap.  Without a gap the tempo is ``first_tempo``, an aggregate of the group, or 120.
    """
    order = Window.partitionBy(*group).orderBy("start")
    onsets = notes.select(*group, "start").distinct().withColumn("gap", F.bround((F.col("start") - F.lag("start").over(order)) / unit) * unit)
    gaps = onsets.where("gap > 0").groupBy(*group, "gap").agg(F.count(F.lit(1)).alias("n"))
    mode = gaps.groupBy(*group).agg(F.max(F.struct("n", (-F.col("gap")).alias("g"))).alias("m")).select(*group, (F.lit(60.0) / -F.col("m.g")).alias("bpm"))
    down = F.greatest(F.floor(F.log2(F.col("bpm") / high)) + 1, F.lit(0))
    up = F.greatest(F.ceil(F.log2(F.lit(low) / F.col("bpm"))), F.lit(0))
    folded = mode.withColumn("bpm", F.col("bpm") * F.pow(F.lit(2.0), up - down))
    known = notes.groupBy(*group).agg((F.lit(None).cast("double") if first_tempo is None else first_tempo).alias("__first"))
    return known.join(folded, group, "left").select(*group, F.coalesce("bpm", "__first", F.lit(DEFAULT_TEMPO)).alias("tempo"))
