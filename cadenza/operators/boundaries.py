"""Boundaries of tracks from what repeats in them: frequent patterns, warped repeats, rhythm clusters; and fixed slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.cluster import kmeans
from cadenza.operators.distance import dtw_repeats
from cadenza.operators.ngrams import windows
from cadenza.operators.timeline import in_ranges, label_changes, silence_regions, spaced_boundaries

GROUP = ["file_id", "track_id"]


def top_patterns(found: DataFrame, k: int = 20, least_count: int = 2, group: list[str] = GROUP) -> DataFrame:
    """(group, gram): the first ``k`` frequent grams of each track in the order of their first occurrence."""
    counts = found.groupBy(*group, "gram").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).where(F.col("n") >= least_count)
    return counts.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy("first", "gram"))).where(F.col("__k") <= k).select(*group, "gram")


def pattern_marks(notes: DataFrame, tokens: list[Column], n: int, threshold: int, k: int = 20, group: list[str] = GROUP) -> DataFrame:
    """(group, pos): where occurrences of top patterns of any token begin, and where their durations would end, unless they begin in a silent region."""
    marks = None
    for token in tokens:
        found = windows(notes, token, n, group)
        held = found.join(top_patterns(found, k, 2, group), [*group, "gram"], "left_semi").select(*group, F.col("start"), (F.col("start") + F.col("total_dur")).alias("stop"))
        marks = held if marks is None else marks.unionByName(held)
    outside = in_ranges(marks.distinct(), silence_regions(notes, threshold, group), "start", group).where("range_start is null")
    return outside.select(*group, F.explode(F.array(F.col("start").cast("double"), F.col("stop").cast("double"))).alias("pos")).distinct()


def pattern_boundaries(notes: DataFrame, tokens: list[Column], n: int, bar: float, threshold: int = 100, least_bars: float = 2, most_bars: float = 8, k: int = 20, group: list[str] = GROUP) -> DataFrame:
    """(group, pos): pattern marks at least ``least_bars`` apart, with steps of ``most_bars`` in longer stretches; none for a track without patterns."""
    return spaced_boundaries(pattern_marks(notes, tokens, n, threshold, k, group), least_bars * bar, most_bars * bar, "pos", group)


def warped_boundaries(notes: DataFrame, width: int, threshold: float, bar: float, least_bars: float = 2, most_bars: float = 8, pairs: int = 20, group: list[str] = GROUP) -> DataFrame:
    """(group, pos): onsets of the first ``pairs`` pairs of windows that warp onto each other, spaced like pattern boundaries."""
    found = dtw_repeats(notes, width, threshold, group)
    first = found.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy("i", "j"))).where(F.col("__k") <= pairs)
    at = first.select(*group, F.explode(F.array("i", "j")).alias("n")).distinct()
    numbered = notes.select(*group, "start", (F.row_number().over(Window.partitionBy(*group).orderBy("start", "note_id")) - 1).alias("n"))
    marks = numbered.join(at, [*group, "n"]).select(*group, F.col("start").cast("double").alias("pos"))
    return spaced_boundaries(marks, least_bars * bar, most_bars * bar, "pos", group)


def rhythm_boundaries(notes: DataFrame, n: int, clusters: int, least: float, group: list[str] = GROUP, seed: int = 42) -> DataFrame:
    """(group, pos): where the cluster of a window of ``n`` (chord hash, duration) pairs changes, ``least`` apart.

    A chord's name is hashed by xxhash64 to 0..99, which is the same in every process.
    """
    token = F.struct(F.pmod(F.xxhash64((F.col("pitch") % 12).cast("string")), F.lit(100)).cast("double").alias("h"), F.col("dur").cast("double").alias("d"))
    found = windows(notes, token, n, group)
    vectors = found.select(F.struct(*group, "pos", "start").alias("id"), F.flatten(F.transform("gram", lambda g: F.array(g["h"], g["d"]))).alias("vec"))
    labelled = kmeans(vectors, clusters, seed)[0].select("id.*", "label").withColumn("note_id", F.col("pos"))
    return spaced_boundaries(label_changes(labelled, "label", 1, group).withColumnRenamed("at", "pos"), least, None, "pos", group)


def fixed_segments(spark: SparkSession, length: int, step: int) -> DataFrame:
    """(start, end): equal slices from 0."""
    return spark.range(0, length, step).select(F.col("id").alias("start"), F.least(F.col("id") + step, F.lit(length)).alias("end"))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, track_id, pos) from JSON lines."""
    return spark.read.schema("file_id string, track_id string, pos double").json(path)


def max_notes(bars: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, n): notes of the fullest bar."""
    return bars.groupBy(*group).agg(F.max(F.size("notes")).alias("n"))


def melody(notes: DataFrame) -> DataFrame:
    """The first track of each file that has notes, chords as notes of one onset."""
    first = notes.groupBy("file_id").agg(F.min("track_id").alias("track_id"))
    return notes.join(first, ["file_id", "track_id"], "left_semi")


def resolve_paths(wanted: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(wanted, path): the file of each wanted name: as it is, below ``root``, or else the least path of that base name; null for none."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    exact = files.select(F.col("path").alias("__p")).distinct()
    named = files.groupBy(base(F.col("path")).alias("__base")).agg(F.min("path").alias("__named"))
    found = wanted.join(exact.withColumnRenamed("__p", "__as_is"), F.col("wanted") == F.col("__as_is"), "left")
    below = F.concat(F.lit(root.rstrip("/") + "/"), F.col("wanted"))
    found = found.join(exact.withColumnRenamed("__p", "__below"), below == F.col("__below"), "left").join(named, base(F.col("wanted")) == F.col("__base"), "left")
    return found.select("wanted", F.coalesce("__as_is", "__below", "__named").alias("path"))


def sample_queries(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded random order that does not depend on partitions."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
