"""Time on a track: silence, pauses, clusters, bars, ranges, as-of values and boundaries.

Every operator orders notes by (start, note_id) within ``group``; a range join is written as an equi-join on the bars a row touches or as
a union with a running value, so that no join compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.schema import DEFAULT_BAR_TICKS

GROUP = ["file_id", "track_id"]


def _order(group: list[str]) -> Window:
    return Window.partitionBy(*group).orderBy("start", "note_id")


def _running(flag: Column, group: list[str]) -> Column:
    return F.sum(flag.cast("long")).over(_order(group).rowsBetween(Window.unboundedPreceding, 0))


def silence_segments(notes: DataFrame, bar: Column | float, group: list[str] = GROUP) -> DataFrame:
    """``notes`` with ``segment_id`` from 0: a new segment begins where the silence since everything before has ended is longer than ``bar``."""
    ended = F.max("end").over(_order(group).rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce(F.col("start") - ended > (bar if isinstance(bar, Column) else F.lit(bar)), F.lit(False))
    return notes.withColumn("__new", gap).withColumn("segment_id", _running(F.col("__new"), group)).drop("__new")


def segment_summary(notes: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, segment_id, start, end, n_notes) of notes with a segment."""
    return notes.groupBy(*group, "segment_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_notes"))


def pause_segments(notes: DataFrame, bar: float, group: list[str] = GROUP) -> DataFrame:
    """``notes`` with ``segment_id``: a new segment after a pause longer than ``bar`` since the end of the note before."""
    w = _order(group)
    gap = F.coalesce(F.col("start") - (F.lag("start").over(w) + F.lag("dur").over(w)) > bar, F.lit(False))
    return notes.withColumn("__new", gap).withColumn("segment_id", _running(F.col("__new"), group)).drop("__new")


def onset_clusters(notes: DataFrame, eps: float, least: int = 2, group: list[str] = GROUP) -> DataFrame:
    """``notes`` with ``cluster``: density clusters in one dimension are runs of onsets at most ``eps`` apart; -1 for smaller runs, the others numbered from 0."""
    gap = F.coalesce(F.col("start") - F.lag("start").over(_order(group)) > eps, F.lit(False))
    runs = notes.withColumn("__new", gap).withColumn("__run", _running(F.col("__new"), group)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*group, "__run")))
    number = F.dense_rank().over(Window.partitionBy(*group, F.col("__n") >= least).orderBy("__run")) - 1
    return runs.withColumn("cluster", F.when(F.col("__n") >= least, number).otherwise(-1)).drop("__new", "__run", "__n")


def bucket_pause_segments(notes: DataFrame, bar: float, buckets: int = 15, group: list[str] = GROUP) -> DataFrame:
    """``notes`` with ``bucket`` and ``segment_id``: equal buckets by position, the rest in the last one; a segment ends at a bucket's end or a long pause."""
    w = _order(group)
    size = F.floor(F.count(F.lit(1)).over(Window.partitionBy(*group)) / buckets)
    bucket = F.when(size == 0, buckets - 1).otherwise(F.least(F.floor((F.row_number().over(w) - 1) / size), F.lit(buckets - 1))).cast("int")
    marked = notes.withColumn("bucket", bucket)
    pause = F.col("start") - (F.lag("start").over(w) + F.lag("dur").over(w)) > bar
    new = F.coalesce((F.col("bucket") != F.lag("bucket").over(w)) | pause, F.lit(False))
    return marked.withColumn("__new", new).withColumn("segment_id", _running(F.col("__new"), group)).drop("__new")


def in_bars(notes: DataFrame, bar: int) -> DataFrame:
    """One row per note and bar that it sounds in (start < bar end and end > bar start), with ``bar``; a note of no length within a bar counts there."""
    first, last = F.floor(F.col("start") / bar), F.floor((F.col("end") - 1) / bar)
    return notes.withColumn("bar", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def bars(notes: DataFrame, bar: int, group: list[str] = GROUP) -> DataFrame:
    """(group, bar, start, end, notes): non-empty bars on the grid of 0; the last one ends with the track."""
    # dealt by track once: the bars and whatever follows on tracks need no second shuffle
    ended = notes.withColumn("__end", F.max("end").over(Window.partitionBy(*group)))
    held = in_bars(ended, bar).groupBy(*group, "bar").agg(F.array_sort(F.collect_list(F.struct("start", "note_id", "pitch", "dur", "velocity", "end"))).alias("notes"), F.max("__end").alias("__end"))
    return held.select(*group, "bar", (F.col("bar") * bar).alias("start"), F.least((F.col("bar") + 1) * bar, "__end").alias("end"), "notes")


def empty_bars(notes: DataFrame, bar: int, group: list[str] = GROUP) -> DataFrame:
    """(group, bar): bars between a track's first and last one that no note sounds in."""
    return absent_bars(in_bars(notes, bar).select(*group, "bar").distinct(), group)


def absent_bars(held: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, bar): the bars missing between each two neighbours of a track's bars; a gap costs one row until it is exploded."""
    gaps = held.select(*group, "bar", F.lead("bar").over(Window.partitionBy(*group).orderBy("bar")).alias("__next")).where(F.col("__next") > F.col("bar") + 1)
    return gaps.select(*group, F.explode(F.sequence(F.col("bar") + 1, F.col("__next") - 1)).alias("bar"))


def runs(rows: DataFrame, at: str, group: list[str], least: int = 1) -> DataFrame:
    """(group, first, last, n): maximal runs of consecutive integers ``at`` of ``least`` members or more."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*group).orderBy(at))
    return rows.withColumn("__island", island).groupBy(*group, "__island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("__island")


def silence_regions(notes: DataFrame, threshold: int, group: list[str] = GROUP) -> DataFrame:
    """(group, start, end): runs of notes softer than ``threshold`` up to the next loud onset; a run that stays open is dropped."""
    w = _order(group)
    soft = F.col("velocity") < threshold
    new = F.coalesce(soft != F.lag(soft).over(w), F.lit(True))
    runs_ = notes.withColumn("__soft", soft).withColumn("__new", new).withColumn("__run", _running(F.col("__new"), group)).groupBy(*group, "__run").agg(F.first("__soft").alias("soft"), F.min("start").alias("start"))
    return runs_.withColumn("end", F.lead("start").over(Window.partitionBy(*group).orderBy("__run"))).where("soft and end is not null").select(*group, "start", "end")


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, group: list[str] = GROUP) -> DataFrame:
    """``points`` with ``range_start`` and ``range_end`` of the range (start <= at < end) they fall in, null outside; ranges of a group don't overlap.

    A range join without a loop: ranges and points are sorted together and the last range's start is carried along.
    """
    marked = points.withColumn("__at", F.col(at).cast("double")).withColumn("__r", F.lit(None).cast("struct<s:double,e:double>"))
    opened = ranges.select(*group, F.col("start").cast("double").alias("__at"), F.struct(F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e")).alias("__r")).where("__r.e > __r.s")
    order = Window.partitionBy(*group).orderBy("__at", F.col("__r.s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.unionByName(opened, allowMissingColumns=True).withColumn("__last", F.last("__r", True).over(order)).where("__r is null")
    inside = F.col("__at") < F.col("__last.e")
    return carried.withColumns({"range_start": F.when(inside, F.col("__last.s")), "range_end": F.when(inside, F.col("__last.e"))}).drop("__at", "__r", "__last")


def as_of(points: DataFrame, changes: DataFrame, at: str, value: str, group: list[str]) -> DataFrame:
    """``points`` with ``value`` of the last change at or before ``at``; null before the first; of changes at one time the largest value holds."""
    marked = points.withColumns({"__at": F.col(at).cast("double"), "__point": F.lit(1)})
    other = changes.groupBy(*group, F.col("time").cast("double").alias("__at")).agg(F.max(value).alias(value)).withColumn("__point", F.lit(0))
    order = Window.partitionBy(*group).orderBy("__at", "__point").rowsBetween(Window.unboundedPreceding, 0)
    return marked.unionByName(other, allowMissingColumns=True).withColumn(value, F.last(value, True).over(order)).where("__point = 1").drop("__at", "__point")


def bar_ticks_as_of(notes: DataFrame, signatures: DataFrame, ticks_per_beat: int, group: list[str]) -> DataFrame:
    """``notes`` with ``bar_ticks`` under the signature (time, numerator) then in force; the fallback where there is none yet."""
    found = as_of(notes, signatures, "start", "numerator", group)
    return found.withColumn("bar_ticks", F.coalesce(F.col("numerator") * ticks_per_beat, F.lit(DEFAULT_BAR_TICKS)).cast("long")).drop("numerator")


def trim_lead(notes: DataFrame, group: list[str]) -> DataFrame:
    """All notes, drums too, earlier by the first melodic onset of the group, where that is after 0."""
    first = F.min(F.when(~F.col("is_drum"), F.col("start"))).over(Window.partitionBy(*group))
    shift = F.greatest(F.coalesce(first, F.lit(0)), F.lit(0))
    return notes.withColumn("__shift", shift).withColumns({"start": F.col("start") - F.col("__shift"), "end": F.col("end") - F.col("__shift")}).drop("__shift")


def cut_range(notes: DataFrame, first: float, last: float) -> DataFrame:
    """Notes that start in [first, last), from 0 on, their ends clipped."""
    return notes.where((F.col("start") >= first) & (F.col("start") < last)).withColumns({"start": F.col("start") - first, "end": F.least(F.col("end"), F.lit(last)) - first}).withColumn("dur", F.col("end") - F.col("start"))


def cut_segments(notes: DataFrame, segments: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Notes of each segment (start <= onset < end), from the segment's start on, ends clipped to it."""
    found = in_ranges(notes, segments, "start", group).where("range_start is not null")
    return found.withColumns({"start": F.col("start") - F.col("range_start"), "end": F.least("end", "range_end") - F.col("range_start")})


def label_changes(notes: DataFrame, label: str, run_length: int = 1, group: list[str] = GROUP) -> DataFrame:
    """(group, at, label): where the label of a run of ``run_length`` notes changes; the boundary is the onset of the run's last note."""
    w = _order(group)
    at = F.lead("start", run_length - 1).over(w) if run_length > 1 else F.col("start")
    return notes.withColumns({"__before": F.lag(label).over(w), "at": at}).where((F.col(label) != F.col("__before")) & F.col("at").isNotNull()).select(*group, "at", F.col(label).alias("label"))


def boundary_ranges(boundaries: DataFrame, at: str = "pos", group: list[str] = GROUP) -> DataFrame:
    """(group, start, end) between neighbouring boundaries."""
    return boundaries.withColumn("end", F.lead(at).over(Window.partitionBy(*group).orderBy(at))).where("end is not null").select(*group, F.col(at).alias("start"), "end")


def _spaced(positions: Column, least: float, most: float | None) -> Column:
    """Positions at least ``least`` after the last kept one; longer stretches are first filled in steps of ``most``."""
    empty = F.array().cast("array<double>")

    def keep(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        if most is None:
            return F.when((F.size(kept) == 0) | (p - last >= least), F.concat(kept, F.array(p))).otherwise(kept)
        # steps of ``most`` that stay short of p
        steps = F.greatest(F.ceil((p - last) / most) - 1, F.lit(0)).cast("int")
        filled = F.when(steps > 0, F.concat(kept, F.transform(F.sequence(F.lit(1), steps), lambda i: last + i * most))).otherwise(kept)
        far = p - (last + steps * most) >= least
        return F.when(F.size(kept) == 0, F.array(p)).when(far, F.concat(filled, F.array(p))).otherwise(filled)

    return F.aggregate(F.array_sort(F.array_distinct(positions)), empty, keep)


def spaced_boundaries(boundaries: DataFrame, least: float, most: float | None = None, at: str = "pos", group: list[str] = GROUP) -> DataFrame:
    """(group, pos): an order-dependent fold over each group's boundaries, inside the JVM."""
    each = boundaries.groupBy(*group).agg(F.collect_list(F.col(at).cast("double")).alias("__p"))
    return each.select(*group, F.explode(_spaced(F.col("__p"), least, most)).alias("pos"))


def merge_small(segments: DataFrame, least: float, group: list[str] = GROUP) -> DataFrame:
    """(group, start, end, repetitions, motif_id): a left fold that joins neighbours while either is shorter than ``least``."""
    kind = "struct<start:double,end:double,repetitions:bigint,motif_id:bigint>"
    rows = F.array_sort(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("repetitions").cast("long").alias("repetitions"), F.col("motif_id").cast("long").alias("motif_id"))))

    def fold(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        short = (s["end"] - s["start"] < least) | (last["end"] - last["start"] < least)
        joined = F.struct(F.least(last["start"], s["start"]).alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.greatest(last["repetitions"], s["repetitions"]).alias("repetitions"), F.when(last["motif_id"] != -1, last["motif_id"]).otherwise(s["motif_id"]).alias("motif_id"))
        return F.when(F.size(kept) == 0, F.array(s)).when(short, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(joined))).otherwise(F.concat(kept, F.array(s)))

    return segments.groupBy(*group).agg(rows.alias("__s")).select(*group, F.explode(F.aggregate("__s", F.array().cast(f"array<{kind}>"), fold)).alias("s")).select(*group, "s.*")


def gap_merge(intervals: DataFrame, gap: float, group: list[str] = GROUP) -> DataFrame:
    """(group, start, end): intervals in time order, joined where the next begins at most ``gap`` after all before have ended."""
    w = Window.partitionBy(*group).orderBy("start", "end")
    new = F.coalesce(F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap, F.lit(False))
    marked = intervals.withColumn("__new", new).withColumn("__run", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def midi_summary(notes: DataFrame, group: list[str]) -> DataFrame:
    """(group, duration, n_tracks, n_notes, any_drum, programs)."""
    return notes.groupBy(*group).agg(F.max("end").alias("duration"), F.count_distinct("track_id").alias("n_tracks"), F.count(F.lit(1)).alias("n_notes"), F.bool_or("is_drum").alias("any_drum"), F.array_sort(F.collect_set("program")).alias("programs"))


def roll_bounds(notes: DataFrame, group: list[str], padding: int = 3) -> DataFrame:
    """(group, low, high, start, end) of a piano roll, padded; 60..72 and 0..4 where nothing sounds."""
    return notes.groupBy(*group).agg(
        F.greatest(F.coalesce(F.min("pitch"), F.lit(60)) - padding, F.lit(0)).alias("low"), F.least(F.coalesce(F.max("pitch"), F.lit(72)) + padding, F.lit(127)).alias("high"), F.coalesce(F.min("start"), F.lit(0)).alias("start"), F.coalesce(F.max("end"), F.lit(4)).alias("end")
    )
