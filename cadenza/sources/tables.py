"""Note views of tables that hold no MIDI: canonical columns file_id, track_id, note_id, pitch, velocity, start, dur, end, is_drum, program."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as notes in seconds: a user is a track, error events are drums."""
    return notes_of_events(table(spark, sf_dir, "events"))


def notes_of_events(events: DataFrame, *more: Column) -> DataFrame:
    """The same of a batch or a stream of events, with ``more`` columns."""
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(
        F.lit("events").alias("file_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("note_id"), (F.floor("value").cast("int") % 128).alias("pitch"), k.alias("velocity"),
        start.alias("start"), k.alias("dur"), (start + k).alias("end"), (F.col("event_type") == "error").alias("is_drum"), F.col("event_type").alias("program"), *more,
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as notes in ticks of a minute since the file's first: a user is a file, an event type a track of it."""
    notes = event_notes(spark, sf_dir).withColumns({"file_id": F.concat(F.lit("user-"), F.col("track_id").cast("string")), "track_name": F.col("program"), "__tick": F.floor(F.col("start") / 60)})
    first = F.min("__tick").over(Window.partitionBy("file_id"))
    return notes.withColumn("start_tick", F.col("__tick") - first).withColumn("end_tick", F.col("start_tick") + F.col("dur")).drop("__tick", "start", "end", "track_id")


def event_meta(ticks: DataFrame) -> DataFrame:
    """(file_id, kind, tick, value1, value2, text): every tenth event sets a tempo, a signature, a key, a lyric or a marker."""
    e = F.col("note_id")
    which = F.floor(e / 10) % 5
    case = lambda *v: F.when(which == 0, v[0]).when(which == 1, v[1]).when(which == 2, v[2]).when(which == 3, v[3]).otherwise(v[4])
    none = F.lit(None)
    return ticks.where(e % 10 == 3).select(
        "file_id", case(*map(F.lit, ("set_tempo", "time_signature", "key_signature", "lyrics", "marker"))).alias("kind"), F.col("start_tick").alias("tick"), case(300_000 + (e % 7) * 50_000, 3 + e % 3, e % 5 - 2, none, none).cast("int").alias("value1"),
        case(none, F.when(F.floor(e / 100) % 2 == 0, 4).otherwise(8), F.lit(0), none, none).cast("int").alias("value2"), case(none, none, none, F.concat(F.lit("la"), e.cast("string")), F.concat(F.lit("m"), e.cast("string"))).alias("text"),
    )


def lineitem_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as notes in days, with chords: a supplier is a file, a return flag a track."""
    start, dur = F.datediff("l_shipdate", F.lit("1990-01-01")), F.round(F.col("l_discount") * 1000).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file_id"), F.col("l_returnflag").alias("track_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("note_id"), F.col("l_quantity").cast("int").alias("pitch"), dur.alias("velocity"),
        start.alias("start"), dur.alias("dur"), (start + dur).alias("end"), (F.col("l_linestatus") == "F").alias("is_drum"), F.col("l_linestatus").alias("program"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as (id, vec, label) with doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def melodic(notes: DataFrame) -> DataFrame:
    """Without drums."""
    return notes.where(~F.col("is_drum"))
