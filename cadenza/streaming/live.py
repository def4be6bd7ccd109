"""Streaming counterparts: note pairing, silence sessions, bars, n-grams, and a catalogue that grows as files arrive.

Each takes a streaming or a static DataFrame of the same columns; on a stream that is closed by later events the results are those of the batch operators.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.features import features10
from cadenza.sources import midi

_NOTE = "file_id string, track_id long, pitch int, start_tick long, end_tick long, velocity int"
_PITCH = ["file_id", "track_id", "pitch"]


def pair_notes(raw: DataFrame, buckets: int = 1024) -> DataFrame:
    """(file_id, track_id, pitch, start_tick, end_tick, velocity) of on and off events (file_id, track_id, seq, time, pitch, velocity), last opened first closed.

    Pitches of tracks are dealt to ``buckets``, as most have a few events a batch and a call for each would cost far more than its work.  The state of a bucket is
    the open notes of its pitches, later ones behind, and goes with the last of them; what a track leaves open stays, at most a few notes a pitch.
    """

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: defaultdict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for *key, start, velocity in zip(*state.get, strict=True) if state.exists else ():
            held[tuple(key)].append((start, velocity))
        rows = pd.concat(list(batches)).sort_values(["time", "seq"], kind="stable")
        keys = zip(*(rows[c].astype(object).where(rows[c].notna(), None) for c in _PITCH), strict=True)
        out = []
        for key, time, velocity in zip(keys, rows["time"], rows["velocity"], strict=True):
            if velocity > 0:
                held[key].append((int(time), int(velocity)))
            elif notes := held.get(key):
                start, loud = notes.pop()
                out.append((*key, start, int(time), loud))
        still = [(*key, *note) for key, notes in held.items() for note in notes]
        if still:
            state.update(tuple(map(list, zip(*still, strict=True))))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[*_PITCH, "start_tick", "end_tick", "velocity"])

    dealt = raw.withColumn("__bucket", F.pmod(F.xxhash64(*_PITCH), F.lit(buckets)))
    return dealt.groupBy("__bucket").applyInPandasWithState(run, _NOTE, "files array<string>, tracks array<long>, pitches array<int>, starts array<long>, velocities array<int>", "append", GroupStateTimeout.NoTimeout)


def silence_sessions(notes: DataFrame, bar_seconds: float, late: str = "10 minutes", group: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(group, start, end, n_notes) of silence segments over event time ``ts`` with durations ``dur`` in seconds.

    A session's gap is the note's length plus a bar and one microsecond, since silence of exactly a bar does not part segments but a session closes at its gap.
    """
    gap = F.concat(((F.col("dur") + F.lit(bar_seconds)) * 1e6 + 1).cast("long").cast("string"), F.lit(" microseconds"))
    timed = notes.withWatermark("ts", late) if notes.isStreaming else notes
    found = timed.groupBy(*group, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_notes"), F.max(F.col("ts") + F.make_dt_interval(secs=F.col("dur"))).alias("end"))
    return found.select(*group, F.col("session_window.start").alias("start"), "end", "n_notes")


def tumbling_bars(notes: DataFrame, bar: str, late: str = "10 minutes", group: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(group, start, end, n_notes, low, high) of the onsets in each bar of event time."""
    timed = notes.withWatermark("ts", late) if notes.isStreaming else notes
    found = timed.groupBy(*group, F.window("ts", bar)).agg(F.count(F.lit(1)).alias("n_notes"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))
    return found.select(*group, "window.start", "window.end", "n_notes", "low", "high")


def sliding_ngrams(notes: DataFrame, n: int) -> DataFrame:
    """(track_id, pos, gram) of the pitches of each track, in the order of (ts, note_id) within and across batches; the state is the last n - 1 pitches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, seen = (list(state.get[0]), int(state.get[1])) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "note_id"], kind="stable")
        tokens = [*tail, *map(int, rows["pitch"])]
        first = seen - len(tail)
        out = [(key[0], first + i, ",".join(map(str, tokens[i : i + n]))) for i in range(len(tokens) - n + 1)]
        state.update((tokens[len(tokens) - (n - 1) :] if len(tokens) >= n else tokens, seen + len(rows)))
        if out:
            yield pd.DataFrame(out, columns=["track_id", "pos", "gram"])

    return notes.groupBy("track_id").applyInPandasWithState(run, "track_id long, pos long, gram string", "tail array<int>, seen long", "append", GroupStateTimeout.NoTimeout)


def watch_folder(spark: SparkSession, folder: str, catalogue: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Add the features of MIDI files that arrive in ``folder`` to the table at ``catalogue``.

    A batch writes its own partition, named by its number, so a batch that runs again after a failure replaces itself; ``read_catalogue`` takes the latest state of a file.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{mid,midi,MID,MIDI}").option("recursiveFileLookup", "true").load(folder)

    def add(batch: DataFrame, number: int) -> None:
        found = midi.events(batch)
        notes = midi.notes(found).where(~F.col("is_drum"))
        made = features10(notes.withColumn("__listed", F.col("track_id")), ["file_id"], ("track_id", "note_id"))
        stamped = made.join(batch.select(F.col("path").alias("file_id"), "modificationTime"), "file_id")
        stamped.write.mode("overwrite").parquet(f"{catalogue}/batch={number}")

    query = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def read_catalogue(spark: SparkSession, catalogue: str) -> DataFrame:
    """The latest features of each file."""
    table = spark.read.parquet(catalogue)
    latest = table.groupBy("file_id").agg(F.max(F.struct("modificationTime", "batch")).alias("__l"))
    return table.join(latest, "file_id").where((F.col("modificationTime") == F.col("__l.modificationTime")) & (F.col("batch") == F.col("__l.batch"))).drop("__l", "batch", "modificationTime")


def replay(df: DataFrame, make: Callable[[DataFrame], DataFrame], name: str, folder: str) -> DataFrame:
    """Run ``make`` over the parquet files of ``folder``, one a batch, and return what it appended; for checks of batch against stream."""
    spark = df.sparkSession
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source holds now and return the table it leaves at ``folder``; ``complete``: the last whole result."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/table")).start()
    else:
        query = writer.format("parquet").start(f"{folder}/table")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
