"""Writers: feature and boundary tables, reports, and MIDI files of patterns, segments, tracks and cuts.

A MIDI file is made where its rows are, one group at a time, and comes back as (name, content), so that a lost task is simply run again.
``save_files`` writes such rows to a folder that all executors share.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources import smf


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, kind: str = "parquet") -> None:
    """Features, scaler, boundaries, assignments or centers as ``parquet``, ``json``, ``csv`` or ``text``."""
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def report_lines(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, value): one line of text per row, for a text report partitioned by ``key``."""
    return df.select(key, F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


def _channel(is_drum: bool, number: int) -> int:
    """Channel 10 for drums, the others in turn without it."""
    return 9 if is_drum else [c for c in range(16) if c != 9][number % 15]


#: What a written file takes over from ``meta``.
CARRIED = ("set_tempo", "time_signature", "key_signature", "lyrics", "marker")


def midi_files(notes: DataFrame, name: list[str], part: str | None = None, ticks_per_beat: int = 480, rebase: bool = True, meta: DataFrame | None = None) -> DataFrame:
    """(name..., content): one file per ``name`` from notes with start_tick, end_tick, pitch, velocity, and is_drum, program and track_name if there are any.

    ``part`` makes a track of each of its values, else the file has one; ``rebase`` moves a file's first onset to 0.  Programs and names come from the notes themselves,
    so a drum track before a melodic one moves nothing.  ``meta`` (some of the name columns, kind, tick, value1, value2, text) are tempos, signatures, keys, lyrics and markers, which
    become the file's first track, moved like the notes; those before the first onset hold from 0.
    """
    have = set(notes.columns)
    extra = [c for c in ("is_drum", "program", "track_name") if c in have]
    parts = [part] if part and part not in (*extra, *name) else []
    types = dict(notes.dtypes)
    schema = ", ".join([*(f"`{n}` {types[n]}" for n in name), "content binary"])
    shared = [n for n in name if meta is not None and n in meta.columns]

    def build(key: tuple, pdf: pd.DataFrame, changes: list[tuple] | None) -> tuple:
        first = int(pdf["start_tick"].min()) if rebase else 0
        midi = smf.MidiFile(1, ticks_per_beat)
        if changes is not None:
            midi.tracks.append(smf.conductor_track(changes, first))
        groups = [g for _, g in pdf.groupby(part, sort=True)] if part else [pdf]
        for number, g in enumerate(groups):
            head = g.iloc[0]
            drum = bool(head["is_drum"]) if "is_drum" in extra else False
            program = str(head["program"]) if "program" in extra else ""
            label = str(head["track_name"]) if "track_name" in extra else (f"{part} {head[part]}" if part else None)
            rows = [(int(a) - first, max(int(b), int(a)) - first, int(p), int(v)) for a, b, p, v in zip(g["start_tick"], g["end_tick"], g["pitch"], g["velocity"], strict=True)]
            midi.tracks.append(smf.notes_track(sorted(rows), _channel(drum, number), int(program) if program.isdigit() else None, label))
        return (*key, smf.encode(midi))

    def alone(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([build(key, pdf, None)], columns=[*name, "content"])

    def together(_: tuple, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        whole = lambda x: None if pd.isna(x) else int(x)
        changes = sorted(((int(t), k, whole(a), whole(b), None if s is None else str(s)) for k, t, a, b, s in zip(found["kind"], found["tick"], found["value1"], found["value2"], found["text"], strict=True)), key=lambda x: (x[0], x[1], x[2] or 0, x[3] or 0, x[4] or ""))
        files = [build(k if isinstance(k, tuple) else (k,), g, changes) for k, g in pdf.groupby(name, sort=True)] if len(pdf) else []
        return pd.DataFrame(files, columns=[*name, "content"])

    rows = notes.select(*name, *parts, "start_tick", "end_tick", "pitch", "velocity", *[c for c in extra if c not in name])
    if meta is None:
        return rows.groupBy(*name).applyInPandas(alone, schema)
    # renamed, as both sides may come from one table
    carried = meta.where(F.col("kind").isin(*CARRIED)).select(*shared, "kind", "tick", "value1", "value2", "text").toDF(*shared, "kind", "tick", "value1", "value2", "text")
    return rows.groupBy(*shared).cogroup(carried.groupBy(*shared)).applyInPandas(together, schema)


def pattern_files(notes: DataFrame, group: list[str], pattern: str = "pattern_no", ticks_per_beat: int = 480, meta: DataFrame | None = None) -> DataFrame:
    """One file per pattern, numbered within its track from 0 by the pattern's own number."""
    return midi_files(notes, [*group, pattern], None, ticks_per_beat, True, meta)


def track_files(notes: DataFrame, group: list[str], pattern: str = "pattern_no", ticks_per_beat: int = 480, meta: DataFrame | None = None) -> DataFrame:
    """One file per track, with each pattern as a track of it."""
    return midi_files(notes, group, pattern, ticks_per_beat, False, meta)


def segment_files(notes: DataFrame, group: list[str], segment: str = "segment_id", least: int = 240, ticks_per_beat: int = 480, meta: DataFrame | None = None) -> DataFrame:
    """One file per segment of at least ``least`` ticks, from its first onset on."""
    spans = notes.groupBy(*group, segment).agg((F.max("end_tick") - F.min("start_tick")).alias("__span")).where(F.col("__span") >= least)
    return midi_files(notes.join(spans.drop("__span"), [*group, segment], "left_semi"), [*group, segment], None, ticks_per_beat, True, meta)


def cut_bars(notes: DataFrame, group: list[str], first: int, last: int, ticks_per_beat: int = 480, beats: int = 4, part: str | None = None, meta: DataFrame | None = None) -> DataFrame:
    """One file per group with the notes that start in bars [first, last), ends clipped, and the changes before the last of them, moved with the notes."""
    a, b = first * beats * ticks_per_beat, last * beats * ticks_per_beat
    held = notes.where((F.col("start_tick") >= a) & (F.col("start_tick") < b)).withColumns({"start_tick": F.col("start_tick") - a, "end_tick": F.least("end_tick", F.lit(b)) - a})
    part = part or ("track_id" if "track_id" in notes.columns and "track_id" not in group else None)
    moved = None if meta is None else meta.where(F.col("tick") < b).withColumn("tick", F.greatest(F.col("tick") - a, F.lit(0)))
    return midi_files(held, group, part, ticks_per_beat, False, moved)


def split_tracks(notes: DataFrame, ticks_per_beat: int = 480, track: str = "track_id", meta: DataFrame | None = None) -> DataFrame:
    """One file per melodic track."""
    return midi_files(notes.where(~F.col("is_drum")), ["file_id", track], None, ticks_per_beat, False, meta)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a temporary one where that is unset and the executors are this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='cadenza-')).rstrip('/')}/tables-{uuid4().hex}"


def save_files(files: DataFrame, folder: str, name: Column) -> DataFrame:
    """(path, length) of files written under ``folder``, a folder that all executors see; each is put in place whole by a rename, so a second attempt is harmless.

    ``name`` is the path below the folder.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for n, content in zip(pdf["name"], pdf["content"], strict=True):
                path = Path(folder, n)
                path.parent.mkdir(parents=True, exist_ok=True)
                draft = path.with_name(f".{path.name}.{uuid4().hex}")
                draft.write_bytes(content)
                os.replace(draft, path)
                done.append((str(path), len(content)))
            yield pd.DataFrame(done, columns=["path", "length"])

    return files.select(name.alias("name"), "content").mapInPandas(run, "path string, length long")
