"""Batch and stream give the same results."""

import shutil

import pytest
from pyspark.sql import functions as F

from cadenza.operators import ngrams
from cadenza.operators import timeline as t
from cadenza.sources import midi, smf
from cadenza.sources.tables import event_notes, melodic, table
from cadenza.streaming import live

from test_midi import random_file, song


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def stamped(spark, sf_dir, tmp_path_factory):
    """Melodic events in three files, in time order, and a last one far later that closes what is open."""
    n = melodic(event_notes(spark, sf_dir)).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("note_id"), F.col("ts").cast("timestamp").alias("ts")), "note_id").select("track_id", "note_id", "pitch", "dur", "start", "end", "ts")
    data = n.toPandas().sort_values(["ts", "note_id"])
    folder = str(tmp_path_factory.mktemp("stream"))
    third = len(data) // 3 + 1
    for k in range(3):
        spark.createDataFrame(data[k * third : (k + 1) * third], n.schema).coalesce(1).write.parquet(f"{folder}/part{k}")
    end = n.agg(F.max("ts") + F.expr("interval 400 days")).first()[0]
    last = spark.createDataFrame([(-1, -1, 0, 0, 0.0, 0.0, end)], n.schema)
    last.coalesce(1).write.parquet(f"{folder}/part3")
    flat = str(tmp_path_factory.mktemp("flat"))
    import glob
    import os
    import time

    for k, f in enumerate(sorted(glob.glob(f"{folder}/part*/*.parquet"), key=lambda x: x.split("/part")[1])):
        shutil.copy(f, f"{flat}/{k}.parquet")
        os.utime(f"{flat}/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return n, flat


def test_sessions(spark, stamped):
    n, folder = stamped
    bar = 86_400
    batch = t.segment_summary(t.silence_segments(n, bar, ["track_id"]), ["track_id"])
    want = sorted((r.track_id, round(r.start, 3), r.n_notes) for r in batch.collect())
    for got in (live.silence_sessions(n, bar), live.replay(n, lambda s: live.silence_sessions(s, bar), "sessions", folder)):
        assert sorted((r.track_id, round(r.start.timestamp(), 3), r.n_notes) for r in got.where("track_id >= 0").collect()) == want


def test_tumbling(spark, stamped):
    n, folder = stamped
    assert rows(live.replay(n, lambda s: live.tumbling_bars(s, "1 day"), "bars", folder).where("track_id >= 0")) == rows(live.tumbling_bars(n, "1 day"))


def test_ngrams(spark, stamped):
    n, folder = stamped
    batch = ngrams.windows(n, F.col("pitch"), 3, ["track_id"], ("ts", "note_id")).select("track_id", F.col("pos").cast("long"), F.array_join(F.transform("gram", lambda x: x.cast("string")), ",").alias("gram"))
    assert rows(live.replay(n, lambda s: live.sliding_ngrams(s, 3), "grams", folder)) == rows(batch)


def test_pairing(spark, tmp_path):
    for seed in range(4):
        (tmp_path / f"r{seed}.mid").write_bytes(smf.encode(random_file(seed)))
    found = midi.read_events(spark, str(tmp_path))
    raw = midi.raw_notes(found).withColumn("track_id", F.col("track_id").cast("long"))
    raw.orderBy("file_id", "track_id", "seq").coalesce(1).write.parquet(str(tmp_path / "raw"))
    got = live.replay(raw, live.pair_notes, "paired", str(tmp_path / "raw"))
    assert rows(got) == rows(midi.pair_lifo(found).select("file_id", F.col("track_id").cast("long"), "pitch", "start_tick", "end_tick", "velocity"))


def test_watch(spark, tmp_path):
    songs, catalogue, checkpoint = tmp_path / "songs", str(tmp_path / "catalogue"), str(tmp_path / "checkpoint")
    songs.mkdir()
    (songs / "a.mid").write_bytes(smf.encode(song()))
    live.watch_folder(spark, str(songs), catalogue, checkpoint).awaitTermination()
    (songs / "b.mid").write_bytes(smf.encode(song(pitches=(70, 71))))
    (songs / "c.mid").write_bytes(b"broken")
    live.watch_folder(spark, str(songs), catalogue, checkpoint).awaitTermination()
    found = {r.file_id[-5:]: r.pitch_mean for r in live.read_catalogue(spark, catalogue).collect()}
    assert found == {"a.mid": 61.0, "b.mid": 70.5}


def test_pairing_in_buckets(spark, tmp_path):
    """state and calls are bounded by the buckets, not one for each pitch of a track; notes stay open from batch to batch, apart from those of other pitches, tracks and files in their bucket."""
    import os

    marks = [(f, t, p, s, 10 * s + p, v) for f in ("a", "b", None) for t in range(5) for p in range(8) for s, v in enumerate((0, 90, 91, 0, 92, 0, 0, 0, 93) if p % 2 else (80, 81, 82, 0))]
    schema = "file_id string, track_id long, pitch int, seq int, time long, velocity int"
    for k, (a, b) in enumerate(((0, 2), (2, 5), (5, 9))):
        spark.createDataFrame([m for m in marks if a <= m[3] < b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
        for f in (tmp_path / "raw").glob("*.parquet"):
            if f.stat().st_mtime > 1e9:  # not dated yet
                os.utime(f, (1e8 + k, 1e8 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "raw"))
    query = live.pair_notes(stream).writeStream.format("memory").queryName("bucketed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    want = []
    for f, t, p in {m[:3] for m in marks}:
        held = []
        for *_, time, v in (m for m in marks if m[:3] == (f, t, p)):
            if v:
                held.append((time, v))
            elif held:
                start, loud = held.pop()
                want.append((f, t, p, start, time, loud))
    order = lambda found: sorted(found, key=lambda r: (r[0] or "", *r[1:]))
    assert len(progress) == 3 and order(map(tuple, spark.table("bucketed").collect())) == order(want)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "raw"))
    query = live.pair_notes(stream, 4).writeStream.format("memory").queryName("four").outputMode("append").start()
    query.processAllAvailable()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"])
    query.stop()
    assert held <= 4 and order(map(tuple, spark.table("four").collect())) == order(want)
