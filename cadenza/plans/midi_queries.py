"""MIDI files made from the events view, read back, cut and listed; tables written and read; and the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import expr
from cadenza.operators import boundaries, features, search
from cadenza.operators import timeline as t
from cadenza.plans.feature_queries import tracks10
from cadenza.plans.oracle import F10, FEATURES, LAGS, E, L
from cadenza.plans.registry import joined, query, r, rounded
from cadenza.plans.timeline_queries import _BARS, _SEG, _SUMMARY, BAR_E, BAR_L, FILE_TRACK, TRACK, _lines
from cadenza.sources import midi, sinks
from cadenza.sources.tables import event_meta, event_notes, event_ticks, melodic, notes_of_events, table
from cadenza.streaming import live

#: Ticks of a beat in the files, of the silence that parts segments, and of the shortest segment that is written.
BEAT, SILENCE, LEAST = 96, 1440, 240
NAMES = ["customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier", "benchmark", "conversations"]


def _files(spark: SparkSession, d: str) -> DataFrame:
    ticks = event_ticks(spark, d)
    return sinks.midi_files(ticks, ["file_id"], "track_name", BEAT, False, event_meta(ticks)).withColumnRenamed("file_id", "path")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return midi.events(_files(spark, d))


# notes in ticks; tracks numbered by name behind the conductor's; on and off marks in the order of the file
_K = f"""{E}, t0 AS (SELECT 'user-' || track_id AS file_id, program AS track_name, note_id, pitch, velocity, dur, is_drum, CAST(floor(start / 60) AS BIGINT) AS tick FROM notes), tk AS (SELECT *, tick - min(tick) OVER (PARTITION BY file_id) AS a, tick - min(tick) OVER (PARTITION BY file_id) + dur AS b FROM t0),
  tn AS (SELECT file_id, track_name, CAST(row_number() OVER (PARTITION BY file_id ORDER BY track_name) AS INT) AS track_id FROM (SELECT DISTINCT file_id, track_name FROM tk)),
  me AS (SELECT file_id, a AS tick, note_id AS e, ['set_tempo', 'time_signature', 'key_signature', 'lyrics', 'marker'][note_id // 10 % 5 + 1] AS kind FROM tk WHERE note_id % 10 = 3),
  mt AS (SELECT file_id, tick, kind, CAST(CASE kind WHEN 'set_tempo' THEN 300000 + e % 7 * 50000 WHEN 'time_signature' THEN 3 + e % 3 WHEN 'key_signature' THEN e % 5 - 2 END AS INT) AS value1, CAST(CASE kind WHEN 'time_signature' THEN CASE WHEN e // 100 % 2 = 0 THEN 4 ELSE 8 END WHEN 'key_signature' THEN 0 END AS INT) AS value2, CASE kind WHEN 'lyrics' THEN 'la' || e WHEN 'marker' THEN 'm' || e END AS text FROM me)"""


def _marks(source: str, keys: str) -> str:
    """SQL: raw (keys, time, pitch, velocity, seq) of the notes (a, b, pitch, velocity) of ``source``."""
    return f"""nk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY a, b, pitch, velocity) AS k FROM {source}), om AS (SELECT {keys}, a AS time, 1 AS o, k, pitch, greatest(1, least(127, velocity)) AS velocity FROM nk UNION ALL SELECT {keys}, b, CASE WHEN b > a THEN 0 ELSE 2 END, k, pitch, 0 FROM nk),
  raw AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY time, o, k) AS seq FROM om)"""


_RAW = f"{_K}, nn AS (SELECT tk.*, track_id FROM tk JOIN tn USING (file_id, track_name)), {_marks('nn', 'file_id, track_id')}"
_SECONDS = f"""tp AS (SELECT file_id, tick, max(value1) AS us FROM mt WHERE kind = 'set_tempo' GROUP BY ALL), t1 AS (SELECT * FROM tp UNION ALL SELECT DISTINCT file_id, 0, 500000 FROM tk WHERE file_id NOT IN (SELECT file_id FROM tp WHERE tick = 0)),
  t2 AS (SELECT *, us / 1e6::DOUBLE / {BEAT} AS per, coalesce((tick - lag(tick) OVER w) * lag(us / 1e6::DOUBLE / {BEAT}) OVER w, 0) AS passed FROM t1 WINDOW w AS (PARTITION BY file_id ORDER BY tick)), t3 AS (SELECT *, sum(passed) OVER (PARTITION BY file_id ORDER BY tick) AS s FROM t2)"""
_LIFO = """lv AS (SELECT *, sum(CASE WHEN velocity > 0 THEN 1 ELSE -1 END) OVER (PARTITION BY file_id, track_id, pitch ORDER BY seq) + CASE WHEN velocity > 0 THEN 0 ELSE 1 END AS level FROM raw),
  pr AS (SELECT *, lead(time) OVER (PARTITION BY file_id, track_id, pitch, level ORDER BY seq) AS stop FROM lv), lifo AS (SELECT file_id, track_id, pitch, time AS start_tick, stop AS end_tick, velocity FROM pr WHERE velocity > 0)"""


@query(f"WITH {_RAW} SELECT file_id, track_id, time, pitch, CAST(velocity AS INT) AS velocity FROM raw")
def midi_raw_events_E(spark: SparkSession, d: str) -> DataFrame:
    return midi.raw_notes(_events(spark, d)).drop("seq")


@query(
    f"""WITH {_RAW}, {_LIFO}, {_SECONDS} SELECT n.file_id, n.track_id, pitch, start_tick, end_tick, CAST(velocity AS INT) AS velocity, round(x.s + (start_tick - x.tick) * x.per, 9) AS start, round(y.s + (end_tick - y.tick) * y.per, 9) AS "end", track_name = 'error' AS is_drum
  FROM lifo n ASOF JOIN t3 x ON n.file_id = x.file_id AND n.start_tick >= x.tick ASOF JOIN t3 y ON n.file_id = y.file_id AND n.end_tick >= y.tick JOIN tn ON tn.file_id = n.file_id AND tn.track_id = n.track_id"""
)
def midi_notes_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(midi.notes(_events(spark, d)).select("file_id", "track_id", "pitch", "start_tick", "end_tick", "velocity", "start", "end", "is_drum"), "start", "end", digits=9)


@query(f"WITH {_RAW}, lg AS (SELECT *, lag(time) OVER w AS start_tick, lag(velocity) OVER w AS v FROM raw WINDOW w AS (PARTITION BY file_id, track_id, pitch ORDER BY seq)) SELECT file_id, track_id, pitch, start_tick, time AS end_tick, CAST(v AS INT) AS velocity FROM lg WHERE velocity = 0 AND v > 0")
def midi_last_on_E(spark: SparkSession, d: str) -> DataFrame:
    return midi.pair_last_on(_events(spark, d)).drop("note_id")


@query(f"WITH {_RAW}, en AS (SELECT file_id, track_id, max(time) AS stop FROM raw GROUP BY ALL UNION ALL SELECT f.file_id, 0, coalesce(max(mt.tick), 0) FROM (SELECT DISTINCT file_id FROM tk) f LEFT JOIN mt USING (file_id) GROUP BY ALL), sh AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY file_id ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM en) SELECT file_id, CAST(time + shift AS BIGINT) AS time, pitch, CAST(velocity AS INT) AS velocity FROM raw JOIN sh USING (file_id, track_id)")
def midi_global_clock_E(spark: SparkSession, d: str) -> DataFrame:
    return midi.raw_notes(midi.global_clock(_events(spark, d))).drop("seq", "track_id")


@query(f"WITH {_K} SELECT file_id, kind, tick, value1, value2, text FROM mt UNION ALL SELECT file_id, 'track_name', 0, NULL, NULL, track_name FROM tn")
def midi_changes_E(spark: SparkSession, d: str) -> DataFrame:
    return midi.meta_changes(_events(spark, d))


def _list(kind: str, other: str) -> str:
    return f"coalesce((SELECT string_agg(tick || ':' || value1 || ':' || coalesce(CAST(value2 AS VARCHAR), ''), ',' ORDER BY tick, value1, value2) FROM mt WHERE mt.file_id = f.file_id AND kind = '{kind}'), '{other}')"


@query(f"WITH {_K}, f AS (SELECT file_id, 2 * count(*) AS n FROM tk GROUP BY ALL) SELECT file_id, {BEAT} AS ticks_per_beat, {_list('set_tempo', '0:500000:')} AS tempos, {_list('time_signature', '0:4:4')} AS signatures, {_list('key_signature', '0:0:0')} AS keys, n AS n_note_events FROM f")
def midi_metadata_E(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["tick"].cast("string"), x["value1"].cast("string"), F.coalesce(x["value2"].cast("string"), F.lit("")))), ",").alias(c)
    return midi.metadata(_events(spark, d)).select("file_id", "ticks_per_beat", text("tempos"), text("signatures"), text("keys"), "n_note_events")


@query(f"WITH {_K}, s AS (SELECT file_id, count(*) AS n FROM mt WHERE kind = 'time_signature' GROUP BY ALL) SELECT file_id, {BEAT} AS ticks_per_beat, CAST(n AS INT) AS n FROM s WHERE n > 1")
def midi_signature_inventory_E(spark: SparkSession, d: str) -> DataFrame:
    return midi.signature_inventory(_events(spark, d)).select("file_id", "ticks_per_beat", F.size("signatures").alias("n"))


@query(f"WITH {_K} SELECT file_id, track_id, track_name AS name, 0 AS program, track_name = 'error' AS is_drum FROM tn UNION ALL SELECT DISTINCT file_id, 0, NULL, 0, FALSE FROM mt")
def midi_tracks_E(spark: SparkSession, d: str) -> DataFrame:
    return midi.tracks(_events(spark, d))


_FIRST = "ft AS (SELECT file_id, 60e6 / arg_min(value1, (tick, value1)) AS tempo FROM mt WHERE kind = 'set_tempo' GROUP BY ALL)"


@query(f"WITH {_K}, {_FIRST} SELECT f.file_id, round(coalesce(tempo, 120), 4) AS tempo FROM (SELECT DISTINCT file_id FROM tk) f LEFT JOIN ft USING (file_id)")
def midi_first_tempo_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(midi.first_tempo(_events(spark, d)), "tempo")


@query(f"WITH {_K}, {_FIRST} SELECT file_id, tick, CAST(value1 * {BEAT} * 4 // value2 AS BIGINT) AS ticks, CAST(value1 * {BEAT} AS BIGINT) AS plain_ticks, round(coalesce(60 / tempo * value1, 2), 4) AS seconds FROM mt LEFT JOIN ft USING (file_id) WHERE kind = 'time_signature'")
def bar_lengths_E(spark: SparkSession, d: str) -> DataFrame:
    found = _events(spark, d)
    tempo = midi.meta_changes(found).where("kind = 'set_tempo'").select("file_id").distinct().join(midi.first_tempo(found), "file_id")
    each = midi.meta_changes(found).where("kind = 'time_signature'").join(tempo, "file_id", "left")
    made = each.select("file_id", "tick", expr.bar_ticks(F.lit(BEAT), "value1", "value2").alias("ticks"), expr.bar_ticks(F.lit(BEAT), "value1").alias("plain_ticks"), expr.bar_seconds("tempo", "value1").alias("seconds"))
    return rounded(made, "seconds")


# files of patterns, segments, cuts and tracks, read back as their on and off marks

_PARTS = f"""sg AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY file_id ORDER BY a, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {SILENCE} THEN 1 ELSE 0 END AS new FROM tk WHERE NOT is_drum), s1 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY file_id ORDER BY a, note_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM sg),
  s2 AS (SELECT file_id, segment_id, min(a) AS first, max(b) - min(a) AS span, min(a) AS start, max(b) AS stop FROM s1 GROUP BY ALL)"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ticks = event_ticks(spark, d)
    spans = melodic(ticks).withColumns({"start": F.col("start_tick"), "end": F.col("end_tick")})
    return t.silence_segments(spans, SILENCE, ["file_id"]), event_meta(ticks)


def _read(files: DataFrame, names: list[str]) -> DataFrame:
    """(path, kind, time, pitch, velocity): marks, and what was carried over."""
    found = midi.events(files.select(F.concat_ws("/", *[F.col(n).cast("string") for n in names]).alias("path"), "content"))
    notes = midi.raw_notes(found).select("file_id", F.lit("note").alias("kind"), "time", "pitch", "velocity")
    carried = midi.meta_changes(found).where(F.col("kind").isin(*sinks.CARRIED)).select("file_id", "kind", F.col("tick").alias("time"), F.col("value1").alias("pitch"), F.col("value2").alias("velocity"))
    return notes.unionByName(carried).withColumnRenamed("file_id", "path")


def _both(path: str, extra: str = "") -> str:
    """SQL: the marks of ``raw`` and the changes of ``ch``, both with a path."""
    return f"SELECT {path} AS path, 'note' AS kind, CAST(time AS BIGINT) AS time, pitch, CAST(velocity AS INT) AS velocity FROM raw {extra} UNION ALL SELECT path, kind, CAST(tick AS BIGINT), value1, value2 FROM ch"


_SEGMENT_PATH, _TRACK_PATH = "file_id || '/' || segment_id", "file_id || '/' || track_name"
_MOVED = "ch AS (SELECT file_id || '/' || segment_id AS path, kind, greatest(0, tick - first) AS tick, value1, value2 FROM mt JOIN nf USING (file_id))"


@query(f"WITH {_K}, {_PARTS}, nf AS (SELECT file_id, segment_id, first FROM s2), nn AS (SELECT file_id, segment_id, a - first AS a, b - first AS b, pitch, velocity FROM s1 JOIN nf USING (file_id, segment_id)), {_marks('nn', 'file_id, segment_id')}, {_MOVED} {_both(_SEGMENT_PATH)}")
def pattern_files_E(spark: SparkSession, d: str) -> DataFrame:
    parts, meta = _parts(spark, d)
    return _read(sinks.pattern_files(parts, ["file_id"], "segment_id", BEAT, meta), ["file_id", "segment_id"])


@query(f"WITH {_K}, {_PARTS}, nf AS (SELECT file_id, segment_id, first FROM s2 WHERE span >= {LEAST}), nn AS (SELECT file_id, segment_id, a - first AS a, b - first AS b, pitch, velocity FROM s1 JOIN nf USING (file_id, segment_id)), {_marks('nn', 'file_id, segment_id')}, {_MOVED} {_both(_SEGMENT_PATH)}")
def segment_files_E(spark: SparkSession, d: str) -> DataFrame:
    parts, meta = _parts(spark, d)
    return _read(sinks.segment_files(parts, ["file_id"], "segment_id", LEAST, BEAT, meta), ["file_id", "segment_id"])


@query(f"WITH {_K}, {_PARTS}, nn AS (SELECT file_id, segment_id, a, b, pitch, velocity FROM s1), {_marks('nn', 'file_id, segment_id')}, ch AS (SELECT file_id AS path, kind, tick, value1, value2 FROM mt WHERE file_id IN (SELECT file_id FROM s1)) {_both('file_id')}")
def track_files_E(spark: SparkSession, d: str) -> DataFrame:
    parts, meta = _parts(spark, d)
    return _read(sinks.track_files(parts, ["file_id"], "segment_id", BEAT, meta), ["file_id"])


@query(f"WITH {_K}, nn AS (SELECT file_id, track_name, a - {2 * 4 * BEAT} AS a, least(b, {40 * 4 * BEAT}) - {2 * 4 * BEAT} AS b, pitch, velocity FROM tk WHERE a >= {2 * 4 * BEAT} AND a < {40 * 4 * BEAT}), {_marks('nn', 'file_id, track_name')}, ch AS (SELECT file_id AS path, kind, greatest(0, tick - {2 * 4 * BEAT}) AS tick, value1, value2 FROM mt WHERE tick < {40 * 4 * BEAT} AND file_id IN (SELECT file_id FROM nn)) {_both('file_id')}")
def cut_bars_E(spark: SparkSession, d: str) -> DataFrame:
    ticks = event_ticks(spark, d)
    return _read(sinks.cut_bars(ticks, ["file_id"], 2, 40, BEAT, 4, "track_name", event_meta(ticks)), ["file_id"])


@query(f"WITH {_K}, nn AS (SELECT * FROM tk WHERE NOT is_drum), {_marks('nn', 'file_id, track_name')}, ch AS (SELECT file_id || '/' || track_name AS path, kind, tick, value1, value2, text FROM mt JOIN tn USING (file_id) WHERE track_name <> 'error') {_both(_TRACK_PATH)}")
def split_tracks_E(spark: SparkSession, d: str) -> DataFrame:
    ticks = event_ticks(spark, d)
    return _read(sinks.split_tracks(ticks, BEAT, "track_name", event_meta(ticks)), ["file_id", "track_name"])


@query(f"WITH {E}, {_SEG}, {_SUMMARY} SELECT n.track_id, n.note_id, round(n.start - s.start, 3) AS start, round(least(n.\"end\", s.\"end\") - s.start, 3) AS \"end\" FROM mel n JOIN sm s ON n.track_id = s.track_id AND n.start >= s.start AND n.start < s.\"end\" WHERE s.n_notes >= 3")
def cut_segments_E(spark: SparkSession, d: str) -> DataFrame:
    notes = melodic(event_notes(spark, d))
    segments = t.segment_summary(t.silence_segments(notes, BAR_E, TRACK), TRACK).where("n_notes >= 3").select("track_id", "start", "end")
    return rounded(t.cut_segments(notes, segments, TRACK).select("track_id", "note_id", "start", "end"), "start", "end", digits=3)


# listings, tables that are written and read again, and small functions

@query("SELECT kind, unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS name FROM (VALUES ('recursive'), ('flat'), ('pruned')) v(kind)")
def scan_files_P(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)\.parquet(/[^/]*)?$", 1).alias("name")
    found = {"recursive": midi.scan_files(spark, d, suffixes=("parquet",)), "flat": midi.scan_files(spark, d, False, suffixes=("parquet",), any_case=False), "pruned": midi.scan_files(spark, d, exclude="_Patterns", suffixes=("parquet",))}
    parts = [files.select(F.lit(kind).alias("kind"), name).distinct() for kind, files in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_KINDS = "(VALUES ('parquet'), ('json'), ('csv')) v(kind)"


@query(f"WITH {E}, {LAGS}, {F10} SELECT kind, track_id, {', '.join(r(c) for c in FEATURES)} FROM f, {_KINDS}")
def written_features_E(spark: SparkSession, d: str) -> DataFrame:
    made, folder = tracks10(spark, d).select("track_id", *FEATURES), sinks.shared_folder(spark)
    found = None
    for kind in ("parquet", "json", "csv"):
        sinks.write_table(made, f"{folder}/{kind}", None, kind)
        reader = spark.read.schema(made.schema)
        part = (reader.option("header", True) if kind == "csv" else reader).format(kind).load(f"{folder}/{kind}").withColumn("kind", F.lit(kind))
        found = part if found is None else found.unionByName(part)
    return rounded(found, *FEATURES)


@query(f"WITH {E}, {_SEG}, {_SUMMARY} SELECT 'events' AS file_id, CAST(track_id AS VARCHAR) AS track_id, round(start, 3) AS pos FROM sm")
def written_boundaries_E(spark: SparkSession, d: str) -> DataFrame:
    marks = t.segment_summary(t.silence_segments(melodic(event_notes(spark, d)), BAR_E, TRACK), TRACK)
    folder = sinks.shared_folder(spark)
    sinks.write_table(marks.select(F.lit("events").alias("file_id"), F.col("track_id").cast("string").alias("track_id"), F.col("start").alias("pos")), folder, None, "json")
    return rounded(boundaries.read_boundaries(spark, folder), "pos", digits=3)


@query("SELECT label, CAST(vec_id AS VARCHAR) || chr(9) || label AS value FROM embeddings")
def report_lines_V(spark: SparkSession, d: str) -> DataFrame:
    folder = sinks.shared_folder(spark)
    sinks.write_table(sinks.report_lines(table(spark, d, "embeddings"), "label", ["vec_id", "label"]), folder, ["label"], "text")
    return spark.read.text(folder).select(F.col("label").cast("int").alias("label"), "value")


@query(f"WITH {L}, {_BARS}, p AS (SELECT file_id, track_id, bar, list(pitch ORDER BY start, note_id) AS ps FROM inb GROUP BY ALL) SELECT file_id, track_id, CAST(bar AS BIGINT) AS bar, array_to_string(list_resize(ps, 8, 0), ',') AS pitches FROM p")
def padded_bars_L(spark: SparkSession, d: str) -> DataFrame:
    return t.bars(_lines(spark, d), BAR_L).select(*FILE_TRACK, "bar", joined(expr.pad(F.transform("notes", lambda n: n["pitch"]), 8, F.lit(0))).alias("pitches"))


@query(f"WITH {E}, j AS (SELECT *, pitch - lag(pitch) OVER (PARTITION BY track_id ORDER BY start, note_id) AS jump FROM mel WHERE note_id % 7 < 2), f AS (SELECT track_id, min(jump) AS min_jump, max(jump) AS max_jump FROM j GROUP BY track_id) SELECT track_id, round(coalesce(min_jump, avg(min_jump) OVER ()), 4) AS min_jump, round(coalesce(max_jump, avg(max_jump) OVER ()), 4) AS max_jump FROM f")
def imputed_E(spark: SparkSession, d: str) -> DataFrame:
    found = features.jump_features(melodic(event_notes(spark, d)).where("note_id % 7 < 2"), ["track_id"])
    return rounded(search.impute_means(found.select("track_id", "min_jump", "max_jump"), ["min_jump", "max_jump"]), "min_jump", "max_jump")


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type")
def group_label_E(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("songs/x_y/"), F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"), F.lit("_a.mid"))
    return table(spark, d, "events").select(expr.group_label(path).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT DISTINCT '/songs/' || event_type || '/u' || user_id || '.mid' AS path, event_type, user_id FROM events), w AS (SELECT DISTINCT user_id, event_type, (user_id + length(event_type)) % 4 AS k FROM events),
  a AS (SELECT CASE k WHEN 0 THEN '/songs/' || event_type || '/u' || user_id || '.mid' WHEN 1 THEN event_type || '/u' || user_id || '.mid' WHEN 2 THEN 'elsewhere/' || event_type || '/u' || user_id || '.mid' ELSE 'gone/v' || user_id || '.mid' END AS wanted, k, user_id, event_type FROM w)
  SELECT wanted, CASE k WHEN 0 THEN wanted WHEN 1 THEN '/songs/' || wanted WHEN 2 THEN (SELECT min(path) FROM f WHERE f.user_id = a.user_id) END AS path FROM a""")
def resolved_paths_E(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "events").select("user_id", "event_type").distinct()
    below = F.concat(F.col("event_type"), F.lit("/u"), F.col("user_id").cast("string"), F.lit(".mid"))
    k = (F.col("user_id") + F.length("event_type")) % 4
    wanted = pairs.select(F.when(k == 0, F.concat(F.lit("/songs/"), below)).when(k == 1, below).when(k == 2, F.concat(F.lit("elsewhere/"), below)).otherwise(F.concat(F.lit("gone/v"), F.col("user_id").cast("string"), F.lit(".mid"))).alias("wanted"))
    return boundaries.resolve_paths(wanted, pairs.select(F.concat(F.lit("/songs/"), below).alias("path")), "/songs/")


@query(f"WITH {E}, b AS (SELECT track_id, start AS beat FROM notes WHERE is_drum), n AS (SELECT m.track_id, m.note_id, min(abs(m.start - b.beat)) AS beat_distance FROM mel m LEFT JOIN b USING (track_id) GROUP BY ALL) SELECT track_id, round(avg(CASE WHEN beat_distance IS NULL THEN NULL WHEN beat_distance > 36000 THEN 1 ELSE 0 END), 4) AS syncopation_ratio FROM n GROUP BY track_id")
def beat_syncopation_E(spark: SparkSession, d: str) -> DataFrame:
    notes = event_notes(spark, d)
    beats = notes.where("is_drum").select("track_id", F.col("start").alias("beat"))
    return rounded(features.beat_syncopation(melodic(notes).select("track_id", "note_id", "start"), beats, TRACK, 36_000.0), "syncopation_ratio")


# streams over the events

def _stream(spark: SparkSession, d: str) -> DataFrame:
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return notes_of_events(source, F.col("ts").cast("timestamp").alias("ts"))


@query(f"WITH {E}, {_SEG}, {_SUMMARY} SELECT track_id, round(start, 3) AS start, round(\"end\", 3) AS \"end\", n_notes FROM sm")
def stream_sessions_E(spark: SparkSession, d: str) -> DataFrame:
    found = live.run_to_table(live.silence_sessions(melodic(_stream(spark, d)), BAR_E), sinks.shared_folder(spark), "complete")
    seconds = lambda c: F.round(F.unix_micros(c) / 1e6, 3).alias(c)
    return found.select("track_id", seconds("start"), seconds("end"), "n_notes")


@query(f"WITH {E} SELECT track_id, CAST(floor(start / {BAR_E}) * {BAR_E} AS BIGINT) AS start, CAST(floor(start / {BAR_E}) * {BAR_E} + {BAR_E} AS BIGINT) AS \"end\", count(*) AS n_notes, min(pitch) AS low, max(pitch) AS high FROM mel GROUP BY ALL")
def stream_bars_E(spark: SparkSession, d: str) -> DataFrame:
    found = live.run_to_table(live.tumbling_bars(melodic(_stream(spark, d)), "1 day"), sinks.shared_folder(spark), "complete")
    return found.select("track_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "n_notes", "low", "high")


@query(f"WITH {E}, g AS (SELECT track_id, row_number() OVER w - 1 AS pos, pitch || ',' || lead(pitch, 1) OVER w || ',' || lead(pitch, 2) OVER w AS gram FROM mel WINDOW w AS (PARTITION BY track_id ORDER BY start, note_id)) SELECT * FROM g WHERE gram IS NOT NULL")
def stream_ngrams_E(spark: SparkSession, d: str) -> DataFrame:
    return live.run_to_table(live.sliding_ngrams(melodic(_stream(spark, d)), 3), sinks.shared_folder(spark))


@query(f"WITH {_RAW}, {_LIFO} SELECT file_id, CAST(track_id AS BIGINT) AS track_id, pitch, start_tick, end_tick, CAST(velocity AS INT) AS velocity FROM lifo")
def stream_pairs_E(spark: SparkSession, d: str) -> DataFrame:
    raw, folder = midi.raw_notes(_events(spark, d)).withColumn("track_id", F.col("track_id").cast("long")), sinks.shared_folder(spark)
    raw.write.parquet(f"{folder}-raw")
    return live.run_to_table(live.pair_notes(spark.readStream.schema(raw.schema).parquet(f"{folder}-raw")), folder)
