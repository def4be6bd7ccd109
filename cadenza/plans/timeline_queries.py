"""Segments, bars, ranges and boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import classify, distance, sequential, structure
from cadenza.operators import timeline as t
from cadenza.plans.oracle import E, L, longer
from cadenza.plans.registry import joined, query, r, rounded
from cadenza.shared import cut
from cadenza.sources.tables import event_notes, lineitem_notes, melodic

#: Bar of the events view in seconds and of the lineitem view in days, ticks of a beat, and the softest loud note.
BAR_E, BAR_L, TICKS, LOUD = 86_400, 30, 96, 50
TRACK, FILE_TRACK = ["track_id"], ["file_id", "track_id"]


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return melodic(event_notes(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return melodic(lineitem_notes(spark, d))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return t.silence_segments(_notes(spark, d), BAR_E, TRACK)


_SEG = f"""g AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY track_id ORDER BY start, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {BAR_E} THEN 1 ELSE 0 END AS new FROM mel),
  seg AS (SELECT *, CAST(sum(new) OVER (PARTITION BY track_id ORDER BY start, note_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM g)"""
_SUMMARY = 'sm AS (SELECT track_id, segment_id, min(start) AS start, max("end") AS "end", count(*) AS n_notes FROM seg GROUP BY ALL)'


def _summary_sql(source: str) -> str:
    return f"SELECT track_id, segment_id, round(min(start), 3) AS start, round(max(\"end\"), 3) AS \"end\", count(*) AS n_notes FROM {source} GROUP BY track_id, segment_id"


@query(f"WITH {E}, {_SEG} {_summary_sql('seg')}")
def silence_segments_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.segment_summary(_segments(spark, d), TRACK), "start", "end", digits=3)


@query(
    f"""WITH {E}, g AS (SELECT *, CASE WHEN start - (lag(start) OVER w + lag(dur) OVER w) > {BAR_E} THEN 1 ELSE 0 END AS new FROM mel WINDOW w AS (PARTITION BY track_id ORDER BY start, note_id)),
  seg AS (SELECT *, CAST(sum(new) OVER (PARTITION BY track_id ORDER BY start, note_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM g) {_summary_sql('seg')}"""
)
def pause_segments_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.segment_summary(t.pause_segments(_notes(spark, d), BAR_E, TRACK), TRACK), "start", "end", digits=3)


@query(
    f"""WITH {E}, g AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY track_id ORDER BY start, note_id) > 36000 THEN 1 ELSE 0 END AS new FROM mel),
  u AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY start, note_id ROWS UNBOUNDED PRECEDING) AS run FROM g), n AS (SELECT *, count(*) OVER (PARTITION BY track_id, run) AS n FROM u)
  SELECT track_id, note_id, CAST(CASE WHEN n >= 2 THEN dense_rank() OVER (PARTITION BY track_id, n >= 2 ORDER BY run) - 1 ELSE -1 END AS INT) AS cluster FROM n"""
)
def onset_clusters_E(spark: SparkSession, d: str) -> DataFrame:
    return t.onset_clusters(_notes(spark, d), 36_000, 2, TRACK).select("track_id", "note_id", "cluster")


@query(
    f"""WITH {E}, s AS (SELECT *, count(*) OVER (PARTITION BY track_id) // 15 AS size, row_number() OVER w - 1 AS i, start - (lag(start) OVER w + lag(dur) OVER w) AS pause FROM mel WINDOW w AS (PARTITION BY track_id ORDER BY start, note_id)),
  b AS (SELECT *, CASE WHEN size = 0 THEN 14 ELSE least(i // size, 14) END AS bucket FROM s), g AS (SELECT *, CASE WHEN bucket <> lag(bucket) OVER w OR pause > {BAR_E} THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY track_id ORDER BY start, note_id)),
  seg AS (SELECT *, CAST(sum(new) OVER (PARTITION BY track_id ORDER BY start, note_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM g) {_summary_sql('seg')}"""
)
def bucket_pause_segments_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.segment_summary(t.bucket_pause_segments(_notes(spark, d), BAR_E, 15, TRACK), TRACK), "start", "end", digits=3)


_BARS = f"""inb AS (SELECT *, unnest(range(start // {BAR_L}, ("end" - 1) // {BAR_L} + 1)) AS bar FROM mel), ends AS (SELECT file_id, track_id, max("end") AS last FROM mel GROUP BY ALL)"""
_EMPTY = """held AS (SELECT DISTINCT file_id, track_id, bar FROM inb), grid AS (SELECT file_id, track_id, unnest(range(min(bar), max(bar) + 1)) AS bar FROM held GROUP BY file_id, track_id),
  empty AS (SELECT * FROM grid ANTI JOIN held USING (file_id, track_id, bar))"""


@query(
    f"""WITH {L}, {_BARS} SELECT file_id, track_id, CAST(bar AS BIGINT) AS bar, CAST(bar * {BAR_L} AS BIGINT) AS start, CAST(least((bar + 1) * {BAR_L}, any_value(last)) AS BIGINT) AS "end", count(*) AS n_notes, min(pitch) AS low, max(pitch) AS high
  FROM inb JOIN ends USING (file_id, track_id) GROUP BY file_id, track_id, bar"""
)
def bars_L(spark: SparkSession, d: str) -> DataFrame:
    pitches = F.transform("notes", lambda n: n["pitch"])
    return t.bars(_lines(spark, d), BAR_L).select(*FILE_TRACK, "bar", "start", F.col("end").cast("long").alias("end"), F.size("notes").cast("long").alias("n_notes"), F.array_min(pitches).alias("low"), F.array_max(pitches).alias("high"))


@query(f"WITH {L}, {_BARS}, {_EMPTY} SELECT file_id, track_id, CAST(bar AS BIGINT) AS bar FROM empty")
def empty_bars_L(spark: SparkSession, d: str) -> DataFrame:
    return t.empty_bars(_lines(spark, d), BAR_L)


def _runs_sql(source: str, least: int = 1) -> str:
    return f"SELECT file_id, track_id, CAST(min(bar) AS BIGINT) AS first, CAST(max(bar) AS BIGINT) AS last, count(*) AS n FROM (SELECT *, bar - row_number() OVER (PARTITION BY file_id, track_id ORDER BY bar) AS island FROM {source}) GROUP BY file_id, track_id, island HAVING count(*) >= {least}"


@query(f"WITH {L}, {_BARS}, {_EMPTY} {_runs_sql('empty')}")
def empty_runs_L(spark: SparkSession, d: str) -> DataFrame:
    return t.runs(t.empty_bars(_lines(spark, d), BAR_L), "bar", FILE_TRACK)


_SILENT = f"""sv AS (SELECT *, velocity < {LOUD} AS soft FROM mel), sn AS (SELECT *, CASE WHEN soft IS DISTINCT FROM lag(soft) OVER (PARTITION BY track_id ORDER BY start, note_id) THEN 1 ELSE 0 END AS new FROM sv),
  sr AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY start, note_id ROWS UNBOUNDED PRECEDING) AS run FROM sn), sg AS (SELECT track_id, run, any_value(soft) AS soft, min(start) AS start FROM sr GROUP BY track_id, run),
  silent AS (SELECT track_id, start, "end" FROM (SELECT *, lead(start) OVER (PARTITION BY track_id ORDER BY run) AS "end" FROM sg) WHERE soft AND "end" IS NOT NULL)"""


@query(f'WITH {E}, {_SILENT} SELECT track_id, round(start, 3) AS start, round("end", 3) AS "end" FROM silent')
def silence_regions_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.silence_regions(_notes(spark, d), LOUD, TRACK), "start", "end", digits=3)


@query(f'WITH {E}, {_SILENT} SELECT m.track_id, m.note_id, round(s.start, 3) AS range_start FROM mel m LEFT JOIN silent s ON m.track_id = s.track_id AND m.start >= s.start AND m.start < s."end"')
def notes_in_segments_E(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d)
    found = t.in_ranges(notes.select("track_id", "note_id", "start"), t.silence_regions(notes, LOUD, TRACK), "start", TRACK)
    return rounded(found.select("track_id", "note_id", "range_start"), "range_start", digits=3)


@query(f'WITH {E}, {_SEG}, {_SUMMARY}, {_SILENT} SELECT m.track_id, round(m.start, 3) AS pos FROM sm m WHERE NOT EXISTS (SELECT 1 FROM silent s WHERE s.track_id = m.track_id AND m.start >= s.start AND m.start < s."end")')
def boundaries_outside_silence_E(spark: SparkSession, d: str) -> DataFrame:
    marks = t.segment_summary(_segments(spark, d), TRACK).select("track_id", F.col("start").alias("pos"))
    found = t.in_ranges(marks, t.silence_regions(_notes(spark, d), LOUD, TRACK), "pos", TRACK).where("range_start is null")
    return rounded(found.select("track_id", "pos"), "pos", digits=3)


@query(
    f"""WITH {L}, c AS (SELECT file_id, start AS time, max(3 + note_id // 10 % 3) AS numerator FROM notes WHERE note_id % 10 = 7 GROUP BY file_id, start), a AS (SELECT m.file_id, c.numerator FROM mel m ASOF LEFT JOIN c ON m.file_id = c.file_id AND m.start >= c.time)
  SELECT file_id, CAST(coalesce(numerator * {TICKS}, 384) AS BIGINT) AS bar_ticks, count(*) AS n FROM a GROUP BY ALL"""
)
def asof_signature_L(spark: SparkSession, d: str) -> DataFrame:
    notes = lineitem_notes(spark, d)
    changes = notes.where("note_id % 10 = 7").select("file_id", F.col("start").alias("time"), (3 + F.floor(F.col("note_id") / 10) % 3).alias("numerator"))
    found = t.bar_ticks_as_of(melodic(notes).select("file_id", "start"), changes, TICKS, ["file_id"])
    return found.groupBy("file_id", "bar_ticks").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E}, s AS (SELECT *, min(start) FILTER (NOT is_drum) OVER (PARTITION BY track_id) AS shift FROM notes) SELECT track_id, note_id, round(start - greatest(coalesce(shift, 0), 0), 3) AS start, round("end" - greatest(coalesce(shift, 0), 0), 3) AS "end" FROM s""")
def trim_lead_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.trim_lead(event_notes(spark, d), TRACK).select("track_id", "note_id", "start", "end"), "start", "end", digits=3)


@query(f"""WITH {L} SELECT file_id, track_id, note_id, CAST(start - {80 * BAR_L} AS INT) AS start, CAST(least("end", {120 * BAR_L}) - {80 * BAR_L} AS INT) AS "end" FROM mel WHERE start >= {80 * BAR_L} AND start < {120 * BAR_L}""")
def bar_range_cut_L(spark: SparkSession, d: str) -> DataFrame:
    return t.cut_range(_lines(spark, d), 80 * BAR_L, 120 * BAR_L).select(*FILE_TRACK, "note_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query(f"WITH {E}, c AS (SELECT track_id, start, program, lag(program) OVER (PARTITION BY track_id ORDER BY start, note_id) AS p FROM mel) SELECT track_id, round(start, 3) AS at, program AS label FROM c WHERE program <> p")
def label_change_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.label_changes(_notes(spark, d), "program", 1, TRACK), "at", digits=3)


@query(f'WITH {E}, {_SEG}, {_SUMMARY} SELECT track_id, round(start, 3) AS start, round("end", 3) AS "end" FROM (SELECT track_id, start, lead(start) OVER (PARTITION BY track_id ORDER BY start) AS "end" FROM sm) WHERE "end" IS NOT NULL')
def boundary_ranges_E(spark: SparkSession, d: str) -> DataFrame:
    marks = t.segment_summary(_segments(spark, d), TRACK).select("track_id", F.col("start").alias("pos"))
    return rounded(t.boundary_ranges(marks, "pos", TRACK), "start", "end", digits=3)


def _spaced_sql(marks: str, least: float, most: float) -> str:
    """SQL: kept (track_id, pos) of ``marks`` (track_id, pos): a walk over a track's marks, with steps of ``most`` in between."""
    return f"""mk AS (SELECT track_id, pos, row_number() OVER (PARTITION BY track_id ORDER BY pos) AS k FROM (SELECT DISTINCT track_id, pos FROM {marks})),
  wk AS (SELECT track_id, k, pos AS last, CAST(NULL AS DOUBLE) AS from_, CAST(0 AS BIGINT) AS steps, TRUE AS own FROM mk WHERE k = 1
    UNION ALL SELECT track_id, k, CASE WHEN pos - (last + steps * {most}) >= {least} THEN pos ELSE last + steps * {most} END, last, steps, pos - (last + steps * {most}) >= {least} FROM (SELECT w.track_id, m.k, m.pos, w.last, CAST(greatest(ceil((m.pos - w.last) / {most}) - 1, 0) AS BIGINT) AS steps FROM wk w JOIN mk m ON m.track_id = w.track_id AND m.k = w.k + 1)),
  kept AS (SELECT track_id, last AS pos FROM wk WHERE own UNION ALL SELECT track_id, from_ + {most} * unnest(range(1, steps + 1)) FROM wk WHERE steps > 0)"""


@query(f"WITH RECURSIVE {E}, {_SEG}, {_SUMMARY}, bm AS (SELECT track_id, start AS pos FROM sm), {_spaced_sql('bm', 2 * BAR_E, 8 * BAR_E)} SELECT track_id, round(pos, 3) AS pos FROM kept")
def spaced_boundaries_E(spark: SparkSession, d: str) -> DataFrame:
    marks = t.segment_summary(_segments(spark, d), TRACK).select("track_id", F.col("start").alias("pos"))
    return rounded(t.spaced_boundaries(marks, 2 * BAR_E, 8 * BAR_E, "pos", TRACK), "pos", digits=3)


@query(
    f"""WITH RECURSIVE {E}, {_SEG}, {_SUMMARY}, rk AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start, "end") AS k, max(n_notes) OVER () AS _ FROM sm),
  fo AS (SELECT track_id, k, 1 AS part, start, "end", n_notes FROM rk WHERE k = 1
    UNION ALL SELECT f.track_id, r.k, CASE WHEN r."end" - r.start < {2 * BAR_E} OR f."end" - f.start < {2 * BAR_E} THEN f.part ELSE f.part + 1 END, CASE WHEN r."end" - r.start < {2 * BAR_E} OR f."end" - f.start < {2 * BAR_E} THEN least(f.start, r.start) ELSE r.start END,
    CASE WHEN r."end" - r.start < {2 * BAR_E} OR f."end" - f.start < {2 * BAR_E} THEN greatest(f."end", r."end") ELSE r."end" END, CASE WHEN r."end" - r.start < {2 * BAR_E} OR f."end" - f.start < {2 * BAR_E} THEN greatest(f.n_notes, r.n_notes) ELSE r.n_notes END FROM fo f JOIN rk r ON r.track_id = f.track_id AND r.k = f.k + 1)
  SELECT track_id, round(start, 3) AS start, round("end", 3) AS "end", n_notes AS repetitions, CAST(-1 AS BIGINT) AS motif_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id, part ORDER BY k DESC) AS z FROM fo) WHERE z = 1"""
)
def merge_small_E(spark: SparkSession, d: str) -> DataFrame:
    found = t.segment_summary(_segments(spark, d), TRACK).select("track_id", "start", "end", F.col("n_notes").alias("repetitions"), F.lit(-1).alias("motif_id"))
    return rounded(t.merge_small(found, 2 * BAR_E, TRACK), "start", "end", digits=3)


@query(f"""WITH {E} SELECT track_id, round(max("end"), 3) AS duration, count(*) AS n_notes, bool_or(is_drum) AS any_drum, string_agg(DISTINCT program, ',' ORDER BY program) AS programs FROM notes GROUP BY track_id""")
def summary_E(spark: SparkSession, d: str) -> DataFrame:
    found = t.midi_summary(event_notes(spark, d).withColumn("owner", F.col("track_id")), ["owner"])
    return rounded(found.select(F.col("owner").alias("track_id"), "duration", "n_notes", "any_drum", F.array_join("programs", ",").alias("programs")), "duration", digits=3)


# bars as vectors and tokens

_ORD = "ob AS (SELECT file_id, track_id, bar, pitch, start - bar * 30 AS rel, dur, velocity, row_number() OVER (PARTITION BY file_id, track_id, bar ORDER BY start, note_id) AS k FROM inb), sz AS (SELECT file_id, track_id, bar, count(*) AS n FROM ob GROUP BY ALL), pv AS (SELECT *, lag(bar) OVER (PARTITION BY file_id, track_id ORDER BY bar) AS previous, lag(n) OVER (PARTITION BY file_id, track_id ORDER BY bar) AS pn, max(n) OVER (PARTITION BY file_id, track_id) AS most FROM sz)"


@query(
    f"""WITH {L}, {_BARS}, {_ORD}, al AS (SELECT file_id, track_id, bar AS at, bar, previous, most, k, pitch, rel, dur, velocity, 1 AS side FROM ob JOIN pv USING (file_id, track_id, bar) UNION ALL SELECT o.file_id, o.track_id, o.bar AS at, p.bar, p.previous, p.most, o.k, -o.pitch, -o.rel, -o.dur, -o.velocity, -1 FROM pv p JOIN ob o ON o.file_id = p.file_id AND o.track_id = p.track_id AND o.bar = p.previous),
  df AS (SELECT file_id, track_id, bar, previous, most, k, pow(sum(pitch), 2) + pow(sum(rel), 2) + pow(sum(dur), 2) + pow(sum(velocity), 2) AS sq FROM al WHERE previous IS NOT NULL GROUP BY ALL)
  SELECT file_id, track_id, CAST(bar AS BIGINT) AS bar, CAST(previous AS BIGINT) AS previous, round(1 - sqrt(sum(sq)) / (sqrt(4 * most) * 127), 4) AS similarity FROM df GROUP BY file_id, track_id, bar, previous, most"""
)
def bar_similarity_L(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distance.adjacent_bar_similarity(t.bars(_lines(spark, d), BAR_L)), "similarity")


@query(
    f"""WITH {L}, {_BARS}, {_ORD} SELECT p.file_id, p.track_id, CAST(p.bar AS BIGINT) AS bar, CAST(p.previous AS BIGINT) AS previous, round(count(*) FILTER (a.pitch = b.pitch) / greatest(any_value(p.n), any_value(p.pn))::DOUBLE, 4) AS ratio
  FROM pv p JOIN ob a ON a.file_id = p.file_id AND a.track_id = p.track_id AND a.bar = p.bar LEFT JOIN ob b ON b.file_id = p.file_id AND b.track_id = p.track_id AND b.bar = p.previous AND b.k = a.k WHERE p.previous IS NOT NULL GROUP BY p.file_id, p.track_id, p.bar, p.previous"""
)
def positional_ratio_L(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distance.adjacent_match_ratio(t.bars(_lines(spark, d), BAR_L)), "ratio")


def _tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = t.bars(_lines(spark, d), BAR_L)
    seqs = classify.bar_sequences(bars, classify.mean_octave(F.col("notes")))
    return bars, seqs, classify.bar_patterns(seqs, 2, 8)


_GRAMS = ", ".join(" || ',' || ".join(["token", *[f"lead(token, {k}) OVER w" for k in range(1, n)]]) + f" AS g{n}" for n in range(2, 9))
_PAT = f"""tok AS (SELECT file_id, track_id, bar, CAST(round_even(avg(pitch) / 12, 0) AS INT) AS token FROM inb GROUP BY ALL), sq AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY file_id, track_id) AS size, {_GRAMS} FROM tok WINDOW w AS (PARTITION BY file_id, track_id ORDER BY bar)),
  gr AS ({" UNION ALL ".join(f"SELECT file_id, track_id, pos, size, {n} AS n, g{n} AS gram FROM sq" for n in range(2, 9))}),
  pat AS (SELECT file_id, track_id, n, gram, list_sort(list(pos)) AS positions, count(*) AS count FROM gr WHERE gram IS NOT NULL AND n <= size // 2 GROUP BY ALL HAVING count(*) > 1)"""
_REP = "occ AS (SELECT file_id, track_id, n, unnest(positions) AS pos FROM pat), rep AS (SELECT DISTINCT s.file_id, s.track_id, s.bar FROM sq s JOIN occ o ON s.file_id = o.file_id AND s.track_id = o.track_id AND s.pos >= o.pos AND s.pos < o.pos + o.n), nonrep AS (SELECT file_id, track_id, bar FROM sq ANTI JOIN rep USING (file_id, track_id, bar))"


@query(f"WITH {L}, {_BARS}, {_PAT} SELECT file_id, track_id, n, gram, array_to_string(positions, ',') AS positions, count FROM pat")
def bar_patterns_L(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d)[2].withColumns({"gram": joined("gram"), "positions": joined("positions")})


@query(f"WITH {L}, {_BARS}, {_PAT}, {_REP} SELECT file_id, track_id, CAST(bar AS BIGINT) AS bar FROM nonrep")
def non_repeating_bars_L(spark: SparkSession, d: str) -> DataFrame:
    bars, seqs, patterns = _tokens(spark, d)
    return bars.select(*FILE_TRACK, "bar").join(classify.repeating_bars(patterns, seqs), [*FILE_TRACK, "bar"], "left_anti")


@query(f"WITH {L}, {_BARS}, {_PAT}, {_REP} {_runs_sql('nonrep')}")
def phrase_islands_L(spark: SparkSession, d: str) -> DataFrame:
    bars, seqs, patterns = _tokens(spark, d)
    return classify.phrases(bars, classify.repeating_bars(patterns, seqs), 1)


@query(
    f"""WITH {L}, {_BARS}, {_EMPTY}, {_PAT}, {_REP}, ph AS ({_runs_sql('nonrep', 2)}), cov AS (SELECT file_id, track_id, bar FROM rep UNION SELECT file_id, track_id, unnest(range(first, last + 1)) AS bar FROM ph)
  SELECT file_id, track_id, type, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(length AS BIGINT) AS length FROM (
  SELECT o.file_id, o.track_id, 'Repeating Pattern' AS type, a.bar * 30 AS start, (b.bar + 1) * 30 AS "end", o.n AS length FROM occ o JOIN sq a ON a.file_id = o.file_id AND a.track_id = o.track_id AND a.pos = o.pos JOIN sq b ON b.file_id = o.file_id AND b.track_id = o.track_id AND b.pos = o.pos + o.n - 1
  UNION ALL SELECT file_id, track_id, 'Melodic Phrase', first * 30, (last + 1) * 30, n FROM ph UNION ALL SELECT file_id, track_id, 'Empty', bar * 30, (bar + 1) * 30, 1 FROM empty
  UNION ALL SELECT file_id, track_id, 'Other', bar * 30, (bar + 1) * 30, 1 FROM tok ANTI JOIN cov USING (file_id, track_id, bar)
  UNION ALL SELECT file_id, track_id, 'Start', min(bar) * 30, min(bar) * 30, 0 FROM tok GROUP BY ALL UNION ALL SELECT file_id, track_id, 'End', (max(bar) + 1) * 30, (max(bar) + 1) * 30, 0 FROM tok GROUP BY ALL)"""
)
def segment_classes_L(spark: SparkSession, d: str) -> DataFrame:
    # six kinds of segments read the bars, so their tokens are computed once; the notes stay behind
    bars = cut(t.bars(_lines(spark, d), BAR_L).select(*FILE_TRACK, "bar", classify.mean_octave(F.col("notes")).alias("token")))
    seqs = classify.bar_sequences(bars, F.col("token"))
    return classify.classify(bars, t.absent_bars(bars), classify.bar_patterns(seqs, 2, 8), seqs, BAR_L, 2)


# decisions in order

def _barred(spark: SparkSession, d: str) -> DataFrame:
    """Segments of coarse pitches with the bar in force at each note: quarters of a day, three to five of them since the last signature, four before it."""
    notes = event_notes(spark, d)
    changes = notes.where("note_id % 10 = 3").select("track_id", F.col("start").alias("time"), (3 + F.col("note_id") % 3).alias("numerator"))
    segments = t.silence_segments(melodic(notes), BAR_E, TRACK).withColumn("pitch", (F.col("pitch") / 32).cast("int"))
    return t.as_of(segments, changes, "start", "numerator", TRACK).withColumn("bar", F.coalesce("numerator", F.lit(4)) * BAR_E / 4).drop("numerator")


@query()
def repeat_detector_E(spark: SparkSession, d: str) -> DataFrame:
    return sequential.repeat_detector(_barred(spark, d), "bar", 60, "repeat", ["track_id", "segment_id"])


@query()
def repeat_runs_E(spark: SparkSession, d: str) -> DataFrame:
    return sequential.repeat_detector(_barred(spark, d), "bar", 60, "run", ["track_id", "segment_id"], 7)


def _numbered(token: str, source: str = "mel", keys: str = "track_id") -> str:
    return f"nt AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY start, note_id) - 1 AS pos, {token} AS token FROM {source})"


def _taken(order: str, free: str, keys: str = "track_id") -> str:
    """SQL: acc (keys, p, q, n, c, m): occurrences of the motifs lv that a greedy walk in ``order`` accepts while ``free`` of used places and candidate; m numbers the motifs."""
    same, held = " AND ".join(f"g.{k} = c.{k}" for k in keys.split(", ")), ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"""mo AS (SELECT {keys}, n, gram, count(*) AS c, min(pos) AS first FROM lv WHERE c > 1 GROUP BY ALL), mr AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, first) - 1 AS m FROM mo),
  cd AS (SELECT {keys}, l.pos AS p, l.pos + l.n - 1 AS q, l.n, r.c, r.m, row_number() OVER (PARTITION BY {keys} ORDER BY r.m, l.pos) AS k FROM lv l JOIN mr r USING ({keys}, n, gram)),
  gw AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS q, CAST(NULL AS INT) AS n, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS m, FALSE AS ok FROM cd
    UNION ALL SELECT {held}, c.k, CASE WHEN {free} THEN list_concat(g.used, range(c.p, c.q + 1)) ELSE g.used END, c.p, c.q, c.n, c.c, c.m, {free} FROM gw g JOIN cd c ON {same} AND c.k = g.k + 1),
  acc AS (SELECT {keys}, p, q, n, c, m FROM gw WHERE ok)"""


_LONGEST, _COMMONEST, _UNUSED = "n DESC, c DESC", "c DESC, n DESC", "len(list_intersect(g.used, range(c.p, c.q + 1))) = 0"


@query(
    f"""WITH RECURSIVE {E}, {_numbered('pitch // 32')}, {longer('nt', 'track_id', 3, 30)}, {_taken(_LONGEST, _UNUSED)}, sp AS (SELECT a.track_id, x.start, y."end" AS stop, c, n, m FROM acc a JOIN nt x ON x.track_id = a.track_id AND x.pos = a.p JOIN nt y ON y.track_id = a.track_id AND y.pos = a.q),
  bf AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY track_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sp), en AS (SELECT track_id, max("end") AS whole FROM mel GROUP BY track_id), la AS (SELECT en.track_id, whole, coalesce(max(stop), 0) AS done FROM en LEFT JOIN sp USING (track_id) GROUP BY ALL)
  SELECT track_id, round(start, 3) AS start, round(stop, 3) AS "end", CAST(c AS INT) AS repetitions, CAST(n AS INT) AS length, CAST(m AS INT) AS motif_id FROM sp UNION ALL SELECT track_id, round(before, 3), round(start, 3), 1, 0, -1 FROM bf WHERE start > before UNION ALL SELECT track_id, round(done, 3), round(whole, 3), 1, 0, -1 FROM la WHERE done < whole"""
)
def greedy_cover_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequential.cover_segments(_notes(spark, d).withColumn("pitch", (F.col("pitch") / 32).cast("int")), 3, 30, TRACK), "start", "end", digits=3)


@query()
def bar_aligned_L(spark: SparkSession, d: str) -> DataFrame:
    return sequential.bar_aligned_segments(_lines(spark, d).withColumns({"pitch": (F.col("pitch") / 26).cast("int"), "dur": F.lit(30)}), BAR_L, 2, 100, 30)


@query(
    f"""WITH RECURSIVE {E}, {_numbered('CAST(round_even(pitch / 12, 0) AS INT)')}, {longer('nt', 'track_id', 3, 20)}, {_taken(_COMMONEST, "NOT list_contains(g.used, c.p) AND NOT list_contains(g.used, c.q) AND c.long").replace("r.c, r.m, row_number()", 'r.c, r.m, y."end" - x.start >= 2 AS long, row_number()').replace("FROM lv l JOIN mr r USING (track_id, n, gram))", "FROM lv l JOIN mr r USING (track_id, n, gram) JOIN nt x ON x.track_id = l.track_id AND x.pos = l.pos JOIN nt y ON y.track_id = l.track_id AND y.pos = l.pos + l.n - 1)").replace("SELECT track_id, l.pos AS p", "SELECT l.track_id, l.pos AS p").replace("OVER (PARTITION BY track_id ORDER BY r.m, l.pos)", "OVER (PARTITION BY l.track_id ORDER BY r.m, l.pos)")},
  sp AS (SELECT a.track_id, x.start, y."end" AS stop FROM acc a JOIN nt x ON x.track_id = a.track_id AND x.pos = a.p JOIN nt y ON y.track_id = a.track_id AND y.pos = a.q), gp AS (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY track_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS new FROM sp),
  rn AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM gp) SELECT track_id, round(min(start), 3) AS start, round(max(stop), 3) AS "end" FROM rn GROUP BY track_id, run"""
)
def octave_segments_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequential.octave_segments(_notes(spark, d), 3, 20, group=TRACK), "start", "end", digits=3)


@query(
    f"""WITH RECURSIVE {E}, n0 AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY track_id ORDER BY start, note_id) > {10 * BAR_E} THEN 1 ELSE 0 END AS gap FROM mel), nq AS (SELECT *, sum(gap) OVER (PARTITION BY track_id ORDER BY start, note_id ROWS UNBOUNDED PRECEDING) AS quiet FROM n0), {_numbered('pitch // 32', 'nq')}, {longer('nt', 'track_id', 4, 16)},
  {_taken(_LONGEST, _UNUSED + " AND c.near").replace("r.c, r.m, row_number()", "r.c, r.m, x.quiet = y.quiet AS near, row_number()").replace("FROM lv l JOIN mr r USING (track_id, n, gram))", "FROM lv l JOIN mr r USING (track_id, n, gram) JOIN nt x ON x.track_id = l.track_id AND x.pos = l.pos JOIN nt y ON y.track_id = l.track_id AND y.pos = l.pos + l.n - 1)").replace("SELECT track_id, l.pos AS p", "SELECT l.track_id, l.pos AS p").replace("OVER (PARTITION BY track_id ORDER BY r.m, l.pos)", "OVER (PARTITION BY l.track_id ORDER BY r.m, l.pos)")},
  ew AS (SELECT a.track_id, x.start, y."end" AS stop, c, n, c * n AS score FROM acc a JOIN nt x ON x.track_id = a.track_id AND x.pos = a.p JOIN nt y ON y.track_id = a.track_id AND y.pos = a.q)
  SELECT track_id, round(start, 3) AS start, round(stop, 3) AS "end", CAST(c AS INT) AS occurrences, CAST(n AS INT) AS length, CAST(score AS INT) AS score, CAST(row_number() OVER (ORDER BY score DESC, track_id, start) AS INT) AS rank FROM ew QUALIFY rank <= 500"""
)
def earworms_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequential.earworms(_notes(spark, d).withColumn("pitch", (F.col("pitch") / 32).cast("int")), 4, 16, 10 * BAR_E, 500, TRACK), "start", "end", digits=3)


_CLOSE = f"""al AS (SELECT a.file_id, a.track_id, a.bar, b.bar AS other, o.k, o.pitch, o.rel, o.dur, o.velocity FROM sz a JOIN sz b ON a.file_id = b.file_id AND a.track_id = b.track_id AND a.bar < b.bar JOIN ob o ON o.file_id = a.file_id AND o.track_id = a.track_id AND o.bar = a.bar
  UNION ALL SELECT a.file_id, a.track_id, a.bar, b.bar, o.k, -o.pitch, -o.rel, -o.dur, -o.velocity FROM sz a JOIN sz b ON a.file_id = b.file_id AND a.track_id = b.track_id AND a.bar < b.bar JOIN ob o ON o.file_id = b.file_id AND o.track_id = b.track_id AND o.bar = b.bar),
  df AS (SELECT file_id, track_id, bar, other, k, pow(sum(pitch), 2) + pow(sum(rel), 2) + pow(sum(dur), 2) + pow(sum(velocity), 2) AS sq FROM al GROUP BY ALL), mx AS (SELECT file_id, track_id, max(n) AS most FROM sz GROUP BY ALL), sc AS (SELECT file_id, track_id, bar, other, 1 - sqrt(sum(sq)) / (sqrt(4 * any_value(most)) * 127) AS similarity FROM df JOIN mx USING (file_id, track_id) GROUP BY file_id, track_id, bar, other)"""


@query(
    f"""WITH RECURSIVE {L}, {_BARS}, {_ORD}, {_CLOSE}, nr AS (SELECT file_id, track_id, other AS bar, list(bar) AS near FROM sc WHERE similarity > 1 - 0.9::DOUBLE GROUP BY ALL), bk AS (SELECT s.file_id, s.track_id, s.bar, coalesce(near, []) AS near, row_number() OVER (PARTITION BY s.file_id, s.track_id ORDER BY s.bar) AS k FROM sz s LEFT JOIN nr USING (file_id, track_id, bar)),
  wl AS (SELECT file_id, track_id, k, bar, bar AS leader, [bar] AS leaders FROM bk WHERE k = 1 UNION ALL SELECT file_id, track_id, k, bar, coalesce(found, bar), CASE WHEN found IS NULL THEN list_append(leaders, bar) ELSE leaders END FROM (SELECT w.file_id, w.track_id, b.k, b.bar, w.leaders, list_filter(w.leaders, lambda x: list_contains(b.near, x))[1] AS found FROM wl w JOIN bk b ON b.file_id = w.file_id AND b.track_id = w.track_id AND b.k = w.k + 1))
  SELECT file_id, track_id, CAST(bar AS BIGINT) AS bar, CAST(leader AS BIGINT) AS leader FROM wl"""
)
def leader_groups_L(spark: SparkSession, d: str) -> DataFrame:
    return sequential.leader_groups(t.bars(_lines(spark, d), BAR_L))


_DP = "pn AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start, note_id) - 1 AS i, start, CAST(pitch AS DOUBLE) AS p, CAST(dur AS DOUBLE) AS u FROM mel), ed AS (SELECT a.track_id, a.i AS j, b.i, sqrt((a.start - b.start) * (a.start - b.start) + (a.p - b.p) * (a.p - b.p) + (a.u - b.u) * (a.u - b.u)) AS w FROM pn a JOIN pn b ON a.track_id = b.track_id AND a.i < b.i), r0 AS (SELECT track_id, i, 0::DOUBLE AS reach FROM pn)"
_ROUNDS = ", ".join(f"r{k} AS (SELECT track_id, i, min(t) AS reach, arg_min(j, (t, j)) AS back FROM (SELECT e.track_id, e.i, e.j, r.reach + e.w AS t FROM ed e JOIN r{k - 1} r ON r.track_id = e.track_id AND r.i = e.j) GROUP BY ALL UNION ALL SELECT track_id, i, 0, NULL FROM pn WHERE i = 0)" for k in range(1, 5))


@query(f"WITH RECURSIVE {E}, {_DP}, {_ROUNDS}, pa AS (SELECT track_id, max(i) AS i FROM pn GROUP BY track_id HAVING max(i) > 0 UNION ALL SELECT p.track_id, r.back FROM pa p JOIN r4 r ON r.track_id = p.track_id AND r.i = p.i WHERE r.back > 0) SELECT track_id, CAST(i AS INT) AS boundary, round(start, 3) AS start FROM pa JOIN pn USING (track_id, i)")
def dp_segments_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequential.dp_segments(_notes(spark, d), 5, TRACK), "start", digits=3)


# patterns of bars that resemble each other

_MATCH = """nb AS (SELECT file_id, track_id, bar, row_number() OVER (PARTITION BY file_id, track_id ORDER BY bar) - 1 AS m, n FROM sz), eq AS (SELECT a.file_id, a.track_id, a.bar AS x, b.bar AS y, count(*) AS same FROM ob a JOIN ob b ON a.file_id = b.file_id AND a.track_id = b.track_id AND a.k = b.k AND a.bar < b.bar AND a.pitch = b.pitch GROUP BY ALL),
  mt AS (SELECT e.file_id, e.track_id, a.m AS x, b.m AS y FROM eq e JOIN nb a ON a.file_id = e.file_id AND a.track_id = e.track_id AND a.bar = e.x JOIN nb b ON b.file_id = e.file_id AND b.track_id = e.track_id AND b.bar = e.y WHERE same / greatest(a.n, b.n)::DOUBLE >= {}),
  isl AS (SELECT *, x - row_number() OVER (PARTITION BY file_id, track_id, y - x ORDER BY x) AS g FROM mt), rl AS (SELECT *, count(*) OVER (PARTITION BY file_id, track_id, y - x, g ORDER BY x DESC) AS run FROM isl),
  ed AS (SELECT file_id, track_id, min(bar) AS lo, max(bar) AS hi FROM sz GROUP BY ALL), wd AS (SELECT e.file_id, e.track_id, w.n, s.bar, min(b.m) AS m, count(*) AS c FROM ed e, (SELECT unnest(range({}, {})) AS n) w, LATERAL (SELECT unnest(range(e.lo, e.hi - w.n + 2)) AS bar) s JOIN nb b ON b.file_id = e.file_id AND b.track_id = e.track_id AND b.bar >= s.bar AND b.bar < s.bar + w.n {} GROUP BY ALL),
  pc AS (SELECT a.file_id, a.track_id, a.n, a.bar, b.bar AS copy FROM wd a JOIN wd b ON a.file_id = b.file_id AND a.track_id = b.track_id AND a.n = b.n AND a.c = b.c AND a.bar < b.bar LEFT JOIN rl r ON r.file_id = a.file_id AND r.track_id = a.track_id AND r.x = a.m AND r.y = b.m WHERE a.m = b.m OR r.run >= a.c)"""


@query(f"WITH {L}, {_BARS}, {_ORD}, {_MATCH.format(0.8, 2, 9, 'WHERE w.n <= (e.hi - e.lo + 1) // 2')} SELECT file_id, track_id, CAST(n AS INT) AS n, CAST(bar AS BIGINT) AS bar, CAST(min(copy) AS BIGINT) AS copy FROM pc GROUP BY file_id, track_id, n, bar")
def similar_bar_patterns_L(spark: SparkSession, d: str) -> DataFrame:
    return classify.similar_bar_patterns(t.bars(_lines(spark, d), BAR_L))


@query(f"WITH {L}, {_BARS}, {_ORD}, {_MATCH.format(0.1, 4, 5, '')} SELECT file_id, track_id, CAST(bar AS BIGINT) AS bar, string_agg(CAST(copy AS VARCHAR), ',' ORDER BY copy) AS copies FROM pc GROUP BY file_id, track_id, bar")
def fixed_bar_patterns_L(spark: SparkSession, d: str) -> DataFrame:
    return classify.fixed_bar_patterns(t.bars(_lines(spark, d), BAR_L), 4, 0.1, True).withColumn("copies", joined("copies"))


@query()
def merged_patterns_L(spark: SparkSession, d: str) -> DataFrame:
    bars, seqs, patterns = _tokens(spark, d)
    return classify.merge_patterns(patterns, seqs, bars).select(*FILE_TRACK, "n", joined("gram").alias("gram"), "count", "family")


@query()
def sequence_similarity_L(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distance.adjacent_sequence_similarity(t.bars(_lines(spark, d), BAR_L)), "similarity")


@query()
def dtw_pairs_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distance.dtw_repeats(_notes(spark, d), 8, 100.0, TRACK), "distance")


@query()
def cluster_similarity_E(spark: SparkSession, d: str) -> DataFrame:
    small = t.onset_clusters(_notes(spark, d), 36_000, 2, TRACK).withColumns({"pitch": F.col("pitch") / 128, "dur": F.col("dur") / 100})
    return rounded(distance.cluster_similarity(small, 0.8, TRACK), "similarity")


@query()
def structure_E(spark: SparkSession, d: str) -> DataFrame:
    return structure.structure_segments(_notes(spark, d), BAR_E / 4, group=TRACK)


@query(
    f"""WITH {L}, {_BARS}, {_ORD}, al AS (SELECT a.file_id, a.track_id, a.bar, b.bar AS other, o.k, o.pitch, o.rel, o.dur, o.velocity FROM sz a JOIN sz b ON a.file_id = b.file_id AND a.track_id = b.track_id AND a.bar < b.bar JOIN ob o ON o.file_id = a.file_id AND o.track_id = a.track_id AND o.bar = a.bar
  UNION ALL SELECT a.file_id, a.track_id, a.bar, b.bar, o.k, -o.pitch, -o.rel, -o.dur, -o.velocity FROM sz a JOIN sz b ON a.file_id = b.file_id AND a.track_id = b.track_id AND a.bar < b.bar JOIN ob o ON o.file_id = b.file_id AND o.track_id = b.track_id AND o.bar = b.bar),
  df AS (SELECT file_id, track_id, bar, other, k, pow(sum(pitch), 2) + pow(sum(rel), 2) + pow(sum(dur), 2) + pow(sum(velocity), 2) AS sq FROM al GROUP BY ALL), mx AS (SELECT file_id, track_id, max(n) AS most FROM sz GROUP BY ALL), sc AS (SELECT file_id, track_id, bar, other, 1 - sqrt(sum(sq)) / (sqrt(4 * any_value(most)) * 127) AS similarity FROM df JOIN mx USING (file_id, track_id) GROUP BY file_id, track_id, bar, other)
  SELECT file_id, track_id, CAST(bar AS BIGINT) AS bar, CAST(other AS BIGINT) AS other, round(similarity, 4) AS similarity FROM sc WHERE similarity > 0.1"""
)
def close_bars_L(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distance.close_bars(t.bars(_lines(spark, d), BAR_L)), "similarity")
