"""N-grams, motifs, chords and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.expr import note_name, octave_bucket, pitch_class
from cadenza.operators import ngrams as g
from cadenza.operators import sequential
from cadenza.plans.oracle import E, L, longer
from cadenza.plans.registry import joined, query, rounded
from cadenza.plans.timeline_queries import _SEG, _lines, _notes, _segments
from cadenza.sources.tables import table

TRACK, FILE_TRACK = ["track_id"], ["file_id", "track_id"]
_NAMES = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"
_W = "WINDOW w AS (PARTITION BY track_id ORDER BY start, note_id)"


def _text(token: str, n: int) -> str:
    """SQL for a window's tokens as text; null where the track ends."""
    return " || ',' || ".join([f"CAST({token} AS VARCHAR)", *[f"CAST(lead({token}, {k}) OVER w AS VARCHAR)" for k in range(1, n)]])


def _levels(token: str, least: int, most: int, source: str = "mel", keys: str = "track_id", window: str = _W) -> str:
    """SQL: (keys, n, pos, gram) for all lengths."""
    return " UNION ALL ".join(f"SELECT * FROM (SELECT {keys}, {n} AS n, row_number() OVER w - 1 AS pos, {_text(token, n)} AS gram FROM {source} {window}) WHERE gram IS NOT NULL" for n in range(least, most + 1))


_MOTIFS = "mo AS (SELECT track_id, n, gram, list_sort(list(pos)) AS positions, count(*) AS count, count(*) * n AS score FROM gr GROUP BY track_id, n, gram HAVING count(*) >= 2)"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return g.sequences(_notes(spark, d), pitch_class("pitch"), TRACK)


@query(f"WITH {E}, gr AS ({_levels('pitch % 12', 3, 3)}) SELECT track_id, gram, count(*) AS count FROM gr GROUP BY track_id, gram HAVING count(*) >= 2")
def ngram_freq_E(spark: SparkSession, d: str) -> DataFrame:
    found = g.windows(_notes(spark, d), pitch_class("pitch"), 3, TRACK)
    return found.groupBy("track_id", "gram").agg(F.count(F.lit(1)).alias("count")).where("count >= 2").withColumn("gram", joined("gram"))


@query(f"WITH {E}, gr AS ({_levels('pitch % 12', 2, 5)}), {_MOTIFS} SELECT track_id, n, gram, array_to_string(positions, ',') AS positions, count FROM mo")
def motifs_multi_len_E(spark: SparkSession, d: str) -> DataFrame:
    found = g.motifs(g.grams(_classes(spark, d), 2, 5, TRACK), 2, TRACK)
    return found.select("track_id", "n", joined("gram").alias("gram"), joined("positions").alias("positions"), "count")


@query(f"WITH {E}, gr AS ({_levels('pitch % 12', 2, 5)}), {_MOTIFS} SELECT track_id, rank, n, gram, count, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY track_id ORDER BY score DESC, positions[1], n, gram) AS INT) AS rank FROM mo) WHERE rank <= 5")
def motif_score_topk_E(spark: SparkSession, d: str) -> DataFrame:
    found = g.motifs(g.grams(_classes(spark, d), 2, 5, TRACK), 2, TRACK).withColumn("gram", joined("gram"))
    return g.top_motifs(found, [F.col("score").desc()], 5, TRACK).select("track_id", "rank", "n", "gram", "count", "score")


@query(f"WITH {E}, gr AS ({_levels('pitch % 12', 1, 8)}), mo AS (SELECT track_id, n, gram, count(*) AS count FROM gr GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM mo QUALIFY n = max(n) OVER (PARTITION BY track_id)")
def longest_frequent_E(spark: SparkSession, d: str) -> DataFrame:
    found = g.longest_frequent(g.grams(_classes(spark, d), 1, 8, TRACK), 2, TRACK)
    return found.withColumn("gram", joined("gram"))


@query(f"WITH {L} SELECT file_id, track_id, CAST(start AS INT) AS start, string_agg(CAST(pitch AS VARCHAR), ',' ORDER BY pitch) AS pitches, min(pitch) AS bass, max(dur) AS dur, count(*) AS density FROM mel GROUP BY file_id, track_id, start")
def chords_L(spark: SparkSession, d: str) -> DataFrame:
    return g.chords(_lines(spark, d)).withColumn("pitches", joined("pitches"))


_CHORD = """pr AS (SELECT file_id, track_id, start, CAST(round_even(pitch / 12, 0) AS INT) AS p, CAST(round_even(dur / 30, 0) * 30 AS INT) AS q FROM mel),
  ch AS (SELECT file_id, track_id, start, string_agg(p || ':' || q, '+' ORDER BY p, q) AS body FROM pr GROUP BY file_id, track_id, start),
  tk AS (SELECT file_id, track_id, start, body || '/' || CAST(coalesce(round_even((lead(start) OVER (PARTITION BY file_id, track_id ORDER BY start) - start) / 30, 0) * 30, 0) AS INT) AS token FROM ch)"""
_FW = "WINDOW w AS (PARTITION BY file_id, track_id ORDER BY start)"


@query(f"WITH RECURSIVE {L}, {_CHORD}, nt AS (SELECT file_id, track_id, row_number() OVER (PARTITION BY file_id, track_id ORDER BY start) - 1 AS pos, token FROM tk), {longer('nt', 'file_id, track_id', 2, 100)} SELECT file_id, track_id, n, gram, array_to_string(list_sort(list(pos)), ',') AS positions, count(*) * n AS score FROM lv WHERE c > 1 GROUP BY file_id, track_id, n, gram")
def chord_motifs_L(spark: SparkSession, d: str) -> DataFrame:
    tokens = g.chord_tokens(_lines(spark, d), 30, octave_bucket("pitch"))
    found = sequential.long_motifs(tokens, F.col("token"), 2, 100, order="start")
    return found.select(*FILE_TRACK, "n", joined("gram").alias("gram"), joined("positions").alias("positions"), "score")


@query(f"WITH {E}, gr AS ({_levels(f'{_NAMES}[pitch % 12 + 1]', 4, 4)}) SELECT track_id, gram, count(*) AS motif_count, greatest(count(*) - 2, 0) AS ostinato_count FROM gr GROUP BY track_id, gram")
def ostinato_E(spark: SparkSession, d: str) -> DataFrame:
    found = g.windows(_notes(spark, d), note_name("pitch"), 4, TRACK)
    return g.ostinatos(found, TRACK).withColumn("gram", joined("gram"))


@query(f"WITH {E}, gr AS ({_levels('pitch % 12', 3, 3)}) SELECT a.track_id, a.gram, count(*) AS pairs FROM gr a JOIN gr b ON a.track_id = b.track_id AND a.gram = b.gram AND b.pos >= a.pos + 3 GROUP BY a.track_id, a.gram")
def sequence_pairs_E(spark: SparkSession, d: str) -> DataFrame:
    found = g.windows(_notes(spark, d), pitch_class("pitch"), 3, TRACK)
    return g.sequence_pairs(found, TRACK).withColumn("gram", joined("gram"))


@query(
    f"""WITH {E}, nm AS (SELECT track_id, start, note_id, {_NAMES}[pitch % 12 + 1] AS name FROM mel), gr AS (SELECT track_id, name AS a, lead(name, 1) OVER w AS b, lead(name, 2) OVER w AS c FROM nm {_W})
  SELECT track_id, a || ',' || b || ',' || c AS gram, count(*) AS count FROM gr WHERE c IS NOT NULL AND a <> b AND b <> c AND a <> c GROUP BY ALL"""
)
def arpeggio_E(spark: SparkSession, d: str) -> DataFrame:
    return g.arpeggios(g.windows(_notes(spark, d), note_name("pitch"), 3, TRACK), TRACK).withColumn("gram", joined("gram"))


_ON = f"ev AS (SELECT track_id, start AS time, note_id * 2 AS seq, {_NAMES}[pitch % 12 + 1] AS name, 1 AS step FROM mel UNION ALL SELECT track_id, start + 1000 * dur, note_id * 2 + 1, {_NAMES}[pitch % 12 + 1], -1 FROM mel)"
_LEVELS = ", ".join(f"sum(CASE WHEN name = '{n}' THEN step ELSE 0 END) OVER w > 0 AS n{k}" for k, n in enumerate(("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")))


def _only(*names: int) -> str:
    return " AND ".join(f"n{k}" if k in names else f"NOT n{k}" for k in range(12))


@query(f"WITH {E}, {_ON}, lv AS (SELECT track_id, time, {_LEVELS} FROM ev WINDOW w AS (PARTITION BY track_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING)) SELECT track_id, round(time, 3) AS time, CASE WHEN n0 THEN 'C,E,G' ELSE 'D,G,B' END AS chord FROM lv WHERE ({_only(0, 4, 7)}) OR ({_only(2, 7, 11)})")
def cadences_E(spark: SparkSession, d: str) -> DataFrame:
    # a note sounds for its value in thousands of seconds, so that some sound together
    notes = _notes(spark, d)
    on = notes.select("track_id", F.col("start").alias("time"), (F.col("note_id") * 2).alias("seq"), note_name("pitch").alias("name"), F.lit(1).alias("step"))
    off = notes.select("track_id", (F.col("start") + 1000 * F.col("dur")).alias("time"), (F.col("note_id") * 2 + 1).alias("seq"), note_name("pitch").alias("name"), F.lit(-1).alias("step"))
    return rounded(g.cadences(on.unionByName(off), TRACK).withColumn("chord", joined("chord")), "time", digits=3)


_OCT = "CAST(round_even(pitch / 12, 0) AS INT)"


@query(f"WITH RECURSIVE {E}, nt AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start, note_id) - 1 AS pos, {_OCT} AS token FROM mel), {longer('nt', 'track_id', 3, 20)}, mo AS (SELECT track_id, n, gram, min(pos) AS first, count(*) AS count FROM lv WHERE c > 1 GROUP BY ALL) SELECT track_id, rank, n, gram, count FROM (SELECT *, CAST(row_number() OVER (PARTITION BY track_id ORDER BY count DESC, n DESC, first, gram) AS INT) AS rank FROM mo) WHERE rank <= 10")
def octave_patterns_E(spark: SparkSession, d: str) -> DataFrame:
    found = sequential.long_motifs(_notes(spark, d), octave_bucket("pitch"), 3, 20, TRACK).withColumn("gram", joined("gram"))
    return g.top_motifs(found, [F.col("count").desc(), F.col("n").desc()], 10, TRACK).select("track_id", "rank", "n", "gram", "count")


@query(f"WITH {E}, gr AS ({_levels('pitch // 32', 4, 16)}), {_MOTIFS} SELECT track_id, n, gram, count, score FROM mo ORDER BY score DESC, track_id, n, gram LIMIT 500")
def earworm_candidates_E(spark: SparkSession, d: str) -> DataFrame:
    seqs = g.sequences(_notes(spark, d), (F.col("pitch") / 32).cast("int"), TRACK)
    found = g.motifs(g.grams(seqs, 4, 16, TRACK), 2, TRACK).withColumn("gram", joined("gram"))
    return found.orderBy(F.col("score").desc(), "track_id", "n", "gram").limit(500).select("track_id", "n", "gram", "count", "score")


@query(
    f"""WITH {E}, gr AS (SELECT track_id, row_number() OVER w - 1 AS pos, start, start + dur + lead(dur, 1) OVER w + lead(dur, 2) OVER w AS stop, {_text('pitch % 12', 3)} AS gram FROM mel {_W}), fr AS (SELECT track_id, gram FROM gr WHERE gram IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
  SELECT track_id, gram, CAST(pos AS INT) AS pos, round(start, 3) AS start, round(stop, 3) AS stop FROM gr SEMI JOIN fr USING (track_id, gram)"""
)
def pattern_occurrences_E(spark: SparkSession, d: str) -> DataFrame:
    found = g.windows(_notes(spark, d), pitch_class("pitch"), 3, TRACK)
    frequent = found.groupBy("track_id", "gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rounded(g.occurrences(found, frequent, TRACK).withColumn("gram", joined("gram")), "start", "stop", digits=3)


@query(
    r"""WITH w AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
  p AS (SELECT lang, t, unnest(range(1, len(t) - 1)) AS i FROM w WHERE len(t) >= 3) SELECT lang, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS gram, count(*) AS count FROM p GROUP BY ALL HAVING count(*) >= 3"""
)
def token_ngrams_D(spark: SparkSession, d: str) -> DataFrame:
    return g.token_ngrams(table(spark, d, "documents"), 3, ["lang"]).where("count >= 3")


# documented deduplication of patterns within and across segments; patterns are the repeated class windows of a segment

_SEGW = "WINDOW w AS (PARTITION BY track_id, segment_id ORDER BY start, note_id)"
_PATTERNS = f"gr AS ({_levels('pitch % 12', 2, 3, 'seg', 'track_id, segment_id', _SEGW)})"


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    keys = ["track_id", "segment_id"]
    found = g.grams(g.sequences(_segments(spark, d), pitch_class("pitch"), keys), 2, 3, keys)
    return found.select(*keys, F.col("pos").alias("first"), F.col("n").alias("length"), joined("gram").alias("pitches"))


@query(f"WITH {E}, {_SEG}, {_PATTERNS} SELECT track_id, segment_id, min(pos) AS first, n AS length, gram AS pitches FROM gr GROUP BY ALL")
def dedupe_in_segment_E(spark: SparkSession, d: str) -> DataFrame:
    return sequential.dedupe_in_segment(_patterns(spark, d), ["track_id", "segment_id"]).select("track_id", "segment_id", F.col("first").cast("long").alias("first"), "length", "pitches")


@query(f"WITH {E}, {_SEG}, {_PATTERNS}, p AS (SELECT *, row_number() OVER (PARTITION BY track_id, segment_id, n ORDER BY pos, gram) AS k FROM gr) SELECT track_id, segment_id, pos AS first, n AS length, gram AS pitches FROM p WHERE k = 1")
def dedupe_compat_E(spark: SparkSession, d: str) -> DataFrame:
    return sequential.dedupe_in_segment(_patterns(spark, d), ["track_id", "segment_id"], compat=True).select("track_id", "segment_id", F.col("first").cast("long").alias("first"), "length", "pitches")


@query(f"WITH {E}, {_SEG}, {_PATTERNS} SELECT track_id, segment_id, pos AS first, n AS length, gram AS pitches FROM gr QUALIFY segment_id = min(segment_id) OVER (PARTITION BY track_id, gram)")
def dedupe_across_segments_E(spark: SparkSession, d: str) -> DataFrame:
    return sequential.dedupe_across_segments(_patterns(spark, d), TRACK).select("track_id", "segment_id", F.col("first").cast("long").alias("first"), "length", "pitches")
