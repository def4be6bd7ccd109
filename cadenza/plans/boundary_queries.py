"""Boundaries from repeats, small summaries, and clusterings of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.expr import octave_name, pitch_class
from cadenza.operators import boundaries as b
from cadenza.operators import classify, cluster, search
from cadenza.operators import timeline as t
from cadenza.plans.feature_queries import EVERY
from cadenza.plans.oracle import E, L
from cadenza.plans.registry import query, rounded
from cadenza.plans.timeline_queries import _BARS, _SILENT, BAR_E, BAR_L, FILE_TRACK, LOUD, TRACK, _lines, _notes, _spaced_sql
from cadenza.sources.tables import vectors


@query(
    f"""WITH {E}, {_SILENT}, w AS (SELECT track_id, start, note_id, start + dur + lead(dur) OVER o AS stop, row_number() OVER o - 1 AS pos, CAST(pitch % 12 AS VARCHAR) || ',' || lead(pitch % 12) OVER o AS gram FROM mel WINDOW o AS (PARTITION BY track_id ORDER BY start, note_id)),
  f AS (SELECT track_id, gram FROM (SELECT track_id, gram, row_number() OVER (PARTITION BY track_id ORDER BY min(pos)) AS k FROM w WHERE gram IS NOT NULL GROUP BY track_id, gram HAVING count(*) >= 2) WHERE k <= 20),
  h AS (SELECT DISTINCT track_id, start, stop FROM w SEMI JOIN f USING (track_id, gram)), p AS (SELECT track_id, unnest([start, stop]) AS pos FROM h WHERE NOT EXISTS (SELECT 1 FROM silent s WHERE s.track_id = h.track_id AND h.start >= s.start AND h.start < s."end"))
  SELECT track_id, round(pos, 3) AS pos FROM (SELECT DISTINCT * FROM p)"""
)
def pattern_marks_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.pattern_marks(_notes(spark, d), [pitch_class("pitch")], 2, LOUD, 20, TRACK), "pos", digits=3)


def _marked(k: int, token: str) -> str:
    """SQL: h{k} (track_id, start, stop), the occurrences of the first frequent pairs of a token."""
    return f"""w{k} AS (SELECT track_id, start, start + dur + lead(dur) OVER o AS stop, row_number() OVER o - 1 AS pos, {token} AS a, lead({token}) OVER o AS b FROM mel WINDOW o AS (PARTITION BY track_id ORDER BY start, note_id)),
  f{k} AS (SELECT track_id, a, b FROM (SELECT track_id, a, b, row_number() OVER (PARTITION BY track_id ORDER BY min(pos)) AS k FROM w{k} WHERE b IS NOT NULL GROUP BY track_id, a, b HAVING count(*) >= 2) WHERE k <= 20), h{k} AS (SELECT DISTINCT track_id, start, stop FROM w{k} SEMI JOIN f{k} USING (track_id, a, b))"""


@query(
    f"""WITH RECURSIVE {E}, {_SILENT}, {_marked(1, 'pitch % 12')}, {_marked(2, 'dur')}, h AS (SELECT * FROM h1 UNION SELECT * FROM h2), bm AS (SELECT track_id, unnest([start, stop]) AS pos FROM h WHERE NOT EXISTS (SELECT 1 FROM silent s WHERE s.track_id = h.track_id AND h.start >= s.start AND h.start < s."end")),
  {_spaced_sql('bm', 2 * BAR_E, 8 * BAR_E)} SELECT track_id, round(pos, 3) AS pos FROM kept"""
)
def pattern_boundaries_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.pattern_boundaries(_notes(spark, d), [pitch_class("pitch"), F.col("dur")], 2, BAR_E, LOUD, group=TRACK), "pos", digits=3)


@query()
def warped_boundaries_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.warped_boundaries(_notes(spark, d), 8, 100.0, BAR_E, group=TRACK), "pos", digits=3)


@query()
def rhythm_boundaries_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.rhythm_boundaries(_notes(spark, d), 8, 5, 4 * BAR_E, TRACK), "pos", digits=3)


@query(
    f"""WITH {E}, g AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY track_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3600 THEN 1 ELSE 0 END AS new FROM mel),
  r AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT track_id, round(min(start), 3) AS start, round(max("end"), 3) AS "end" FROM r GROUP BY track_id, run"""
)
def gap_merge_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.gap_merge(_notes(spark, d).select("track_id", "start", "end"), 3600, TRACK), "start", "end", digits=3)


@query(f'WITH {E} SELECT track_id, greatest(min(pitch) - 3, 0) AS low, least(max(pitch) + 3, 127) AS high, round(min(start), 3) AS start, round(max("end"), 3) AS "end" FROM mel GROUP BY track_id')
def roll_bounds_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.roll_bounds(_notes(spark, d), TRACK), "start", "end", digits=3)


@query(f"WITH {L}, {_BARS} SELECT file_id, track_id, CAST(max(n) AS INT) AS n FROM (SELECT file_id, track_id, bar, count(*) AS n FROM inb GROUP BY ALL) GROUP BY ALL")
def max_notes_L(spark: SparkSession, d: str) -> DataFrame:
    return b.max_notes(t.bars(_lines(spark, d), BAR_L))


@query(f"WITH {L} SELECT file_id, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][pitch % 12 + 1] || CAST(pitch // 12 - 1 AS VARCHAR) AS name, count(*) AS n FROM mel SEMI JOIN (SELECT file_id, min(track_id) AS track_id FROM mel GROUP BY file_id) USING (file_id, track_id) GROUP BY ALL")
def melody_names_L(spark: SparkSession, d: str) -> DataFrame:
    return b.melody(_lines(spark, d)).groupBy("file_id", octave_name("pitch").alias("name")).agg(F.count(F.lit(1)).alias("n"))


_EDGE = "eb AS (SELECT file_id, track_id, bar, arg_min(pitch, (start, note_id)) AS hp, arg_min(dur, (start, note_id)) AS hd, arg_max(pitch, (start, note_id)) AS tp, arg_max(dur, (start, note_id)) AS td FROM inb GROUP BY ALL)"


@query(
    f"""WITH {L}, {_BARS}, {_EDGE}, j AS (SELECT *, CASE WHEN bar - lag(bar) OVER w = 1 AND (abs(hp - lag(tp) OVER w) <= 2 OR (least(hd, lag(td) OVER w) > 0 AND greatest(hd, lag(td) OVER w) <= 2 * least(hd, lag(td) OVER w))) THEN 0 ELSE 1 END AS new FROM eb WINDOW w AS (PARTITION BY file_id, track_id ORDER BY bar)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY file_id, track_id ORDER BY bar ROWS UNBOUNDED PRECEDING) AS run FROM j) SELECT file_id, track_id, CAST(min(bar) AS BIGINT) AS first, CAST(max(bar) AS BIGINT) AS last, count(*) AS n FROM r GROUP BY file_id, track_id, run HAVING count(*) BETWEEN 2 AND 8"""
)
def continuous_phrases_L(spark: SparkSession, d: str) -> DataFrame:
    return classify.continuous_phrases(t.bars(_lines(spark, d), BAR_L), group=FILE_TRACK)


@query()
def note_clusters_E(spark: SparkSession, d: str) -> DataFrame:
    return cluster.note_clusters(_notes(spark, d).withColumn("start", F.col("start") / BAR_E), 30.0, TRACK)


@query()
def note_kmeans_E(spark: SparkSession, d: str) -> DataFrame:
    return cluster.note_kmeans(_notes(spark, d))


@query()
def pca_similar_V(spark: SparkSession, d: str) -> DataFrame:
    reduced = cluster.pca(vectors(spark, d), 8)[0]
    return rounded(search.similar_vectors(reduced, reduced.where(F.col("id") % EVERY == 0), 8), "d2", "similarity")


@query()
def best_k_V(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.best_k(vectors(spark, d)), "silhouette")


@query()
def elbow_V(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.elbow(vectors(spark, d), range(1, 11)), "cost")


@query("SELECT CAST(i * 5 AS BIGINT) AS start, CAST(i * 5 + 5 AS BIGINT) AS \"end\" FROM range(20) r(i)")
def fixed_segments(spark: SparkSession, d: str) -> DataFrame:
    return b.fixed_segments(spark, 100, 5)
