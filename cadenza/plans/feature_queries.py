"""Feature sets, scaling and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators import cluster, distance, features, search
from cadenza.plans.oracle import F10, FEATURES, LAGS, LONG10, E
from cadenza.plans.registry import query, r, rounded
from cadenza.schema import FEATURE_WEIGHTS, FEATURES8
from cadenza.sources.tables import event_notes, melodic, vectors

DIM = 64
VECTOR_WEIGHTS = [0.5 + (i % 4) * 0.5 for i in range(DIM)]
_W = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in FEATURE_WEIGHTS.items())
_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT vec_id, label, unnest(e) AS val, generate_subscripts(e, 1) AS i FROM v)"
_SCALE = "s AS (SELECT i, CASE WHEN stddev_pop(val) = 0 THEN 1 ELSE stddev_pop(val) END AS sd FROM x GROUP BY i)"


def tracks10(spark: SparkSession, d: str) -> DataFrame:
    """The ten features of every track."""
    return features.features10(melodic(event_notes(spark, d)))


def tracks8(spark: SparkSession, d: str) -> DataFrame:
    """The eight features of every track."""
    return features.features8(melodic(event_notes(spark, d)))


@query(f"WITH {E}, {LAGS}, {F10} SELECT track_id, {', '.join(r(c) for c in FEATURES)}, n_notes FROM f")
def features10_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracks10(spark, d).drop("file_id"), *FEATURES)


@query(f"WITH {E}, {LAGS}, {F10}, {LONG10} SELECT feature, {r('mean')}, {r('scale')} FROM (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS scale FROM long GROUP BY feature)")
def scaler_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.scaler_table(tracks10(spark, d), FEATURES), "mean", "scale")


#: A search asks for every row whose id this divides, against all rows.
EVERY = 20

_NEAR10 = f"""w(feature, weight) AS (VALUES {_W}), s AS (SELECT feature, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd FROM long GROUP BY feature),
  d AS (SELECT q.track_id AS query, l.track_id, sum(pow(weight * (q.value - l.value) / sd, 2)) AS d2 FROM long l JOIN long q USING (feature) JOIN s USING (feature) JOIN w USING (feature) WHERE q.track_id % {EVERY} = 0 GROUP BY q.track_id, l.track_id),
  near AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(d2, 9), track_id) AS INT) AS rank, track_id, d2 FROM d QUALIFY rank <= 33)"""


def _asked(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key) % EVERY == 0)


@query(f"WITH {E}, {LAGS}, {F10}, {LONG10}, {_NEAR10} SELECT query, rank, track_id, {r('d2')}, round(1 / (1 + d2), 4) AS similarity FROM near")
def similar_tracks_E(spark: SparkSession, d: str) -> DataFrame:
    catalogue = tracks10(spark, d)
    return rounded(search.similar(catalogue, _asked(catalogue, "track_id"), "track_id", FEATURES), "d2", "similarity")


def _knn_sql(weight: str) -> str:
    return f"""WITH {_V}, {_SCALE}, q AS (SELECT vec_id AS query, i, val FROM x WHERE vec_id % {EVERY} = 0), d AS (SELECT query, x.vec_id AS id, sum(pow({weight} * (q.val - x.val) / sd, 2)) AS d2 FROM x JOIN q USING (i) JOIN s USING (i) GROUP BY query, x.vec_id),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(d2, 9), id) AS INT) AS rank FROM d QUALIFY rank <= 33) SELECT query, rank, id, {r('d2')}, round(1 / (1 + d2), 4) AS similarity FROM k"""


@query(_knn_sql("(0.5 + ((i - 1) % 4) * 0.5)"))
def knn_weighted_V(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(search.similar_vectors(v, _asked(v, "id"), DIM, VECTOR_WEIGHTS), "d2", "similarity")


@query(_knn_sql("1"))
def knn_unweighted_V(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(search.similar_vectors(v, _asked(v, "id"), DIM), "d2", "similarity")


_EIGHT = [*FEATURES8, "pitch_min", "pitch_max", "duration_min", "duration_max"]
_F8 = """g AS (SELECT track_id, 120.0::DOUBLE AS tempo, avg(pitch) AS pitch_mean, stddev_pop(pitch) AS pitch_std, avg(dur) AS duration_mean, stddev_pop(dur) AS duration_std, coalesce(avg(ioi), 0) AS ioi_mean, coalesce(stddev_pop(ioi), 0) AS ioi_std, avg(off) AS syncopation_ratio,
  min(pitch) AS pitch_min, max(pitch) AS pitch_max, min(dur) AS duration_min, max(dur) AS duration_max FROM lags GROUP BY track_id)"""


@query(f"WITH {E}, {LAGS}, {_F8} SELECT track_id, {', '.join(r(c) for c in _EIGHT)} FROM g")
def features8_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracks8(spark, d).drop("file_id"), *_EIGHT)


_F29 = ["avg_pitch", "pitch_std", "median_pitch", "avg_velocity", "velocity_std", "avg_duration", "duration_std", "median_duration", "note_count", "pitch_range", "track_duration", "chord_frequency", "tempo", "avg_interval", "silence_ratio", "upper_half_ratio", "lower_half_ratio", "avg_chord_size", "chord_time_ratio", "note_density", "duration_skewness", "duration_kurtosis", "duration_min", "duration_max", "duration_range", "duration_iqr", "short_long_ratio", "pitch_entropy", "note_variety"]


@query(
    f"""WITH {E}, p AS (SELECT track_id, program, pitch, count(*) AS n FROM mel GROUP BY ALL), en AS (SELECT track_id, program, -sum(n / t * ln(n / t)) AS pitch_entropy, count(*) AS note_variety FROM (SELECT *, sum(n) OVER (PARTITION BY track_id, program)::DOUBLE AS t FROM p) GROUP BY ALL),
  l AS (SELECT *, start - lag(start) OVER (PARTITION BY track_id, program ORDER BY note_id) AS ds, min(pitch) OVER g + (max(pitch) OVER g - min(pitch) OVER g) / 2.0::DOUBLE AS mid, median(dur) OVER g AS med, avg(dur) OVER g AS mu FROM mel WINDOW g AS (PARTITION BY track_id, program)),
  a AS (SELECT track_id, program, avg(pitch) AS avg_pitch, stddev_pop(pitch) AS pitch_std, median(pitch) AS median_pitch, avg(velocity) AS avg_velocity, stddev_pop(velocity) AS velocity_std, avg(dur) AS avg_duration, stddev_pop(dur) AS duration_std, median(dur) AS median_duration, count(*) AS note_count, max(pitch) - min(pitch) AS pitch_range, sum(dur) AS track_duration,
  sum(CASE WHEN ds = 0 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS chord_frequency, 120.0::DOUBLE AS tempo, coalesce(avg(ds), 0) AS avg_interval, 1 - sum(dur) / max(start) AS silence_ratio, avg(CASE WHEN pitch > mid THEN 1 ELSE 0 END) AS upper_half_ratio, avg(CASE WHEN pitch <= mid THEN 1 ELSE 0 END) AS lower_half_ratio,
  count(*) / max(start) AS note_density, avg(pow(dur - mu, 3)) / nullif(pow(avg(pow(dur - mu, 2)), 1.5), 0) AS duration_skewness, avg(pow(dur - mu, 4)) / nullif(pow(avg(pow(dur - mu, 2)), 2), 0) - 3 AS duration_kurtosis, min(dur) AS duration_min, max(dur) AS duration_max, max(dur) - min(dur) AS duration_range,
  quantile_cont(dur, 0.75) - quantile_cont(dur, 0.25) AS duration_iqr, sum(CASE WHEN dur < med THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN dur >= med THEN 1 ELSE 0 END) AS short_long_ratio FROM l GROUP BY track_id, program)
  SELECT track_id, program, {', '.join(r(c) for c in _F29 if c not in ('avg_chord_size', 'chord_time_ratio'))}, round(chord_frequency, 4) AS avg_chord_size, round(chord_frequency, 4) AS chord_time_ratio FROM a JOIN en USING (track_id, program)"""
)
def features29_E(spark: SparkSession, d: str) -> DataFrame:
    found = features.instrument_features(melodic(event_notes(spark, d)), ["track_id", "program"])
    return rounded(found, *_F29)


@query(
    f"""WITH {E}, j AS (SELECT *, pitch - lag(pitch) OVER (PARTITION BY track_id ORDER BY start, note_id) AS jump FROM mel)
  SELECT track_id, min(pitch) AS min_pitch, max(pitch) AS max_pitch, max(pitch) - min(pitch) AS pitch_range, min(jump) AS min_jump, max(jump) AS max_jump, count(*) AS note_count FROM j GROUP BY track_id"""
)
def jump_features_E(spark: SparkSession, d: str) -> DataFrame:
    return features.jump_features(melodic(event_notes(spark, d)), ["track_id"])


@query(
    f"""WITH {E}, {LAGS}, m AS (SELECT *, avg(abs(step)) OVER (PARTITION BY track_id) AS mu, dur / nullif(lag(dur) OVER (PARTITION BY track_id ORDER BY note_id), 0)::DOUBLE AS dr FROM lags)
  SELECT track_id, round(avg(abs(step)), 4) AS mean_interval, round(avg(pow(abs(step) - mu, 3)) / nullif(pow(avg(pow(abs(step) - mu, 2)), 1.5), 0), 4) AS interval_skewness, round(max(pitch) / nullif(avg(pitch), 0), 4) AS peak_to_mean, round(avg(dr), 4) AS duration_ratio FROM m GROUP BY track_id"""
)
def extra_features_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.extra_features(melodic(event_notes(spark, d)), ["track_id"]), "mean_interval", "interval_skewness", "peak_to_mean", "duration_ratio")


@query(
    f"""WITH {E}, {LAGS}, {_F8}, long AS (UNPIVOT g ON {', '.join(FEATURES8)} INTO NAME feature VALUE value)
  SELECT feature, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max FROM long GROUP BY feature"""
)
def describe_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.describe(tracks8(spark, d), FEATURES8), "mean", "std", "min", "q25", "q50", "q75", "max")


_VARYING = FEATURES8[1:]


@query(f"WITH {E}, {LAGS}, {_F8} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM g" for i, a in enumerate(_VARYING) for b in _VARYING[i:]))
def corr_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.correlations(tracks8(spark, d), _VARYING), "corr")


_KNN = f"p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, a.label AS la, b.label AS lb, pow(list_distance(a.e, b.e), 2) AS d2 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), neighbour) AS INT) AS rank FROM p QUALIFY rank <= 5)"


@query(f"WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), {_KNN} SELECT id, rank, neighbour, {r('d2')} FROM k")
def knn_V(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(search.nearest_neighbours(v, 5, queries=_asked(v, "id")), "d2")


@query(f"WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), {_KNN} SELECT id, count(*) FILTER (la = lb) AS hits, count(*) FILTER (la = lb) >= 3 AS ok FROM k GROUP BY id")
def precision_at_k_V(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return search.precision_at_k(search.nearest_neighbours(v, 5, queries=_asked(v, "id")), v.select("id", "label"))


@query(
    f"""WITH {E}, b AS (SELECT track_id, start AS beat FROM notes WHERE is_drum), n AS (SELECT m.track_id, m.note_id, min(abs(m.start - b.beat)) AS beat_distance FROM mel m LEFT JOIN b USING (track_id) GROUP BY ALL)
  SELECT track_id, note_id, {r('beat_distance', 3)} FROM n"""
)
def nearest_beat_E(spark: SparkSession, d: str) -> DataFrame:
    notes = event_notes(spark, d)
    beats = notes.where("is_drum").select("track_id", F.col("start").alias("beat"))
    return rounded(features.nearest_beat(melodic(notes).select("track_id", "note_id", "start"), beats, ["track_id"]).select("track_id", "note_id", "beat_distance"), "beat_distance", digits=3)


@query(f"WITH {E}, {LAGS}, {F10}, {LONG10}, {_NEAR10} SELECT n.query, n.track_id, l.feature, round(abs(l.value - q.value), 4) AS diff FROM near n JOIN long l USING (track_id) JOIN long q ON q.track_id = n.query AND q.feature = l.feature")
def feature_diff_E(spark: SparkSession, d: str) -> DataFrame:
    catalogue = tracks10(spark, d)
    found = search.similar(catalogue, _asked(catalogue, "track_id"), "track_id", FEATURES)
    return rounded(search.feature_differences(found, catalogue, "track_id", FEATURES), "diff")


@query(
    f"""WITH {E}, o AS (SELECT DISTINCT track_id, start FROM mel), g AS (SELECT track_id, round_even((start - lag(start) OVER (PARTITION BY track_id ORDER BY start)) / 60, 0) * 60 AS gap FROM o), n AS (SELECT track_id, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL),
  b AS (SELECT track_id, 60 / arg_min(gap, (-n, gap)) AS bpm FROM n GROUP BY track_id), f AS (SELECT track_id, bpm * pow(2, greatest(ceil(log2(60 / bpm)), 0) - greatest(floor(log2(bpm / 200)) + 1, 0)) AS tempo FROM b) SELECT track_id, round(coalesce(tempo, 120), 4) AS tempo FROM (SELECT DISTINCT track_id FROM mel) LEFT JOIN f USING (track_id)"""
)
def tempo_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.estimate_tempo(melodic(event_notes(spark, d)), ["track_id"], unit=60.0), "tempo")


_CHROMA = f"fr AS (SELECT track_id, CAST(floor(start / 86400) AS BIGINT) AS frame, {', '.join(f'sum(CASE WHEN pitch % 12 = {k} THEN velocity ELSE 0 END)::DOUBLE AS c{k}' for k in range(12))} FROM mel GROUP BY ALL)"


@query(f"WITH {E}, {_CHROMA} SELECT a.track_id, a.frame AS i, b.frame AS j, round(sqrt({' + '.join(f'pow(a.c{k} - b.c{k}, 2)' for k in range(12))}), 4) AS distance FROM fr a JOIN fr b ON a.track_id = b.track_id AND a.frame < b.frame")
def ssm_E(spark: SparkSession, d: str) -> DataFrame:
    frames = distance.chroma_frames(melodic(event_notes(spark, d)), 86_400, ["track_id"])
    return rounded(distance.self_similarity(frames, "frame", [f"c{k}" for k in range(12)], ["track_id"]), "distance")


_STEPS = "st AS (SELECT track_id, row_number() OVER w AS pos, sqrt(pow(pitch - lag(pitch) OVER w, 2) + pow(dur - lag(dur) OVER w, 2)) AS step FROM mel WINDOW w AS (PARTITION BY track_id ORDER BY start, note_id))"


def _novelty(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("track_id").orderBy("start", "note_id")
    step = F.sqrt(F.pow(F.col("pitch") - F.lag("pitch").over(w), 2) + F.pow(F.col("dur") - F.lag("dur").over(w), 2))
    steps = melodic(event_notes(spark, d)).select("track_id", F.row_number().over(w).cast("long").alias("pos"), step.alias("step")).where("step is not null")
    return distance.moving_kernel(steps, "step", "pos", group=["track_id"])


@query(f"WITH {E}, {_STEPS}, s2 AS (SELECT * FROM st WHERE step IS NOT NULL) SELECT track_id, pos, round(coalesce(0.5 * lag(step, 3) OVER w + lag(step, 2) OVER w + lag(step, 1) OVER w + step + lead(step, 1) OVER w + lead(step, 2) OVER w + 0.5 * lead(step, 3) OVER w, 0), 4) AS novelty FROM s2 WINDOW w AS (PARTITION BY track_id ORDER BY pos)")
def novelty_E(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_novelty(spark, d).select("track_id", "pos", "novelty"), "novelty")


@query()
def novelty_peaks_E(spark: SparkSession, d: str) -> DataFrame:
    return distance.novelty_peaks(_novelty(spark, d), "pos", 10, 0.1, ["track_id"])


_CENTERS = f"{_V}, c AS (SELECT label, i, avg(val) AS center FROM x GROUP BY label, i)"


@query(
    f"""WITH {_CENTERS}, d AS (SELECT x.vec_id AS id, c.label, sum(pow(val - center, 2)) AS d2 FROM x JOIN c USING (i) GROUP BY ALL)
  SELECT id, label, {r('d2')} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, label) AS n FROM d) WHERE n = 1"""
)
def nearest_centroid_V(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(cluster.nearest_centroid(v, cluster.centroids(v)), "d2")


@query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT a.vec_id AS id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS total, count(*) AS n FROM v a JOIN v b ON TRUE GROUP BY ALL),
  d AS (SELECT id, label, max(CASE WHEN other = label AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN other <> label THEN total / n END) AS b, max(CASE WHEN other = label THEN n END) AS size FROM t GROUP BY id, label)
  SELECT id, label, round(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 4) AS silhouette FROM d"""
)
def silhouette_V(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.silhouette(vectors(spark, d)), "silhouette")


@query(f"WITH {_CENTERS}, d AS (SELECT x.vec_id, x.label, sqrt(sum(pow(val - center, 2))) AS dist FROM x JOIN c USING (label, i) GROUP BY ALL) SELECT label, count(*) AS n, round(avg(dist), 4) AS mean_distance, round(max(dist), 4) AS max_distance FROM d GROUP BY label")
def cluster_report_V(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(cluster.cluster_report(v, cluster.centroids(v)), "mean_distance", "max_distance")


@query()
def pca_V(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.pca(vectors(spark, d), 8)[1].select("component", "explained", "cumulative"), "explained", "cumulative")


@query()
def kmeans_V(spark: SparkSession, d: str) -> DataFrame:
    return cluster.kmeans(vectors(spark, d), 10)[0].select("id", "label")


@query()
def hmm_E(spark: SparkSession, d: str) -> DataFrame:
    return cluster.hmm(melodic(event_notes(spark, d)), 2, ["track_id"])
