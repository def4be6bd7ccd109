"""Operators without SQL, and edge cases, on hand-made notes."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import expr
from cadenza.operators import classify, cluster, distance, features, ngrams, search, sequential, structure
from cadenza.operators import timeline as t
from cadenza.plans import QUERIES, timeline_queries
from cadenza.schema import FEATURES10

T = ["track_id"]


def notes(spark, *tracks):
    rows = [("f", k, i, *n[:1], 80 if len(n) < 4 else n[3], float(n[1]), float(n[2]), float(n[1] + n[2]), False, "x") for k, tr in enumerate(tracks) for i, n in enumerate(tr)]
    return spark.createDataFrame(rows, "file_id string, track_id long, note_id long, pitch int, velocity int, start double, dur double, end double, is_drum boolean, program string")


def patterns(tr, bar=4.0, **options):
    start, dur, pitch = (np.array([n[k] for n in tr], dtype=float) for k in (1, 2, 0))
    return list(sequential.repeated_patterns(start, start + dur, pitch, dur, bar, **options))


def melody(*pitches, length=2.0, at=0.0):
    return [(p, at + i * length, length) for i, p in enumerate(pitches)]


def test_repeat_detector():
    a, b, c = 60, 62, 64
    assert patterns(melody(*[a, b, c] * 3)) == [(0, 3)]
    assert patterns(melody(*[a, b, c] * 2)) == []
    assert patterns(melody(a, b, c, 70, 71, 72)) == []
    assert patterns(melody(*[a, b] * 6)) == [(0, 4)]  # two notes are too few, four are not
    assert patterns(melody(*[a, b, c] * 3), bar=1000.0) == []
    stretched = [(p, s, d + (10 if 3 <= i < 6 else 0)) for i, (p, s, d) in enumerate(melody(*[a, b, c] * 3, length=20.0))]
    assert patterns(stretched) == [(0, 3)] and patterns([(p, s, d + (1 if d > 20 else 0)) for p, s, d in stretched]) == []
    assert patterns(melody(*[a, b, c] * 2, 70), mode="run") == [(0, 3)]
    chords = [(p, 4.0 * k, 4.0) for k in range(3) for p in ((60, 64, 67) if k != 1 else (64, 60, 67))]
    assert patterns(chords, bar=1.0) == [] and patterns(chords, bar=1.0, neighbours=7) == [(0, 3)]
    assert patterns([]) == [] and patterns([(60, 0, 1)]) == [] and patterns([(60, 0, 1)] * 9) == []


def test_repeat_detector_frame(spark):
    n = t.silence_segments(notes(spark, melody(*[60, 62, 64] * 3), melody(60, 62, 64)), 4.0, T)
    found = sequential.repeat_detector(n, 4.0, group=["track_id", "segment_id"]).collect()
    assert [(r.track_id, r.first, r.length, r.pitches) for r in found] == [(0, 0, 3, "60,62,64")]


def test_silence_segments(spark):
    bar = 10
    exact = [(60, 0, 5), (61, 15, 5)]  # silence of just a bar
    longer = [(60, 0, 5), (61, 16, 5)]
    covered = [(60, 0, 100), (61, 10, 1), (62, 105, 1), (63, 117, 1)]
    rng = random.Random(5)
    wild = sorted(((rng.randint(50, 70), rng.randint(0, 300), rng.randint(1, 25)) for _ in range(25)), key=lambda n: n[1])
    n = t.silence_segments(notes(spark, exact, longer, covered, wild, [(1, 0, 0)]), bar, T)
    got = {k: [r.segment_id for r in g] for k, g in itertools.groupby(n.orderBy("track_id", "start", "note_id").collect(), lambda r: r.track_id)}
    assert got[0] == [0, 0] and got[1] == [0, 1] and got[2] == [0, 0, 0, 1] and got[4] == [0]
    want, ended, seg = [], wild[0][1], 0
    for _, a, d in wild:
        seg += a - ended > bar
        want.append(seg)
        ended = max(ended, a + d)
    assert got[3] == want


def test_features_edges(spark):
    f = features.features10(notes(spark, [(60, 0, 1), (62, 1.5, 1)], [(60, 0, 1)], [(60, 1, 1)] * 3), T).orderBy("track_id").collect()
    assert [r.track_id for r in f] == [0, 2]
    assert [f[0][c] for c in FEATURES10] == [61, 1, 1, 0, 1.5, 0, 0, 120, 0, 0.5]
    assert [f[1][c] for c in FEATURES10] == [60, 0, 1, 0, 0, 0, 0, 120, 0, 0]
    late = features.features10(notes(spark, [(60, 0.475, 1), (60, 0.05, 1), (60, 0.06, 1)]), T).first()
    assert round(late.syncopation_ratio, 6) == round(2 / 3, 6)  # just before a beat is off, just after it is not
    shifted = features.features10(notes(spark, [(60, 0, 1), (65, 1.5, 1), (61, 2, 1)]).withColumn("pitch", F.col("pitch") + 7), T).first()
    plain = features.features10(notes(spark, [(60, 0, 1), (65, 1.5, 1), (61, 2, 1)]), T).first()
    assert shifted.interval_std == plain.interval_std and shifted.contour_slope == plain.contour_slope and shifted.pitch_mean == plain.pitch_mean + 7
    assert features.features8(notes(spark, [(60, 0.3, 1)]), T, numerator=None).first().syncopation_ratio == 0
    assert features.features10(notes(spark, []), T).count() == 0


def test_tempo(spark):
    steady = [(60, i * 0.5, 0.1) for i in range(20)]
    slow = [(60, i * 1.5, 0.1) for i in range(8)]
    got = {r.track_id: r.tempo for r in features.estimate_tempo(notes(spark, steady, slow, [(60, 0, 1)]), T).collect()}
    assert got == {0: 120.0, 1: 80.0, 2: 120.0}
    beat = features.beat_syncopation(notes(spark, steady), spark.createDataFrame([(0, float(i)) for i in range(10)], "track_id long, beat double"), T).first()
    assert beat.syncopation_ratio == 0.5


def test_search_properties(spark):
    rows = [(i, *[float((i * 7 + k * 3) % 11) for k in range(9)], 5.0) for i in range(30)]
    df = spark.createDataFrame(rows, ["track_id", *FEATURES10])
    top = search.similar(df, df.where("track_id = 3"), "track_id", FEATURES10).collect()
    assert top[0].track_id == 3 and top[0].d2 == 0 and top[0].similarity == 1 and len(top) == 30
    once = {r.track_id: r.d2 for r in top}
    scaled = {r.track_id: r.d2 for r in search.similar(df, df.where("track_id = 3"), "track_id", FEATURES10, {c: 3 * w for c, w in __import__("cadenza.schema", fromlist=["x"]).FEATURE_WEIGHTS.items()}).collect()}
    assert all(abs(scaled[k] - 9 * v) < 1e-9 * max(1, v) for k, v in once.items())
    assert search.similar(df, df.where("track_id < 0"), "track_id", FEATURES10).count() == 0
    assert search.similar(df.limit(0), df, "track_id", FEATURES10).count() == 0
    filled = search.impute_means(spark.createDataFrame([(1, None), (2, 4.0), (3, 8.0)], "id int, x double"), ["x"])
    assert sorted(r.x for r in filled.collect()) == [4.0, 6.0, 8.0]


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (90, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), int(v[0])) for i, v in enumerate(x)], "id long, vec array<double>, label int")
    want = {}
    for i in range(90):
        d = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(90) if j != i)[:4]
        want[i] = [(j, v) for v, j in d]
    for block in (4096, 17):
        got = {}
        for r in search.nearest_neighbours(df, 4, block).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.neighbour, r.d2))
        assert got == want
        s = {r.id: r.silhouette for r in search.silhouette(df, block).collect()}
        d0 = np.sqrt(((x[0] - x) ** 2).sum(axis=1))
        own = x[:, 0] == x[0, 0]
        a, b = d0[own].sum() / (own.sum() - 1), min(d0[x[:, 0] == v].mean() for v in set(x[:, 0]) - {x[0, 0]})
        assert abs(s[0] - (b - a) / max(a, b)) < 1e-9


def test_ranges(spark):
    points = spark.createDataFrame([(0, v) for v in (0.0, 1.0, 2.0, 3.0, 5.0)] + [(1, 2.0)], "track_id long, at double")
    ranges = spark.createDataFrame([(0, 1.0, 3.0), (0, 3.0, 4.0), (0, 4.0, 4.0)], "track_id long, start double, end double")
    got = {(r.track_id, r["at"]): r.range_start for r in t.in_ranges(points, ranges, "at", T).collect()}
    assert got == {(0, 0.0): None, (0, 1.0): 1.0, (0, 2.0): 1.0, (0, 3.0): 3.0, (0, 5.0): None, (1, 2.0): None}
    signatures = spark.createDataFrame([(0, 2.0, 3), (0, 4.0, 6)], "track_id long, time double, numerator int")
    bars = {(r.track_id, r.start): r.bar_ticks for r in t.bar_ticks_as_of(points.withColumnRenamed("at", "start"), signatures, 10, T).collect()}
    assert bars == {(0, 0.0): 384, (0, 1.0): 384, (0, 2.0): 30, (0, 3.0): 30, (0, 5.0): 60, (1, 2.0): 384}


def spaced(positions, least, most):
    kept = []
    for p in sorted(set(positions)):
        if not kept:
            kept.append(p)
            continue
        while most and kept[-1] + most < p:
            kept.append(kept[-1] + most)
        if p - kept[-1] >= least:
            kept.append(p)
    return kept


def test_boundaries(spark):
    rng = random.Random(2)
    for least, most in ((3, None), (3, 7), (1, 2), (5, 40)):
        p = [float(rng.randint(0, 100)) for _ in range(25)]
        df = spark.createDataFrame([(0, x) for x in p], "track_id long, pos double")
        got = [r.pos for r in t.spaced_boundaries(df, least, most, "pos", T).collect()]
        assert got == spaced(p, least, most)
    small = spark.createDataFrame([(0, 0.0, 5.0, 1, -1), (0, 5.0, 6.0, 3, 7), (0, 6.0, 20.0, 1, -1), (0, 20.0, 40.0, 2, 3)], "track_id long, start double, end double, repetitions long, motif_id long")
    assert [tuple(r)[1:] for r in t.merge_small(small, 4.0, T).collect()] == [(0.0, 6.0, 3, 7), (6.0, 20.0, 1, -1), (20.0, 40.0, 2, 3)]
    merged = t.gap_merge(spark.createDataFrame([(0, 0.0, 1.0), (0, 1.5, 2.0), (0, 5.0, 9.0), (0, 6.0, 7.0)], "track_id long, start double, end double"), 1.0, T)
    assert sorted(tuple(r) for r in merged.collect()) == [(0, 0.0, 2.0), (0, 5.0, 9.0)]


def test_cover_and_friends(spark):
    tokens = [1, 2, 3, 9, 1, 2, 3, 1, 2, 3, 8, 8]
    found = sequential.motif_positions(tokens, 2, 5)
    every = {}
    for n in range(2, 6):
        for i in range(len(tokens) - n + 1):
            every.setdefault(tuple(tokens[i : i + n]), []).append(i)
    assert found == {k: v for k, v in every.items() if len(v) > 1}
    cover = sequential.greedy_cover(tokens, 2, 5)
    assert [(p, n) for p, n, _, _ in cover] == [(0, 3), (4, 3), (7, 3)]
    n = notes(spark, melody(*tokens, length=1.0, at=2.0))
    rows = [tuple(r)[1:] for r in sequential.cover_segments(n, 2, 5, T).orderBy("start").collect()]
    assert rows[0][:3] == (0.0, 2.0, 1) and [r[-1] for r in rows] == [-1, 0, -1, 0, 0, -1]
    aligned = sequential.bar_aligned_segments(n, 4.0, 2, 5, 1, T).collect()
    assert all(r.start % 4 == 0 and r.end % 4 == 0 for r in aligned)
    worms = sequential.earworms(n, 2, 5, 100, 2, T).collect()
    assert len(worms) == 2 and worms[0].score == 9
    assert sequential.octave_segments(n, 2, 5, 1.0, 1.0, T).count() >= 1
    for empty in (sequential.cover_segments, sequential.octave_segments, sequential.dp_segments):
        assert empty(n.limit(0), group=T).count() == 0


def test_dp():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 3))

    def brute(segments):
        cost = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        reach, back = np.zeros(9), np.zeros(9, dtype=int)
        for _ in range(1, segments):
            now = reach.copy()
            for i in range(1, 9):
                options = [reach[j] + cost[j, i] for j in range(i)]
                back[i], now[i] = int(np.argmin(options)), min(options)
            now[0] = 0
            reach = now
        out, i = [], 8
        while i > 0:
            out.append(i)
            i = back[i]
        return out[::-1]

    for segments in (2, 3, 5):
        assert sequential.dp_boundaries(x, segments) == brute(segments)
    assert sequential.dp_boundaries(x[:1], 5) == []


def test_time_warping():
    rng = np.random.default_rng(1)

    def plain(a, b):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        return d[-1, -1]

    for n, m in ((1, 1), (1, 5), (4, 7), (8, 8), (9, 2)):
        a, b = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
        assert abs(distance.dtw(a, b) - plain(a, b)) < 1e-9
        one, many = rng.normal(size=(6, n)), rng.normal(size=(6, m))
        assert np.allclose(distance.dtw_pairs(one, many), [plain(x[:, None], y[:, None]) for x, y in zip(one, many, strict=True)])
    assert distance.dtw([], []) == 0 and distance.dtw([1], []) == np.inf
    assert distance.shared_ratio([], []) == 1 and distance.shared_ratio([1], []) == 0 and distance.shared_ratio([1, 2, 3], [1, 2, 4]) == pytest.approx(2 / 3)
    same = {"pitch": [60, 62], "dur": [1, 2]}
    assert distance.sequence_similarity(same, same) == pytest.approx(1.0) and distance.sequence_similarity({"pitch": [1], "dur": [0]}, same) < 1


def test_shared_ratio_column(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([], [])], "a array<int>, b array<int>")
    assert [round(r[0], 4) for r in df.select(distance.shared_ratio_of("a", "b")).collect()] == [0.6667, 1.0]


def test_structure(spark):
    a, b = [(60, 64, 67), (65, 69, 72), (67, 71, 74), (60, 64, 67)], [(61, 66, 70), (63, 68, 73), (58, 63, 66), (61, 66, 70)]
    rows, at = [], 0.0
    for part in (a, b, a):
        for _ in range(10):
            for chord in part:
                rows += [(p, at, 1.0) for p in chord]
                at += 1.0
    n = notes(spark, rows)
    found = structure.structure_segments(n, 1.0, structure.StructureConfig(), T).orderBy("start").collect()
    cuts = [r.start for r in found[1:]]
    assert structure.boundary_f1(cuts, [40.0, 80.0], 6.0) >= 0.8
    assert found[0].start == 0 and found[-1].end == 120 and all(x.end == y.start for x, y in itertools.pairwise(found))
    assert structure.structure_segments(notes(spark, [(60, 0, 1)]), 1.0, group=T).count() == 1
    curve = np.array([0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.5, 0.45, 0.5, 0, 2, 0])
    assert structure.prominent_peaks(curve).tolist() == [1, 15]
    x = np.vstack([np.tile([1.0, 0.0], (10, 1)), np.tile([0.0, 1.0], (10, 1))])
    assert structure.diagonal_novelty(structure.self_similarity_matrix(x)).argmax() == 10
    for norm in ("inf", "-inf", "min_max", "log", None):
        assert np.isfinite(structure.normalise(np.array([[0.0, 0.0], [1.0, 3.0]]), norm)).all()


def test_structure_keeps_the_frame_of_long_tracks(spark):
    rng = np.random.default_rng(8)
    parts = [rng.integers(48, 84, 16) for _ in range(5)]
    rows = [(int(p), float(i), 1.0) for i, p in enumerate(p for k in (0, 1, 0, 2, 3, 1, 4, 0) for _ in range(20) for p in parts[k])]
    found = structure.structure_segments(notes(spark, rows), 1.0, structure.StructureConfig(), T).collect()
    assert len(rows) == 2560 and len(found) > 4 and all(r.start == int(r.start) for r in found)
    x = structure.embed(rng.random((300, 12)).round(1), 3)
    c = structure.StructureConfig()
    whole = structure.striped_novelty(x, c)
    assert (structure.striped_novelty(x, structure.StructureConfig(cells=1)) == whole).all()
    plain = structure.novelty(structure.gaussian_smooth(structure.time_lag(structure.recurrence(np.round(x * 10), c.nearest)), c.gaussian))
    assert np.allclose(structure.striped_novelty(np.round(x * 10), c), plain)


def test_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    labelled, cost, centers = cluster.kmeans(df, 3)
    groups = {}
    for r in labelled.collect():
        groups.setdefault(r.label, set()).add(r.id // 20)
    assert sorted(map(len, groups.values())) == [1, 1, 1] and cost < 3 and centers.count() == 3
    assert [r.k for r in cluster.best_k(df, range(2, 5), least=1).where("chosen").collect()] == [3]
    costs = [r.cost for r in cluster.elbow(df, range(1, 4)).orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True)
    projected, report = cluster.pca(df, 2)
    rows = report.orderBy("component").collect()
    assert rows[0].explained > 0.99 and abs(rows[-1].cumulative - 1) < 1e-9 and projected.count() == 60
    assert {r.feature for r in cluster.top_loadings(report, ["a", "b"], 1).collect()} <= {"a", "b"}
    d = np.abs(np.array([0.0, 1, 2, 10, 11])[:, None] - np.array([0.0, 1, 2, 10, 11])[None])
    assert cluster.agglomerate(d, 3).tolist() == [0, 0, 0, 1, 1] and cluster.agglomerate(np.zeros((1, 1)), 3).tolist() == [0]
    assert cluster.agglomerate(d, 3, "average").tolist() == [0, 0, 0, 1, 1]
    z = np.concatenate([rng.normal(0, 0.3, (40, 1)), rng.normal(4, 0.3, (40, 1)), rng.normal(0, 0.3, (20, 1))])
    assert cluster.hmm_states(z).tolist() == [0] * 40 + [1] * 40 + [0] * 20
    assert cluster.hmm_states(z[:1]).tolist() == [0] and cluster.hmm_states(np.zeros((5, 2))).shape == (5,)
    n = notes(spark, [(60, 0, 1), (61, 1, 1), (100, 500, 1)])
    assert [r.label for r in cluster.note_clusters(n, 10, T).orderBy("note").collect()] == [0, 0, 1]
    assert cluster.note_kmeans(n, 2).count() == 3


def test_bars(spark):
    n = notes(spark, [(60, 0, 4), (62, 3, 2), (64, 9, 0), (65, 12, 1)])
    bars = {r.bar: ([x.pitch for x in r.notes], r.end) for r in t.bars(n, 4, T).collect()}
    assert bars == {0: ([60, 62], 4), 1: ([62], 8), 2: ([64], 12), 3: ([65], 13)}
    gap = notes(spark, [(60, 0, 1), (61, 20, 1)])
    assert [r.bar for r in t.empty_bars(gap, 4, T).orderBy("bar").collect()] == [1, 2, 3, 4]
    close = classify.continuous_phrases(t.bars(notes(spark, [(60, 0, 4), (61, 4, 4), (90, 8, 1), (30, 40, 1)]), 4, T), group=T).collect()
    assert [(r.first, r.last, r.n) for r in close] == [(0, 1, 2)]
    leaders = sequential.leader_groups(t.bars(notes(spark, [(60, 0, 1), (61, 4, 1), (120, 8, 1)]), 4, T), 0.1, group=T).orderBy("bar").collect()
    assert [r.leader for r in leaders] == [0, 0, 2]


def test_cadences(spark):
    names = lambda *p: [expr.note_name(F.lit(x)) for x in p]  # noqa: E731, F841
    raw = [(0, 0, "C", 1), (0, 1, "E", 1), (0, 2, "G", 1), (4, 3, "C", -1), (4, 4, "E", -1), (5, 5, "B", 1), (5, 6, "D", 1), (9, 7, "G", -1)]
    df = spark.createDataFrame([(0, *r) for r in raw], "track_id long, time long, seq long, name string, step int")
    assert [(r.time, r.chord) for r in ngrams.cadences(df, T).orderBy("time").collect()] == [(0, ["C", "E", "G"]), (5, ["D", "G", "B"])]


def test_expressions(spark):
    one = spark.range(1).select(
        expr.octave_name(F.lit(60)).alias("o"), expr.bar_ticks(F.lit(480), F.lit(6), F.lit(8)).alias("b"), expr.bar_ticks(F.lit(480), F.lit(None).cast("int")).alias("d"), expr.quantize(F.lit(45.0), 30).alias("q"), expr.pad(F.array(F.lit(1)), 3, F.lit(0)).alias("p"),
        expr.group_label(F.lit("/x/GroupA_tempo.mid")).alias("g"), expr.as_percent(F.lit(0.12345)).alias("c"), expr.bar_seconds(F.lit(None).cast("double"), F.lit(4)).alias("s"), expr.match_ratio(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))).alias("m"),
    ).first()
    assert (one.o, one.b, one.d, one.q, one.p, one.g, one.c, one.s, one.m) == ("C4", 1440, 384, 60.0, [1, 0, 0], "GroupA", "12.35%", 2.0, 0.5)


def test_cluster_queries_try_all_k(spark, sf_dir):
    assert sorted(r.k for r in QUERIES["best_k_V"](spark, sf_dir).collect()) == list(range(2, 11))
    assert sorted(r.k for r in QUERIES["elbow_V"](spark, sf_dir).collect()) == list(range(1, 11))


def test_close_bars_query_has_all_similar_pairs(spark, sf_dir):
    every = distance.close_bars(timeline_queries.t.bars(timeline_queries._lines(spark, sf_dir), timeline_queries.BAR_L), 2.0)
    wanted = every.where("similarity > 0.1").count()
    found = QUERIES["close_bars_L"](spark, sf_dir)
    assert found.count() == wanted > every.where("similarity > 0.98").count()


def test_absent_bars_fill_the_gaps_of_each_track(spark):
    held = spark.createDataFrame([("a", "x", 2), ("a", "x", 5), ("a", "x", 6), ("b", "x", 1), (None, None, 0), (None, None, 2)], "file_id string, track_id string, bar long")
    assert sorted((str(r.file_id), r.bar) for r in t.absent_bars(held).collect()) == [("None", 1), ("a", 3), ("a", 4)]
    assert t.absent_bars(held.limit(0)).count() == 0


def test_shipping_from_several_threads_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    from cadenza import ship

    ship._SENT.discard(spark.sparkContext.applicationId)
    real, sent = spark.sparkContext.addPyFile, []
    spark.sparkContext.addPyFile = sent.append
    try:
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda _: ship.ship(spark), range(8)))
    finally:
        spark.sparkContext.addPyFile = real
        ship._SENT.discard(spark.sparkContext.applicationId)
    assert len(sent) == 1


@pytest.mark.parametrize("block", [16_384, 23])
def test_silhouettes_of_several_labellings(spark, block):
    """all labellings from one pass over the pairs, with copies, points far from 0, a label of one row and a label of none."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.integers(0, 3, (60, 3)) + 1e6, rng.normal(0, 1e-3, (30, 3)) + 1e6]).astype(float)
    labels = [(i % 3, 0 if i == 7 else 1 + i % 2) for i in range(90)]
    df = spark.createDataFrame([(i, v.tolist(), a, b) for i, (v, (a, b)) in enumerate(zip(x, labels, strict=True))], "id long, vec array<double>, l0 int, l1 int")
    got = {r.id: (r.l0, r.l1) for r in search.silhouettes(df, {"l0": 3, "l1": 5}, block).collect()}
    for k in (0, 1):
        one = {r.id: r.silhouette for r in search.silhouette(df.withColumnRenamed(f"l{k}", "label")).collect()}
        assert len(got) == 90 and all(abs(got[i][k] - one[i]) < 1e-9 for i in one)
    assert got[7][1] == 0


def test_best_k_compares_pairs_once(spark):
    """it did so again for every k."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(35)], "id long, vec array<double>")
    plan = cluster.best_k(df, range(2, 6))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
