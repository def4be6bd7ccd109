"""Clustering, projections and their reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.expr import squared_distance
from cadenza.operators.search import silhouettes
from cadenza.operators.sequential import per_group

GROUP = ["file_id", "track_id"]


def kmeans(vectors: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, float, DataFrame]:
    """(id, vec, label), the training cost, and (label, center): Lloyd's algorithm with a seeded, scalable start."""
    data = vectors.select("id", "vec", array_to_vector("vec").alias("__v"))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="label").fit(data)
    centers = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "label int, center array<double>")
    return model.transform(data).drop("__v"), float(model.summary.trainingCost), centers


def elbow(vectors: DataFrame, ks: range, seed: int = 42) -> DataFrame:
    """(k, cost); the cost of one cluster is the spread about the mean."""

    def cost(k: int) -> float:
        if k > 1:
            return kmeans(vectors, k, seed)[1]
        each = vectors.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg((F.var_pop("x") * F.count(F.lit(1))).alias("v"))
        return float(each.agg(F.sum("v")).first()[0] or 0.0)

    return vectors.sparkSession.createDataFrame([(k, cost(k)) for k in ks], "k int, cost double")


def best_k(vectors: DataFrame, ks: range = range(2, 11), least: int = 5, seed: int = 42) -> DataFrame:
    """(k, silhouette, chosen): the first k of the best mean silhouette, raised to ``least``; all clusterings share one pass over the pairs of rows."""
    data = vectors.select("id", "vec", array_to_vector("vec").alias("__v"))
    labelled, labels = data, {}
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol=f"__k{k}").fit(data)
        labelled, labels[f"__k{k}"] = model.transform(labelled), len(model.clusterCenters())
    means = silhouettes(labelled.drop("__v"), labels).agg(*[F.avg(c).alias(c) for c in labels])
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__k{k}").alias("silhouette"), F.lit(-k).alias("n")) for k in ks])
    best = F.greatest(-F.array_max(F.transform(each, lambda x: F.struct(x["silhouette"], x["n"])))["n"], F.lit(least))
    return means.select(best.alias("__best"), F.inline(each)).select("k", "silhouette", (F.col("k") == F.col("__best")).alias("chosen"))


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, center, n): mean vector of each label."""
    parts = vectors.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"), F.max("n").alias("n"))


def nearest_centroid(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, label, d2): the closest center, ties to the smaller label; ``centers`` has a row per cluster."""
    scored = vectors.select("id", "vec").join(F.broadcast(centers.select("label", "center"))).select("id", "label", squared_distance(F.col("vec"), F.col("center")).alias("d2"))
    return scored.groupBy("id").agg(F.min(F.struct("d2", "label")).alias("b")).select("id", "b.label", "b.d2")


def cluster_report(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(label, n, mean_distance, max_distance): spread of each cluster about its center."""
    joined = vectors.join(F.broadcast(centers.select("label", "center")), "label").select("label", F.sqrt(squared_distance(F.col("vec"), F.col("center"))).alias("d"))
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"))


def pca(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, vec) on the first ``k`` components, and (component, explained, cumulative, loadings); each component's largest loading is positive."""
    data = vectors.select("id", array_to_vector("vec").alias("__v"))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(data)
    loadings = model.pc.toArray().T
    sign = np.array([1.0 if row[np.abs(row).argmax()] >= 0 else -1.0 for row in loadings])
    ratio = model.explainedVariance.toArray()
    report = vectors.sparkSession.createDataFrame([(i, float(ratio[i]), float(ratio[: i + 1].sum()), [float(x) for x in loadings[i] * sign[i]]) for i in range(k)], "component int, explained double, cumulative double, loadings array<double>")
    signs = F.array(*[F.lit(float(s)) for s in sign])
    return model.transform(data).select("id", F.zip_with(vector_to_array("__p"), signs, lambda x, s: x * s).alias("vec")), report


def top_loadings(report: DataFrame, names: list[str], k: int = 3) -> DataFrame:
    """(component, rank, feature, loading): the ``k`` largest by size."""
    named = F.transform("loadings", lambda x, i: F.struct((-F.abs(x)).alias("o"), F.element_at(F.array(*map(F.lit, names)), i + 1).alias("feature"), x.alias("loading")))
    return report.select("component", F.posexplode(F.slice(F.array_sort(named), 1, k)).alias("rank", "t")).select("component", (F.col("rank") + 1).alias("rank"), "t.feature", "t.loading")


def note_kmeans(notes: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(note_id, label): notes by onset, pitch and duration."""
    return kmeans(notes.select(F.col("note_id").alias("id"), F.array(*[F.col(c).cast("double") for c in ("start", "pitch", "dur")]).alias("vec")), k, seed)[0].select(F.col("id").alias("note_id"), "label")


def agglomerate(d: np.ndarray, cut: float, linkage: str = "complete") -> np.ndarray:
    """Labels from 0 by first member: the closest clusters join while their distance is below ``cut``."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    while n > 1 and np.isfinite(d).any() and d.min() < cut:
        a, b = sorted(divmod(int(d.argmin()), n))
        row = np.maximum(d[a], d[b]) if linkage == "complete" else (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = row, row
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1] if n else label


def note_clusters(notes: DataFrame, cut: float = 10.0, group: list[str] = GROUP) -> DataFrame:
    """(group, note, label): complete linkage over (onset, duration, pitch) of single notes, within a track."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        x = pdf[["start", "dur", "pitch"]].to_numpy(dtype=float)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        for i, lab in zip(pdf["note_id"], agglomerate(d, cut), strict=True):
            yield int(i), int(lab)

    return per_group(notes, group, ["note_id", "start", "dur", "pitch"], "note long, label int", run)


def hmm_states(x: np.ndarray, states: int = 2, rounds: int = 50, tolerance: float = 1e-4) -> np.ndarray:
    """Most likely states of a diagonal Gaussian HMM, fitted by Baum-Welch in logs from quantiles of the first column; states are ordered by its mean."""
    n, dim = x.shape
    if n < states:
        return np.zeros(n, dtype=int)
    deviation = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(deviation > 0, deviation, 1)
    rank = np.argsort(np.argsort(z[:, 0], kind="stable"), kind="stable") * states // n
    mean = np.array([z[rank == s].mean(axis=0) for s in range(states)])
    var = np.array([z[rank == s].var(axis=0) + 1e-2 for s in range(states)])
    log_a, log_pi, before = np.log(np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))), np.log(np.full(states, 1 / states)), -np.inf

    def emission() -> np.ndarray:
        return -0.5 * (((z[:, None] - mean[None]) ** 2 / var[None]) + np.log(2 * np.pi * var[None])).sum(axis=2)

    for _ in range(rounds):
        b = emission()
        forward, backward = np.zeros((n, states)), np.zeros((n, states))
        forward[0] = log_pi + b[0]
        for t in range(1, n):
            forward[t] = b[t] + np.logaddexp.reduce(forward[t - 1][:, None] + log_a, axis=0)
        for t in range(n - 2, -1, -1):
            backward[t] = np.logaddexp.reduce(log_a + (b[t + 1] + backward[t + 1])[None], axis=1)
        total = np.logaddexp.reduce(forward[-1])
        gamma = np.exp(forward + backward - total)
        if n > 1:
            xi = np.exp(forward[:-1, :, None] + log_a[None] + (b[1:] + backward[1:])[:, None, :] - total).sum(axis=0)
            log_a = np.log(np.maximum(xi / np.maximum(xi.sum(axis=1, keepdims=True), 1e-300), 1e-12))
        log_pi = np.log(np.maximum(gamma[0], 1e-12))
        weight = np.maximum(gamma.sum(axis=0), 1e-9)[:, None]
        mean = gamma.T @ z / weight
        var = np.maximum(gamma.T @ z**2 / weight - mean**2, 0) + 1e-2
        if total - before < tolerance:
            break
        before = total
    b = emission()
    score, back = log_pi + b[0], np.zeros((n, states), dtype=int)
    for t in range(1, n):
        step = score[:, None] + log_a
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + b[t]
    path = np.zeros(n, dtype=int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return np.argsort(np.argsort(mean[:, 0], kind="stable"), kind="stable")[path]


def hmm(notes: DataFrame, states: int = 2, group: list[str] = GROUP) -> DataFrame:
    """(group, note, state): hidden states of each track over pitch, duration and gap to the note before."""

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        x = np.column_stack([pdf["pitch"], pdf["dur"], np.diff(pdf["start"], prepend=pdf["start"].iloc[0])]).astype(float)
        for i, s in zip(pdf["note_id"], hmm_states(x, states), strict=True):
            yield int(i), int(s)

    return per_group(notes, group, ["note_id", "start", "pitch", "dur"], "note long, state int", run)
