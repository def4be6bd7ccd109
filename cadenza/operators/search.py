"""Scaling, descriptive statistics and exact nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.schema import FEATURE_WEIGHTS, TOP_K


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, value): one row per feature."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.selectExpr(*keys, f"stack({len(columns)}, {pairs}) as (feature, value)")


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (mean array, scale array): population moments, and scale 1 for a constant column."""
    scale = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    return df.agg(F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*[scale(c) for c in columns]).alias("scale"))


def scaler_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, scale)."""
    std = F.stddev_pop("value")
    return long_form(df, [], columns).groupBy("feature").agg(F.avg("value").alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("scale"))


def similar(catalogue: DataFrame, queries: DataFrame, key: str, columns: list[str], weights: dict[str, float] | None = None, k: int = TOP_K) -> DataFrame:
    """(query, rank, key, d2, similarity): the ``k`` rows nearest to each row of ``queries``, which finds itself first if it is in the catalogue.

    Weights scale raw features before the scaler that was fitted without them; the means cancel, so the squared distance is
    the sum of (w (q - x) / s)^2, and both sides are brought to that scale once.  Only the one-row scaler is broadcast.
    """
    weights = FEATURE_WEIGHTS if weights is None else weights
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    scaler = fit_scaler(catalogue, columns).select("scale")
    factor = F.zip_with(F.array(*[F.lit(float(weights.get(c, 1.0))) for c in columns]), F.col("scale"), lambda w, s: w / s)

    def scaled(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key).alias("id"), vec.alias("__x")).join(F.broadcast(scaler)).select("id", F.zip_with("__x", factor, lambda x, w: x * w).alias("vec"))

    found = nearest_neighbours(scaled(catalogue), k, queries=scaled(queries), others=False)
    return found.select(F.col("id").alias("query"), "rank", F.col("neighbour").alias(key), "d2", (1 / (1 + F.col("d2"))).alias("similarity"))


def similar_vectors(vectors: DataFrame, queries: DataFrame, dim: int, weights: list[float] | None = None, k: int = TOP_K) -> DataFrame:
    """``similar`` for (id, vec): a vector has one weight for each of its ``dim`` positions."""
    names = [f"v{i}" for i in range(dim)]
    wide = lambda df: df.select("id", *[F.col("vec")[i].alias(n) for i, n in enumerate(names)])
    return similar(wide(vectors), wide(queries), "id", names, dict(zip(names, weights or [1.0] * dim, strict=True)), k)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, quartiles and extremes per column."""
    q = lambda p: F.percentile("value", F.lit(p))
    return long_form(df, [], columns).groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("value").alias("max")
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("r")).select("r.*")


def impute_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become their column's mean; the means are one broadcast row."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    return df.join(F.broadcast(means)).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def feature_differences(found: DataFrame, catalogue: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(query, key, feature, diff): absolute differences of each (query, key) pair that a search found; two equi-joins by row and feature."""
    each = long_form(catalogue, [key], columns)
    asked = each.select(F.col(key).alias("query"), "feature", F.col("value").alias("__q"))
    return found.select("query", key).join(each, key).join(asked, ["query", "feature"]).select("query", key, "feature", F.abs(F.col("value") - F.col("__q")).alias("diff"))


def _blocked(queries: DataFrame, vectors: DataFrame, block_rows: int) -> DataFrame:
    """Rows with (q, c, side): every query (side 0) against each block of candidates and every candidate (side 1) against each block of queries.

    Blocks have ``block_rows`` rows or so whatever the size, so a pair of blocks fits a task and the work is the product of two bounded sides.
    """
    def dealt(rows: DataFrame, side: int, own: int, other: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias("qc"[side])
        return rows.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("cq"[side]), F.lit(side).alias("side"))

    many = [max(1, -(-df.count() // block_rows)) for df in (queries, vectors)]
    return dealt(queries, 0, *many).unionByName(dealt(vectors, 1, *many[::-1]))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf.vec.tolist(), dtype=np.float64).reshape(len(pdf), -1)


def _squared(a: np.ndarray, b: np.ndarray, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """Exact squared distances, a stripe of rows at a time."""
    for i in range(0, len(a), rows):
        part = a[i : i + rows]
        out = np.zeros((len(part), len(b)))
        for d in range(a.shape[1]):
            out += (part[:, d, None] - b[None, :, d]) ** 2
        yield i, out


def nearest_neighbours(vectors: DataFrame, k: int, block_rows: int = 8192, queries: DataFrame | None = None, others: bool = True) -> DataFrame:
    """(id, rank, neighbour, d2): the ``k`` nearest rows of (id, vec) to every query, exactly, ties by id; ``others``: a row is no neighbour of itself.

    ``queries`` are all rows by default.  Pairs of blocks keep k candidates a query; the second step merges them, so no more than that is shuffled but the blocks themselves.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def best(pair: pd.DataFrame) -> pd.DataFrame:
        left, right = (pair[pair["side"] == k] for k in (0, 1))
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "neighbour": [], "d2": []})
        a, b, ids, names = _matrix(left), _matrix(right), left.id.to_numpy(), right.id.to_numpy()
        order = np.argsort(np.argsort(names, kind="stable"), kind="stable")
        out = []
        for i, d2 in _squared(a, b):
            for r in range(len(d2)):
                row = d2[r].copy()
                if others:
                    row[names == ids[i + r]] = np.inf
                bound = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                near = np.flatnonzero((row <= bound) & np.isfinite(row))
                near = near[np.lexsort((order[near], row[near]))][:k]
                out.append((np.full(len(near), ids[i + r]), names[near], row[near]))
        return pd.DataFrame({"id": np.concatenate([o[0] for o in out]), "neighbour": np.concatenate([o[1] for o in out]), "d2": np.concatenate([o[2] for o in out])})

    asked = (vectors if queries is None else queries).select("id", "vec")
    some = _blocked(asked, vectors.select("id", "vec"), block_rows).groupBy("q", "c").applyInPandas(best, f"id {kind}, neighbour {kind}, d2 double")
    order = Window.partitionBy("id").orderBy("d2", "neighbour")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "d2")


def precision_at_k(neighbours: DataFrame, labels: DataFrame, enough: int = 3) -> DataFrame:
    """(id, hits, ok): neighbours of the same label; ``labels`` is (id, label)."""
    own, other = labels.select("id", F.col("label").alias("own")), labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    hits = neighbours.join(own, "id").join(other, "neighbour").groupBy("id").agg(F.sum((F.col("own") == F.col("other")).cast("int")).alias("hits"))
    return hits.withColumn("ok", F.col("hits") >= enough)


def label_distances(vectors: DataFrame, block_rows: int = 4096) -> DataFrame:
    """(id, label, other, total, n): sum of Euclidean distances of each row of (id, vec, label) to the rows of each label."""
    def sums(pair: pd.DataFrame) -> pd.DataFrame:
        left, right = (pair[pair["side"] == k] for k in (0, 1))
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "label": [], "other": [], "total": [], "n": []})
        a, b, out = _matrix(left), _matrix(right), []
        labels = np.unique(right.label.to_numpy())
        member = (right.label.to_numpy()[:, None] == labels[None, :]).astype(float)
        for i, d2 in _squared(a, b):
            total = np.sqrt(d2) @ member
            rows = len(total)
            out.append(pd.DataFrame({"id": np.repeat(left.id.to_numpy()[i : i + rows], len(labels)), "label": np.repeat(left.label.to_numpy()[i : i + rows], len(labels)), "other": np.tile(labels, rows), "total": total.ravel(), "n": np.tile(member.sum(axis=0).astype(int), rows)}))
        return pd.concat(out)

    labelled = vectors.select("id", "vec", "label")
    each = _blocked(labelled, labelled, block_rows).groupBy("q", "c").applyInPandas(sums, "id long, label int, other int, total double, n long")
    return each.groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouette(vectors: DataFrame, block_rows: int = 4096) -> DataFrame:
    """(id, label, silhouette) by Euclidean distance; 0 for a label of one row, null with one label."""
    own = F.col("other") == F.col("label")
    d = label_distances(vectors, block_rows).groupBy("id", "label").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("size")
    )
    return d.select("id", "label", F.when(F.col("size") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def _distances(a: np.ndarray, b: np.ndarray, rows: int = 128) -> Iterator[tuple[int, np.ndarray]]:
    """Euclidean distances, a stripe of rows at a time, by one product about the mean of ``b``; pairs that are close for their size, where that loses digits, are subtracted instead."""
    middle = b.mean(axis=0)
    x, y = a - middle, b - middle
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left, right = np.column_stack([x, nx, np.ones(len(x))]), np.column_stack([-2 * y, np.ones(len(y)), ny]).T
    for i in range(0, len(a), rows):
        d2 = left[i : i + rows] @ right
        r, c = np.nonzero(d2 < 1e-6 * (nx[i : i + rows, None] + ny.max()))
        close = d2[r, c] < 1e-6 * (nx[i + r] + ny[c])
        r, c = r[close], c[close]
        for j in range(0, len(r), 16_384):
            p, q = r[j : j + 16_384], c[j : j + 16_384]
            d2[p, q] = ((a[i + p] - b[q]) ** 2).sum(axis=1)
        yield i, np.sqrt(d2, out=d2)


def silhouettes(vectors: DataFrame, labels: dict[str, int], block_rows: int = 16_384) -> DataFrame:
    """(id, label columns): the silhouettes of (id, vec, label columns) under each labelling; ``labels``: column -> number of labels from 0 on.

    As ``silhouette`` of each, but a pair's distance is computed once for all labellings and for both of its rows.
    """
    start = dict(zip(labels, np.cumsum([0, *labels.values()]).tolist(), strict=False))
    total = sum(labels.values())
    names = [f"__t{i}" for i in range(total)]
    sizes = vectors.agg(F.count(F.lit(1)), *[F.count_if(F.col(c) == i) for c, n in labels.items() for i in range(n)]).first()
    blocks = max(1, -(-sizes[0] // block_rows))

    def sums(key: tuple, pair: pd.DataFrame) -> pd.DataFrame:
        own = pair["__block"].to_numpy()
        sides = [pair[own == k] for k in dict.fromkeys(key)]
        x, member = [_matrix(s) for s in sides], []
        for s in sides:
            one = np.zeros((len(s), total))
            for c, o in start.items():
                one[np.arange(len(s)), o + s[c].to_numpy()] = 1
            member.append(one)
        made = [np.zeros(m.shape) for m in member]
        if all(map(len, sides)):
            for i, d in _distances(x[0], x[-1]):
                made[0][i : i + len(d)] = d @ member[-1]
                if len(sides) == 2:
                    made[1] += d.T @ member[0][i : i + len(d)]
        found = [pd.concat([s[["id", *labels]].reset_index(drop=True), pd.DataFrame(m, columns=names)], axis=1) for s, m in zip(sides, made, strict=True)]
        return pd.concat(found, ignore_index=True)

    block, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = vectors.select("id", "vec", *labels, block.alias("__block"), other.alias("__other"))
    pairs = dealt.select("id", "vec", *labels, "__block", F.least("__block", "__other").alias("__q"), F.greatest("__block", "__other").alias("__c"))
    schema = ", ".join([f"id {vectors.schema['id'].dataType.simpleString()}", *(f"`{c}` int" for c in labels), *(f"{n} double" for n in names)])
    # a pair of blocks is much work on few bytes, so its tasks are not to be joined by size
    each = pairs.repartition(blocks * (blocks + 1) // 2, "__q", "__c").groupBy("__q", "__c").applyInPandas(sums, schema)
    whole = each.groupBy("id", *labels).agg(*[F.sum(n).alias(n) for n in names])

    def width(c: str) -> Column:
        own, at = F.col(c), range(start[c], start[c] + labels[c])
        size, sums_of = F.array(*[F.lit(sizes[1 + i]) for i in at]), F.array(*[F.col(names[i]) for i in at])
        a = F.get(sums_of, own) / F.nullif(F.get(size, own) - 1, F.lit(0))
        b = F.array_min(F.transform(sums_of, lambda t, i: F.when(i != own, t / F.nullif(F.get(size, i), F.lit(0)))))
        return F.when(F.get(size, own) == 1, 0.0).when((a == 0) & (b == 0), 0.0).otherwise((b - a) / F.greatest(a, b))

    return whole.select("id", *[width(c).alias(c) for c in labels])
