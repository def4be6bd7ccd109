"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

    y = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),  score = 1 / (1 + e^-y)

so all pairwise interactions cost time linear in a text's features.  Features of a text: each distinct word (lower-cased,
crc32 into ``buckets``) with weight sqrt(count), scaled to unit length, and to less in a text of few words; ``STRUCTURE`` statistics of the whole text; and, as
metadata, the document's stated character count, whether it is missing, and whether it differs from the text's.  Labels, lang, source and doc_id are no inputs.

The defaults of ``learn`` and ``_FEW_WORDS`` have the least log loss in cross-validation over the rows that may be learnt from, equal texts in one fold.

Learning: labelled rows whose crc32(doc_id as text) mod 3 is not 1, at most ``sample_rows`` of them (a documented bound; those
of least md5(doc_id)), as feature rows of at most ``buckets`` entries each; AdaGrad on the driver, seeded, so reruns agree.
Scoring covers every row and whole texts, one batch at a time, without a shuffle.

Defined cases: null text is the empty text, which has a score from its structure features; a null doc_id is never learnt from
and not held out; a label other than 0 or 1, or null, is left out; repeated labels count once, and of rows that share a doc_id the least text; without any label every
score is 0.5, predicted 1; an empty table gives no rows; other columns are ignored, and rows keep theirs in ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import pieces

STRUCTURE = (
    "log words", "log characters", "mean word length", "upper-case share", "share of words ending in a symbol", "digit share", "symbol share", "distinct word share", "share of adjacent equal words",
    "share of repeated lines", "words per line", "sentence marks per word", "separators per word", "white space share", "longest word", "no words", "log metadata characters", "metadata characters missing", "metadata characters differ",
)
#: The number of words at which a text's words weigh 1 / sqrt(2) of a long text's.
_FEW_WORDS = 10
_SYMBOL_BYTES = frozenset(b"#*$%&|<>!?^~_=+@")


def _features(text: str, n_chars: int | None, buckets: int, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values; structure features come first."""
    words = text.encode().split()
    n, chars = len(words), len(text)
    ids = np.empty(n, dtype=np.int64)
    upper = marked = adjacent = 0
    before = None
    longest = 0
    for i, w in enumerate(words):
        k = cache.get(w)
        if k is None:
            if len(cache) > 500_000:
                cache.clear()
            k = zlib.crc32(w.lower()) % buckets
            k |= (w[-1] in _SYMBOL_BYTES) << 30 | (w.isupper() and len(w) > 1) << 31
            k |= min(len(w), 255) << 32
            cache[w] = k
        ids[i] = k
        adjacent += w == before
        before = w
    marked = int(((ids >> 30) & 1).sum())
    upper = int(((ids >> 31) & 1).sum())
    longest = int((ids >> 32).max()) if n else 0
    counts = np.bincount(ids & 0x3FFFFFFF, minlength=1)
    found = np.flatnonzero(counts)
    weights = np.sqrt(counts[found])
    lines = [x for x in text.split("\n") if x.strip()]
    d = max(1, n)
    structure = np.array(
        [
            np.log1p(n) / 8, np.log1p(chars) / 10, min(2.0, (chars / d) / 10), upper / d, marked / d, sum(map(text.count, "0123456789")) / max(1, chars), sum(map(text.count, "#*$%&|<>")) / max(1, chars) * 4, len(set(words)) / d, adjacent / d,
            1 - len(set(lines)) / max(1, len(lines)), min(2.0, n / max(1, len(lines)) / 50), min(2.0, sum(map(text.count, ".!?")) / d * 4), min(2.0, sum(map(text.count, "|»•·")) / d * 2), text.count(" ") / max(1, chars), min(2.0, longest / 50), float(n == 0), np.log1p(max(0, n_chars or 0)) / 10, float(n_chars is None), float(n_chars is not None and n_chars != chars),
        ]
    )
    # a few words say little, so a short text's are scaled down
    norm = float(np.sqrt((weights**2).sum() * (1 + _FEW_WORDS / n))) if n else 1.0
    return np.concatenate([np.arange(len(STRUCTURE)), found + len(STRUCTURE)]), np.concatenate([structure, weights / norm])


@dataclass(frozen=True)
class FactorisationMachine:
    """The learnt parameters; ``w`` has one weight and ``v`` one row of factors per feature."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        """y of one row, in time linear in its features."""
        s = x @ (v := self.v[at])
        return float(self.w0 + x @ self.w[at] + 0.5 * (s @ s - (x * x) @ (v * v).sum(axis=1)))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        """The probability of label 1."""
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, x), -30, 30))))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], size: int, factors: int = 8, epochs: int = 12, rate: float = 0.05, l2: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on log loss."""
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(size), rng.normal(0, 0.05, (size, factors)), 0.0
    if not rows:
        return FactorisationMachine(0.0, w, np.zeros((size, factors)))
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            va = v[at]
            s = x @ va
            y = w0 + x @ w[at] + 0.5 * (s @ s - (x * x) @ (va * va).sum(axis=1))
            g = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[i]
            g0 += g * g
            w0 -= rate * g / np.sqrt(g0)
            dw = g * x + l2 * w[at]
            gw[at] += dw * dw
            w[at] -= rate * dw / np.sqrt(gw[at])
            dv = g * (x[:, None] * s - va * (x * x)[:, None]) + l2 * va
            gv[at] += dv * dv
            v[at] -= rate * dv / np.sqrt(gv[at])
    return FactorisationMachine(float(w0), w, v)


def remainder(key: str = "doc_id"):
    """crc32(key as text) mod 3, null for a null key."""
    return F.crc32(F.encode(F.col(f"`{key}`").cast("string"), "UTF-8")) % 3


def _inputs(documents: DataFrame, text_col: str, chars_col: str) -> tuple[Column, Column]:
    """A row's text and stated character count, null where the table has none."""
    chars = F.col(f"`{chars_col}`") if chars_col in documents.columns else F.lit(None)
    return F.coalesce(F.col(f"`{text_col}`"), F.lit("")), chars.cast("long")


def labelled_features(documents: DataFrame, labels: DataFrame, sample_rows: int = 4000, buckets: int = 4096) -> list:
    """(id, y, at, x) of the labelled rows that may be learnt from, ``sample_rows`` at most, in a fixed order."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y")).where(remainder("__id") != 1).distinct()
    chosen = known.select("__id", "__y", F.md5(F.col("__id").cast("string")).alias("__h")).orderBy("__h", "__id", "__y").limit(sample_rows)
    text, chars = _inputs(documents, "text", "n_chars")
    texts = documents.select(F.col("doc_id").alias("__doc"), text.alias("__text"), chars.alias("__n"))
    # at most sample_rows rows of two integers and a hash, by the limit above; one text a key, so no more rows come back
    joined = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    sample = joined.groupBy("__id", "__y").agg(F.min(F.struct("__text", "__n")).alias("__t")).select("__id", "__y", "__t.__text", "__t.__n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in pieces(batches):
            made = [_features(t, n, buckets, cache) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in made], type=pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in made], type=pa.list_(pa.float32()))], names=["id", "y", "at", "x"]
            )

    made = sample.mapInArrow(run, f"id {sample.schema[0].dataType.simpleString()}, y int, at array<int>, x array<float>")
    return sorted(made.toLocalIterator(), key=lambda r: (str(r.id), r.y))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 4000, buckets: int = 4096, **settings) -> FactorisationMachine:
    """Fit on a bounded sample of the rows that may be learnt from."""
    rows = labelled_features(documents, labels, sample_rows, buckets)
    return learn([(np.array(r.at), np.array(r.x, dtype=np.float64)) for r in rows], [r.y for r in rows], len(STRUCTURE) + buckets, **settings)


def score_documents(documents: DataFrame, model: FactorisationMachine, keep: list[str] | None = None, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``keep`` (all columns by default), then score and predicted, which take the place of columns of these names."""
    passed = [c for c in (documents.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    # columns go by position, so their names do not matter
    source = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(passed)], *_inputs(documents, text_col, chars_col)).toDF(*[f"c{i}" for i in range(len(passed))], "text", "chars")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-2]), "score double, predicted int"])
    names = [*source.columns[:-2], "score", "predicted"]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its size is that of the hash space
    buckets = len(model.w) - len(STRUCTURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        fm = shared.value
        for batch in pieces(batches):
            k = batch.num_columns
            score = np.array([fm.score(*_features(t, n, buckets, cache)) for t, n in zip(batch.column(k - 2).to_pylist(), batch.column(k - 1).to_pylist(), strict=True)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=names)

    return source.mapInArrow(run, schema).toDF(*passed, "score", "predicted")


def keep_good(documents: DataFrame, model: FactorisationMachine) -> DataFrame:
    """The rows that the model predicts as good, with the columns of ``documents``, whatever their names."""
    plain = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    where = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    scored = score_documents(plain, model, text_col=where["text"], chars_col=where.get("n_chars", "none"))
    return scored.where("predicted = 1").drop("score", "predicted").toDF(*documents.columns)
