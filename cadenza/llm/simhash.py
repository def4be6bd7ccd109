"""SimHash near-duplicates: fingerprints, pigeonhole blocks, a Hamming check, and connected components.

Texts are lower-cased (A-Z only) and split into words; each shingle of ``width`` words, repeats included, is hashed with XXH64
(seed 42), and bit k of the fingerprint is 1 if it is 1 in over half the hashes.  Fingerprints within ``distance`` bits link.

Blocks: 64 bits are cut into ``blocks`` runs; two fingerprints within ``distance`` bits agree on some ``blocks - distance`` of
them, so each fingerprint is filed once per choice of that many runs, and equal keys are compared.  With 6 runs and distance
3 a key has 32 bits or so, so chance meetings stay few as the corpus grows.

Scale: only distinct fingerprints are filed (a group of equal texts is one row after a combining group-by).  Keys of one
fingerprint are dropped before anything is compared.  A key with over ``unit`` fingerprints is cut into chunks, and each pair
of chunks is a unit of work of its own, so no task holds more than two chunks and none is skipped.  A unit emits a spanning
forest, fewer links than it has fingerprints, never its pairs.

Defined cases: null, empty and blank texts have fingerprint 0, which links like any other; a text of fewer words than a
shingle is one shingle; repeated rows and null ids keep their rows; the component of fingerprints without any non-null id
is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import cut, pieces, text_or_empty
from cadenza.llm.components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose hashes are unpacked to bits at a time.
_AT_ONCE = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of a text, unsigned."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    joined = b" ".join(words)
    if n == 1:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _AT_ONCE):
        part = np.array(hashes[k : k + _AT_ONCE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 3, key: str = "doc_id", text_col: str = "text", marks: tuple[Column, ...] = ()) -> DataFrame:
    """(key, fp, marks) with the fingerprint as a signed 64-bit integer; ``marks`` are long columns passed through."""
    source = documents.select(F.col(f"`{key}`").alias(key), text_or_empty(f"`{text_col}`").alias("__text"), *marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), *batch.columns[2:]], names=[key, "fp", *names])

    names = source.columns[2:]
    return source.mapInArrow(run, ", ".join([f"`{key}` {source.schema[0].dataType.simpleString()}", "fp long", *(f"`{c}` long" for c in names)]))


def block_masks(blocks: int, distance: int) -> list[int]:
    """One 64-bit mask per choice of ``blocks - distance`` runs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(runs, blocks - distance)]


def forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that connect just what lies within ``distance`` bits, through the unit's fingerprints: each is expanded once, against those not yet reached."""
    left = np.unique(fps)
    a: list[int] = []
    b: list[int] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= distance
            if near.any():
                found = left[near]
                a += [int(at)] * len(found)
                b += found.tolist()
                queue.extend(found)
                left = left[~near]
    return a, b


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def link_fingerprints(distinct: DataFrame, distance: int = 3, blocks: int = 6, unit: int = 20_000) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all pairs within ``distance`` bits."""
    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    masks = [signed(m) for m in block_masks(blocks, distance)]
    filed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("mask", "part"))
    met = filed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.select("mask", "part", F.ceil(F.col("n") / F.lit(unit)).cast("int").alias("chunks"))
    # chunk c of a key goes to the units (c, 0..c) and (c..chunks - 1, c)
    units = (
        filed.join(met, ["mask", "part"])
        .withColumn("c", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
        .withColumn("o", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("mask", "part", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    )
    key = ["mask", "part", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at: tuple | None = None

        def links() -> pa.RecordBatch:
            a, b = forest(np.concatenate(held), distance)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in key]
            fps = batch.column("fp").to_numpy()
            new = np.zeros(len(fps), dtype=bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [*np.flatnonzero(new).tolist(), len(fps)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                here = tuple(int(k[start]) for k in keys)
                if here != at and held:
                    if sum(map(len, held)) > 1 and len((made := links())):
                        yield made
                    held = []
                at = here
                held.append(fps[start:end].copy())
        if held and len((made := links())):
            yield made

    return units.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, distance: int = 3, blocks: int = 6, width: int = 3, key: str = "doc_id", text_col: str = "text", unit: int = 20_000) -> DataFrame:
    """(key, fp, component_id): the least key that is reachable over links, per row."""
    rows = cut(fingerprints(documents, width, key, text_col))
    distinct = rows.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(link_fingerprints(distinct, distance, blocks, unit))
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only fingerprints with a link look up what others of their component have
    linked = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(linked, "fp").select(key, "fp", "component_id")


def drop_near_duplicates(documents: DataFrame, distance: int = 3, blocks: int = 6, width: int = 3, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with one row of each component: its least non-null key, then the least hash of the text, then the least row as JSON."""
    # a key and 128 bits of its text tell rows apart, as a key may be null or repeat
    text = text_or_empty(f"`{text_col}`")
    marks = (F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(1), text).alias("__b"))
    rows = cut(fingerprints(documents, width, key, text_col, marks).groupBy("fp", key, "__a", "__b").agg(F.count(F.lit(1)).alias("n")))
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__a").alias("a"), F.col("__b").alias("b"))
    distinct = rows.groupBy("fp").agg(F.min(row).alias("least"))
    roots = components(link_fingerprints(distinct, distance, blocks))
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "first")
    judged = rows.join(linked, "fp").select(F.col(key).alias("__key"), F.col("__a").alias("__c"), F.col("__b").alias("__d"), row.eqNullSafe(F.col("first")).alias("stays"), "n")
    # what goes is fewer rows than what stays
    found = cut(judged.where("not stays or n > 1"))
    here = documents.withColumns({"__a": marks[0], "__b": marks[1]})
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__a") == F.col("__c")) & (F.col("__b") == F.col("__d"))
    once = here.join(found.select("__key", "__c", "__d"), same, "left_anti").drop("__a", "__b")
    few = here.join(found.where("stays").select("__key", "__c", "__d"), same, "left_semi")
    all_columns = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    one = few.groupBy(F.col(f"`{key}`").alias("__key"), "__a", "__b").agg(F.min_by(all_columns, F.to_json(all_columns)).alias("__row"))
    return once.unionByName(one.select("__row.*"))
