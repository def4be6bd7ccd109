"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified exactly.

Words are maximal runs of letters and digits (ASCII, lower-cased) and of anything beyond ASCII.  A window is ``width``
consecutive words of an item (the whole item if shorter); its tokens are its shingles of ``shingle`` words.  Containing a window
means containing all its shingles, so the prefix that a document must share is one shingle, and the rarest one is the cheapest: shingles
are ordered by their number of occurrences in all documents.  Where a document has a window's prefix shingle, the shingle's
offset fixes the window's only possible place; it must fit within the document (positional and length bounds), and then the words
are compared.  Every document word inside an occurrence is hit.

One plan for any number of items: windows, their shingles with counts, and the prefixes are tables, joined by the shingle's hash.  What is sent to
executors is only a filter, a table of bits (two per shingle, ``filter_bits`` at most, 128 MB by default); a fuller filter lets more words through to
the join, which decides.  Documents are read twice, to count shingles and to find places, whatever the number of windows, and their texts
never move: a place that passes goes on with the words round it.  Places are keyed by 128 bits of their text, and repeated ones combine before the
shuffle, so a text that a third of the documents share is looked up once per task; hot prefixes are split by adaptive execution.

Defined cases: null or wordless texts have no words and are not contaminated; items without words are in no window, repeated
items count once, an item without an id hits but is not listed; repeated documents are judged each; a null key is kept; an
empty benchmark hits nothing; an empty document table gives no rows; clashing columns of the input are replaced, and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import cut, pieces, row_identity

#: ASCII but letters and digits separates words; A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same words, as a pattern of raw text.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LEAST_BITS = 20


_P = 0x9E3779B97F4A7C15
#: Bytes whose hashes are computed at a time.
_AT_ONCE = 1 << 20


def words_of(text: str) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode().translate(_TABLE).split()


class WordTable:
    """The words of many texts as places in one string of bytes: word k is ``data[starts[k]:ends[k]]``, and text t has the words from ``bounds[t]`` to ``bounds[t + 1]``."""

    def __init__(self, texts: list[str]) -> None:
        plain = [t.encode().translate(_TABLE) for t in texts]
        self.data = b" ".join([*plain, b""])
        edge = np.diff((np.frombuffer(self.data, dtype=np.uint8) != 32).view(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.bounds = np.searchsorted(self.starts, np.cumsum([0, *(len(x) + 1 for x in plain)]))

    def text(self, first: int, last: int) -> str:
        """The words from ``first`` up to ``last``, with single spaces."""
        return b" ".join(self.data[self.starts[first] : self.ends[last - 1]].split()).decode() if last > first else ""

    def hashes(self) -> np.ndarray:
        """A hash of every word, the same in every process: its bytes as the digits of a number, taken from running sums, then mixed."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        data = np.frombuffer(self.data, dtype=np.uint8)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(out):
                base = self.starts[at]
                # as many words as fit, one at least
                stop = max(at + 1, int(np.searchsorted(self.ends, base + _AT_ONCE, side="right")))
                up, down = _powers(int(self.ends[stop - 1] - base) + 1)
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(data[base : self.ends[stop - 1]] * up[:-1])])
                starts = self.starts[at:stop] - base
                key = (sums[self.ends[at:stop] - base] - sums[starts]) * down[starts]
                key ^= key >> np.uint64(32)
                key *= _B
                key ^= key >> np.uint64(29)
                out[at:stop] = key
                at = stop
        return out


_KNOWN: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse, modulo 2^64."""
    if not _KNOWN or len(_KNOWN[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _KNOWN[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)]), dtype=np.uint64) for x in (_P, pow(_P, -1, 1 << 64))]
    return _KNOWN[0][:n], _KNOWN[1][:n]


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` words."""
    n = max(0, len(ids) - size + 1)
    key = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            key *= _A
            key += ids[k : k + n]
            key ^= key >> np.uint64(29)
        key *= _B
        key ^= key >> np.uint64(32)
    return key


def item_windows(benchmark: DataFrame, width: int, shingle: int, key: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, n, size, shingles, items): distinct windows of ``n`` words with the hashes of their shingles of ``size`` words and the ids, as text, of the items that hold them."""
    schema = pa.schema([("item", pa.string()), ("window", pa.string()), ("n", pa.int32()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = WordTable([text])
                if words := len(table.starts):
                    n = min(width, words)
                    size = min(shingle, n)
                    marks = shingle_hashes(table.hashes(), size).view(np.int64).tolist()
                    rows += [(item, table.text(i, i + n), n, size, marks[i : i + n - size + 1]) for i in range(words - n + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    texts = benchmark.select(F.col(f"`{key}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    made = texts.mapInArrow(run, "item string, window string, n int, size int, shingles array<long>")
    return made.groupBy("window", "n", "size", "shingles").agg(F.array_sort(F.collect_set("item")).alias("items"))


class ShingleFilter:
    """Which hashes may be among those that it was made of; each sets two bits."""

    def __init__(self, bits: int, table: np.ndarray) -> None:
        self.bits, self.table = bits, table

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of each hash."""
        with np.errstate(over="ignore"):
            return keys >> np.uint64(64 - bits), (keys * _C) >> np.uint64(64 - bits)

    @staticmethod
    def of(shingles: DataFrame, most_bits: int) -> ShingleFilter:
        """From (shingle): 64 bits a shingle up to ``most_bits`` in all; what reaches the driver is the table of bits."""
        bits = int(np.clip(int(np.ceil(np.log2(max(1, shingles.count()) * 64))), _LEAST_BITS, max(_LEAST_BITS, most_bits.bit_length() - 1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = np.concatenate(ShingleFilter.places(batch.column(0).to_numpy().view(np.uint64), bits)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(both))], names=["bit"])

        bit = shingles.select("shingle").mapInArrow(run, "bit long").withColumn("bit", F.col("bit") + 1)
        parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("held"))
        table = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for r in parts.toLocalIterator():
            at, held = (r.part - 1) * 4096, np.frombuffer(r.held, dtype=np.uint8)
            table[at : at + len(held)] = held
        return ShingleFilter(bits, table)

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the hashes that pass."""
        first, second = self.places(keys, self.bits)
        at = np.flatnonzero(self.table[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1)
        second = second[at]
        return at[(self.table[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]


def _met(table: WordTable, sizes: list[int], fits: ShingleFilter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, word, hash) of the shingles of each size that pass the filter and lie in one text."""
    ids = table.hashes()
    for s in sizes:
        keys = shingle_hashes(ids, s)
        at = fits.among(keys)
        at = at[at + s <= table.bounds[np.searchsorted(table.bounds, at, side="right")]] if len(at) else at
        yield s, at, keys[at]


def _occurrences(texts: DataFrame, shingles: DataFrame, sizes: list[int], most_bits: int) -> DataFrame:
    """(shingle, n): how often each of ``shingles`` is in the documents; a task sends one row for each that it met."""
    shared = texts.sparkSession.sparkContext.broadcast(ShingleFilter.of(shingles, most_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = shared.value
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["shingle", "n"])

        for batch in pieces(batches):
            for _, _, keys in _met(WordTable(batch.column(0).to_pylist()), sizes, fits):
                held.append(keys)
                size += len(keys)
            if size > 1 << 22:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    # the filter may let others through; the semi-join leaves them out before they are counted on
    return texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).join(shingles, "shingle", "left_semi")


def _prefixes(windows: DataFrame, texts: DataFrame, sizes: list[int], most_bits: int) -> DataFrame:
    """(shingle, offset, window, n, size, items): each window under its rarest shingle; windows of which no document has one are gone."""
    each = windows.select("window", F.posexplode("shingles").alias("offset", "shingle"))
    often = _occurrences(texts, each.select("shingle").distinct(), sizes, most_bits)
    # a window all of whose shingles occur: the others cannot be contained
    rarest = each.join(often, "shingle").groupBy("window").agg(F.min(F.struct("n", "shingle", "offset")).alias("r"), F.count(F.lit(1)).alias("met"))
    return windows.join(rarest, "window").where(F.col("met") == F.size("shingles")).select(F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset"), "window", "n", "items")


def _places(texts: DataFrame, prefixes: DataFrame, sizes: list[int], width: int, most_bits: int) -> DataFrame:
    """(a, b, at, shingle, lead, near): the places of texts that may hold a prefix shingle, with the words from ``lead`` before it to a window's reach after it."""
    shared = texts.sparkSession.sparkContext.broadcast(ShingleFilter.of(prefixes.select("shingle").distinct(), most_bits))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("at", pa.int64()), ("shingle", pa.int64()), ("lead", pa.int32()), ("near", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = shared.value
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in pieces(batches):
            table, a, b = WordTable(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for s, at, keys in _met(table, sizes, fits):
                # the shortest windows are one shingle; windows of the full shingle size reach out on both sides
                reach = width - s if s == sizes[-1] else 0
                texts_at = np.searchsorted(table.bounds, at, side="right") - 1
                for i, k, t in zip(at.tolist(), keys.view(np.int64).tolist(), texts_at.tolist(), strict=True):
                    begin, end = int(table.bounds[t]), int(table.bounds[t + 1])
                    first = max(begin, i - reach)
                    rows.append((a[t], b[t], i - begin, k, i - first, table.text(first, min(end, i + s + reach))))
                    if len(rows) >= 1 << 14:
                        yield made()
                        rows = []
        if rows:
            yield made()

    return texts.mapInArrow(run, "a long, b long, at long, shingle long, lead int, near string").distinct()


def _covered(hits: Column) -> Column:
    """How many words lie in one of the spans."""
    def add(state: Column, h: Column) -> Column:
        return F.struct((state["n"] + F.greatest(F.lit(0), h["stop"] - F.greatest(h["start"], state["end"]))).alias("n"), F.greatest(h["stop"], state["end"]).alias("end"))

    zero = F.lit(0).cast("long")
    return F.aggregate(F.array_sort(hits), F.struct(zero.alias("n"), zero.alias("end")), add, lambda s: s["n"])


def hits_of_texts(documents: DataFrame, benchmark: DataFrame, width: int = 13, shingle: int = 3, filter_bits: int = 1 << 30, text_col: str = "text") -> DataFrame:
    """(a, b, hits, items, n_hit) of the distinct texts that hold a window; (a, b) is ``row_identity`` of the text column."""
    a, b = row_identity(documents, [text_col])
    texts = documents.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"), a.alias("a"), b.alias("b"))
    windows = cut(item_windows(benchmark, width, shingle))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # 1 to ``shingle``
    prefixes = cut(_prefixes(windows, texts, sizes, filter_bits))
    met = _places(texts, prefixes, sizes, width, filter_bits).join(prefixes, "shingle")
    # the place must leave room for the window before and after, and then hold its words
    fits = met.where("lead >= offset").where(F.array_join(F.slice(F.split("near", " "), F.col("lead") - F.col("offset") + 1, F.col("n")), " ") == F.col("window"))
    start = F.col("at") - F.col("offset")
    found = fits.groupBy("a", "b").agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("n")).alias("stop"))).alias("hits"), F.collect_set("items").alias("items"))
    return found.select("a", "b", F.array_sort("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), _covered(F.col("hits")).alias("n_hit"))


def contamination(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, percent: int = 5, text_col: str = "text", **settings) -> DataFrame:
    """``keep`` (all columns by default), n_words, hits, items, n_hit, n_items, contaminated, per document."""
    outputs = ["n_words", "hits", "items", "n_hit", "n_items", "contaminated"]
    passed = [c for c in (documents.columns if keep is None else keep) if c.lower() not in {*outputs, "__a", "__b"}]
    a, b = row_identity(documents, [text_col])
    source = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(passed)], a.alias("a"), b.alias("b"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = [*source.columns[:-1], "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts = np.diff(WordTable(batch.column(batch.num_columns - 1).to_pylist()).bounds).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=names)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "n_words long"])
    rows = source.mapInArrow(run, schema).toDF(*passed, "__a", "__b", "n_words")
    found = cut(hits_of_texts(documents, benchmark, text_col=text_col, **settings)).toDF("__c", "__d", "hits", "items", "n_hit")
    joined = rows.join(found, (F.col("__a") == F.col("__c")) & (F.col("__b") == F.col("__d")), "left")
    made = joined.withColumns({"hits": F.coalesce("hits", F.array().cast("array<struct<start:bigint,stop:bigint>>")), "items": F.coalesce("items", F.array().cast("array<string>")), "n_hit": F.coalesce("n_hit", F.lit(0).cast("long"))})
    made = made.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    return made.select(*[F.col(f"`{c}`") for c in passed], *outputs)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = 5, text_col: str = "text", **settings) -> DataFrame:
    """The clean rows, with the columns of ``documents``; only the texts that hold a window at all are looked at again."""
    a, b = row_identity(documents, [text_col])
    found = cut(hits_of_texts(documents, benchmark, text_col=text_col, **settings)).select(F.col("a").alias("__c"), F.col("b").alias("__d"), F.col("n_hit").alias("__n_hit"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"), a.alias("__a"), b.alias("__b"))
    joined = rows.join(found, (F.col("__a") == F.col("__c")) & (F.col("__b") == F.col("__d")), "left")
    contaminated = F.when(F.col("__n_hit") > 0, 100 * F.col("__n_hit") >= percent * F.regexp_count("__text", F.lit(WORDS))).otherwise(F.lit(False))
    return joined.where(~contaminated).select("__row.*")
