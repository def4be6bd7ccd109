"""N-grams and motifs over the notes of a track, as arrays and grouped aggregates inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.expr import is_chord, quantize

GROUP = ["file_id", "track_id"]


def windows(notes: DataFrame, token: Column, n: int, group: list[str] = GROUP, order: tuple[str, ...] = ("start", "note_id")) -> DataFrame:
    """(group, pos, start, end, gram): every window of ``n`` notes, from 0; a frame over sorted rows, so no track is gathered."""
    w = Window.partitionBy(*group).orderBy(*order)
    frame = w.rowsBetween(0, n - 1)
    made = notes.withColumn("__token", token).select(*group, (F.row_number().over(w) - 1).alias("pos"), "start", F.last("end").over(frame).alias("end"), F.sum("dur").over(frame).alias("total_dur"), F.collect_list("__token").over(frame).alias("gram"))
    return made.where(F.size("gram") == n)


def sequences(notes: DataFrame, token: Column, group: list[str] = GROUP, order: tuple[str, ...] = ("start", "note_id")) -> DataFrame:
    """(group, tokens): one array per track in order."""
    keyed = F.struct(*[F.col(c) for c in order], token.alias("__t"))
    return notes.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["__t"]).alias("tokens"))


def grams(seqs: DataFrame, least: int, most: int, group: list[str] = GROUP, tokens: str = "tokens") -> DataFrame:
    """(group, n, pos, gram): all windows of ``least`` to ``most`` tokens of each array."""
    sized = seqs.where(F.size(tokens) >= least).withColumn("n", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.size(tokens)))))
    return sized.select(*group, "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(tokens) - F.col("n") + 1), lambda i: F.slice(F.col(tokens), i, F.col("n")))).alias("pos", "gram"))


def motifs(found: DataFrame, least_count: int = 2, group: list[str] = GROUP) -> DataFrame:
    """(group, n, gram, positions, count, score): grams that occur often enough; the score is count times length."""
    each = found.groupBy(*group, "n", "gram").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count(F.lit(1)).alias("count")).where(F.col("count") >= least_count)
    return each.withColumn("score", F.col("count") * F.col("n"))


def top_motifs(found: DataFrame, by: list[Column], k: int, group: list[str] = GROUP) -> DataFrame:
    """The first ``k`` of each group, with ``rank``; ties by first position, then by the gram."""
    order = Window.partitionBy(*group).orderBy(*by, F.col("positions")[0], F.col("n"), "gram")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def longest_frequent(found: DataFrame, least_count: int = 2, group: list[str] = GROUP) -> DataFrame:
    """(group, n, gram, count): the grams of the greatest length at which any is frequent."""
    counts = found.groupBy(*group, "n", "gram").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least_count)
    return counts.withColumn("__n", F.max("n").over(Window.partitionBy(*group))).where("n = __n").drop("__n")


def chords(notes: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, start, pitches, bass, dur, density): notes of one onset."""
    return notes.groupBy(*group, "start").agg(F.array_sort(F.collect_list("pitch")).alias("pitches"), F.min("pitch").alias("bass"), F.max("dur").alias("dur"), F.count(F.lit(1)).alias("density"))


def chord_tokens(notes: DataFrame, unit: float = 30.0, pitch: Column | None = None, group: list[str] = GROUP) -> DataFrame:
    """(group, start, token): an onset's (pitch, quantized duration) pairs, sorted, and the quantized gap to the next onset, 0 at the end."""
    pair = F.struct((F.col("pitch") if pitch is None else pitch).alias("p"), quantize("dur", unit).cast("int").alias("d"))
    each = notes.groupBy(*group, "start").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    gap = F.coalesce(quantize(F.lead("start").over(Window.partitionBy(*group).orderBy("start")) - F.col("start"), unit), F.lit(0.0)).cast("int")
    text = F.array_join(F.transform("pairs", lambda x: F.concat_ws(":", x["p"].cast("string"), x["d"].cast("string"))), "+")
    return each.select(*group, "start", F.concat_ws("/", text, gap.cast("string")).alias("token"))


def ostinatos(grams4: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, gram, motif_count, ostinato_count): an ostinato is each occurrence of a four-note motif from the third on."""
    return grams4.groupBy(*group, "gram").agg(F.count(F.lit(1)).alias("motif_count")).withColumn("ostinato_count", F.greatest(F.col("motif_count") - 2, F.lit(0)))


def sequence_pairs(grams3: DataFrame, group: list[str] = GROUP, apart: int = 3) -> DataFrame:
    """(group, gram, pairs): pairs of equal grams whose positions are ``apart`` or more apart.

    All pairs are counted from the number of positions, and the few that are too close by lags; no pair is ever made.
    """
    w = Window.partitionBy(*group, "gram").orderBy("pos")
    near = sum((F.coalesce(F.col("pos") - F.lag("pos", k).over(w) < apart, F.lit(False)).cast("long") for k in range(1, apart)), F.lit(0))
    each = grams3.withColumn("__near", near).groupBy(*group, "gram").agg(F.count(F.lit(1)).alias("__n"), F.sum("__near").alias("__near"))
    return each.select(*group, "gram", (F.floor(F.col("__n") * (F.col("__n") - 1) / 2) - F.col("__near")).alias("pairs")).where("pairs > 0")


def arpeggios(grams3: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, gram, count) of grams with three distinct names."""
    return grams3.where(is_chord("gram")).groupBy(*group, "gram").agg(F.count(F.lit(1)).alias("count"))


def cadences(events: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, time, chord): times at which just a tonic or dominant triad sounds, as the set of names after an on or off event (time, seq, name, step)."""
    w = Window.partitionBy(*group, "name").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*group).orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    names = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
    level = events.withColumn("__on", F.sum("step").over(w) > 0)
    state = level.withColumns({f"__{n}": F.last(F.when(F.col("name") == n, F.col("__on")), True).over(order) for n in names})
    sounding = F.array_compact(F.array(*[F.when(F.col(f"__{n}"), F.lit(n)) for n in names]))
    triads = F.array(*[F.array(*map(F.lit, sorted(t, key=names.index))) for t in (("C", "E", "G"), ("G", "B", "D"))])
    return state.withColumn("chord", sounding).where(F.array_contains(triads, F.col("chord"))).select(*group, "time", "chord")


def occurrences(found: DataFrame, patterns: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, gram, pos, start, stop): where each frequent gram occurs; ``stop`` is the onset plus the sum of its durations."""
    return found.join(patterns.select(*group, "gram"), [*group, "gram"], "left_semi").select(*group, "gram", "pos", "start", (F.col("start") + F.col("total_dur")).alias("stop"))


def token_ngrams(documents: DataFrame, n: int, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, gram, count) over all documents; grams are made within a text, counts combine before the shuffle."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    each = documents.select(*keys, words.alias("w")).where(F.size("w") >= n)
    return each.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(n)), " "))).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("count"))
