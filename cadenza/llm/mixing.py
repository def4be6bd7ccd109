"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Targets: sources, by code point with null last, weigh ``weights`` in turn and share ``demand`` times all words; a source's target
stops at ``cap`` times its own words and the excess is shared again by weight, until none is above.  A round is one aggregate over the sources
and caps at least one more, so the rounds end; sources are numbered by range, so no task sees them all.

Curriculum: a schedule is data, knots (time, weight) from time 0 to 1 with straight lines between, scaled to the integral 1; sources take
``schedules`` in turn, as they do weights.  At schedule time t source s is drawn at the rate target_s x f_s(t), and has been drawn F_s(t) of its target, F_s being the
integral of f_s.  A source's documents, in the order of a hash, form a stream that is repeated up to its target; the word at offset c is demanded at
the time t with F_s(t) = c / target, the root of a quadratic on its stretch of the schedule.  Its position is what all sources together have been drawn by then,
sum of target_u F_u(t) over the sum of targets: the share of the training tokens that come before it.  So at every position the sources' rates add up to one, and
over any stretch of positions a source's share of the tokens is that of its rate in the sum of all.  Documents are range-sorted by position.

Offsets: rows that agree in all columns are counted first, with a combining group-by.  Each source's rows are dealt to ``buckets`` ranges of the hash of key
and text; sums per range, at most sources x buckets rows, give each range its first offset, and running sums go on within a range.  So a source with a
third of all words is spread over as many tasks as a small one's rows allow, and so are the rows that share or lack a key.

``taken`` counts words and is cut within the one document of a source in which its target ends, so a source's taken words are its target
rounded down.  Texts are not cut: ``mix_rows`` repeats a row once per whole copy, and for that one document if at least half is taken.

Defined cases: null, empty and blank texts have size 0 and are taken 0 times; null is a source; null keys come last among
equal hashes; rows with the same or no key are rows of their own, told apart by their content, and equal rows are interchangeable; an empty table or one without
words takes nothing; clashing columns are replaced in the report of ``mix`` and kept in ``mix_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import WORD, cut, row_identity

Schedule = tuple[tuple[float, float], ...]
#: Schedules in turn: heavy sources fade, those between hold, light ones grow.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (0.5, 1.25), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.5, 0.75), (1.0, 2.5)))


def stretches(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(t, F(t), f(t), slope of f) at the start of each straight stretch of a schedule that is scaled to the integral 1."""
    times = [t for t, _ in schedule]
    if len(schedule) < 2 or times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:], strict=False)) or any(w < 0 for _, w in schedule):
        raise ValueError("a schedule has knots of weight 0 or more at rising times from 0 to 1")
    whole = sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:], strict=False))
    if whole <= 0:
        raise ValueError("a schedule has a weight above 0")
    out, passed = [], 0.0
    for (a, v), (b, w) in zip(schedule, schedule[1:], strict=False):
        out.append((a, passed, v / whole, (w - v) / whole / (b - a)))
        passed += (b - a) * (v + w) / 2 / whole
    return out


def _pick(parts: list[tuple[float, float, float, float]], at: int, value: Column, made) -> Column:
    """``made`` of the last stretch whose entry ``at`` is at most ``value``, or of the first."""
    chosen = made(*parts[0])
    for part in parts[1:]:
        chosen = F.when(value >= F.lit(part[at]), made(*part)).otherwise(chosen)
    return chosen


def integral(schedule: Schedule, t: Column) -> Column:
    """F(t), the share of its target that a source has been drawn by schedule time t."""
    return _pick(stretches(schedule), 0, t, lambda a, passed, f, slope: F.lit(passed) + (t - a) * (F.lit(f) + F.lit(slope / 2) * (t - a)))


def time_of(schedule: Schedule, share: Column) -> Column:
    """The schedule time t with F(t) = share."""
    def made(a: float, passed: float, f: float, slope: float) -> Column:
        rest = F.greatest(share - passed, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(f * f) + F.lit(2 * slope) * rest, F.lit(0.0)))
        return F.lit(a) + F.when(rest > 0, 2 * rest / (F.lit(f) + root)).otherwise(0.0)

    return F.least(F.lit(1.0), _pick(stretches(schedule), 1, share, made))


def _cycled(rank: Column, made: list[Column]) -> Column:
    chosen = made[-1]
    for k in range(len(made) - 1):
        chosen = F.when(F.pmod(rank, F.lit(len(made))) == k, made[k]).otherwise(chosen)
    return chosen


def numbered(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 in the order of ``by``, which no two share: sorted ranges are numbered each from the count of those before."""
    ranged = cut(rows.repartitionByRange(by).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    first = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("__range").orderBy(by)
    return ranged.join(F.broadcast(first), "__range").withColumn(name, F.col("__first") + F.row_number().over(within) - 1).drop("__range", "__first")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), demand: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size)."""
    ranked = numbered(sizes, F.col("source").asc_nulls_last(), "rank")
    weighed = ranked.withColumns({"weight": _cycled(F.col("rank"), [F.lit(float(w)) for w in weights]), "most": F.lit(float(cap)) * F.col("source_size")})
    wanted = float(demand) * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, free = 0.0, -1
    while True:
        # sources that reach their cap at this level stay capped at every higher one
        capped = F.col("most") <= F.lit(level) * F.col("weight")
        fixed, open_weight, still = weighed.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(~capped)).first()
        if still == free or not still:
            break
        level, free = (wanted - (fixed or 0.0)) / open_weight, still
    return weighed.select("source", "source_size", "rank", F.least("most", F.lit(level) * F.col("weight")).alias("target") if free > 0 and still else F.col("most").alias("target"))


def mix(documents: DataFrame, key: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 1024, schedules: tuple[Schedule, ...] = SCHEDULES, **settings) -> DataFrame:
    """(key, source, size, source_size, target, taken, copies, position, offset, time) per row; texts are read once and never shuffled."""
    placed, at = _placed(documents, key, text_col, source_col, buckets, schedules, settings)
    each = placed.withColumn("__offset", F.explode(F.expr("transform(sequence(0, __n - 1), i -> __offset + i * size)")))
    each = at(each.withColumn("taken", _taken(F.col("__offset"))))
    return each.withColumn("position", _position(schedules, F.col("time"))).select(key, "source", "size", "source_size", "target", "taken", _copies().alias("copies"), "position", F.col("__offset").alias("offset"), "time")


def _taken(offset: Column) -> Column:
    """Words taken of the row at ``offset`` of its source: whole passes over the source, then what of the last one falls into the row."""
    total = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(total / F.col("source_size"))).otherwise(0).cast("long")
    left = total - passes * F.col("source_size")
    return (passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - offset))).cast("long")


def _copies() -> Column:
    return F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")


def _position(schedules: tuple[Schedule, ...], time: Column) -> Column:
    drawn = sum((F.col("__t")[k] * integral(s, time) for k, s in enumerate(schedules)), F.lit(0.0))
    return F.when(F.col("__all") > 0, F.least(F.lit(1.0), drawn / F.col("__all"))).otherwise(1.0)


def _placed(documents: DataFrame, key: str, text_col: str, source_col: str, buckets: int, schedules: tuple[Schedule, ...], settings: dict):
    """Distinct rows (key, __a, __b, __n of them, source, size, __offset of the first) with their source's figures; and what adds the schedule ``time`` of __offset."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    a, b = row_identity(documents)
    # the key and the text decide the order; rows that differ in other columns only follow by identity
    rows = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{source_col}`").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.lit(":"), F.md5(text))).alias("__h"), a.alias("__a"), b.alias("__b"))
    rows = cut(rows.groupBy(key, "source", "size", "__h", "__a", "__b").agg(F.count(F.lit(1)).alias("__n")))
    rows = rows.withColumn("__bucket", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    words = F.col("size") * F.col("__n")
    sums = rows.groupBy("source", "__bucket").agg(F.sum(words).alias("bucket_size"))
    wanted = cut(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), **settings))
    # one row: what each schedule's sources are drawn in all
    drawn = wanted.agg(*[F.coalesce(F.sum(F.when(F.pmod("rank", F.lit(len(schedules))) == k, F.col("target"))), F.lit(0.0)).alias(f"t{k}") for k in range(len(schedules))])
    drawn = drawn.select(F.array(*drawn.columns).alias("__t"), sum((F.col(c) for c in drawn.columns), F.lit(0.0)).alias("__all"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.withColumn("__first", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).alias("f")
    firsts = firsts.join(wanted.alias("w"), F.col("f.source").eqNullSafe(F.col("w.source"))).select(F.col("f.source").alias("__source"), F.col("__bucket").alias("__b2"), "__first", "source_size", "target", "rank").join(F.broadcast(drawn))
    within = Window.partitionBy("source", "__bucket").orderBy("__h", F.col(key).asc_nulls_last(), "size", "__a", "__b").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__sum", F.coalesce(F.sum(words).over(within), F.lit(0))).join(firsts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b2")))

    def at(rows: DataFrame) -> DataFrame:
        # a column of its own, as the curves refer to it many times
        shared = rows.withColumn("__share", F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("__offset") / F.col("target"))).otherwise(1.0))
        return shared.withColumn("time", _cycled(F.col("rank"), [time_of(s, F.col("__share")) for s in schedules])).drop("__share")

    return placed.withColumn("__offset", F.col("__first") + F.col("__sum")).drop("__source", "__b2", "__first", "__sum", "__bucket", "__h"), at


def by_position(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Range-sorted by the position at which training first meets a row."""
    return mixed.repartitionByRange("position", key).sortWithinPartitions("position", key)


def mix_rows(documents: DataFrame, key: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 1024, schedules: tuple[Schedule, ...] = SCHEDULES, **settings) -> DataFrame:
    """``documents`` with each row as often as the mix takes it, in the order of training positions.

    Rows meet their copies by 128 bits of all their columns.  Rows that are equal in all of them take their copies together: one stands for all.
    """
    placed, at = _placed(documents, key, text_col, source_col, buckets, schedules, settings)
    each = placed.withColumn("__offset", F.explode(F.expr("transform(sequence(0, __n - 1), i -> __offset + i * size)"))).withColumn("taken", _taken(F.col("__offset"))).withColumn("copies", _copies()).where("copies > 0")
    # copy j of a row starts j passes of its source later
    each = each.withColumn("__offset", F.explode(F.expr("transform(sequence(0, copies - 1), j -> __offset + j * source_size)")))
    timed = at(each)
    taken = cut(timed.select(F.col("__a").alias("__c"), F.col("__b").alias("__d"), _position(schedules, F.col("time")).alias("__position")))
    a, b = row_identity(documents)
    # equal rows become one before the shuffle, however many there are
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), a.alias("__a"), b.alias("__b")).groupBy("__a", "__b").agg(F.first("__row").alias("__row"))
    joined = whole.join(taken, (F.col("__a") == F.col("__c")) & (F.col("__b") == F.col("__d")))
    order = [F.col("__position"), F.col(f"__row.`{key}`")]
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select("__row.*")
