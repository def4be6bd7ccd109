"""URL filters as a sort-merge range join of urls with nested allow and block rules, in DataFrame operations only.

A rule (host, path) fits its host, all subdomains of it, and every path that starts with its path.  The canonical key of a host is its labels in reverse, each
with a dot behind it, so "the host and all below it" is a prefix, and a prefix is the interval [prefix, prefix + FF) of the sorted keys (bytes of UTF-8, in which
FF and FE never are).  Intervals of prefixes nest or are disjoint, and ``sweep`` runs over points and interval ends in one sorted order with a stack of
the intervals that are open: a start pushes, an end pops.

Two sweeps find the rule: the first takes the distinct hosts through the rule hosts' intervals and reads off the whole stack, the rule hosts above each url host;
the second takes host key + FE + path through the intervals of rule host key + FE + rule path and reads off the top, the longest path of each of those hosts.
Of these, the longest host wins.

The stack in columns: the depth is the running sum of +1 and -1, and the entry at level k of the stack is the last start that reached depth k.  The sorted rows
are cut into ranges of the key, by size and not by host, so a host with a third of all urls is many ranges.  Each range is handed the depth and the open stack at
its beginning, taken from one row per range and level; so ranges run side by side.  Every join on the way is an equi-join on a host or a url, each once,
that adaptive execution may broadcast after it has seen the size, or split; only the rows per range are broadcast, whose number is that of the partitions.

Defined cases: a null url, or one without ``://``, has empty host and path; an empty host fits no rule; A-Z are lower-cased in the hosts of urls and rules, other
letters are not; of rules with equal host and path, block wins; rules with a null or empty host are ignored and a null path means every path; an unknown or
null action reads as block; repeated pages are judged alike; an empty rule table gives the default verdict; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import cut


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``a.b.net`` -> ``net.b.a.`` as bytes."""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")), "UTF-8")


def path_key(host: Column, path: Column) -> Column:
    """The key of a path below the key of a host."""
    return F.concat(host, F.expr("unhex('FE')"), F.encode(path, "UTF-8"))


#: What comes first at one place of the sorted order.
_END, _START, _POINT = 0, 1, 2


def sweep(points: DataFrame, prefixes: DataFrame, every: bool, ranges: int | None = None) -> DataFrame:
    """(point, prefix): ``points`` (at, point) with the longest of the distinct ``prefixes`` (at, prefix) that their key starts with, or, ``every``, with each of them; points without one are gone."""
    point, prefix = points.schema["point"].dataType, prefixes.schema["prefix"].dataType
    no_point, no_prefix = F.lit(None).cast(point).alias("point"), F.lit(None).cast(prefix).alias("prefix")
    rows = points.select("at", F.lit(_POINT).alias("kind"), F.lit(0).alias("step"), "point", no_prefix)
    rows = rows.unionByName(prefixes.select("at", F.lit(_START).alias("kind"), F.lit(1).alias("step"), no_point, "prefix"))
    rows = rows.unionByName(prefixes.select(F.concat("at", F.expr("unhex('FF')")).alias("at"), F.lit(_END).alias("kind"), F.lit(-1).alias("step"), no_point, no_prefix))
    # equal keys are in one range; the number of the range is fixed by the cut
    ranged = cut((rows.repartitionByRange(ranges, "at") if ranges else rows.repartitionByRange("at")).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    handed = F.broadcast(ranged.groupBy("range").agg(F.sum("step").alias("steps")).select("range", F.coalesce(F.sum("steps").over(before), F.lit(0)).alias("depth")))
    here = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = ranged.withColumn("passed", F.sum("step").over(here)).join(handed, "range").withColumn("level", F.col("depth") + F.col("passed"))
    starts = deep.where(F.col("kind") == _START).select("range", "level", "at", "kind", "point", "prefix")
    # the open stack at the beginning of each range: per level, the last start in the ranges before it
    lasts = starts.groupBy("range", "level").agg(F.max_by("prefix", "at").alias("prefix")).select("range", "level", "prefix", F.lit(1).alias("order"))
    asked = handed.where("depth > 0").select("range", F.explode(F.sequence(F.lit(1).cast("long"), "depth")).alias("level"), no_prefix, F.lit(0).alias("order"))
    carried = Window.partitionBy("level").orderBy("range", "order").rowsBetween(Window.unboundedPreceding, -1)
    opened = lasts.unionByName(asked).withColumn("prefix", F.last("prefix", ignorenulls=True).over(carried)).where("order = 0")
    opened = opened.select("range", "level", F.expr("X''").alias("at"), F.lit(_START).alias("kind"), no_point, "prefix")
    met = deep.where((F.col("kind") == _POINT) & (F.col("level") > 0))
    met = met.withColumn("level", F.explode(F.sequence(F.lit(1).cast("long"), "level"))) if every else met
    at_level = Window.partitionBy("range", "level").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = starts.unionByName(opened).unionByName(met.select("range", "level", "at", "kind", "point", "prefix"))
    return stacked.withColumn("prefix", F.last("prefix", ignorenulls=True).over(at_level)).where(F.col("kind") == _POINT).select("point", "prefix")


def clean_rules(rules: DataFrame) -> DataFrame:
    """(host, path, action, host_key), each host and path once."""
    action = F.when(F.col("action") == "allow", "allow").otherwise("block")
    r = rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"), action.alias("action")).where(F.coalesce(F.col("host"), F.lit("")) != "")
    return r.groupBy("host", "path").agg(F.max("action").alias("action")).withColumn("host_key", host_key(F.col("host")))  # "block" sorts after "allow"


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``urls`` (host, path; distinct) with rule and verdict."""
    r = clean_rules(rules)
    hosts = urls.where("host <> ''").select("host").distinct().select(host_key(F.col("host")).alias("at"), F.col("host").alias("point"))
    above = sweep(hosts, r.select(F.col("host_key").alias("at"), F.col("host_key").alias("prefix")).distinct(), True, ranges).select(F.col("point").alias("host"), F.col("prefix").alias("host_key"))
    below = urls.join(above, "host").select(path_key(F.col("host_key"), F.col("path")).alias("at"), F.struct("host", "path", F.octet_length("host_key").alias("reach")).alias("point"))
    wanted = r.select(path_key(F.col("host_key"), F.col("path")).alias("at"), F.struct(F.concat("host", "path").alias("rule"), "action").alias("prefix"))
    found = sweep(below, wanted, False, ranges)
    best = found.groupBy("point.host", "point.path").agg(F.max_by("prefix", "point.reach").alias("best")).select("host", "path", "best.rule", "best.action")
    return urls.join(best, ["host", "path"], "left").select("host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """(key, url, host, path, rule, verdict) of every row of ``pages``; ``ranges`` is the number of ranges a sweep is cut into, the session's number of partitions by default."""
    parsed = pages.select(F.col(f"`{key}`"), F.col(f"`{url_col}`").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judge_urls(parsed.select("host", "path").distinct(), rules, default, ranges)
    return parsed.join(judged, ["host", "path"]).select(f"`{key}`", "url", "host", "path", "rule", "verdict")
