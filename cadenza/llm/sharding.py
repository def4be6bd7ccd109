"""Sharding by a hierarchical weighted hash tree, in DataFrame operations only.

A row descends region, rack and shard.  At every node each child draws u in (0, 1) from md5(key : child) and the child with
the least -ln(u) / weight wins; the weight of a subtree is the sum of its leaves'.  A draw depends on the key and the child
alone, so a changed weight moves rows only into or out of the subtrees whose weights change: rows that stay in a region whose
weights are as before stay in their rack and shard.  ``Tree.grown`` opens a region of its own for a new shard, so no weight of
an old node changes and the new shard takes rows only into itself.

Nodes are named by position, and a draw costs one md5 per child on the way down, 9 for 3 x 2 x 4 shards, not one per shard.

Slots: rows that agree in all that is kept of them are counted first, with a combining group-by, so a row that is there a million times is one; what
is left is dealt to ``buckets`` hash buckets of its shard by its whole content, so rows that share or lack a key spread.  Counts per bucket, at most shards x
buckets rows whatever the input, give each bucket its first slot, and rows are numbered within their bucket.  No task holds more than a bucket.

Defined cases: a null key hashes as the text ``null``; null text has no bytes and crc32 0; equal keys share a shard, repeated rows get
slots of their own; an empty table gives no rows; shards of weight 0 get no rows.  Columns of the input that clash are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """``weights[region][rack][shard]``; shards are numbered from 0 in that order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(regions: int = 3, racks: int = 2, shards: int = 4) -> Tree:
        """All leaves of weight 1."""
        return Tree((((1.0,) * shards,) * racks,) * regions)

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, the next number, in a rack and region of its own."""
        return Tree((*self.weights, ((weight,),)))

    @property
    def shards(self) -> int:
        """How many leaves there are."""
        return sum(len(rack) for region in self.weights for rack in region)


def _draw(key: Column, node: str) -> Column:
    """-ln(u) with u from the first 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + node))), 1, 13), 16, 10).cast("long").cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52)))


def _choice(key: Column, children: list[tuple[str, float]]) -> Column:
    """Position of the child that wins, as int; ties, which are next to impossible, go to the first."""
    drawn = [F.struct((_draw(key, name) / F.lit(weight)).alias("d"), F.lit(i).alias("i")) for i, (name, weight) in enumerate(children) if weight > 0]
    if not drawn:
        return F.lit(0)
    return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["i"]


def assign_shard(df: DataFrame, tree: Tree, key: str, out: str = "shard") -> DataFrame:
    """``df`` with the number of the shard that ``key`` descends to."""
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    region_w = [sum(map(sum, region)) for region in tree.weights]
    df = df.withColumn("__region", _choice(name, [(f"g{g}", w) for g, w in enumerate(region_w)]))

    def per(column: str, choices: list[Column]) -> Column:
        made = choices[-1]
        for i in reversed(range(len(choices) - 1)):
            made = F.when(F.col(column) == i, choices[i]).otherwise(made)
        return made

    racks, first, number = [], [], 0
    for g, region in enumerate(tree.weights):
        racks.append(_choice(name, [(f"g{g}r{r}", sum(rack)) for r, rack in enumerate(region)]) + F.lit(len(first)))
        for rack in region:
            first.append((g, number, rack))
            number += len(rack)
    df = df.withColumn("__rack", per("__region", racks))
    # a rack's position in its region names its leaves
    where = [r for region in tree.weights for r in range(len(region))]
    leaves = [_choice(name, [(f"g{g}r{where[k]}s{s}", w) for s, w in enumerate(rack)]) + F.lit(start) for k, (g, start, rack) in enumerate(first)]
    return df.withColumn(out, per("__rack", leaves).cast("int")).drop("__region", "__rack")


def count_rows(df: DataFrame, count: str = "__n") -> DataFrame:
    """The distinct rows of ``df`` and how often each is there."""
    return df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias(count))


def add_slots(counted: DataFrame, shard: str = "shard", slot: str = "slot", count: str = "__n", buckets: int = 1024) -> DataFrame:
    """The rows that ``count_rows`` counted, each as often as it was there, with a gapless number from 0 within each shard; columns are small and can be sorted."""
    columns = [f"`{c}`" for c in counted.columns if c != count]
    # dealt once, for the sums and for the numbers
    dealt = counted.withColumn("__bucket", F.pmod(F.xxhash64(*[c for c in columns if c != f"`{shard}`"]), F.lit(buckets)).cast("int")).repartition(shard, "__bucket")
    sums = dealt.groupBy(shard, "__bucket").agg(F.sum(count).alias("n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # shards x buckets rows at most, by construction
    firsts = F.broadcast(sums.select(shard, "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first")))
    within = Window.partitionBy(shard, "__bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__before", F.coalesce(F.sum(count).over(within), F.lit(0))).join(firsts, [shard, "__bucket"])
    return placed.select(*columns, F.explode(F.expr(f"sequence(__first + __before, __first + __before + `{count}` - 1)")).alias(slot))


def shard_documents(documents: DataFrame, tree: Tree | None = None, key: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard); texts are read once and never shuffled."""
    tree = tree or Tree.even()
    data = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = count_rows(documents.select(F.col(f"`{key}`"), (F.octet_length(data) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(data, "UTF-8")).alias("text_crc32")))
    numbered = add_slots(assign_shard(rows, tree, key), buckets=buckets)
    return assign_shard(numbered, tree.grown(), key, "grown_shard").select(f"`{key}`", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
