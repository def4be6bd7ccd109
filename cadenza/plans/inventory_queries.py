"""Inventories of names and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.expr import as_percent
from cadenza.plans.registry import query, rounded
from cadenza.sources import midi
from cadenza.sources.tables import table


@query(
    r"""WITH p AS (SELECT regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[^./]+)$', 1) AS ext FROM pages), c AS (SELECT CASE WHEN coalesce(ext, '') = '' THEN '(no extension)' ELSE lower(ext) END AS ext, count(*) AS n FROM p GROUP BY 1),
  r AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, ext) AS INT) AS rank FROM c), g AS (SELECT CAST(least(rank, 6) AS INT) AS rank, CASE WHEN rank <= 5 THEN ext ELSE 'others' END AS ext, sum(n) AS n FROM r GROUP BY 1, 2)
  SELECT ext, CAST(n AS BIGINT) AS n, round(100.0 * n / sum(n) OVER (), 4)::DOUBLE AS percent, rank FROM g"""
)
def file_inventory_P(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return rounded(midi.inventory(paths), "percent")


@query("SELECT source, count(*) AS n, printf('%.2f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS share FROM documents GROUP BY source")
def share_report_D(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", as_percent(F.col("n") / F.sum("n").over(Window.partitionBy())))
