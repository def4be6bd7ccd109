"""Helpers shared by the corpus operators: table access, row identity and bounded pieces of batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.shared import cut, shared_dir  # noqa: F401

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, wherever Spark keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Views of at most ``rows`` rows: Spark bounds a batch by bytes, and this what is turned into Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def row_identity(df: DataFrame, columns: list[str] | None = None) -> tuple[Column, Column]:
    """128 bits that tell rows of different content apart, as two long columns; the same in every run, so rows can be matched again after a lost task."""
    def plain(name: str, kind: str) -> Column:
        # maps and variants have no hash of their own
        return F.to_json(F.struct(F.col(f"`{name}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{name}`")

    each = [x for n, t in df.dtypes if columns is None or n in columns for x in (F.col(f"`{n}`").isNull(), plain(n, t))]
    return F.xxhash64(F.lit(0), *each), F.xxhash64(F.lit(1), *each)


def text_or_empty(column: Column | str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
