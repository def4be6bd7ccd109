"""Tables that more than one branch of a plan reads, kept where driver and executors both see them."""

from __future__ import annotations

import tempfile
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_SETTING = Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors are this very machine (``local[...]``) gets a temporary folder; on a cluster none would do, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    with _SETTING:  # queries of one session may run side by side
        if context.getCheckpointDir() is None:
            if not configured and not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="cadenza-checkpoint-"))
    return configured or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and read it from reliable storage from here on, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
