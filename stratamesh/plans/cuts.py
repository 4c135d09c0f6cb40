"""Cutting lineage in driver loops."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the folder that the session's spark.checkpoint.dir names (one of our own only where it is unset)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "stratamesh-checkpoints"))
    return df.checkpoint()
