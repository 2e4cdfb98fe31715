"""Where plans are cut: checkpoints and written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


#: Called with each frame that is about to be cut.
WATCHERS: list[Callable[[DataFrame], None]] = []


def cut(df: DataFrame) -> DataFrame:
    """`df` checkpointed: a lost executor costs no recomputation, and the plan does not grow."""
    for watch in WATCHERS:
        watch(df)
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
