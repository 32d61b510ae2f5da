"""Shared-folder and session helpers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting uses one beside its warehouse.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_growthcast"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return (named or sc.getCheckpointDir()).rstrip("/")


def new_table_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here.

    The copy survives lost executors and gives later scans Parquet pruning. The
    shuffle files that the writing took are dropped when it is done. With
    ``batch_bytes``, what goes to Python comes in Arrow batches of about that size at
    most (or of one row): both sides hold a batch for each task.
    """
    spark, path = df.sparkSession, new_table_path(df.sparkSession, label)
    before = {CLEANUP: spark.conf.get(CLEANUP, "false")}
    spark.conf.set(CLEANUP, "true")
    if batch_bytes:
        before[BATCH_BYTES] = spark.conf.get(BATCH_BYTES)
        spark.conf.set(BATCH_BYTES, str(batch_bytes))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
