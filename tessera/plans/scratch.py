"""Cutting long plans: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet under spark.checkpoint.dir (a temporary folder where that is unset) and reads it back."""
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/tessera-{context.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
