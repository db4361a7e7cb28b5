"""Shared scratch space for tables that outlive a job."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint directory.

    Only a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} is not set; name a folder all executors share")
        root = tempfile.mkdtemp(prefix="gatelake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
