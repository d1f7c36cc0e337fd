"""Folders for queries that write."""

from __future__ import annotations

import tempfile
import uuid

from leakatlas.sources.checkpoints import checkpoint_folder


def new_folder(spark, name: str) -> str:
    """A new folder of the shared one; only a session without that setting, on one machine, gets a temporary one."""
    root = checkpoint_folder(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix=f"run-{name}-")
    return f"{root}/{name}-{uuid.uuid4().hex}"
