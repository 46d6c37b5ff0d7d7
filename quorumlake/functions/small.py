"""The shared folder."""

from __future__ import annotations

import tempfile


def checkpoints(spark) -> str:
    """The shared folder of spark.checkpoint.dir, which is set up for checkpoints. Only on one machine (tests) is a folder made where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quorumlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")
