"""Cutting the lineage of iterative operators through the shared folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder (``spark.checkpoint.dir``) and read from there. Only a local master gets a
    folder of its own where none is set: on a cluster its executors wouldn't share it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if given is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="vellum-checkpoints-"))
    return df.checkpoint()
