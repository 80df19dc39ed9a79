"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``; only where it is unset and there are no other machines
    (local tests) a temporary folder is used, and an error is raised on a cluster.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()
