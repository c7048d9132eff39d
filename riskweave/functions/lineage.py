"""Cut a plan where it is used several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder of spark.checkpoint.dir and read it from there. Where the session names none, a
    temporary one serves on a local master, whose threads all see it; on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="riskweave-checkpoint-"))
    return df.checkpoint(eager=True)
