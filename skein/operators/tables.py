"""Tables that are computed once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the folder that spark.checkpoint.dir names: plans behind it start from a scan, and a lost executor takes nothing
    with it. Only in local mode (tests) may the setting be missing; then a temporary folder serves."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        there = sc.getConf().get("spark.checkpoint.dir")
        if not there and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it names the folder that the driver and all executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="skein-checkpoints-"))
    return df.checkpoint()
