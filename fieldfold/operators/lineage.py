"""Cutting the lineage of iterative steps so that it survives lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; on a
    cluster it is an error, as executors would write to their own disks.

    Spark would carry its estimate of the size over. A join's is the product of its sides', so in rounds the digits of that
    number double with each join, until planning takes minutes and the driver's memory: the rows come back without one."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="fieldfold-cp-")
            atexit.register(shutil.rmtree, _own[sc.applicationId], True)
        sc.setCheckpointDir("file://" + _own[sc.applicationId])
    cut = df.checkpoint()._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(cut.queryExecution().toRdd(), cut.schema(), False), df.sparkSession)
