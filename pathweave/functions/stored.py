"""Tables whose lineage is cut in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session that names none gets one of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-")
        folder = _own[app]
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, so later steps neither recompute nor plan it again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()
