"""What tasks need of a session: a package that Python workers can find, and a folder that all share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def is_local(spark: SparkSession) -> bool:
    """True for a session whose tasks run in the driver's own process and machine."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def reach_package(spark: SparkSession | None) -> None:
    """Lets the workers of a local session find this package, which may only be on the driver's path.

    A cluster has it installed or gets it with ``--py-files``; nothing is changed there.
    """
    if spark is not None and is_local(spark):
        here, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        if here not in environment.get("PYTHONPATH", "").split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), here]))


#: Arrow batches of Python tasks, where the session sets none of its own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def reach_in_small_batches(spark: SparkSession | None) -> None:
    """:func:`reach_package`, for workers that get whole texts: a batch is held several times, beside what is made of it. What the session sets itself stays."""
    for name, value in BATCHES.items():
        if spark is not None and spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    reach_package(spark)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session, as in tests, gets a folder of this machine where that is unset; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder as Parquet and reread."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def written_and_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, object]]:
    """:func:`written`, with aggregates of its rows that the job which writes them takes on the way."""
    seen = Observation()
    rows = written(df.observe(seen, *(c.alias(name) for name, c in counts.items())))
    return rows, dict(seen.get)
