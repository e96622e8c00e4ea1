"""Session settings, stored stages and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "sightline", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings the operators assume (AQE on, UTC, ANSI SQL)."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def recovery_directory(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a folder on this machine.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    context.setCheckpointDir(configured)
    return configured


#: Spark removes the shuffle files of an execution when it ends, if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, free: bool = False, codec: str | None = None) -> DataFrame:
    """Write a stage as Parquet in the shared checkpoint folder and read it back.

    Unlike ``checkpoint`` the copy is columnar, so later branches read only their columns. A lost executor costs a
    re-read: no lineage and no machine-local file is needed. ``free``: the shuffle files of the stage are removed once it is
    written, as nothing reads them again. ``codec``: another compression than the session's.
    """
    spark = frame.sparkSession
    path = f"{recovery_directory(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    try:
        if free:
            spark.conf.set(CLEANUP, "true")
        frame.write.parquet(path, compression=codec)
    finally:
        if free:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def cut(frame: DataFrame) -> DataFrame:
    """Materialise a stage that several branches read, in the shared folder.

    Later branches read one stored copy: nothing is recomputed, float sums keep
    one value in every branch, and a lost executor costs a re-read only. The
    shuffle files of the stage go once it is stored.
    """
    return stored(frame, free=True)
