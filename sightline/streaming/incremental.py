"""Incremental loads with Structured Streaming: filings that are not held yet, horizons that became due.

Each micro-batch goes through ``foreachBatch`` and an anti join against what is held, so a batch that is repeated after a
failure adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def held_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows written so far; none before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def append_new(batch: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows of a batch whose keys are not held: of equal keys the smallest row, null keys like any other."""
    rest = [name for name in batch.columns if name not in keys]
    rank = F.struct(*[F.col(name) for name in rest]) if rest else F.struct(F.lit(0))
    single = batch.groupBy(*keys).agg(F.min(rank).alias("x"))
    single = single.select(*keys, *[F.col(f"x.{name}").alias(name) for name in rest]).select(*batch.columns)
    held = held_rows(batch.sparkSession, path, batch).select(*[F.col(name).alias(f"__{name}") for name in keys]).distinct()
    same = [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in keys]
    single.join(held, same, "left_anti").write.mode("append").parquet(path)


def load_available(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str) -> None:
    """Process what the stream holds now, then stop; the checkpoint remembers how far it came."""
    query = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, keys)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
