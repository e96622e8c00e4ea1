"""Indexed runs, reports, flat tables and cohorts that are written once.

Paths name folders that every executor reaches. Each writer gives the same files when it runs again on the same rows,
so a job that was lost half-way is repeated as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_runs(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Replace the rows of the runs in ``rows``, and only those, in the indexed history.

    Dynamic partition overwrite: indexing one run twice leaves one copy. Rows of a run are dealt by a hash of the
    whole row, so a large run is written by many tasks and not by one.
    """
    spread = rows.repartition(F.col(run), F.pmod(F.xxhash64(*[F.col(name) for name in rows.columns]), F.lit(16)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def score_report(rows: DataFrame, path: str, score: Column, ties: Sequence[Column]) -> None:
    """All rows as CSV, best score first, nulls last; a range sort, so any number of rows."""
    rows.orderBy(score.desc_nulls_last(), *ties).write.mode("overwrite").option("header", "true").csv(path)


def observations(rows: DataFrame, path: str) -> None:
    """Backtest observations as compressed CSV."""
    rows.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)


def flat_periods(periods: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per period and measure; measures that are null are left out."""
    entries = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value")) for name in measures]))
    return periods.select(*keys, entries.alias("x")).select(*keys, "x.*").where(F.col("value").isNotNull())


def freeze(cohort: DataFrame, folder: str, cohort_id: str) -> str:
    """Write a cohort once; a second cohort with the same id is refused. Returns its path."""
    path = f"{folder}/cohort_id={cohort_id}"
    try:
        cohort.write.mode("errorifexists").parquet(path)
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            raise FileExistsError(f"cohort {cohort_id} is frozen already") from error
        raise
    return path


def resolved_rows(resolution: DataFrame, status: str = "status", pending: str = "pending") -> DataFrame:
    """The resolved horizons of a cohort, without those that are still open."""
    return resolution.where(~F.col(status).eqNullSafe(pending))
