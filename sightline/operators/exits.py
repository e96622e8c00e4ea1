"""Delisted companies: candidates, exit types, monthly rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.scalars import half_even

MERGER_FORMS = ("DEFM14A", "DEFM14C", "PREM14A", "SC 14D9", "SC TO-T", "SC 13E3")


def delisted_candidates(notices: DataFrame, current: DataFrame, start: str, end: str) -> DataFrame:
    """Filers with a delisting notice in the window that are not listed now, with their exit date."""
    inside = notices.where(F.col("filed").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.join(current.select("cik"), "cik", "left_anti").groupBy("cik").agg(
        F.max("filed").alias("exit_date"), F.count(F.lit(1)).alias("notices"))


def classify_exits(exits: DataFrame, filings: DataFrame) -> DataFrame:
    """bankruptcy, acquired, delisted_noncompliance or other, from filings near the exit.

    ``filings``: cik, form, filed, items (array of strings).
    """
    joined = exits.join(filings, "cik", "left")
    gap = F.datediff("filed", "exit_date")

    def any_of(condition, low: int, high: int):
        return F.coalesce(F.max((condition & gap.between(low, high)).cast("int")), F.lit(0)) == 1

    def item(code: str):
        return F.array_contains("items", code)

    flags = joined.groupBy(*exits.columns).agg(
        any_of(item("1.03"), -730, 60).alias("b"), any_of(F.col("form").isin(*MERGER_FORMS), -365, 30).alias("m"),
        any_of(item("5.01"), -60, 30).alias("c"), any_of(item("3.01"), -365, 0).alias("n"))
    return flags.withColumn("exit_type", F.when(F.col("b"), "bankruptcy").when(F.col("m") | F.col("c"), "acquired")
                            .when(F.col("n"), "delisted_noncompliance").otherwise("other")).drop("b", "m", "c", "n")


def monthly_rates(dead: DataFrame, scenario: Mapping[str, float]) -> DataFrame:
    """Lifetime return of the exit type spread evenly over the company's months (one row per month)."""
    months = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    lifetime = F.element_at(F.create_map(*[F.lit(x) for pair in scenario.items() for x in pair]), F.col("exit_type"))
    return dead.withColumn("monthly_rate", half_even((F.pow(1.0 + lifetime, 1.0 / months) - 1.0) * 100.0, 6))
