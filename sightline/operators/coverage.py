"""Run summaries: counts, factor coverage, confidence buckets, the official score gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import stats
from sightline.functions.ranking import first_rows, join_groups
from sightline.functions.scalars import half_even, ratio
from sightline.operators import rules

BUCKETS = ("0-24", "25-49", "50-74", "75-99", "100")


def factor_rows(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long factor table of a frame with a ``factors`` array."""
    return scored.select(*keys, F.explode("factors").alias("f")).select(*keys, F.col("f.name").alias("factor"), *[
        F.col(f"f.{name}") for name in ("raw_value", "source_value", "points", "max_points", "available", "applicable", "data_quality")])


def official_score(rows: DataFrame, minimum_sessions: int = C.LOOKBACKS["minimum_price_history_days"]) -> DataFrame:
    """Gates, then technical points plus size and sector points. Failed rows score 0."""
    cap, band = F.col("market_cap"), C.MARKET_CAP
    failure = (
        F.when(F.coalesce(F.col("sessions") < minimum_sessions, F.lit(True)), "Insufficient price history")
        .when(cap.isNull(), "Missing market cap")
        .when((cap < band["minimum"]) | (cap > band["maximum"]), "Outside market cap range")
    )
    total = F.col("technical_score") + rules.market_cap_points(cap) + rules.sector_points(F.col("sector"))
    return rows.withColumn("failure", failure).withColumns({
        "status": F.when(F.col("failure").isNull(), "OK").otherwise("FAILED"),
        "discovery_score": F.when(F.col("failure").isNull(), half_even(total, 2)).otherwise(0.0),
    })


def backtest_universe(rows: DataFrame, duplicates: DataFrame | None, reason: str, order: Sequence[Column] = ()) -> DataFrame:
    """OK and FAILED rows plus those filtered for size only, the first per ticker in ``order``, duplicates removed.

    Without an order, the row with the smallest values, column by column: the same in every run.
    """
    size_only = (F.col("status") == "FILTERED") & F.coalesce(
        F.col(reason).startswith("Below minimum market cap") | F.col(reason).startswith("Above maximum market cap"), F.lit(False))
    kept = rows.where(F.col("status").isin("OK", "FAILED") | size_only).withColumn(
        "ticker", F.upper(F.trim(F.col("ticker").cast("string")))).where(F.col("ticker") != "")
    single = first_rows(kept, "ticker", order)
    return single.join(duplicates.select("ticker"), "ticker", "left_anti") if duplicates is not None else single


def factor_coverage(factors: DataFrame, dimensions: Sequence[str] = ()) -> DataFrame:
    """available / applicable per factor overall and along each dimension, in one grouping-sets pass."""
    exploded = factors.select("factor", "available", "applicable", F.explode(F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")),
        *[F.struct(F.lit(name).alias("dimension"), F.coalesce(F.col(name).cast("string"), F.lit("UNKNOWN")).alias("value"))
          for name in dimensions])).alias("d")).select("factor", "available", "applicable", "d.*")
    applicable = F.sum(F.col("applicable").cast("bigint"))
    available = F.sum(F.col("available").cast("bigint"))
    return exploded.groupBy("dimension", "value", "factor").agg(
        available.alias("available"), applicable.alias("applicable"), F.count(F.lit(1)).alias("total"),
    ).withColumn("percentage", F.coalesce(half_even(ratio("available", "applicable") * 100, 2), F.lit(0.0)))


def confidence_bucket(value: Column) -> Column:
    number = F.coalesce(value, F.lit(0.0))
    return (F.when(number >= 100, "100").when(number >= 75, "75-99").when(number >= 50, "50-74")
            .when(number >= 25, "25-49").otherwise("0-24"))


def confidence_buckets(rows: DataFrame, value: str) -> DataFrame:
    """Counts per bucket, empty buckets included."""
    bucket = confidence_bucket(F.col(value))
    counts = [F.sum((bucket == name).cast("bigint")).alias(name) for name in BUCKETS]
    wide = rows.agg(*counts)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("bucket"), F.coalesce(F.col(f"`{name}`"), F.lit(0)).alias("n")) for name in BUCKETS])).alias("b")).select("b.*")


def count_by(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Counts along several dimensions in one pass: (dimension, value, n)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.coalesce(value.cast("string"), F.lit("UNKNOWN")).alias("value"))
        for name, value in dimensions.items()]))
    return rows.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def failure_stage(reason: Column) -> Column:
    return F.substring_index(reason, ":", 1)


def reason_counts(rows: DataFrame, reasons: str, separator: str = "; ") -> DataFrame:
    """Counts of each text in a separated list."""
    return rows.where(F.length(reasons) > 0).select(F.explode(F.split(reasons, separator)).alias("reason")).groupBy(
        "reason").agg(F.count(F.lit(1)).alias("n"))


def factor_readiness(coverage: DataFrame, ready: float = 75.0, limited: float = 40.0) -> DataFrame:
    return coverage.withColumn("readiness", F.when(F.col("percentage") >= ready, "ready").when(
        F.col("percentage") >= limited, "limited").otherwise("shadow_only"))


def discovery_quality(rows: DataFrame, groups: Sequence[str], failed: Column, limit: float = 0.02) -> DataFrame:
    """Rows, error rate and whether it is within the limit, per run."""
    share = F.avg(F.when(failed, 1.0).otherwise(0.0))
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), half_even(share, 6).alias("error_rate"), (share <= limit).alias("passed"))


def from_median(rows: DataFrame, groups: Sequence[str], score: str, name: str = "above_median") -> DataFrame:
    """Each row's score less its group's exact median; a null group is a group."""
    medians = stats.quantiles(rows, groups, score, {"__median": 0.5})
    return join_groups(rows, medians, groups, "left").withColumn(name, half_even(F.col(score) - F.col("__median"), 3)).drop("__median")
