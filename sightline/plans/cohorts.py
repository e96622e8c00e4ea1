"""Frozen cohorts and their resolution against later prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import ranking, stats
from sightline.functions.scalars import half_even, ratio
from sightline.operators.asof import close_on_or_before


def classify_queue(queue: DataFrame, settings: Mapping = C.COHORT) -> DataFrame:
    """Cohort label of every queue row: top names, quintiles, then why a row has no score.

    The scored tier leads the queue, so ``research_rank`` is its position.
    """
    scored = F.col("ranking_basis") == "score_v3"
    totals = queue.where(scored).agg(F.count(F.lit(1)).alias("__n")).withColumn("__g", F.lit(0))
    joined = queue.withColumn("__g", F.lit(0)).join(F.broadcast(totals), "__g").drop("__g")
    quintile = settings["quantiles"] - ranking.floor_bucket(F.col("research_rank"), F.col("__n"), settings["quantiles"])
    basis = F.col("ranking_basis")
    label = (
        F.when(scored & (F.col("research_rank") <= settings["top_n"]), "queue_top_n")
        .when(scored, F.concat(F.lit("v3_quintile_"), quintile.cast("string")))
        .when(basis.isin("duplicate_listing", "below_liquidity_floor", "investment_fund"), basis)
        .when(F.coalesce("score_v3_excluded", F.lit(False)), "v3_excluded").when(basis == "score_v2", "v2_fallback")
        .otherwise("official_fallback")
    )
    return joined.withColumn("classification", label).drop("__n")


def freeze(members: DataFrame, baseline: str = "baseline", horizons: Mapping[str, int] = C.COHORT_HORIZON_DAYS) -> DataFrame:
    """One row per (member, horizon) with the date it becomes eligible."""
    entries = F.explode(F.array(*[
        F.struct(F.lit(name).alias("horizon"), F.lit(days).alias("days")) for name, days in horizons.items()]))
    return members.withColumn("h", entries).withColumn("horizon", F.col("h.horizon")).withColumn(
        "eligible", F.date_add(baseline, F.col("h.days"))).drop("h")


def resolve(members: DataFrame, prices: DataFrame, bench: DataFrame, as_of, tolerance: int = C.COHORT["staleness_days"]) -> DataFrame:
    """Status and excess return of each (member, horizon): pending, unresolved, stale, without benchmark, resolved.

    ``members``: ticker, benchmark, baseline, horizon, eligible. A vanished price
    stays visible as unresolved; it is never dropped.
    """
    pending = F.col("eligible") > F.lit(as_of).cast("date")
    asked = members.withColumn("__due", F.when(~pending, F.col("eligible")))
    last = prices.groupBy("ticker").agg(F.max("d").alias("last_price_date"))
    found = asked.join(last, "ticker", "left")
    for key, table, prefix in (("ticker", prices, "t"), ("benchmark", bench, "b")):
        for target, name in (("baseline", "anchor"), ("__due", "final")):
            found = close_on_or_before(found, table, target, tolerance, key=key, prefix=f"{prefix}_{name}_")
    ticker_return = (F.col("t_final_close") / F.col("t_anchor_close") - 1.0) * 100.0
    market_return = (F.col("b_final_close") / F.col("b_anchor_close") - 1.0) * 100.0
    status = (
        F.when(pending, "pending").when(F.col("last_price_date").isNull() | F.col("t_anchor_close").isNull(), "unresolved")
        .when(F.col("t_final_close").isNull(), "unresolved_stale").when(market_return.isNull(), "resolved_without_benchmark")
        .otherwise("resolved")
    )
    return found.select(
        *members.columns, status.alias("status"), half_even(ticker_return, 4).alias("ticker_return_percent"),
        half_even(market_return, 4).alias("benchmark_return_percent"),
        half_even(ticker_return - market_return, 4).alias("excess_return_percent"))


def cohort_summary(resolved: DataFrame, by: list[str]) -> DataFrame:
    """Counts by status, resolution share and outcome figures per group."""
    due = resolved.where(F.col("status") != "pending")
    is_resolved = F.col("status").isin("resolved", "resolved_without_benchmark")
    counts = due.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidates"), F.sum((F.col("status") == "resolved").cast("bigint")).alias("resolved"),
        F.sum(F.col("status").startswith("unresolved").cast("bigint")).alias("unresolved"),
        half_even(ratio(F.sum(is_resolved.cast("bigint")), F.count(F.lit(1))) * 100, 2).alias("resolution_percent"))
    measured = due.where(F.col("excess_return_percent").isNotNull())
    outcome = stats.outcome_summary(measured, by, "excess_return_percent").select(
        *by, half_even("median", 4).alias("median_excess"), half_even("mean", 4).alias("mean_excess"),
        half_even("win_rate", 4).alias("win_rate"))
    trimmed = stats.trimmed_mean(measured, by, "excess_return_percent").withColumn("trimmed_mean", half_even("trimmed_mean", 4))
    joined = ranking.join_groups(counts, outcome, by, "left")
    return ranking.join_groups(joined, trimmed, by, "left")


FIGURES = ("median_excess", "mean_excess", "trimmed_mean", "win_rate")


def selected_minus_control(resolved: DataFrame, label: str, selected: Sequence[str], control: Sequence[str], by: Sequence[str],
                           minimum: int = C.COHORT["minimum_size"]) -> DataFrame:
    """Per group the figures of the selected labels less those of the control labels, and whether both are large enough.

    A side without resolved names leaves its figures, and so the differences, null.
    """
    side = F.when(F.col(label).isin(*selected), "selected").when(F.col(label).isin(*control), "control")
    summary = cohort_summary(resolved.withColumn("__side", side).where("__side is not null"), [*by, "__side"])

    def part(name: str) -> DataFrame:
        return summary.where(F.col("__side") == name).select(
            *by, F.col("resolved").alias(f"{name}_resolved"), *[F.col(x).alias(f"__{name}_{x}") for x in FIGURES])

    both = part("selected").join(part("control"), list(by), "full")
    counts = {f"{name}_resolved": F.coalesce(f"{name}_resolved", F.lit(0)) for name in ("selected", "control")}
    return both.withColumns(counts).select(
        *by, *counts, *[half_even(F.col(f"__selected_{x}") - F.col(f"__control_{x}"), 2).alias(f"{x}_difference") for x in FIGURES],
        ((F.col("selected_resolved") >= minimum) & (F.col("control_resolved") >= minimum)).alias("comparable"))


def due_horizons(members: DataFrame, resolved: DataFrame, as_of) -> DataFrame:
    """Eligible horizons that no earlier resolution holds."""
    return members.where(F.col("eligible") <= F.lit(as_of).cast("date")).join(
        resolved.select("ticker", "horizon"), ["ticker", "horizon"], "left_anti")
