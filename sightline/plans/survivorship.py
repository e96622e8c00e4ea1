"""How much could companies that vanished change a backtest? Observed and imputed returns in one scenario dimension."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.scalars import half_even
from sightline.operators import scoring
from sightline.session import cut

#: Assumed lifetime returns of a vanished company by exit type.
SCENARIOS: Mapping[str, Mapping[str, float]] = {
    "mild": {"bankruptcy": -0.80, "delisted_noncompliance": -0.50, "other": -0.30, "acquired": 0.20},
    "central": {"bankruptcy": -0.95, "delisted_noncompliance": -0.75, "other": -0.50, "acquired": 0.10},
    "severe": {"bankruptcy": -0.999, "delisted_noncompliance": -0.90, "other": -0.70, "acquired": 0.0},
}
GROUPS = ("filter_excluded", "scored", "never_scored")
OBSERVED, UNIVERSE = "observed", "universe"


def observed_group(score: str = "score_v3", excluded: str = "score_v3_excluded") -> Column:
    """What the backtest did with a row: its filters took it out, it was scored, or neither."""
    return F.when(F.coalesce(F.col(excluded), F.lit(False)), GROUPS[0]).when(F.col(score).isNotNull(), GROUPS[1]).otherwise(GROUPS[2])


def dead_groups(observed: DataFrame, dead: DataFrame, model: Mapping, sector: str | None = None) -> DataFrame:
    """Adds ``group`` to dead(period, ticker, exit_type, signals): what the model would have done in that month's cross-section.

    Vanished companies have no prices, so no score; the filters read fundamentals only and are applied in the cross-section
    of observed and vanished names. A name that they keep counts as scored if it had revenue and cash figures.
    """
    used = [name for name in dict.fromkeys([*model["signals"], *[rule[0] for rule in model["exclusions"]]]) if name in observed.columns or name in dead.columns]
    extra = [sector] if sector else []
    narrow = lambda rows, label: rows.select("period", F.concat(F.lit(label), F.col("ticker").cast("string")).alias("key"),
                                             *[name for name in [*used, *extra] if name in rows.columns])
    both = narrow(observed, "live:").unionByName(narrow(dead, "dead:"), allowMissingColumns=True)
    scored = scoring.score_cross_section(cut(both), ["period"], "key", model, sector=sector).where("startswith(key, 'dead:')").select(
        "period", "key", F.col(f"{model['prefix']}_excluded").alias("__out"))
    held = dead.withColumn("key", F.concat(F.lit("dead:"), F.col("ticker").cast("string"))).join(scored, ["period", "key"], "left").drop("key")
    known = F.col("pit_revenue_ttm").isNotNull() & F.col("pit_cash").isNotNull()
    return held.withColumn("group", F.when(F.col("__out"), GROUPS[0]).when(known, GROUPS[1]).otherwise(GROUPS[2])).drop("__out")


def in_windows(rows: DataFrame, windows: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rows with the ``window`` whose first and last period hold theirs; others go. Windows may overlap."""
    spans = F.array_compact(F.array(*[F.when(F.col("period").between(*span), F.lit(name)) for name, span in windows.items()]))
    return rows.withColumn("window", F.explode(spans))


def survivorship_panel(observations: DataFrame, dead: DataFrame, model: Mapping, windows: Mapping[str, tuple[str, str]],
                       minimum_cross_section: int = 50, minimum_scored: int = 100, sector: str | None = None) -> DataFrame:
    """window, period, ticker, group, exit_type and r of observed rows (exit_type null) and vanished ones (r null).

    Only months with enough rows and enough scored ones count. Rows without both returns are not observed.
    """
    live = cut(observations.dropna(subset=["return_1M", "benchmark_return_1M"]).withColumn("group", observed_group()))
    enough = live.groupBy("period").agg(F.count("*").alias("n"), F.sum((F.col("group") == "scored").cast("long")).alias("scored")).where(
        (F.col("n") >= minimum_cross_section) & (F.col("scored") >= minimum_scored)).select("period")
    gone = dead_groups(live, dead, model, sector)
    columns = ["period", F.col("ticker").cast("string").alias("ticker"), "group"]
    both = live.select(*columns, F.lit(None).cast("string").alias("exit_type"), F.col("return_1M").cast("double").alias("r")).union(
        gone.select(*columns, "exit_type", F.lit(None).cast("double")))
    return in_windows(both.join(enough, "period"), windows)


def compounded_bounds(panel: DataFrame, scenarios: Mapping[str, Mapping[str, float]] = SCENARIOS) -> DataFrame:
    """scenario, window, group, months, compounded_percent: the monthly mean returns of each group compounded.

    Scenario ``observed`` holds the observed rows alone; every other one adds every vanished name with the lifetime return of
    its exit type, spread evenly over its months of the window. Group ``universe`` holds all three. An exit type that the
    scenario does not name has no return.
    """
    live = F.col("exit_type").isNull()
    months = F.count(F.when(~live, F.lit(1))).over(Window.partitionBy("window", "ticker"))
    choices = F.array(F.struct(F.lit(OBSERVED).alias("scenario"), F.when(live, F.col("r")).alias("r")), *[
        F.struct(F.lit(name).alias("scenario"), F.when(live, F.col("r")).otherwise(
            (F.pow(1.0 + F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("exit_type")), 1.0 / F.col("months")) - 1.0) * 100.0).alias("r"))
        for name, rates in scenarios.items()])
    rows = panel.withColumn("months", months).withColumn("c", F.explode(choices)).withColumn("group", F.explode(F.array("group", F.lit(UNIVERSE))))
    monthly = rows.where("c.r is not null").groupBy("c.scenario", "window", "group", "period").agg(F.avg("c.r").alias("mean"))
    return monthly.groupBy("scenario", "window", "group").agg(
        F.count("*").alias("months"), ((F.product(1.0 + F.col("mean") / 100.0) - 1.0) * 100.0).alias("compounded_percent"))


def group_counts(panel: DataFrame) -> DataFrame:
    """Observed and vanished rows a month, and the share of the vanished, per window and group."""
    months = panel.where("exit_type is null").groupBy("window").agg(F.countDistinct("period").alias("months"))
    counts = panel.groupBy("window", "group").agg(F.count(F.when(F.col("exit_type").isNull(), F.lit(1))).alias("live"), F.count("exit_type").alias("dead"))
    return counts.join(F.broadcast(months), "window").select(  # one row a window
        "window", "group", half_even(F.col("live") / F.col("months"), 1).alias("observed_per_month"), half_even(F.col("dead") / F.col("months"), 1).alias("dead_per_month"),
        half_even(100.0 * F.col("dead") / (F.col("live") + F.col("dead")), 2).alias("dead_share_percent"))


def exit_types(panel: DataFrame) -> DataFrame:
    """Vanished companies of each exit type per window; a company counts once."""
    return panel.where("exit_type is not null").groupBy("window", "exit_type").agg(F.countDistinct("ticker").alias("companies"))

