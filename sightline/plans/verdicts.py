"""Outcomes of a resolved cohort by review verdict: medians, win rates, spreads and thirds of the defensive score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranking, stats
from sightline.functions.scalars import finite, half_even

# Verdicts and the groups that are compared.
VERDICTS = ("clear", "caution", "avoid", "not_reviewed", "validation_failed")
GROUPS = {"flagged": ("caution", "avoid"), "rest": ("clear", "caution")}
JUDGED = ("clear", "caution", "avoid")


def reviewed_outcomes(resolved: DataFrame, reviews: DataFrame) -> DataFrame:
    """horizon, ticker, verdict, defensive, discount, excess of reviewed names that a horizon resolved.

    A review without a verdict counts under its status. Names without a review, or without a finite excess, count nowhere;
    of a repeated review one row stays (``ranking.first_rows``).
    """
    one = ranking.first_rows(reviews.where("ticker is not null").select(
        "ticker", F.coalesce("verdict", "status").alias("verdict"), finite("defensive").alias("defensive"), "discount"), "ticker")
    rows = resolved.where("status = 'resolved'").select("horizon", "ticker", finite("excess_return_percent").alias("excess"))
    return rows.where("excess is not null").join(one, "ticker")


def outside_cohort(reviews: DataFrame, members: DataFrame) -> DataFrame:
    """Reviewed tickers that the cohort does not hold."""
    return reviews.where("ticker is not null").select("ticker").distinct().join(members.select("ticker").distinct(), "ticker", "left_anti")


def _tags() -> Column:
    """Groups of a row: its verdict, what that belongs to, and whether a discount was explained."""
    belongs = [F.when(F.col("verdict").isin(*verdicts), F.lit(name)) for name, verdicts in GROUPS.items()]
    return F.array_compact(F.array(F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")), *belongs,
                                   F.when(F.col("discount") == "no", F.lit("unexplained")), F.when(F.col("discount") == "yes", F.lit("explained"))))


def _medians(rows: DataFrame, by: list[str]) -> DataFrame:
    tagged = rows.select(*by, "excess", F.explode(_tags()).alias("group"))
    wins = F.sum(F.when(F.col("excess") > 0, F.col("n")).otherwise(0))
    return stats.quantiles(tagged, [*by, "group"], "excess", {"median": 0.5}, extra=[F.sum("n").alias("resolved"), wins.alias("wins")])


def verdict_outcomes(rows: DataFrame) -> DataFrame:
    """horizon, group, resolved, median_excess_percent, win_rate_percent; all groups are taken in one pass."""
    return _medians(rows, ["horizon"]).select("horizon", "group", "resolved", half_even("median", 2).alias("median_excess_percent"),
                                              half_even(F.col("wins") * 100.0 / F.col("resolved"), 2).alias("win_rate_percent"))


def _spreads(medians: DataFrame, by: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    of = lambda group: F.max(F.when(F.col("group") == group, F.col("median")))
    return medians.groupBy(*by).agg(*[half_even(of(a) - of(b), 2).alias(name) for name, (a, b) in pairs.items()])


def verdict_spreads(rows: DataFrame) -> DataFrame:
    """Differences of group medians per horizon, null where a side has no names. The first is the tested one."""
    return _spreads(_medians(rows, ["horizon"]), ["horizon"], {
        "rest_minus_avoid": ("rest", "avoid"), "clear_minus_flagged": ("clear", "flagged"), "unexplained_minus_explained": ("unexplained", "explained")})


def defensive_thirds(rows: DataFrame) -> DataFrame:
    """horizon, third (1 least defensive), names, rest_minus_avoid, where at least three judged names carry a score."""
    scored = rows.where(F.col("verdict").isin(*JUDGED) & F.col("defensive").isNotNull())
    sizes = scored.groupBy("horizon").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    placed = ranking.positions(scored, ["horizon"], [F.col("defensive"), F.col("ticker")], name="place")
    parts = ranking.join_groups(placed, sizes, ["horizon"]).withColumn("third", F.ceil(F.col("place") * 3 / F.col("size")).cast("int"))
    names = parts.groupBy("horizon", "third").agg(F.count(F.lit(1)).alias("names"))
    return names.join(_spreads(_medians(parts, ["horizon", "third"]), ["horizon", "third"], {"rest_minus_avoid": ("rest", "avoid")}), ["horizon", "third"])


def screened(rows: DataFrame) -> DataFrame:
    """Names that passed the screen, carry both frozen scores and were resolved: both orders are measured on the same names."""
    both = finite("score_defensive").isNotNull() & finite("score_v3").isNotNull() & finite("excess").isNotNull()
    return rows.where((F.col("screen_status") == "passes") & both).select("horizon", "ticker", "score_defensive", "score_v3", "excess")


def screen_correlations(rows: DataFrame, minimum: int = 50) -> DataFrame:
    """horizon, resolved, ic_defensive, ic_v3 and their difference, over ``screened`` rows; null below ``minimum`` names."""
    one = lambda score, name: stats.rank_correlation(rows, ["horizon"], score, "excess", minimum=minimum, name=name)
    both = one("score_defensive", "d").join(one("score_v3", "v").drop("pairs"), "horizon")
    d, v = half_even("d", 4), half_even("v", 4)
    return both.select("horizon", F.col("pairs").alias("resolved"), d.alias("ic_defensive"), v.alias("ic_v3"), half_even(d - v, 4).alias("defensive_minus_v3"))


def screen_terciles(rows: DataFrame, minimum: int = 50) -> DataFrame:
    """horizon, tercile (1 least defensive), resolved, median and win rate of ``screened`` rows; none below ``minimum`` names."""
    sizes = rows.groupBy("horizon").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= minimum)
    placed = ranking.positions(rows, ["horizon"], [F.col("score_defensive"), F.col("ticker")], name="place")
    parts = ranking.join_groups(placed, sizes, ["horizon"]).withColumn("tercile", ranking.floor_bucket(F.col("place"), F.col("size"), 3) + 1)
    wins = F.sum(F.when(F.col("excess") > 0, F.col("n")).otherwise(0))
    found = stats.quantiles(parts, ["horizon", "tercile"], "excess", {"median": 0.5}, extra=[F.sum("n").alias("resolved"), wins.alias("wins")])
    return found.select("horizon", "tercile", "resolved", half_even("median", 2).alias("median_excess_percent"), half_even(F.col("wins") * 100.0 / F.col("resolved"), 2).alias("win_rate_percent"))
