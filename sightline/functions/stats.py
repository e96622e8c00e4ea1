"""Exact distribution statistics from value ladders, and series tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.ranking import attach_ladder, attach_ladders, join_groups, ladder_over, value_ladder
from sightline.functions.scalars import finite, half_even


def _quantile(value: str, share: float) -> Column:
    """Linear-interpolation quantile as an aggregate over one group's ladder."""
    place = (F.col("total") - 1) * F.lit(share)

    def at(index: Column) -> Column:
        return F.max(F.when(
            (F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(value).cast("double"),
        ))

    low, high = at(F.floor(place)), at(F.ceil(place))
    return low + (high - low) * (F.max(place) - F.floor(F.max(place)))


def quantiles(frame: DataFrame, groups: Sequence[str], value: str, shares: Mapping[str, float],
              extra: Sequence[Column] = ()) -> DataFrame:
    """Exact quantiles per group; ``extra`` aggregates see value, n, below and total."""
    rungs = value_ladder(frame, groups, value)
    return rungs.groupBy(*groups).agg(
        *[_quantile(value, share).alias(name) for name, share in shares.items()], *extra,
    )


def distribution(frame: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """count, min, quartiles and max."""
    return quantiles(
        frame, groups, value, {"p25": 0.25, "median": 0.5, "p75": 0.75},
        extra=[
            F.sum("n").alias("count"),
            F.min(value).alias("minimum"),
            F.max(value).alias("maximum"),
        ],
    )


def outcome_summary(frame: DataFrame, groups: Sequence[str], value: str, tail: float = 0.02) -> DataFrame:
    """count, mean, median, winsorised mean and share of positive values in percent.

    The winsorised mean clips at the tail quantiles, then averages; it is taken
    over distinct values with their counts, so no group is ever gathered.
    """
    if not groups:
        one = frame.withColumn("__all", F.lit(0))
        return outcome_summary(one, ["__all"], value, tail).drop("__all")
    rungs = value_ladder(frame, groups, value)
    number = F.col(value)
    first = rungs.groupBy(*groups).agg(
        _quantile(value, tail).alias("__low"),
        _quantile(value, 1.0 - tail).alias("__high"),
        _quantile(value, 0.5).alias("median"),
        F.sum("n").alias("observations"),
        (F.sum(number * F.col("n")) / F.sum("n")).alias("mean"),
        (F.sum(F.when(number > 0, F.col("n")).otherwise(0)) / F.sum("n") * 100.0).alias("win_rate"),
    )
    clipped = join_groups(rungs, first, groups).groupBy(*groups).agg(
        (F.sum(F.least(F.greatest(number, F.col("__low")), F.col("__high")) * F.col("n")) / F.sum("n"))
        .alias("winsorised_mean"),
    )
    return join_groups(first, clipped, groups).drop("__low", "__high").select(
        *groups, "median", "observations", "mean", "win_rate", "winsorised_mean")


def trimmed_mean(frame: DataFrame, groups: Sequence[str], value: str, tail: float = 0.02) -> DataFrame:
    """Mean after dropping max(1, floor(tail * n)) rows at each end when n >= 3."""
    rungs = value_ladder(frame, groups, value)
    drop = F.when(F.col("total") >= 3, F.greatest(F.floor(F.col("total") * tail), F.lit(1))).otherwise(F.lit(0))
    kept = F.greatest(
        F.least(F.col("below") + F.col("n"), F.col("total") - drop) - F.greatest(F.col("below"), drop),
        F.lit(0),
    )
    return rungs.groupBy(*groups).agg(
        (F.sum(F.col(value) * kept) / F.nullif(F.sum(kept), F.lit(0))).alias("trimmed_mean"),
    )


def rank_correlation(frame: DataFrame, groups: Sequence[str], left: str, right: str, *, minimum: int = 2, name: str = "ic",
                     dealt: bool = False, extra: Sequence[Column] = ()) -> DataFrame:
    """Spearman correlation per group: pairs first, then average ranks, then Pearson.

    Groups with fewer than ``minimum`` pairs or a constant side give null. ``dealt``: see ``ranking.in_groups``; only then
    ``extra`` aggregates over all rows of a group, and a group without pairs stays.
    """
    pair = finite(left).isNotNull() & finite(right).isNotNull()
    if dealt and extra:
        pairs = frame.withColumn("__pair", pair)
    else:
        pairs = frame.where(pair).select(*groups, left, right).withColumn("__pair", F.lit(True))
    if dealt:
        for prefix, value in (("l_", left), ("r_", right)):
            n, below, _ = ladder_over([*groups, "__pair"], value)
            pairs = pairs.select("*", n.alias(prefix + "n"), below.alias(prefix + "below"))
        ranked = pairs
    elif groups:
        ranked = attach_ladders(pairs, groups, {"l_": left, "r_": right})
    else:
        ranked = attach_ladder(attach_ladder(pairs, groups, left, "l_"), groups, right, "r_")
    paired = lambda column: F.when(F.col("__pair"), column)
    left_rank = paired(F.col("l_below") + (F.col("l_n") + 1) / 2.0)
    right_rank = paired(F.col("r_below") + (F.col("r_n") + 1) / 2.0)
    a, b = paired(F.col(left)), paired(F.col(right))
    enough = (F.count(a) >= minimum) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return ranked.groupBy(*groups).agg(
        F.count(a).alias("pairs"),
        # Pearson from moments: a constant side gives null, not a division error.
        F.when(enough, F.covar_pop(left_rank, right_rank) / F.nullif(
            F.stddev_pop(left_rank) * F.stddev_pop(right_rank), F.lit(0.0))).alias(name),
        *extra,
    )


def series_summary(frame: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample deviation, t of the mean and positive share of a short series."""
    number = F.col(value)
    spread = F.stddev_samp(value)
    known = frame.where(finite(value).isNotNull())
    return known.groupBy(*groups).agg(
        F.count(value).alias("periods"),
        half_even(F.avg(value), 4).alias("mean"),
        half_even(spread, 4).alias("std"),
        half_even(F.when(spread > 0, F.avg(value) / spread * F.sqrt(F.count(value))), 2).alias("t_stat"),
        half_even(F.avg(F.when(number > 0, 1.0).otherwise(0.0)) * 100.0, 2).alias("positive_share_percent"),
    )


def newey_west(frame: DataFrame, groups: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """Mean and Newey-West t with Bartlett weights of one series per group.

    A series holds at most one row per period, so its length is bounded by the
    calendar and a window over it is small. Null when n < lags + 3.
    """
    known = frame.where(finite(value).isNotNull())
    if not groups:
        known = known.withColumn("__all", F.lit(0))
    keys = list(groups) or ["__all"]
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(order)
    centred = known.withColumn("__d", F.col(value) - F.avg(value).over(whole))
    centred = centred.select(
        *keys, F.col(value).alias("__v"), "__d",
        *[F.lag("__d", lag).over(ordered).alias(f"__d{lag}") for lag in range(1, lags + 1)],
    )
    variance = F.sum(F.col("__d") * F.col("__d"))
    for lag in range(1, lags + 1):
        weight = 2.0 * (1.0 - lag / (lags + 1))
        variance = variance + weight * F.coalesce(F.sum(F.col("__d") * F.col(f"__d{lag}")), F.lit(0.0))
    count = F.count(F.lit(1))
    scaled = variance / count
    result = centred.groupBy(*keys).agg(
        count.alias("periods"),
        F.avg("__v").alias("mean"),
        F.when((count >= lags + 3) & (scaled > 0), F.avg("__v") / F.sqrt(scaled / count)).alias("t"),
    )
    return result.drop("__all")
