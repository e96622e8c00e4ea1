"""Signal studies over saved observations: windows, half splits, paired tests, groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import ranking, stats
from sightline.functions.scalars import half_even
from sightline.operators import scoring
from sightline.session import cut


def with_screen(rows: DataFrame, score: str = "score_v3", quantiles: int = 5, minimum: int = 3, dealt: bool = False) -> DataFrame:
    """Adds the score quintile (5 best) and whether the screen passes the row.

    Rows are ordered by score descending, then ticker; bucket = floor(index * q / n).
    """
    flag = f"{score}_excluded"
    barred = F.coalesce(F.lower(F.col(flag).cast("string")).isin("true", "1"), F.lit(False)) \
        if flag in rows.columns else F.lit(False)
    candidate = F.col(score).isNotNull() & ~barred
    quintile = (quantiles - ranking.floor_bucket(F.col("position"), F.col("__n"), quantiles)).cast("int")
    if dealt:
        placed = ranking.positions(rows.withColumn("__candidate", candidate), ["period", "__candidate"],
                                   [-F.col(score), F.col("ticker")], total="__n", dealt=True)
        graded = placed.withColumn("quintile", F.when(F.col("__candidate"), quintile)).drop("__candidate", "position", "__n")
        return graded.withColumn("in_screen", F.coalesce(F.col("quintile") >= minimum, F.lit(False)))
    placed = ranking.positions(
        rows.where(candidate).select("period", "ticker", score), ["period"],
        [-F.col(score), F.col("ticker")], total="__n", sized=True,
    )
    graded = placed.select("period", "ticker", quintile.alias("quintile"))
    return rows.join(graded, ["period", "ticker"], "left").withColumn(
        "in_screen", F.coalesce(F.col("quintile") >= minimum, F.lit(False)))


def label_groups(rows: DataFrame, score: str = "score_v3", dealt: bool = False) -> DataFrame:
    """Screen group of every observation, and the part of the never-scored ones."""
    screened = with_screen(rows, score, dealt=dealt)
    excluded = F.coalesce(F.lower(F.col(f"{score}_excluded").cast("string")).isin("true", "1"), F.lit(False))
    group = (
        F.when(F.col("in_screen"), "screen").when(F.col(score).isNotNull(), "low_quintile")
        .when(excluded, "rejected_by_filters").otherwise("never_scored")
    )
    return screened.withColumn("group", group)


def never_scored_part(revenue: str, sector: str = "sector", financial: str = "Financial Services") -> Column:
    """Why a never-scored row has no score."""
    return F.when(F.col("group") == "never_scored", F.when(F.col(sector) == financial, "financials")
                  .when(F.col(revenue).isNull(), "no_fundamentals").otherwise("other"))


def window_label(split: str = C.FIT_SPLIT) -> Column:
    return F.when(F.col("period") < split, "fit").otherwise("holdout")


def signal_series(long: DataFrame, minimum: int, dealt: bool = False) -> DataFrame:
    """IC and coverage per (period, horizon, column) inside a group.

    ``long`` has one row per measured name and column, score null when missing.
    """
    keys = ["period", "horizon", "column"]
    if dealt:
        return stats.rank_correlation(long, keys, "score", "excess", minimum=minimum, dealt=True, extra=[
            (F.count("score") / F.count(F.lit(1))).alias("coverage")])
    coverage = long.groupBy(*keys).agg((F.count("score") / F.count(F.lit(1))).alias("coverage"))
    ic = stats.rank_correlation(long, keys, "score", "excess", minimum=minimum)
    return coverage.join(ic, keys, "left")


def windows(series: DataFrame, horizon: str, split: str = C.FIT_SPLIT, value: str = "ic") -> DataFrame:
    """Mean and Newey-West t of a series per column before and from the split."""
    part = series.where(F.col("horizon") == horizon).withColumn("window", window_label(split))
    return stats.newey_west(part, ["column", "window"], "period", value, C.NEWEY_WEST_LAGS.get(horizon, 0))


def verdicts(window_table: DataFrame, threshold: float = C.T_THRESHOLD) -> DataFrame:
    """separates / suggestive / no, from the fit and holdout windows of each column."""
    def at(window: str, name: str) -> Column:
        return F.max(F.when(F.col("window") == window, F.col(name)))

    wide = window_table.groupBy("column").agg(
        at("fit", "mean").alias("fit_mean"), at("holdout", "mean").alias("holdout_mean"),
        at("fit", "t").alias("fit_t"), at("holdout", "t").alias("holdout_t"),
    )

    def strong(name: str) -> Column:
        return ((F.abs(F.col(name)) >= threshold) & (F.signum(name) == F.signum("fit_mean"))).cast("int")

    known = F.col("fit_mean").isNotNull() & F.col("holdout_mean").isNotNull() & F.col("fit_t").isNotNull() \
        & F.col("holdout_t").isNotNull()
    same = (F.signum("fit_mean") == F.signum("holdout_mean")) & (F.col("fit_mean") != 0)
    count = strong("fit_t") + strong("holdout_t")
    return wide.withColumn(
        "verdict",
        F.when(~known | ~same, "no").when(count == 2, "separates").when(count == 1, "suggestive").otherwise("no"),
    )


def half_split(long: DataFrame, directions: DataFrame | None, minimum: int, split: str = C.FIT_SPLIT) -> DataFrame:
    """Median excess and win rate of the better and the worse half, averaged per window."""
    keys = ["period", "horizon", "column"]
    paired = long.where(F.col("score").isNotNull() & F.col("excess").isNotNull())
    if directions is not None:
        paired = paired.join(directions, "column").withColumn("score", F.col("score") * F.col("direction"))
    placed = ranking.attach_ladder(paired.select(*keys, "score", "excess"), keys, "score", sized=True)
    halves = placed.withColumn("half", F.when(ranking.rank_share() > 0.5, "better").otherwise("worse")).where(
        (F.col("total") >= minimum) & (F.col("n") < F.col("total")))
    summary = stats.outcome_summary(halves, [*keys, "half"], "excess")

    def at(half: str, name: str) -> Column:
        return F.max(F.when(F.col("half") == half, F.col(name)))

    wide = summary.groupBy(*keys).agg(
        at("better", "median").alias("bm"), at("worse", "median").alias("wm"),
        at("better", "win_rate").alias("bw"), at("worse", "win_rate").alias("ww"),
    ).where(F.col("bm").isNotNull() & F.col("wm").isNotNull())
    return wide.withColumn("window", window_label(split)).groupBy("horizon", "column", "window").agg(
        F.avg("bm").alias("better_median_excess"), F.avg("wm").alias("worse_median_excess"),
        F.avg("bw").alias("better_win_rate"), F.avg("ww").alias("worse_win_rate"),
    )


def yearly_agreement(series: DataFrame, horizon: str) -> DataFrame:
    """Mean IC per calendar year and how many years share the fit direction (+1 here)."""
    by_year = series.where((F.col("horizon") == horizon) & F.col("ic").isNotNull()).groupBy(
        "column", F.substring("period", 1, 4).alias("year")).agg(F.avg("ic").alias("ic"))
    return by_year.groupBy("column").agg(
        F.count(F.lit(1)).alias("years"), F.sum((F.col("ic") > 0).cast("bigint")).alias("positive_years"),
        F.sum((F.col("ic") < 0).cast("bigint")).alias("negative_years"),
    )


def within_periods(rows: DataFrame, pairs: Sequence[tuple[str, str]], minimum: int, dealt: bool = False) -> DataFrame:
    """Rank correlation of signal pairs per period."""
    long = rows.select("period", F.explode(F.array(*[
        F.struct(F.lit(left).alias("first"), F.lit(right).alias("second"),
                 F.col(left).cast("double").alias("x"), F.col(right).cast("double").alias("y"))
        for left, right in pairs
    ])).alias("p")).select("period", "p.*")
    return stats.rank_correlation(long, ["period", "first", "second"], "x", "y", minimum=minimum, dealt=dealt)


def within_correlation(series: DataFrame) -> DataFrame:
    """Mean of the rank correlations of ``within_periods``."""
    return series.where(F.col("ic").isNotNull()).groupBy("first", "second").agg(
        F.count(F.lit(1)).alias("periods"), F.avg("ic").alias("mean_correlation"))


def group_comparison(labelled: DataFrame, horizon: str, split: str = C.FIT_SPLIT, minimum: int = 10) -> DataFrame:
    """Each group's monthly median, win rate and mean against the screen's."""
    excess = f"excess_{horizon}"
    monthly = stats.outcome_summary(
        labelled.where(F.col(excess).isNotNull()), ["period", "group"], excess,
    ).where(F.col("observations") >= minimum)
    screen = monthly.where(F.col("group") == "screen").select(
        "period", F.col("median").alias("s_median"), F.col("win_rate").alias("s_win"))
    joined = monthly.join(screen, "period", "left").withColumn("window", window_label(split))
    return joined.groupBy("group", "window").agg(
        F.count(F.lit(1)).alias("periods"), F.avg("median").alias("median_excess"),
        F.avg("win_rate").alias("win_rate"), F.avg("mean").alias("mean_excess"),
        F.count("s_median").alias("compared_periods"),
        F.avg(F.col("median") - F.col("s_median")).alias("median_minus_screen"),
        F.avg(F.col("win_rate") - F.col("s_win")).alias("win_rate_minus_screen"),
        F.sum((F.col("median") > F.col("s_median")).cast("bigint")).alias("periods_median_above_screen"),
    )


def apply_change(model: Mapping, change: Mapping) -> dict:
    """A model with signals removed (None), reweighted (a number) or replaced (a mapping)."""
    signals = dict(model["signals"])
    exclusions = {sector: tuple(names) for sector, names in model["sector_exclusions"].items()}
    for name, value in change.items():
        if value is None:
            if name not in signals:
                raise ValueError(f"Cannot remove {name!r}: the model does not use it.")
            signals.pop(name)
        elif isinstance(value, Mapping):
            replaced = value.get("replaces")
            if replaced is not None:
                if replaced not in signals:
                    raise ValueError(f"Cannot replace {replaced!r}: the model does not use it.")
                signals.pop(replaced)
                exclusions = {
                    sector: tuple(name if item == replaced else item for item in names)
                    for sector, names in exclusions.items()
                }
            signals[name] = (float(value["weight"]), value.get("direction", "higher"))
        else:
            signals[name] = (float(value), signals.get(name, (0.0, "higher"))[1])
    if not signals:
        raise ValueError("A change cannot remove every signal.")
    return {**model, "signals": signals, "sector_exclusions": exclusions}


def paired_test(rows: DataFrame, model: Mapping, change: Mapping, horizons: Sequence[str], minimum: int,
                split: str = C.FIT_SPLIT) -> DataFrame:
    """Difference in IC between the changed and the current model per horizon and window."""
    from sightline.plans.backtest import outcomes

    keep = ["period", "ticker", *[c for c in rows.columns if c.startswith(("excess_", "return_", "benchmark_return_"))]]
    base = scoring.score_cross_section(rows, ["period"], "ticker", {**model, "prefix": "base"})
    changed = scoring.score_cross_section(rows, ["period"], "ticker", {**apply_change(model, change), "prefix": "changed"})
    both = cut(base.select(*keep, "base").join(changed.select("period", "ticker", "changed"), ["period", "ticker"]))
    series = stats.rank_correlation(
        outcomes(both, ["base", "changed"], horizons), ["period", "horizon", "column"], "score", "excess", minimum=minimum)

    def at(column: str) -> Column:
        return F.max(F.when(F.col("column") == column, F.col("ic")))

    difference = cut(series.groupBy("period", "horizon").agg((at("changed") - at("base")).alias("ic")).withColumn(
        "column", F.lit("difference")))
    tables = [windows(difference, name, split).withColumn("horizon", F.lit(name)) for name in horizons]
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result.select("horizon", "window", "periods", F.col("mean").alias("mean_difference"), F.col("t").alias("newey_west_t"))


def accepted(result: DataFrame, horizon: str) -> DataFrame:
    """Accept only when both windows improve, one t is at least 2 and none falls to -2."""
    return result.where(F.col("horizon") == horizon).groupBy("horizon").agg(
        F.coalesce(
            (F.count("newey_west_t") == 2) & (F.min("mean_difference") > 0)
            & (F.max("newey_west_t") >= 2.0) & (F.min("newey_west_t") > -2.0), F.lit(False),
        ).alias("accepted"))


def tiebreaker(rows: DataFrame, chosen: Mapping[str, float], name: str = "tiebreaker") -> DataFrame:
    """Equal-weight mean of signed within-period percentile ranks; 0.5 when all are missing."""
    entries = F.array(*[
        F.struct(F.lit(column).alias("signal"), (F.col(column) * sign).cast("double").alias("value"))
        for column, sign in chosen.items()
    ])
    long = rows.select("period", "ticker", F.explode(entries).alias("e")).select("period", "ticker", "e.*") \
        .where(F.col("value").isNotNull())
    placed = ranking.attach_ladder(long, ["period", "signal"], "value", sized=True)
    mean = placed.groupBy("period", "ticker").agg(half_even(F.avg(ranking.rank_share()), 9).alias("__t"))
    return rows.join(mean, ["period", "ticker"], "left").withColumn(name, F.coalesce("__t", F.lit(0.5))).drop("__t")
