"""Daily-bar operators. Every window here runs over one security's sessions.

Bars are reduced to one row per (security, day) before any window, so a window
partition is bounded by the trading calendar whatever the raw row counts are.
Trailing means use running sums (two window passes over one sort) instead of
re-adding each frame.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions.scalars import finite, half_even, ladder, positive, ratio


def drop_incomplete_bars(bars: DataFrame) -> DataFrame:
    """Keep bars with a finite positive close; move splits off dropped bars.

    A split on a dropped bar goes to the next complete bar (else the last one)
    and multiplies with a split already there.
    """
    complete = F.col("__complete")
    before = Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    counted = bars.withColumn("__complete", positive("close").isNotNull()).withColumns({
        "__before": F.coalesce(F.count(F.when(complete, 1)).over(before), F.lit(0)),
        "__all": F.count(F.when(complete, 1)).over(Window.partitionBy("ticker")),
    })
    # A complete bar and the dropped ones just before it count the same complete bars before them; those at the end join the last.
    event = F.nullif(F.coalesce(finite("split"), F.lit(0.0)), F.lit(0.0))
    moved = counted.withColumn("__run", F.least("__before", F.col("__all") - 1)).withColumn(
        "__split", F.product(event).over(Window.partitionBy("ticker", "__run")))
    return moved.where(complete).drop("__complete", "__before", "__all", "__run", "split").withColumn(
        "split", F.coalesce("__split", F.lit(0.0))).drop("__split")


def normalise_history(raw: DataFrame, sequence: str) -> DataFrame:
    """Numeric close and volume, day dates, positive closes, last row per day, null volume as 0."""
    typed = raw.select(
        "ticker", F.to_date("at").alias("d"), finite("close").alias("close"),
        finite("volume").alias("volume"), sequence,
    ).where(F.col("d").isNotNull() & (F.col("close") > 0))
    last = F.max_by(F.struct("close", "volume"), sequence)
    return typed.groupBy("ticker", "d").agg(last.alias("x")).select(
        "ticker", "d", "x.close", F.coalesce("x.volume", F.lit(0.0)).alias("volume"),
    )


def clean_points(bars: DataFrame) -> DataFrame:
    """Snapshot points: close must be positive, other prices positive or null, rounded 6."""
    return bars.where(F.col("close") > 0).select(
        "ticker", "d",
        *[half_even(positive(name), 6).alias(name) for name in ("open", "high", "low", "close")],
        "volume",
        F.coalesce("dividend", F.lit(0.0)).alias("dividend"),
        F.coalesce("split", F.lit(0.0)).alias("split"),
    )


#: Closes of one of the short windows that make up a high.
HIGH_STEP = 16


def price_features(bars: DataFrame, by: str = "ticker", settings: Mapping | None = None) -> DataFrame:
    """Raw price signals and technical inputs as of every session.

    Input columns: ``by``, ``d``, ``close``, ``volume``. Signals stay null
    until ``minimum_price_history_days`` sessions exist. A return needs a finite
    positive close at both ends, volatility one on every day of its window; a
    null, NaN, zero or negative close elsewhere does no harm.
    """
    look = {**C.LOOKBACKS, **(settings or {})}
    minimum = look["minimum_price_history_days"]
    own = Window.partitionBy(by).orderBy("d")
    close = F.when(finite("close").isNotNull(), F.col("close"))
    price = F.when(positive("close").isNotNull(), F.col("close"))
    change = F.log(price / F.lag(price, 1).over(own))
    running = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The highest close of a long window is the highest of short ones that cover it: a sliding maximum looks at its whole frame.
    size = look["high_window"]
    step = min(HIGH_STEP, size)
    covers = sorted({min(back, size - step) for back in range(0, size, step)})
    base = bars.select(
        by, "d", "close", "volume",
        F.row_number().over(own).alias("sessions"),
        F.sum("volume").over(running).alias("__cv"),
        F.sum(close).over(running).alias("__cc"),
        change.alias("__r"),
        F.max(close).over(own.rowsBetween(-(step - 1), 0)).alias("__high"),
        # Short means are added up anew: running totals of a long history would cost their last digits.
        F.sum("volume").over(own.rowsBetween(-29, 0)).alias("__v30"),
        F.sum(close).over(own.rowsBetween(-29, 0)).alias("__c30"),
        *[
            F.lag(price, back).over(own).alias(f"__c{back}")
            for back in sorted({
                look["long_window"], look["medium_window"], look["skip_window"], look["reversal_window"],
                look["relative_strength_days"] - 1,
            })
        ],
    ).withColumns({
        "__s0": F.sum(F.col("__r").isNotNull().cast("int")).over(running),
        "__s1": F.sum(F.coalesce("__r", F.lit(0.0))).over(running),
        "__s2": F.sum(F.coalesce(F.col("__r") * F.col("__r"), F.lit(0.0))).over(running),
        "__high": F.array_max(F.array(*[F.lag("__high", back).over(own) for back in covers])),
    })

    def trailing(total: str, size: int) -> Column:
        return F.col(total) - F.coalesce(F.lag(total, size).over(own), F.lit(0.0))

    def mean(total: str, size: int) -> Column:
        return trailing(total, size) / F.least(F.col("sessions"), F.lit(size))

    def window_return(window: int, skip: int) -> Column:
        end = price if skip == 0 else F.col(f"__c{skip}")
        return F.when(F.col("sessions") > window, end / F.col(f"__c{window}") - 1.0)

    n = look["volatility_window"]
    spread = (trailing("__s2", n) - trailing("__s1", n) * trailing("__s1", n) / n) / (n - 1)
    signals = {
        "momentum_long": window_return(look["long_window"], look["skip_window"]),
        "momentum_medium": window_return(look["medium_window"], look["skip_window"]),
        "short_term_reversal": window_return(look["reversal_window"], 0),
        "high_proximity": F.when(
            (F.col("sessions") >= look["high_window"]) & (F.col("__high") > 0), ratio(close, "__high")),
        "volatility": F.when(
            (F.col("sessions") > n) & (trailing("__s0", n) == n), F.sqrt(F.greatest(spread, F.lit(0.0))) * math.sqrt(252.0),
        ),
        "volume_trend": F.when(
            F.col("sessions") >= look["volume_long"],
            ratio(mean("__cv", look["volume_short"]), mean("__cv", look["volume_long"])),
        ),
    }
    ready = F.col("sessions") >= minimum
    strength = look["relative_strength_days"]
    start = F.col(f"__c{strength - 1}")
    return base.select(
        by, "d", "close", "volume", "sessions",
        *[half_even(F.when(ready, value), 6).alias(f"v2_{name}") for name, value in signals.items()],
        half_even(F.when(
            F.col("sessions") >= look["score_volume_long"],
            ratio(mean("__cv", look["score_volume_short"]), mean("__cv", look["score_volume_long"])),
        ), 6).alias("volume_ratio"),
        half_even(F.when(F.col("sessions") >= strength, (close - start) / start * 100.0), 6).alias("period_return"),
        half_even(F.col("__v30") / F.least("sessions", F.lit(30)) * (F.col("__c30") / F.least("sessions", F.lit(30))), 6)
        .alias("average_dollar_volume_30d"),
        half_even(F.when(F.col("sessions") >= look["moving_average_long"], mean("__cc", look["moving_average_short"])), 7)
        .alias("sma_short"),
        half_even(F.when(F.col("sessions") >= look["moving_average_long"], mean("__cc", look["moving_average_long"])), 7)
        .alias("sma_long"),
    )


def technical_points(features: DataFrame, benchmark_return: str = "benchmark_period_return") -> DataFrame:
    """The four price-based point scores: volume, relative strength, trend and liquidity."""
    points = C.WEIGHTS
    strength = F.col("period_return") - F.col(benchmark_return)
    above = (F.col("close") > F.col("sma_short")).cast("int") + (F.col("close") > F.col("sma_long")).cast("int")

    def scaled(name: str, steps) -> list[tuple[float, float]]:
        return [(bound, points[name] * share) for bound, share in steps]

    scored = features.withColumn("relative_strength_6m", half_even(strength, 6)).withColumns({
        "volume_score": F.coalesce(
            ladder("volume_ratio", scaled("volume_acceleration", C.VOLUME_STEPS)), F.lit(0.0)),
        "relative_strength_score": F.coalesce(
            ladder("relative_strength_6m", scaled("relative_strength", C.STRENGTH_STEPS)), F.lit(0.0)),
        "trend_score": F.when(above == 2, points["trend_strength"] * 1.0)
        .when(above == 1, points["trend_strength"] * C.MIXED_TREND_SHARE).otherwise(0.0),
        "liquidity_score": F.coalesce(
            ladder("average_dollar_volume_30d", scaled("liquidity", C.LIQUIDITY_STEPS)), F.lit(0.0)),
    })
    return scored.withColumn(
        "technical_score",
        half_even(sum(F.col(f"{name}_score") for name in ("volume", "relative_strength", "trend", "liquidity")), 6),
    )


def month_ends(calendar: DataFrame, by: str = "benchmark") -> DataFrame:
    """Last session of each closed month per calendar; the open last month is dropped."""
    months = calendar.groupBy(by, F.date_format("d", "yyyy-MM").alias("period")).agg(F.max("d").alias("d"))
    return months.withColumn(
        "__last", F.max("period").over(Window.partitionBy(by)),
    ).where(F.col("period") < F.col("__last")).drop("__last")


def split_events(bars: DataFrame) -> DataFrame:
    """(ticker, on, ratio) of usable splits: finite, positive, not 1."""
    value = finite("split")
    return bars.where((value > 0) & (value != 1)).select("ticker", F.col("d").alias("on"), value.alias("ratio"))


def split_factor_after(requests: DataFrame, splits: DataFrame, boundary: str, name: str = "split_factor") -> DataFrame:
    """Product of the ratios after ``boundary``; 1 when none."""
    keyed = requests.select("ticker", boundary).distinct()
    after = keyed.join(splits, "ticker").where(F.col("on") > F.col(boundary))
    factors = after.groupBy("ticker", boundary).agg(F.product("ratio").alias(name))
    usable = F.when(finite(name) > 0, F.col(name)).otherwise(1.0)
    return requests.join(factors, ["ticker", boundary], "left").withColumn(name, F.coalesce(usable, F.lit(1.0)))


def split_between(requests: DataFrame, splits: DataFrame, start: str, end: str, name: str = "split_ambiguous") -> DataFrame:
    """True when a split falls in (start, end]."""
    keyed = requests.select("ticker", start, end).distinct()
    hits = keyed.join(splits, "ticker").where(
        (F.col("on") > F.col(start)) & (F.col("on") <= F.col(end)),
    ).select("ticker", start, end, F.lit(True).alias(name)).distinct()
    return requests.join(hits, ["ticker", start, end], "left").withColumn(name, F.coalesce(name, F.lit(False)))
