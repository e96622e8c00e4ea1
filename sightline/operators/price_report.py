"""Chart series, period returns and price-quality checks for all securities at once.

As in ``prices``, a window partition is one security's sessions.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions.scalars import half_even, ratio


def own():
    """One security's sessions in date order (built late: importing needs no session)."""
    return Window.partitionBy("ticker").orderBy("d")


def adjust_corporate_actions(points: DataFrame) -> DataFrame:
    """Divide earlier prices by each later split whose jump the prices confirm.

    The jump test compares unadjusted closes; prices round to 6 places after
    each split, in date order. Adds ``event_status`` on split days.
    """
    observed = ratio("close", F.lag("close").over(own()))
    is_split = (F.col("split") != 0) & (F.col("split") != 1)
    confirmed = is_split & (observed > 0) & (F.abs(F.log(observed * F.col("split"))) <= math.log(C.SPLIT_JUMP_FACTOR))
    marked = points.withColumn("__ok", F.coalesce(confirmed, F.lit(False))).withColumn(
        "event_status",
        F.when(F.col("__ok"), "verified_adjusted").when(is_split, "reported_already_adjusted"),
    )
    # One small array of events per security, made once for its partition; each row keeps the later ones.
    events = F.collect_list(F.when(F.col("__ok"), F.struct("d", "split"))).over(Window.partitionBy("ticker"))
    adjusted = marked.withColumn("__events", events).withColumn("__later", F.transform(
        F.filter(F.array_sort("__events"), lambda event: event["d"] > F.col("d")), lambda event: event["split"])).drop("__events")

    def fold(name: str):
        return F.aggregate("__later", F.col(name), lambda value, split: half_even(value / split, 6))

    prices = [name for name in ("open", "high", "low", "close") if name in points.columns]
    volume = F.aggregate("__later", F.col("volume"), lambda value, split: value * split)
    return adjusted.withColumns({**{name: fold(name) for name in prices}, "volume": volume}).drop("__later", "__ok")


def anomalies(points: DataFrame) -> DataFrame:
    """Day-on-day changes of +300 % or more, or -75 % or less."""
    change = (ratio("close", F.lag("close").over(own())) - 1) * 100
    return points.select("ticker", "d", "close", F.lag("close").over(own()).alias("previous_close"),
                         change.alias("__change")).where(
        (F.col("__change") >= C.ANOMALY_RISE) | (F.col("__change") <= C.ANOMALY_FALL),
    ).select("ticker", "d", "previous_close", "close", half_even("__change", 2).alias("change_percent"))


def moving_average(points: DataFrame, window: int, name: str, digits: int = 4) -> DataFrame:
    """Mean of full windows only."""
    frame = own().rowsBetween(-(window - 1), 0)
    return points.withColumn(name, F.when(
        F.count("close").over(frame) == window, half_even(F.avg("close").over(frame), digits),
    ))


def bollinger_bands(points: DataFrame, window: int = 20, deviations: float = 2.0, digits: int = 4) -> DataFrame:
    """Mean and mean +/- deviations of the population standard deviation, full windows only."""
    frame = own().rowsBetween(-(window - 1), 0)
    middle, spread = F.avg("close").over(frame), F.stddev_pop("close").over(frame) * deviations
    banded = points.select(
        "ticker", "d", F.count("close").over(frame).alias("__n"),
        half_even(middle, digits).alias("middle"), half_even(middle + spread, digits).alias("upper"),
        half_even(middle - spread, digits).alias("lower"),
    )
    return banded.where(F.col("__n") == window).drop("__n")


def exponential_average(points: DataFrame, window: int, digits: int = 4) -> DataFrame:
    """Recursive average seeded with the first window's mean.

    The one recursive operator: each security's series (bounded by the
    calendar) is folded inside a task, securities are spread by Spark.
    """

    def fold(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("d")
        if len(bars) < window:
            return pd.DataFrame({"ticker": [], "d": [], "ema": []})
        tail = bars["close"].iloc[window - 1:].copy()
        tail.iloc[0] = bars["close"].iloc[:window].mean()
        smooth = tail.ewm(alpha=2 / (window + 1), adjust=False).mean()
        return pd.DataFrame({
            "ticker": bars["ticker"].iloc[window - 1:].to_numpy(),
            "d": bars["d"].iloc[window - 1:].to_numpy(),
            "ema": smooth.round(digits).to_numpy(),
        })

    kind = points.schema["ticker"].dataType.simpleString()
    return points.select("ticker", "d", "close").groupBy("ticker").applyInPandas(
        fold, f"ticker {kind}, d date, ema double",
    )


def period_returns(points: DataFrame, breaks: DataFrame) -> DataFrame:
    """Calendar-period returns from the first point on or after each target date.

    A return is withheld when an anomaly falls after its start. Adds the year-
    to-date period. One row per (ticker, period).
    """
    last = points.groupBy("ticker").agg(
        F.max("d").alias("last_d"), F.max_by("close", "d").alias("last_close"), F.count(F.lit(1)).alias("points"),
    )
    names = [*C.RETURN_PERIODS, "YTD"]
    targets = F.array(*[
        F.struct(F.lit(name).alias("period"), (
            F.trunc("last_d", "year") if name == "YTD" else F.date_sub("last_d", C.RETURN_PERIODS[name])
        ).alias("target"))
        for name in names
    ])
    asked = last.withColumn("p", F.explode(targets)).select(
        "ticker", "last_d", "last_close", "points", "p.period", "p.target",
    )
    longest = max(C.RETURN_PERIODS.values()) + 1
    recent = points.select("ticker", "d", "close").join(last.select("ticker", "last_d"), "ticker").where(
        F.col("d") >= F.date_sub("last_d", longest),
    ).drop("last_d")
    started = asked.join(recent, "ticker").where(F.col("d") >= F.col("target")).groupBy(
        "ticker", "period", "last_close", "points",
    ).agg(F.min_by(F.struct("d", "close"), "d").alias("s"))
    broken = breaks.groupBy("ticker").agg(F.max("d").alias("broken_on"))
    crossed = F.coalesce(F.col("broken_on") > F.col("s.d"), F.lit(False))
    enough = (F.col("points") >= 2) | (F.col("period") == "YTD")
    value = half_even((F.col("last_close") / F.col("s.close") - 1) * 100, 2)
    return started.join(broken, "ticker", "left").select(
        "ticker", "period", F.col("s.d").alias("start_date"),
        F.when(~crossed & enough, value).alias("period_return"),
        (~crossed & enough & value.isNotNull()).alias("reliable"),
    )


def rebased(points: DataFrame, start: str) -> DataFrame:
    """Close over the first close on or after ``start`` (a date column), times 100."""
    chosen = points.where(F.col("d") >= F.col(start))
    base = F.first("close").over(own().rowsBetween(Window.unboundedPreceding, 0))
    return chosen.select("ticker", "d", half_even(F.col("close") / base * 100, 3).alias("value"))


def valid_bars(points: DataFrame) -> DataFrame:
    """Bars with all four prices in a consistent order."""
    low, high = F.col("low"), F.col("high")
    return points.where(
        (low <= F.least("open", "close")) & (high >= F.greatest("open", "close")) & (low <= high)
        & F.col("open").isNotNull() & F.col("close").isNotNull(),
    )


def bar_coverage(points: DataFrame) -> DataFrame:
    """Valid-bar count and share per security."""
    whole = points.groupBy("ticker").agg(F.count(F.lit(1)).alias("point_count"))
    good = valid_bars(points).groupBy("ticker").agg(F.count(F.lit(1)).alias("ohlcv_point_count"))
    valid = F.coalesce("ohlcv_point_count", F.lit(0))
    return whole.join(good, "ticker", "left").select(
        "ticker", "point_count", valid.alias("ohlcv_point_count"),
        half_even(valid / F.col("point_count") * 100, 2).alias("ohlcv_coverage_percent"),
        (valid >= 2).alias("ohlcv"),
    )


def price_summary(points: DataFrame) -> DataFrame:
    """Latest bar, daily change, period extremes and 30-session mean volume."""
    from_end = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("d").desc()))
    marked = points.withColumn("__back", from_end)

    def at(back: int, name: str):
        return F.max(F.when(F.col("__back") == back, F.col(name)))

    has_range = {"high", "low"} <= set(points.columns)
    return marked.groupBy("ticker").agg(
        F.max("d").alias("latest_date"),
        half_even(at(1, "close"), 4).alias("latest_close"),
        half_even((at(1, "close") / at(2, "close") - 1) * 100, 2).alias("daily_change"),
        half_even(F.coalesce(F.max("high"), F.max("close")) if has_range else F.max("close"), 4).alias("period_high"),
        half_even(F.coalesce(F.min("low"), F.min("close")) if has_range else F.min("close"), 4).alias("period_low"),
        half_even(F.avg(F.when(F.col("__back") <= 30, F.col("volume"))), 2).alias("average_volume_30d"),
    )


def market_risk(bars: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Dollar volume, volatility, drawdown, dilution and reverse splits per security.

    ``bars``: ticker, d, close, volume, split. ``shares``: ticker, d, shares.
    """
    running = own().rowsBetween(Window.unboundedPreceding, 0)
    from_end = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("d").desc()))
    marked = bars.select(
        "ticker", "d", "close", "volume", "split", from_end.alias("__back"),
        (ratio("close", F.lag("close").over(own())) - 1).alias("__r"),
        (1 - ratio("close", F.max("close").over(running))).alias("__drop"),
    )
    recent = F.when(F.col("__back") <= 30, F.col("close") * F.col("volume"))
    count = F.count(F.lit(1))
    risk = marked.groupBy("ticker").agg(
        count.alias("price_observations"), F.min("d").alias("price_start_date"), F.max("d").alias("price_end_date"),
        F.when(F.count(recent) >= 20, half_even(F.avg(recent), 2)).alias("average_dollar_volume_30d"),
        F.when(count >= 60, half_even(F.stddev_samp("__r") * math.sqrt(252.0) * 100, 2))
        .alias("annualized_volatility_percent"),
        F.when(count >= 60, half_even(F.max("__drop") * 100, 2)).alias("maximum_drawdown_percent"),
        F.sum(((F.col("split") > 0) & (F.col("split") < 1)).cast("bigint")).alias("reverse_split_count_1y"),
    )
    if shares is None:
        return risk
    window = risk.select("ticker", "price_start_date", "price_end_date")
    inside = shares.where(F.col("shares") > 0).join(window, "ticker").where(
        F.col("d").between(F.col("price_start_date"), F.col("price_end_date")),
    )
    span = inside.groupBy("ticker").agg(
        F.min("d").alias("__from"), F.max("d").alias("__to"),
        F.min_by("shares", "d").alias("__first"), F.max_by("shares", "d").alias("__last"),
        F.count(F.lit(1)).alias("__n"),
    ).where((F.col("__n") >= 2) & (F.datediff("__to", "__from") >= 180))
    between = bars.where(F.col("split") > 0).join(span.select("ticker", "__from", "__to"), "ticker").where(
        (F.col("d") > F.col("__from")) & (F.col("d") <= F.col("__to")),
    ).groupBy("ticker").agg(F.product("split").alias("__m"))
    start = F.col("__first") * F.coalesce("__m", F.lit(1.0))
    change = span.join(between, "ticker", "left").select(
        "ticker", half_even((F.col("__last") / start - 1) * 100, 2).alias("share_count_change_percent"),
    )
    measured = risk.join(change, "ticker", "left").withColumn(
        "dilution_percent", F.greatest(F.col("share_count_change_percent"), F.when(
            F.col("share_count_change_percent").isNotNull(), F.lit(0.0))),
    )
    price_metrics = ["average_dollar_volume_30d", "annualized_volatility_percent",
                     "maximum_drawdown_percent", "reverse_split_count_1y"]
    priced = F.lit(True)
    for name in price_metrics:
        priced = priced & F.col(name).isNotNull()
    any_known = F.coalesce(*[F.col(name).cast("double") for name in [*price_metrics, "dilution_percent"]]).isNotNull()
    return measured.withColumn(
        "data_status",
        F.when(priced & F.col("dilution_percent").isNotNull(), "complete").when(priced, "price_only")
        .when(any_known, "partial").otherwise("unavailable"),
    )
