"""Point-in-time backtest: month-end observations, per-period metrics, summaries.

Stages that several metrics read (observations, the unpivoted outcomes) are
cut to the shared folder; everything after is grouped by (period, horizon,
column), and ranks inside those groups come from the distributed helpers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import ranking, stats
from sightline.functions.scalars import half_even, positive
from sightline.operators import prices, scoring
from sightline.session import cut


#: Columns that a listing gives every session of its ticker.
MEMBER = ("ticker", "benchmark", "sector", "market_cap")


def _month(day: str) -> Column:
    """Months as whole numbers, one apart."""
    return F.year(day) * 12 + F.month(day)


def close_requests(calendar: DataFrame, ends: DataFrame, stale: int, slots: Sequence[int]) -> DataFrame:
    """benchmark, d, at and ``asks``: what the close of this session answers, if it still holds ``back`` sessions later.

    The month end ``m`` asks in ``slot`` for the close slots[slot] sessions later; one after the end of the calendar has no
    close. A session has at most ``stale`` + 1 times the number of slots of them, so the table is as long as the calendar.
    """
    asked = F.explode(F.array(*[
        F.struct((F.col("at") + days).alias("at"), F.lit(i).alias("slot")) for i, days in enumerate(slots)]))
    wanted = ends.select("benchmark", "m", "length", asked.alias("x")).where("x.at <= length").withColumn(
        "back", F.explode(F.sequence(F.lit(0), F.lit(stale))))
    asks = wanted.groupBy("benchmark", (F.col("x.at") - F.col("back")).alias("at")).agg(
        F.collect_list(F.struct("back", "m", "x.slot")).alias("asks"))
    return calendar.select("benchmark", "d", "at").join(asks, ["benchmark", "at"], "left")


def month_rows(dated: DataFrame, ends: DataFrame, requests: DataFrame, minimum: int, stale: int, slots: Sequence[str]) -> DataFrame:
    """Per (ticker, month end): the last of dated(ticker, benchmark, d, sessions, close, ...) on or before it, unless it is
    stale then, and the close that holds at every slot of ``requests``.

    ``ends``: benchmark, d, m (the month of d), stale_after. Every session says which month ends it is the last one before
    and which requests its close answers, from the tables of the calendar alone; so no ticker meets its whole calendar and
    nothing but ``ticker`` deals the rows, as in the windows before. A null close answers nothing; sessions outside the
    calendar are known, but their closes answer nothing.
    """
    values = [name for name in dated.columns if name not in MEMBER]
    bounds = ends.groupBy("benchmark").agg(F.max("m").alias("__last"))
    rows = dated.withColumn("m", _month("d")).join(bounds, "benchmark").join(
        ends.select("benchmark", "m", F.col("d").alias("__end")), ["benchmark", "m"], "left").join(requests, ["benchmark", "d"], "left")
    # The first month whose end is not before the session.
    rows = rows.withColumn("__first", F.when(F.col("d") > F.col("__end"), F.col("m") + 1).otherwise(F.col("m"))).withColumn(
        "__held", F.when(F.col("close").isNotNull(), F.col("at")))
    rows = rows.withColumns({
        "__next": F.lead("__first").over(Window.partitionBy("ticker").orderBy("d")),
        "__then": F.expr("lead(__held) IGNORE NULLS OVER (PARTITION BY ticker ORDER BY d)"),
    })
    until = F.least(F.coalesce(F.col("__next") - 1, F.col("__last")), F.col("__last"))
    known = F.when((F.col("__first") <= until) & (F.col("sessions") >= minimum), F.transform(
        F.sequence("__first", until), lambda m: F.struct(m.alias("m"), F.lit(-1).alias("slot"))))
    lasting = F.coalesce(F.col("__then") - 1 - F.col("at"), F.lit(stale))
    answers = F.when(F.col("__held").isNotNull(), F.transform(
        F.filter("asks", lambda ask: ask["back"] <= lasting), lambda ask: F.struct(ask["m"].alias("m"), ask["slot"].alias("slot"))))
    none = F.array().cast("array<struct<m:int,slot:int>>")
    spread = rows.select(*MEMBER, *values, F.explode(F.concat(F.coalesce(known, none), F.coalesce(answers, none))).alias("x"))
    found = spread.groupBy(*MEMBER, F.col("x.m").alias("m")).agg(
        F.max(F.col("x.slot") == -1).alias("__known"),
        *[F.max(F.when(F.col("x.slot") == -1, F.col(name))).alias("own_d" if name == "d" else name) for name in values],
        *[F.max(F.when(F.col("x.slot") == i, F.col("close"))).alias(name) for i, name in enumerate(slots)])
    return found.where("__known").drop("__known").join(ends, ["benchmark", "m"]).where(F.col("own_d") >= F.col("stale_after"))


def observations(bars: DataFrame, bench: DataFrame, listing: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """One row per (period, ticker): features known at month end and forward returns.

    ``bars``: ticker, d, close, volume. ``bench``: benchmark, d, close.
    ``listing``: ticker, benchmark, sector, market_cap. Only month ends and the sessions that a horizon leads to are looked
    up, so the rows that are sorted and joined grow with the bars, not with tickers times sessions. All steps deal the bars
    by ticker: they are shuffled once, and not at all if they come so.
    """
    rules = {**C.BACKTEST, **(settings or {})}
    horizons: Mapping[str, int] = rules["horizons"]
    stale = rules["stale_sessions"]
    over_bench = Window.partitionBy("benchmark").orderBy("d")
    strength = C.LOOKBACKS["relative_strength_days"]
    base = F.lag("close", strength - 1).over(over_bench)
    calendar = cut(bench.select(
        "benchmark", "d", F.row_number().over(over_bench).alias("at"),
        F.count(F.lit(1)).over(Window.partitionBy("benchmark")).alias("length"),
        half_even((F.col("close") - base) / base * 100.0, 6).alias("benchmark_period_return"),
        F.coalesce(F.lag("d", stale).over(over_bench), F.min("d").over(Window.partitionBy("benchmark")))
        .alias("stale_after"),
        *[
            ((F.lead("close", days).over(over_bench) / F.col("close") - 1.0) * 100.0).alias(f"benchmark_return_{name}")
            for name, days in horizons.items()
        ],
    ))
    # The calendars are stored, so Spark knows that they are small and broadcasts them.
    ends = cut(calendar.join(prices.month_ends(calendar.select("benchmark", "d")), ["benchmark", "d"]).withColumn("m", _month("d")))
    slots = {"start_close": 0, **{f"close_{name}": days for name, days in horizons.items()}}
    requests = cut(close_requests(calendar, ends, stale, list(slots.values())))
    features = prices.price_features(bars)
    names = [name for name in features.columns if name not in ("ticker", "d")]
    chosen = month_rows(features.join(listing.select(*MEMBER), "ticker"), ends, requests, rules["minimum_history"], stale, list(slots))
    with_returns = chosen.withColumns({
        f"return_{name}": (F.col(f"close_{name}") / F.col("start_close") - 1.0) * 100.0 for name in horizons})
    flat = with_returns.select(
        "period", "d", "ticker", "benchmark", "sector", "market_cap", "start_close", "benchmark_period_return",
        *names,
        *[f"return_{name}" for name in horizons],
        *[f"benchmark_return_{name}" for name in horizons],
        *[
            (F.col(f"return_{name}") - F.col(f"benchmark_return_{name}")).alias(f"excess_{name}")
            for name in horizons
        ],
    )
    return prices.technical_points(flat)


def size_and_liquidity_gate(rows: DataFrame, floor: float, band: tuple[float, float], last_close: DataFrame) -> DataFrame:
    """Market cap at the date with its basis, and the reason a row leaves the universe.

    Filed shares give the cap directly (``pit_market_cap`` when present), else
    the current cap scaled by the price change since.
    """
    derived = positive("pit_market_cap") if "pit_market_cap" in rows.columns else F.lit(None).cast("double")
    joined = rows.join(last_close.select("ticker", F.col("close").alias("__last")), "ticker", "left")
    scaled = positive("market_cap") * positive("start_close") / positive("__last")
    unit = F.col("share_unit_factor") if "share_unit_factor" in rows.columns else F.lit(1.0)
    cap = F.coalesce(derived * unit, scaled)
    liquid = (F.lit(floor) <= 0) | F.coalesce(F.col("average_dollar_volume_30d") >= floor, F.lit(False))
    return joined.withColumns({
        "universe_market_cap": cap,
        "universe_cap_basis": F.when(derived.isNotNull() & (unit != 1.0), "filed_shares_unit_corrected")
        .when(derived.isNotNull(), "filed_shares").when(scaled.isNotNull(), "price_scaled_approximation")
        .otherwise("unavailable"),
        "gate": F.when(~liquid, "below_liquidity_floor")
        .when(F.coalesce(cap.between(*band), F.lit(False)), "inside_band").otherwise("outside_band"),
    }).drop("__last")


def outcomes(rows: DataFrame, columns: Sequence[str], horizons: Sequence[str], *, keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot to (period, horizon, column, ticker, score, excess, return, benchmark_return)."""
    by_horizon = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("horizon"), F.col(f"excess_{name}").alias("excess"),
            F.col(f"return_{name}").alias("stock"), F.col(f"benchmark_return_{name}").alias("market"),
        )
        for name in horizons
    ]))
    by_column = F.explode(F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(name).cast("double").alias("score")) for name in columns
    ]))
    first = rows.select("period", "ticker", *keep, *columns, by_horizon.alias("h")).where(F.col("h.excess").isNotNull())
    return first.select("period", "ticker", *keep, "h.horizon", "h.excess", "h.stock", "h.market", by_column.alias("c")) \
        .select("period", "horizon", "c.column", "ticker", *keep, "c.score", "excess", "stock", "market")


def wide_enough(long: DataFrame, minimum: int, dealt: bool = False) -> DataFrame:
    """Keep (period, horizon) cross-sections with enough measured names."""
    if dealt:
        counted = long.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("period", "horizon", "column")))
        most = F.max("__n").over(Window.partitionBy("period", "horizon"))
        return counted.withColumn("__n", most).where(F.col("__n") >= minimum).drop("__n")
    counts = long.groupBy("period", "horizon", "column").agg(F.count(F.lit(1)).alias("__n")).groupBy(
        "period", "horizon").agg(F.max("__n").alias("__n"))
    return long.join(counts.where(F.col("__n") >= minimum).drop("__n"), ["period", "horizon"])


def information_coefficients(long: DataFrame, minimum: int, dealt: bool = False) -> DataFrame:
    """Spearman IC per (period, horizon, column)."""
    return stats.rank_correlation(
        long.where(F.col("score").isNotNull()), ["period", "horizon", "column"], "score", "excess", minimum=minimum, dealt=dealt)


def ranked_outcomes(long: DataFrame, dealt: bool = False) -> DataFrame:
    """Tie-broken order per cross-section: score, then relative strength, both descending, then ticker."""
    scored = long.where(F.col("score").isNotNull())
    order = [-F.col("score"), F.col("relative_strength_6m").isNull(), -F.col("relative_strength_6m"), F.col("ticker")]
    return ranking.positions(scored, ["period", "horizon", "column"], order, total="members", sized=True, dealt=dealt)


def quantile_ladder(ranked: DataFrame, quantiles: int) -> DataFrame:
    """Mean, median, win rate and winsorised mean of each quantile bucket, lowest first."""
    bucket = ranking.edge_bucket(F.col("members") - F.col("position") + 1, F.col("members"), quantiles)
    bucketed = ranked.where(F.col("members") >= quantiles).withColumn("bucket", bucket)
    return stats.outcome_summary(bucketed, ["period", "horizon", "column", "bucket"], "excess")


def top_portfolios(ranked: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Equal-weight outcome of the best N names per cross-section, only where N names exist.

    A group here holds at most N rows, so plain medians and member lists are bounded.
    """
    fits = F.filter(
        F.array(*[F.lit(size) for size in sizes]),
        lambda size: (size <= F.col("members")) & (F.col("position") <= size),
    )
    chosen = ranked.where(F.col("position") <= max(sizes)).withColumn("top_n", F.explode(fits))
    return chosen.groupBy("period", "horizon", "column", "top_n").agg(
        F.avg("excess").alias("mean_excess"), F.median("excess").alias("median_excess"),
        F.avg("stock").alias("mean_return"), F.avg("market").alias("mean_benchmark_return"),
        (F.avg(F.when(F.col("excess") > 0, 1.0).otherwise(0.0)) * 100.0).alias("hit_rate_percent"),
        F.array_sort(F.collect_list("ticker")).alias("members"),
    )


def turnover(tops: DataFrame, horizon: str) -> DataFrame:
    """Mean share of new members between consecutive available periods, in percent."""
    own = Window.partitionBy("column", "top_n").orderBy("period")
    previous = F.lag("members").over(own)
    rate = (1.0 - F.size(F.array_intersect(previous, "members")) / F.size("members")) * 100.0
    moved = tops.where(F.col("horizon") == horizon).select("column", "top_n", F.when(previous.isNotNull(), rate).alias("r"))
    return moved.groupBy("column", "top_n").agg(half_even(F.avg("r"), 4).alias("turnover_percent"))


def mean_of_rounded(value: str, digits: int = 4) -> Column:
    """Mean of per-period figures rounded first; summed as whole numbers, so the order cannot matter."""
    scale = float(10 ** digits)
    return F.rint(F.avg(F.rint(F.col(value) * scale))) / scale


def compounded(tops: DataFrame, horizon: str) -> DataFrame:
    """Portfolio and benchmark compounded over the periods that have a top N."""
    usable = tops.where((F.col("horizon") == horizon) & F.col("mean_return").isNotNull()
                        & F.col("mean_benchmark_return").isNotNull())
    portfolio = F.product(1.0 + half_even("mean_return", 4) / 100.0)
    benchmark = F.product(1.0 + half_even("mean_benchmark_return", 4) / 100.0)
    return usable.groupBy("column", "top_n").agg(
        F.count(F.lit(1)).alias("periods"), portfolio.alias("portfolio_growth"), benchmark.alias("benchmark_growth"),
        half_even((portfolio - 1.0) * 100.0, 2).alias("portfolio_return_percent"),
        half_even((benchmark - 1.0) * 100.0, 2).alias("benchmark_return_percent"),
        half_even((portfolio - benchmark) * 100.0, 2).alias("difference_percent"),
    )


def ladder_summary(ladder: DataFrame) -> DataFrame:
    """Bucket figures averaged over periods, nulls skipped."""
    means = [
        mean_of_rounded(name).alias(name) for name in ("mean", "median", "winsorised_mean", "win_rate")
    ]
    return ladder.groupBy("horizon", "column", "bucket").agg(F.countDistinct("period").alias("periods"), *means)


def ladder_spread(ladder: DataFrame, quantiles: int) -> DataFrame:
    """Top minus bottom bucket per cross-section."""
    def at(bucket: int, name: str) -> Column:
        return F.max(F.when(F.col("bucket") == bucket, half_even(name, 4)))

    return ladder.groupBy("period", "horizon", "column").agg(
        (at(quantiles - 1, "mean") - at(0, "mean")).alias("spread"),
        (at(quantiles - 1, "median") - at(0, "median")).alias("median_spread"),
    )


def top_summary(tops: DataFrame) -> DataFrame:
    return tops.groupBy("horizon", "column", "top_n").agg(
        F.count(F.lit(1)).alias("periods"),
        *[mean_of_rounded(name).alias(name) for name in ("mean_excess", "median_excess", "hit_rate_percent")],
    )


def filter_diagnostics(rows: DataFrame, model: Mapping, horizons: Sequence[str]) -> DataFrame:
    """Outcomes of excluded and retained rows among those the filters could judge."""
    judged = F.lit(False)
    for signal, *_ in model["exclusions"]:
        if signal in rows.columns:
            judged = judged | F.col(signal).isNotNull()
    flag = F.col(f"{model['prefix']}_excluded")
    long = outcomes(rows.where(judged).withColumn("__flag", flag.cast("double")), ["__flag"], horizons)
    labelled = long.withColumn("part", F.when(F.col("score") == 1.0, "excluded").otherwise("retained"))
    return stats.outcome_summary(labelled, ["horizon", "part"], "excess")


def scored_observations(rows: DataFrame, models: Sequence[Mapping] = (C.MODEL_V2,), dealt: bool = False) -> DataFrame:
    """Every period's cross-section scored with each model."""
    for model in models:
        rows = scoring.score_cross_section(rows, ["period"], "ticker", model, dealt=dealt)
        rows = rows.drop(*[name for name in rows.columns if name.startswith("pct_")])
    return rows
