"""Backtest and study queries: P4, A6, A7, A10-A15, A22-A27, R13, F12, P6-P8, X22, X32, K3."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import config as C
from sightline.catalog.prices import FEATURES_SQL
from sightline.catalog.registry import register
from sightline.catalog.scores import newey_west_sql, score_sql
from sightline.catalog.views import Views, r
from sightline.functions import ranking
from sightline.functions.scalars import half_even
from sightline.plans import backtest, studies
from sightline.session import cut

HORIZONS = tuple(C.BACKTEST["horizons"])
# The panel ends in 2001, so the fit/holdout split and the listing groups are set for it.
SPLIT = "1999-06"
MODEL = {**C.MODEL_V2, "minimum_group": 5, "exclusions": (
    ("v2_volatility", None, 80.0, "Top-quintile volatility"),
    ("v2_volume_trend", 20.0, None, "Bottom-quintile volume trend"),
)}
COMPOSITES = ("technical_score", "score_v2")
SIGNALS = ("v2_momentum_long", "v2_volatility", "v2_volume_trend", "relative_strength_6m")
MINIMUM = 50
TOPS = (10, 25, 50)

OBS_SQL = FEATURES_SQL + f""", cal AS (SELECT benchmark, d,
    {r('(close - lag(close, 125) OVER o) / lag(close, 125) OVER o * 100', 6)} AS br,
    COALESCE(lag(d, 5) OVER o, min(d) OVER (PARTITION BY benchmark)) AS stale_after,
    {", ".join(f"(lead(close, {days}) OVER o / close - 1) * 100 AS benchmark_return_{name}" for name, days in C.BACKTEST['horizons'].items())}
    FROM bench WINDOW o AS (PARTITION BY benchmark ORDER BY d)),
  me AS (SELECT * FROM (SELECT *, max(period) OVER (PARTITION BY benchmark) AS lp FROM (
    SELECT benchmark, strftime(d, '%Y-%m') AS period, max(d) AS d FROM bench GROUP BY 1, 2) a) b WHERE period < lp),
  al AS (SELECT l.ticker, l.sector, l.market_cap, c.*, last_value(px.close IGNORE NULLS) OVER (PARTITION BY l.ticker ORDER BY c.d ROWS 5 PRECEDING) AS start_close
    FROM listing l JOIN cal c USING (benchmark) LEFT JOIN px ON px.ticker = l.ticker AND px.d = c.d),
  fw AS (SELECT *, {", ".join(f"(lead(start_close, {days}) OVER o / start_close - 1) * 100 AS return_{name}" for name, days in C.BACKTEST['horizons'].items())}
    FROM al WINDOW o AS (PARTITION BY ticker ORDER BY d)),
  ow AS (SELECT period, fw.*, (SELECT max(d) FROM px WHERE px.ticker = fw.ticker AND px.d <= fw.d) AS own_d FROM fw JOIN me USING (benchmark, d)),
  ob AS (SELECT ow.*, pf.* EXCLUDE (ticker, d), {r('period_return - br', 6)} AS relative_strength_6m,
      {", ".join(f"return_{h} - benchmark_return_{h} AS excess_{h}" for h in HORIZONS)}
    FROM ow JOIN pf ON pf.ticker = ow.ticker AND pf.d = own_d WHERE sessions >= 200 AND own_d >= stale_after),
  obs AS (SELECT *, {r('''CASE WHEN volume_ratio >= 3 THEN 25 WHEN volume_ratio >= 2 THEN 20 WHEN volume_ratio >= 1.5 THEN 14 WHEN volume_ratio >= 1.2 THEN 8 ELSE 0 END
      + CASE WHEN relative_strength_6m >= 50 THEN 25 WHEN relative_strength_6m >= 30 THEN 20 WHEN relative_strength_6m >= 15 THEN 14 WHEN relative_strength_6m >= 0 THEN 8 ELSE 0 END
      + CASE WHEN close > sma_short AND close > sma_long THEN 15 WHEN close > sma_short OR close > sma_long THEN 7.95 ELSE 0 END
      + CASE WHEN average_dollar_volume_30d >= 5e6 THEN 10 WHEN average_dollar_volume_30d >= 1e6 THEN 7 WHEN average_dollar_volume_30d >= 250000 THEN 4 ELSE 0 END''', 6)} AS technical_score FROM ob)"""
VIEWS = "px bench listing"

SCORED_SQL = OBS_SQL + ", " + score_sql("obs", "period", "ticker", MODEL, "sc") + """,
  so AS (SELECT obs.*, sc.score_v2, sc.score_v2_confidence, sc.score_v2_excluded FROM obs JOIN sc USING (period, ticker))"""


def long_sql(source: str, columns, horizons=HORIZONS, name: str = "lg") -> str:
    parts = [
        f"SELECT period, '{h}' AS horizon, '{c}' AS col, ticker, CAST({c} AS DOUBLE) AS score, excess_{h} AS excess, return_{h} AS stock,"
        f" benchmark_return_{h} AS market, relative_strength_6m FROM {source} WHERE excess_{h} IS NOT NULL"
        for h in horizons for c in columns]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def ic_sql(source: str, keys: str, minimum: int, name: str = "ic") -> str:
    """Spearman IC per group from average ranks of complete pairs."""
    def average(column):
        w = f"PARTITION BY {keys}"
        return f"(rank() OVER ({w} ORDER BY {column}) + (count(*) OVER ({w}, {column}) - 1) / 2.0)"

    return f"""{name}_k AS (SELECT {keys}, score, excess, {average('score')} AS rx, {average('excess')} AS ry FROM {source}
        WHERE score IS NOT NULL AND excess IS NOT NULL),
      {name} AS (SELECT {keys}, count(*) AS pairs, CASE WHEN count(*) >= {minimum} AND min(score) < max(score) AND min(excess) < max(excess)
        THEN corr(rx, ry) END AS ic FROM {name}_k GROUP BY {keys})"""


def observed(v: Views):
    return backtest.observations(v.bars, v.bench, v.listing)


def by_period(v: Views, columns, plan):
    """``plan(scored, dealt)`` of the scored observations with ``columns``; see ``ranking.in_groups``.

    Only the columns that the model or the plan reads are stored. Periods of at most ``ranking.DEALT`` tickers are shuffled once
    and scored and ranked where they are; those of larger ones are stored again once scored.
    """
    needed = dict.fromkeys(["period", "ticker", "sector", *MODEL["signals"], *columns])

    def scored(rows, dealt):
        found = backtest.scored_observations(rows, (MODEL,), dealt)
        return plan(found if dealt else cut(found), dealt)

    return ranking.in_groups(cut(observed(v).select(*[name for name in needed if not name.startswith("score_v2")])), ["period"], scored)


def measures(horizons, kinds=("excess", "return", "benchmark_return")):
    return [f"{kind}_{name}" for name in horizons for kind in kinds]


@register("p04_backtest_observations", VIEWS, "WITH " + OBS_SQL + f""" SELECT period, ticker, CAST(d AS VARCHAR) AS d, sector, sessions,
    technical_score, v2_momentum_long, v2_volatility, relative_strength_6m, {", ".join(r(f"return_{h}", 4) + f" AS return_{h}" for h in HORIZONS)},
    {", ".join(r(f"excess_{h}", 4) + f" AS excess_{h}" for h in HORIZONS)} FROM obs""")
def _(v: Views):
    return observed(v).select(
        "period", "ticker", F.col("d").cast("string").alias("d"), "sector", "sessions", "technical_score",
        "v2_momentum_long", "v2_volatility", "relative_strength_6m",
        *[half_even(f"return_{h}", 4).alias(f"return_{h}") for h in HORIZONS], *[half_even(f"excess_{h}", 4).alias(f"excess_{h}") for h in HORIZONS])


@register("w22_forward_returns", VIEWS, "WITH " + OBS_SQL + f""" SELECT ticker, period, {", ".join(
    r(f"return_{h}", 4) + f" AS return_{h}, " + r(f"benchmark_return_{h}", 4) + f" AS benchmark_return_{h}" for h in HORIZONS)} FROM obs""")
def _(v: Views):
    return observed(v).select("ticker", "period", *[
        half_even(f"{kind}_{h}", 4).alias(f"{kind}_{h}") for h in HORIZONS for kind in ("return", "benchmark_return")])


@register("w23_staleness_gate", VIEWS, "WITH " + OBS_SQL + """ SELECT period, count(*) AS kept, CAST(min(stale_after) AS VARCHAR) AS earliest_boundary
    FROM obs GROUP BY 1""")
def _(v: Views):
    rows = backtest.observations(v.bars, v.bench, v.listing)
    over = prices_boundary(v)
    return rows.join(over, ["benchmark", "d"]).groupBy("period").agg(
        F.count(F.lit(1)).alias("kept"), F.min("stale_after").cast("string").alias("earliest_boundary"))


def prices_boundary(v: Views):
    from pyspark.sql import Window
    w = Window.partitionBy("benchmark").orderBy("d")
    return v.bench.select("benchmark", "d", F.coalesce(
        F.lag("d", 5).over(w), F.min("d").over(Window.partitionBy("benchmark"))).alias("stale_after"))


@register("f12_size_liquidity_gate", VIEWS, "WITH " + OBS_SQL + """, lc AS (SELECT ticker, max_by(close, d) AS lcl FROM px GROUP BY 1),
  g AS (SELECT *, market_cap * start_close / lcl AS cap FROM obs JOIN lc USING (ticker))
  SELECT CASE WHEN average_dollar_volume_30d < 80000 THEN 'below_liquidity_floor' WHEN cap BETWEEN 1e8 AND 1e9 THEN 'inside_band' ELSE 'outside_band' END AS gate,
    CASE WHEN cap IS NULL THEN 'unavailable' ELSE 'price_scaled_approximation' END AS universe_cap_basis, count(*) AS n FROM g GROUP BY 1, 2""")
def _(v: Views):
    last = v.px.groupBy("ticker").agg(F.max_by("close", "d").alias("close"))
    gated = backtest.size_and_liquidity_gate(observed(v), 80000.0, (1e8, 1e9), last)
    return gated.groupBy("gate", "universe_cap_basis").agg(F.count(F.lit(1)).alias("n"))


@register("p04_scored_observations", VIEWS, "WITH " + SCORED_SQL
          + " SELECT period, ticker, score_v2, score_v2_confidence, score_v2_excluded FROM so")
def _(v: Views):
    return by_period(v, [], lambda rows, dealt: rows.select(
        "period", "ticker", "score_v2", "score_v2_confidence", "score_v2_excluded"))


@register("a06_information_coefficient", VIEWS, "WITH " + SCORED_SQL + ", " + long_sql("so", COMPOSITES + SIGNALS) + ", "
          + ic_sql("lg", "period, horizon, col", MINIMUM)
          + f""" SELECT period, horizon, col AS "column", pairs, {r('ic', 6)} AS ic FROM ic""")
def _(v: Views):
    columns = tuple(dict.fromkeys((*COMPOSITES, *SIGNALS)))

    def coefficients(rows, dealt):
        return backtest.information_coefficients(backtest.outcomes(rows, columns, HORIZONS), MINIMUM, dealt)

    return by_period(v, [*columns, *measures(HORIZONS)], coefficients).select(
        "period", "horizon", "column", "pairs", half_even("ic", 6).alias("ic"))


RANKED_SQL = SCORED_SQL + ", " + long_sql("so", COMPOSITES) + f""", we AS (SELECT * FROM lg
    QUALIFY count(*) OVER (PARTITION BY period, horizon, col) >= {MINIMUM}),
  rk AS (SELECT *, row_number() OVER (PARTITION BY period, horizon, col ORDER BY score DESC, relative_strength_6m DESC NULLS LAST, ticker) AS pos,
    count(*) OVER (PARTITION BY period, horizon, col) AS n FROM we WHERE score IS NOT NULL)"""
LADDER_SQL = RANKED_SQL + """, bk AS (SELECT *, CAST(greatest(ceil((n - pos) * 5.0 / (n - 1)) - 1, 0) AS INTEGER) AS bucket FROM rk WHERE n >= 5),
  bq AS (SELECT period, horizon, col, bucket, quantile_cont(excess, 0.02) AS lo, quantile_cont(excess, 0.98) AS hi, quantile_cont(excess, 0.5) AS md FROM bk GROUP BY 1, 2, 3, 4),
  ld AS (SELECT period, horizon, col, bucket, count(*) AS observations, avg(excess) AS mean, max(md) AS median,
    avg(least(greatest(excess, lo), hi)) AS winsorised_mean, avg(CASE WHEN excess > 0 THEN 100.0 ELSE 0 END) AS win_rate
    FROM bk JOIN bq USING (period, horizon, col, bucket) GROUP BY 1, 2, 3, 4)"""


def ranked(v: Views, plan=lambda rows: rows):
    """``plan`` of the ranked outcomes; it keeps to the periods."""
    def ranks(rows, dealt):
        long = backtest.wide_enough(backtest.outcomes(rows, COMPOSITES, HORIZONS, keep=["relative_strength_6m"]), MINIMUM, dealt)
        return plan(backtest.ranked_outcomes(long if dealt else cut(long), dealt))

    return by_period(v, [*COMPOSITES, "relative_strength_6m", *measures(HORIZONS)], ranks)


def ladder(v: Views):
    needed = ["period", "horizon", "column", "position", "members", "excess"]
    return backtest.quantile_ladder(cut(ranked(v, lambda rows: rows.select(*needed))), 5)


@register("r13_backtest_order", VIEWS, "WITH " + RANKED_SQL + """ SELECT period, horizon, col AS "column", ticker, pos AS position, n AS members FROM rk""")
def _(v: Views):
    return ranked(v).select("period", "horizon", "column", "ticker", "position", "members")


@register("a07_quantile_ladder", VIEWS, "WITH " + LADDER_SQL + f""" SELECT period, horizon, col AS "column", bucket, observations,
    {", ".join(f"{r(c, 4)} AS {c}" for c in ("mean", "median", "winsorised_mean", "win_rate"))} FROM ld""")
def _(v: Views):
    return ladder(v).select("period", "horizon", "column", "bucket", "observations", *[
        half_even(c, 4).alias(c) for c in ("mean", "median", "winsorised_mean", "win_rate")])


TOP_SQL = RANKED_SQL + """, tn AS (SELECT rk.*, t.top_n FROM rk JOIN (VALUES (10), (25), (50)) t(top_n) ON pos <= top_n AND n >= top_n),
  tp AS (SELECT period, horizon, col, top_n, avg(excess) AS mean_excess, quantile_cont(excess, 0.5) AS median_excess, avg(stock) AS mean_return,
    avg(market) AS mean_benchmark_return, avg(CASE WHEN excess > 0 THEN 100.0 ELSE 0 END) AS hit_rate_percent, list(ticker ORDER BY ticker) AS members
    FROM tn GROUP BY 1, 2, 3, 4)"""


def tops(v: Views):
    return ranked(v, lambda rows: backtest.top_portfolios(rows, TOPS))


@register("a10_top_portfolios", VIEWS, "WITH " + TOP_SQL + f""" SELECT period, horizon, col AS "column", top_n,
    {", ".join(f"{r(c, 4)} AS {c}" for c in ("mean_excess", "median_excess", "mean_return", "mean_benchmark_return", "hit_rate_percent"))},
    array_to_string(members, ',') AS members FROM tp""")
def _(v: Views):
    return tops(v).select("period", "horizon", "column", "top_n", *[half_even(c, 4).alias(c) for c in (
        "mean_excess", "median_excess", "mean_return", "mean_benchmark_return", "hit_rate_percent")],
        F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@register("a12_turnover", VIEWS, "WITH " + TOP_SQL + f""", lm AS (SELECT col, top_n, members, lag(members) OVER (PARTITION BY col, top_n ORDER BY period) AS pm
    FROM tp WHERE horizon = '1M')
  SELECT col AS "column", top_n, {r('avg((1 - len(list_intersect(pm, members)) / len(members)) * 100)', 4)} AS turnover_percent FROM lm GROUP BY 1, 2""")
def _(v: Views):
    return backtest.turnover(tops(v), "1M")


@register("a13_compounded", VIEWS, "WITH " + TOP_SQL + f""", cm AS (SELECT col, top_n, count(*) AS periods,
    product(1 + {r('mean_return', 4)} / 100) AS p, product(1 + {r('mean_benchmark_return', 4)} / 100) AS b FROM tp WHERE horizon = '1M' GROUP BY 1, 2)
  SELECT col AS "column", top_n, periods, {r('ln(p)', 6)} AS log_portfolio, {r('ln(b)', 6)} AS log_benchmark FROM cm""")
def _(v: Views):
    # Logs: the panel's monthly swings compound far beyond two decimals of a percentage.
    return backtest.compounded(tops(v), "1M").select(
        "column", "top_n", "periods", half_even(F.log("portfolio_growth"), 6).alias("log_portfolio"),
        half_even(F.log("benchmark_growth"), 6).alias("log_benchmark"))


@register("a14_filter_diagnostics", VIEWS, "WITH " + SCORED_SQL + f""", jd AS (
    {" UNION ALL ".join(f"SELECT '{h}' AS horizon, CASE WHEN score_v2_excluded THEN 'excluded' ELSE 'retained' END AS part, excess_{h} AS x FROM so WHERE excess_{h} IS NOT NULL AND (v2_volatility IS NOT NULL OR v2_volume_trend IS NOT NULL)" for h in HORIZONS)}),
  q AS (SELECT horizon, part, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi, quantile_cont(x, 0.5) AS md FROM jd GROUP BY 1, 2)
  SELECT horizon, part, count(*) AS observations, {r('max(md)', 4)} AS median, {r('avg(least(greatest(x, lo), hi))', 4)} AS winsorised_mean,
    {r('avg(CASE WHEN x > 0 THEN 100.0 ELSE 0 END)', 4)} AS win_rate FROM jd JOIN q USING (horizon, part) GROUP BY 1, 2""")
def _(v: Views):
    rows = cut(by_period(v, measures(HORIZONS), lambda rows, dealt: rows))
    return backtest.filter_diagnostics(rows, MODEL, HORIZONS).select(
        "horizon", "part", "observations", *[half_even(c, 4).alias(c) for c in ("median", "winsorised_mean", "win_rate")])


@register("a15_ladder_summary", VIEWS, "WITH " + LADDER_SQL + f""" SELECT horizon, col AS "column", bucket, count(*) AS periods,
    {", ".join(f"round_even(avg(round_even({c} * 1e4, 0)), 0) / 1e4 AS {c}" for c in ("mean", "median", "winsorised_mean", "win_rate"))} FROM ld GROUP BY 1, 2, 3""")
def _(v: Views):
    return backtest.ladder_summary(ladder(v))


@register("a15_spread", VIEWS, "WITH " + LADDER_SQL + f""" SELECT period, horizon, col AS "column",
    {r(f"max(CASE WHEN bucket = 4 THEN {r('mean', 4)} END) - max(CASE WHEN bucket = 0 THEN {r('mean', 4)} END)", 4)} AS spread,
    {r(f"max(CASE WHEN bucket = 4 THEN {r('median', 4)} END) - max(CASE WHEN bucket = 0 THEN {r('median', 4)} END)", 4)} AS median_spread FROM ld GROUP BY 1, 2, 3""")
def _(v: Views):
    return backtest.ladder_spread(ladder(v), 5).select(
        "period", "horizon", "column", half_even("spread", 4).alias("spread"), half_even("median_spread", 4).alias("median_spread"))


@register("a15_top_summary", VIEWS, "WITH " + TOP_SQL + f""" SELECT horizon, col AS "column", top_n, count(*) AS periods,
    {", ".join(f"round_even(avg(round_even({c} * 1e4, 0)), 0) / 1e4 AS {c}" for c in ("mean_excess", "median_excess", "hit_rate_percent"))} FROM tp GROUP BY 1, 2, 3""")
def _(v: Views):
    return backtest.top_summary(tops(v))


# Studies: the price model stands in for the screen's score.
SCREEN_SQL = SCORED_SQL + """, qs AS (SELECT period, ticker, CAST(5 - least(floor((row_number() OVER (PARTITION BY period ORDER BY score_v2 DESC, ticker) - 1) * 5
      / count(*) OVER (PARTITION BY period)), 4) AS INTEGER) AS quintile FROM so WHERE score_v2 IS NOT NULL AND NOT score_v2_excluded),
  ss AS (SELECT so.*, quintile, COALESCE(quintile >= 3, FALSE) AS in_screen, CASE WHEN COALESCE(quintile >= 3, FALSE) THEN 'screen' WHEN score_v2 IS NOT NULL THEN 'low_quintile'
    WHEN score_v2_excluded THEN 'rejected_by_filters' ELSE 'never_scored' END AS grp FROM so LEFT JOIN qs USING (period, ticker))"""
STUDY = ("score_v2", "technical_score", "v2_momentum_long", "v2_volatility")
PAIRS = 25


def screened(v: Views, columns, plan=lambda rows, dealt: rows):
    """``plan(rows, dealt)`` of the observations in the screen; it keeps to the periods."""
    def passed(rows, dealt):
        found = studies.with_screen(rows, "score_v2", dealt=dealt).where("in_screen")
        return plan(found if dealt else cut(found), dealt)

    return by_period(v, columns, passed)


def study_outcomes(v: Views, horizons=("3M", "1Y"), plan=lambda long, dealt: long):
    def unpivoted(rows, dealt):
        long = backtest.outcomes(rows, STUDY, horizons)
        return plan(long if dealt else cut(long), dealt)

    return screened(v, [*STUDY, *measures(horizons)], unpivoted)


def study_series(v: Views, horizons=("3M", "1Y")):
    return study_outcomes(v, horizons, lambda long, dealt: studies.signal_series(long, PAIRS, dealt))


@register("x32_screen_groups", VIEWS, "WITH " + SCREEN_SQL + """ SELECT period, ticker, quintile, grp AS "group" FROM ss""")
def _(v: Views):
    return by_period(v, [], lambda rows, dealt: studies.label_groups(rows, "score_v2", dealt)).select("period", "ticker", "quintile", "group")


STUDY_SQL = SCREEN_SQL + ", sn AS (SELECT * FROM ss WHERE in_screen), " + long_sql("sn", STUDY, ("3M", "1Y")) + ", " + ic_sql("lg", "period, horizon, col", PAIRS)


@register("a22_screen_ic_series", VIEWS, "WITH " + STUDY_SQL + f""" SELECT lg.period, lg.horizon, lg.col AS "column", {r('count(score) / count(*)', 6)} AS coverage,
    {r('max(ic)', 6)} AS ic FROM lg LEFT JOIN ic USING (period, horizon, col) GROUP BY 1, 2, 3""")
def _(v: Views):
    return study_series(v).select(
        "period", "horizon", "column", half_even("coverage", 6).alias("coverage"), half_even("ic", 6).alias("ic"))


WINDOW_SQL = STUDY_SQL + f", wd AS (SELECT *, CASE WHEN period < '{SPLIT}' THEN 'fit' ELSE 'holdout' END AS win FROM ic WHERE horizon = '3M'), " + newey_west_sql("wd", "col, win", "ic", 2)


@register("a23_fit_holdout_windows", VIEWS, "WITH " + WINDOW_SQL + f""" SELECT col AS "column", win AS "window", periods, {r('mean', 6)} AS mean, {r('t', 4)} AS t FROM nw""")
def _(v: Views):
    series = study_series(v, ("3M",))
    return studies.windows(series, "3M", SPLIT).select(
        "column", "window", "periods", half_even("mean", 6).alias("mean"), half_even("t", 4).alias("t"))


@register("x22_signal_verdicts", VIEWS, "WITH " + WINDOW_SQL + f""", wv AS (SELECT col, max(CASE WHEN win = 'fit' THEN mean END) AS fm, max(CASE WHEN win = 'holdout' THEN mean END) AS hm,
    max(CASE WHEN win = 'fit' THEN t END) AS ft, max(CASE WHEN win = 'holdout' THEN t END) AS ht FROM nw GROUP BY 1)
  SELECT col AS "column", {r('fm', 6)} AS fit_mean, {r('hm', 6)} AS holdout_mean, CASE WHEN fm IS NULL OR hm IS NULL OR ft IS NULL OR ht IS NULL OR sign(fm) <> sign(hm) OR fm = 0 THEN 'no'
    ELSE ['no', 'suggestive', 'separates'][1 + CAST(abs(ft) >= 1 AND sign(ft) = sign(fm) AS INTEGER) + CAST(abs(ht) >= 1 AND sign(ht) = sign(fm) AS INTEGER)] END AS verdict FROM wv""")
def _(v: Views):
    series = study_series(v, ("3M",))
    return studies.verdicts(studies.windows(series, "3M", SPLIT), threshold=1.0).select(
        "column", half_even("fit_mean", 6).alias("fit_mean"), half_even("holdout_mean", 6).alias("holdout_mean"), "verdict")


@register("a24_half_split", VIEWS, "WITH " + STUDY_SQL + f""", hs AS (SELECT *, (rank() OVER (PARTITION BY period, horizon, col ORDER BY score)
      + (count(*) OVER (PARTITION BY period, horizon, col, score) - 1) / 2.0) / count(*) OVER (PARTITION BY period, horizon, col) AS pr,
      count(*) OVER (PARTITION BY period, horizon, col) AS n FROM lg WHERE score IS NOT NULL),
  hp AS (SELECT period, horizon, col, quantile_cont(CASE WHEN pr > 0.5 THEN excess END, 0.5) AS bm, quantile_cont(CASE WHEN pr <= 0.5 THEN excess END, 0.5) AS wm,
    avg(CASE WHEN pr > 0.5 THEN CASE WHEN excess > 0 THEN 100.0 ELSE 0 END END) AS bw, avg(CASE WHEN pr <= 0.5 THEN CASE WHEN excess > 0 THEN 100.0 ELSE 0 END END) AS ww
    FROM hs WHERE n >= {PAIRS} GROUP BY 1, 2, 3 HAVING min(score) < max(score))
  SELECT horizon, col AS "column", CASE WHEN period < '{SPLIT}' THEN 'fit' ELSE 'holdout' END AS "window", {r('avg(bm)', 4)} AS better_median_excess,
    {r('avg(wm)', 4)} AS worse_median_excess, {r('avg(bw)', 4)} AS better_win_rate, {r('avg(ww)', 4)} AS worse_win_rate FROM hp WHERE bm IS NOT NULL AND wm IS NOT NULL GROUP BY 1, 2, 3""")
def _(v: Views):
    return studies.half_split(cut(study_outcomes(v)), None, PAIRS, SPLIT).select("horizon", "column", "window", *[
        half_even(c, 4).alias(c) for c in ("better_median_excess", "worse_median_excess", "better_win_rate", "worse_win_rate")])


@register("a25_year_agreement", VIEWS, "WITH " + STUDY_SQL + """, yy AS (SELECT col, substr(period, 1, 4) AS y, avg(ic) AS ic FROM ic WHERE horizon = '3M' AND ic IS NOT NULL GROUP BY 1, 2)
  SELECT col AS "column", count(*) AS years, CAST(sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_years,
    CAST(sum(CASE WHEN ic < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_years FROM yy GROUP BY 1""")
def _(v: Views):
    return studies.yearly_agreement(study_series(v, ("3M",)), "3M")


@register("a26_within_correlation", VIEWS, "WITH " + SCREEN_SQL + """, lg AS (SELECT period, 'technical_score' AS first, 'score_v2' AS second, technical_score AS score, score_v2 AS excess FROM ss WHERE in_screen
    UNION ALL SELECT period, 'v2_volatility', 'market_cap', v2_volatility, market_cap FROM ss WHERE in_screen), """ + ic_sql("lg", "period, first, second", PAIRS) + f"""
  SELECT first, second, count(*) AS periods, {r('avg(ic)', 6)} AS mean_correlation FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2""")
def _(v: Views):
    pairs = [("technical_score", "score_v2"), ("v2_volatility", "market_cap")]
    series = screened(v, [name for pair in pairs for name in pair], lambda rows, dealt: studies.within_periods(rows, pairs, PAIRS, dealt))
    return studies.within_correlation(series).withColumn(
        "mean_correlation", half_even("mean_correlation", 6))


@register("a27_group_comparison", VIEWS, "WITH " + SCREEN_SQL + f""", gm AS (SELECT period, grp, count(*) AS n, quantile_cont(excess_3M, 0.5) AS md,
    avg(CASE WHEN excess_3M > 0 THEN 100.0 ELSE 0 END) AS wr, avg(excess_3M) AS mn FROM ss WHERE excess_3M IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10),
  gj AS (SELECT g.*, s.md AS sm, s.wr AS sw, CASE WHEN g.period < '{SPLIT}' THEN 'fit' ELSE 'holdout' END AS win FROM gm g LEFT JOIN gm s ON s.period = g.period AND s.grp = 'screen')
  SELECT grp AS "group", win AS "window", count(*) AS periods, {r('avg(md)', 4)} AS median_excess, {r('avg(wr)', 4)} AS win_rate, {r('avg(mn)', 4)} AS mean_excess,
    count(sm) AS compared_periods, {r('avg(md - sm)', 4)} AS median_minus_screen, {r('avg(wr - sw)', 4)} AS win_rate_minus_screen,
    CAST(sum(CASE WHEN md > sm THEN 1 WHEN md <= sm THEN 0 END) AS BIGINT) AS periods_median_above_screen FROM gj GROUP BY 1, 2""")
def _(v: Views):
    labelled = cut(by_period(v, ["excess_3M"], lambda rows, dealt: studies.label_groups(rows, "score_v2", dealt)))
    out = studies.group_comparison(labelled, "3M", SPLIT)
    return out.select("group", "window", "periods", "compared_periods", "periods_median_above_screen", *[
        half_even(c, 4).alias(c) for c in ("median_excess", "win_rate", "mean_excess", "median_minus_screen", "win_rate_minus_screen")])


CHANGE = {"v2_short_term_reversal": None, "v2_volume_trend": 25.0}
CHANGED = studies.apply_change(MODEL, CHANGE)


@register("p06_paired_model_test", VIEWS, "WITH " + OBS_SQL + ", " + score_sql("obs", "period", "ticker", MODEL, "sa") + ", "
          + score_sql("obs", "period", "ticker", CHANGED, "sb") + """, pb AS (SELECT obs.*, sa.score_v2 AS base, sb.score_v2 AS changed FROM obs JOIN sa USING (period, ticker) JOIN sb USING (period, ticker)), """
          + long_sql("pb", ("base", "changed"), ("3M", "1M")) + ", " + ic_sql("lg", "period, horizon, col", PAIRS) + f""",
  df AS (SELECT period, horizon, CASE WHEN period < '{SPLIT}' THEN 'fit' ELSE 'holdout' END AS win, max(CASE WHEN col = 'changed' THEN ic END) - max(CASE WHEN col = 'base' THEN ic END) AS x FROM ic GROUP BY 1, 2),
  d3 AS (SELECT * FROM df WHERE horizon = '3M'), """ + newey_west_sql("d3", "horizon, win", "x", 2) + ", n3 AS (SELECT * FROM nw), d1 AS (SELECT * FROM df WHERE horizon = '1M'), "
          + newey_west_sql("d1", "horizon, win", "x", 0).replace("nd AS", "nd1 AS").replace("FROM nd)", "FROM nd1)").replace("nl AS", "nl1 AS").replace("FROM nl ", "FROM nl1 ").replace("nw AS", "n1 AS")
          + f""" SELECT horizon, win AS "window", periods, {r('mean', 6)} AS mean_difference, {r('t', 4)} AS newey_west_t FROM (SELECT * FROM n3 UNION ALL SELECT * FROM n1)""")
def _(v: Views):
    out = studies.paired_test(cut(observed(v)), MODEL, CHANGE, ("3M", "1M"), PAIRS, SPLIT)
    return out.select("horizon", "window", "periods", half_even("mean_difference", 6).alias("mean_difference"),
                      half_even("newey_west_t", 4).alias("newey_west_t"))


@register("p07_tiebreaker", VIEWS, "WITH " + SCREEN_SQL + f""", tl AS (
    SELECT period, ticker, 'a' AS s, v2_volatility * -1 AS x FROM ss WHERE in_screen AND v2_volatility IS NOT NULL
    UNION ALL SELECT period, ticker, 'b', v2_momentum_long FROM ss WHERE in_screen AND v2_momentum_long IS NOT NULL),
  tr AS (SELECT period, ticker, (rank() OVER (PARTITION BY period, s ORDER BY x) + (count(*) OVER (PARTITION BY period, s, x) - 1) / 2.0) / count(*) OVER (PARTITION BY period, s) AS pr FROM tl)
  SELECT sn.period, sn.ticker, {r('COALESCE(avg(pr), 0.5)', 6)} AS tiebreaker FROM (SELECT * FROM ss WHERE in_screen) sn LEFT JOIN tr USING (period, ticker) GROUP BY 1, 2""")
def _(v: Views):
    return studies.tiebreaker(cut(screened(v, [])), {"v2_volatility": -1.0, "v2_momentum_long": 1.0}).select(
        "period", "ticker", half_even("tiebreaker", 6).alias("tiebreaker"))
