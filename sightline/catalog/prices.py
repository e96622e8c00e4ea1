"""Price-bar queries: S4-S6, W1-W23, X1-X3, J2, J3, J8."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from sightline import config as C
from sightline.catalog.registry import register
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.operators import asof, price_report, prices
from sightline.session import cut

FEATURES_SQL = f"""pf AS (
  SELECT ticker, d, close, volume, rn AS sessions,
    {r('CASE WHEN rn >= 200 AND rn > 240 THEN c21 / c240 - 1 END', 6)} AS v2_momentum_long,
    {r('CASE WHEN rn >= 200 AND rn > 126 THEN c21 / c126 - 1 END', 6)} AS v2_momentum_medium,
    {r('CASE WHEN rn >= 200 THEN close / c21 - 1 END', 6)} AS v2_short_term_reversal,
    {r('CASE WHEN rn >= 240 THEN close / hi END', 6)} AS v2_high_proximity,
    {r('CASE WHEN rn >= 200 THEN sd * sqrt(252.0) END', 6)} AS v2_volatility,
    {r('CASE WHEN rn >= 240 THEN v21 / v240 END', 6)} AS v2_volume_trend,
    {r('CASE WHEN rn >= 90 THEN v30 / v90 END', 6)} AS volume_ratio,
    {r('CASE WHEN rn >= 126 THEN (close - c125) / c125 * 100 END', 6)} AS period_return,
    {r('v30 * m30', 6)} AS average_dollar_volume_30d,
    {r('CASE WHEN rn >= 200 THEN m50 END', 7)} AS sma_short,
    {r('CASE WHEN rn >= 200 THEN m200 END', 7)} AS sma_long
  FROM (SELECT *,
      lag(close, 21) OVER o AS c21, lag(close, 125) OVER o AS c125, lag(close, 126) OVER o AS c126,
      lag(close, 240) OVER o AS c240, row_number() OVER o AS rn,
      max(close) OVER (o ROWS 239 PRECEDING) AS hi,
      stddev_samp(lr) OVER (o ROWS 62 PRECEDING) AS sd,
      avg(volume) OVER (o ROWS 20 PRECEDING) AS v21, avg(volume) OVER (o ROWS 239 PRECEDING) AS v240,
      avg(volume) OVER (o ROWS 29 PRECEDING) AS v30, avg(volume) OVER (o ROWS 89 PRECEDING) AS v90,
      avg(close) OVER (o ROWS 29 PRECEDING) AS m30, avg(close) OVER (o ROWS 49 PRECEDING) AS m50,
      avg(close) OVER (o ROWS 199 PRECEDING) AS m200
    FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY d)) AS lr FROM px) q
    WINDOW o AS (PARTITION BY ticker ORDER BY d)) w)"""

LAST_SQL = FEATURES_SQL + """, last AS (
  SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1)"""


def features(v: Views):
    return prices.price_features(v.bars)


def latest(frame):
    rest = [name for name in frame.columns if name not in ("ticker", "d")]
    return frame.groupBy("ticker").agg(F.max_by(F.struct("d", *rest), "d").alias("x")).select("ticker", "x.*")


def monthly(frame):
    """The last session of each month per security. Select what is asked first: all columns given are worked out and kept."""
    month = F.struct(F.trunc("d", "month"))
    following = F.lead(month).over(Window.partitionBy("ticker").orderBy("d"))
    return frame.withColumn("__last", ~following.eqNullSafe(month)).where("__last").drop("__last")


MONTHLY = "SELECT ticker, CAST(d AS VARCHAR) AS d, {cols} FROM pf QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', d) ORDER BY d DESC) = 1"


def _feature_query(name: str, columns: list[str]) -> None:
    @register(name, "px", "WITH " + FEATURES_SQL + " " + MONTHLY.format(cols=", ".join(columns)))
    def plan(v: Views):
        return monthly(features(v).select("ticker", "d", *columns)).withColumn("d", F.col("d").cast("string"))


_feature_query("w01_window_return", ["v2_momentum_long", "v2_momentum_medium", "v2_short_term_reversal"])
_feature_query("w02_high_proximity", ["v2_high_proximity"])
_feature_query("w03_annualized_volatility", ["v2_volatility"])
_feature_query("w04_volume_trend", ["v2_volume_trend"])
_feature_query("w05_price_signals", [f"v2_{name}" for name in C.PRICE_SIGNALS])
_feature_query("w06_average_dollar_volume", ["average_dollar_volume_30d"])
_feature_query("w07_period_return", ["period_return"])


# A split and an incomplete bar are derived from the panel: a close at least
# double the one before counts as a split, a bar of volume 1..3 as incomplete.
def split_bars(v: Views):
    own = Window.partitionBy("ticker").orderBy("d")
    jump = F.lag("close").over(own) / F.col("close")
    return v.bars.withColumn(
        "split", F.when((jump >= 1.6) | (jump <= 0.5), half_even(jump, 1)).otherwise(0.0),
    )


SPLITS_SQL = """sb AS (SELECT *, CASE WHEN j >= 1.6 OR j <= 0.5 THEN round_even(j * 10, 0) / 10 ELSE 0.0 END AS split
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY d) / close AS j FROM px) q)"""


@register("s04_drop_incomplete_bars", "px", f"""WITH {SPLITS_SQL},
  t AS (SELECT ticker, d, CASE WHEN volume > 5 THEN close END AS close, split FROM sb),
  k AS (SELECT *, COALESCE(
      (SELECT min(d) FROM t n WHERE n.ticker = t.ticker AND n.d >= t.d AND n.close IS NOT NULL),
      (SELECT max(d) FROM t n WHERE n.ticker = t.ticker AND n.close IS NOT NULL)) AS target FROM t),
  p AS (SELECT ticker, target AS d, product(split) AS split FROM k WHERE split <> 0 GROUP BY 1, 2)
  SELECT t.ticker, CAST(t.d AS VARCHAR) AS d, t.close, {r('COALESCE(p.split, 0)', 6)} AS split
  FROM t LEFT JOIN p ON p.ticker = t.ticker AND p.d = t.d WHERE t.close IS NOT NULL""")
def _(v: Views):
    bars = split_bars(v).withColumn("close", F.when(F.col("volume") > 5, F.col("close")))
    return prices.drop_incomplete_bars(bars).select(
        "ticker", F.col("d").cast("string").alias("d"), "close", half_even("split", 6).alias("split"))


@register("s05_normalise_history", "", """WITH raw AS (
    SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d,
      CASE WHEN l_discount > 0 THEN l_extendedprice / l_quantity ELSE 0 END AS close,
      CASE WHEN l_tax > 0.01 THEN l_quantity END AS volume, l_orderkey * 8 + l_linenumber AS seq FROM lineitem)
  SELECT ticker, CAST(d AS VARCHAR) AS d, close, COALESCE(volume, 0) AS volume FROM raw WHERE close > 0
  QUALIFY row_number() OVER (PARTITION BY ticker, d ORDER BY seq DESC, close DESC, volume DESC) = 1""")
def _(v: Views):
    raw = v.table("lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("at"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / F.col("l_quantity")).otherwise(0.0)
        .cast("string").alias("close"),
        F.when(F.col("l_tax") > 0.01, F.col("l_quantity")).cast("string").alias("volume"),
        F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("a"), F.when(
            F.col("l_discount") > 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("b"), F.when(
            F.col("l_tax") > 0.01, F.col("l_quantity")).alias("c")).alias("seq"),
    )
    return prices.normalise_history(raw, "seq").withColumn("d", F.col("d").cast("string"))


# Daily open/high/low from the day's trades.
def ohlc(v: Views):
    trades = v.table("lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("d"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), "l_quantity", "l_discount",
    )
    key = F.struct("seq", "p")
    return trades.groupBy("ticker", "d").agg(
        F.min_by("p", key).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", key).alias("close"), F.sum("l_quantity").alias("volume"),
        half_even(F.max("l_discount"), 2).alias("dividend"),
    )


OHLC_SQL = f"""tr AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d,
    l_extendedprice / l_quantity AS p, l_orderkey * 8 + l_linenumber AS seq, l_quantity, l_discount
    FROM lineitem),
  oh AS (SELECT ticker, d, first(p ORDER BY seq, p) AS open, max(p) AS high, min(p) AS low,
    last(p ORDER BY seq, p) AS close, sum(l_quantity) AS volume, {r('max(l_discount)', 2)} AS dividend
    FROM tr GROUP BY 1, 2)"""


@register("s06_clean_points", "", f"""WITH {OHLC_SQL}
  SELECT ticker, CAST(d AS VARCHAR) AS d, {r('CASE WHEN open > 1000 THEN open - 1000 END', 6)} AS open, {r('high', 6)} AS high, {r('low', 6)} AS low, {r('close', 6)} AS close, volume,
    dividend, 0.0::DOUBLE AS split FROM oh""")
def _(v: Views):
    bars = ohlc(v).withColumn("open", F.col("open") - 1000).withColumn("split", F.lit(None).cast("double"))
    return prices.clean_points(bars).withColumn("d", F.col("d").cast("string"))


@register("w08_moving_averages", "px", f"""SELECT ticker, CAST(d AS VARCHAR) AS d,
    CASE WHEN rn >= 20 THEN {r('avg(close) OVER (o ROWS 19 PRECEDING)', 5)} END AS sma_20,
    CASE WHEN rn >= 50 THEN {r('avg(close) OVER (o ROWS 49 PRECEDING)', 5)} END AS sma_50,
    CASE WHEN rn >= 200 THEN {r('avg(close) OVER (o ROWS 199 PRECEDING)', 5)} END AS sma_200
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d) AS rn FROM px) q
  WINDOW o AS (PARTITION BY ticker ORDER BY d)""")
def _(v: Views):
    points = v.px
    for window in (20, 50, 200):
        points = price_report.moving_average(points, window, f"sma_{window}", digits=5)
    return points.select("ticker", F.col("d").cast("string").alias("d"), "sma_20", "sma_50", "sma_200")


@register("w09_exponential_average", "px", """WITH RECURSIVE n AS (
    SELECT ticker, d, close, row_number() OVER (PARTITION BY ticker ORDER BY d) AS rn,
      avg(close) OVER (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING) AS seed FROM px),
  e AS (SELECT ticker, rn, seed AS ema FROM n WHERE rn = 20
    UNION ALL SELECT n.ticker, n.rn, (n.close - e.ema) * (2.0::DOUBLE / 21) + e.ema
    FROM e JOIN n ON n.ticker = e.ticker AND n.rn = e.rn + 1)
  SELECT e.ticker, CAST(n.d AS VARCHAR) AS d, round_even(e.ema * 1e5, 0) / 1e5 AS ema FROM e JOIN n USING (ticker, rn)""")
def _(v: Views):
    return price_report.exponential_average(v.px, 20, digits=5).withColumn("d", F.col("d").cast("string"))


@register("w10_bollinger_bands", "px", f"""SELECT ticker, CAST(d AS VARCHAR) AS d,
    {r('m', 5)} AS middle, {r('m + 2 * s', 5)} AS upper, {r('m - 2 * s', 5)} AS lower
  FROM (SELECT *, avg(close) OVER o AS m, stddev_pop(close) OVER o AS s, count(*) OVER o AS n FROM px
    WINDOW o AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING)) q WHERE n = 20""")
def _(v: Views):
    return price_report.bollinger_bands(v.px, digits=5).withColumn("d", F.col("d").cast("string"))


ANOMALY_SQL = f"""an AS (SELECT ticker, d, p AS previous_close, close, {r('(close / p - 1) * 100', 2)} AS change_percent
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY d) AS p FROM px) q
  WHERE (close / p - 1) * 100 >= 300 OR (close / p - 1) * 100 <= -75)"""


@register("w11_period_returns", "px", f"""WITH {ANOMALY_SQL},
  l AS (SELECT ticker, max(d) AS ld, max_by(close, d) AS lc, count(*) AS n FROM px GROUP BY 1),
  t AS (SELECT l.*, period, CASE WHEN days = 0 THEN CAST(date_trunc('year', ld) AS DATE)
      ELSE CAST(ld - to_days(days) AS DATE) END AS target
    FROM l, (VALUES ('1W', 7), ('1M', 30), ('3M', 91), ('6M', 182), ('1Y', 365), ('YTD', 0)) p(period, days)),
  s AS (SELECT t.ticker, period, lc, n, min(px.d) AS sd, min_by(px.close, px.d) AS sc
    FROM t JOIN px ON px.ticker = t.ticker AND px.d >= t.target GROUP BY 1, 2, 3, 4),
  b AS (SELECT ticker, max(d) AS bd FROM an GROUP BY 1)
  SELECT s.ticker, period, CAST(sd AS VARCHAR) AS start_date,
    CASE WHEN COALESCE(bd > sd, FALSE) OR n < 2 THEN NULL ELSE {r('(lc / sc - 1) * 100', 2)} END AS period_return,
    NOT (COALESCE(bd > sd, FALSE) OR n < 2) AS reliable
  FROM s LEFT JOIN b ON b.ticker = s.ticker""")
def _(v: Views):
    return price_report.period_returns(v.px, price_report.anomalies(v.px)).withColumn(
        "start_date", F.col("start_date").cast("string"))


@register("w12_price_anomalies", "px", f"WITH {ANOMALY_SQL} SELECT ticker, CAST(d AS VARCHAR) AS d, previous_close, close, change_percent FROM an")
def _(v: Views):
    return price_report.anomalies(v.px).withColumn("d", F.col("d").cast("string"))


@register("w13_corporate_actions", "px", f"""WITH {SPLITS_SQL},
  m AS (SELECT *, CASE WHEN split <> 0 AND split <> 1 THEN
      CASE WHEN abs(ln(close / p * split)) <= ln(1.5) THEN 'verified_adjusted' ELSE 'reported_already_adjusted' END
    END AS event_status FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY d) AS p FROM sb) q),
  a AS (SELECT *, list(split) FILTER (event_status = 'verified_adjusted') OVER (PARTITION BY ticker ORDER BY d
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM m)
  SELECT ticker, CAST(d AS VARCHAR) AS d, split, event_status,
    CASE WHEN later IS NULL THEN close ELSE list_reduce(list_prepend(close, later),
      lambda x, y: round_even(x / y * 1e6, 0) / 1e6) END AS close,
    {r("CASE WHEN later IS NULL THEN volume ELSE list_reduce(list_prepend(volume, later), lambda x, y: x * y) END", 2)} AS volume FROM a""")
def _(v: Views):
    return price_report.adjust_corporate_actions(split_bars(v)).select(
        "ticker", F.col("d").cast("string").alias("d"), "split", "event_status", "close",
        half_even("volume", 2).alias("volume"))


@register("w14_rebased_series", "px bench listing", f"""WITH c AS (
    SELECT px.*, greatest(min(px.d) OVER (PARTITION BY px.ticker), b.bd) AS start FROM px
    JOIN listing USING (ticker) JOIN (SELECT benchmark, min(d) AS bd FROM bench GROUP BY 1) b USING (benchmark))
  SELECT ticker, CAST(d AS VARCHAR) AS d,
    {r('close / first_value(close) OVER (PARTITION BY ticker ORDER BY d) * 100', 3)} AS value FROM c WHERE d >= start""")
def _(v: Views):
    first = v.px.groupBy("ticker").agg(F.min("d").alias("own")).join(v.listing, "ticker").join(
        v.bench.groupBy("benchmark").agg(F.min("d").alias("bd")), "benchmark",
    ).select("ticker", F.greatest("own", "bd").alias("start"))
    return price_report.rebased(v.px.join(first, "ticker"), "start").withColumn("d", F.col("d").cast("string"))


@register("w15_valid_bars", "", f"""WITH {OHLC_SQL},
  b AS (SELECT *, CASE WHEN volume > 20 THEN open + 500 ELSE open END AS o2 FROM oh),
  g AS (SELECT ticker, count(*) AS point_count, CAST(sum(CASE WHEN low <= least(o2, close) AND high >= greatest(o2, close)
    AND low <= high THEN 1 ELSE 0 END) AS BIGINT) AS k FROM b GROUP BY 1)
  SELECT ticker, point_count, k AS ohlcv_point_count, {r('k / point_count * 100', 2)} AS ohlcv_coverage_percent, k >= 2 AS ohlcv FROM g""")
def _(v: Views):
    bars = ohlc(v).withColumn("open", F.when(F.col("volume") > 20, F.col("open") + 500).otherwise(F.col("open")))
    return price_report.bar_coverage(bars)


@register("w16_price_summary", "", f"""WITH {OHLC_SQL},
  b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM oh)
  SELECT ticker, CAST(max(d) AS VARCHAR) AS latest_date, {r('max(CASE WHEN k = 1 THEN close END)', 4)} AS latest_close,
    {r('(max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 2 THEN close END) - 1) * 100', 2)} AS daily_change,
    {r('max(high)', 4)} AS period_high, {r('min(low)', 4)} AS period_low, {r('avg(CASE WHEN k <= 30 THEN volume END)', 2)} AS average_volume_30d
  FROM b GROUP BY 1""")
def _(v: Views):
    return price_report.price_summary(ohlc(v)).withColumn("latest_date", F.col("latest_date").cast("string"))


RISK_SQL = f"""rk AS (SELECT ticker, count(*) AS price_observations, min(d) AS pf, max(d) AS pt,
    CASE WHEN count(CASE WHEN k <= 30 THEN close END) >= 20 THEN {r('avg(CASE WHEN k <= 30 THEN close * volume END)', 2)} END AS average_dollar_volume_30d,
    CASE WHEN count(*) >= 60 THEN {r('stddev_samp(rr) * sqrt(252.0) * 100', 2)} END AS annualized_volatility_percent,
    CASE WHEN count(*) >= 60 THEN {r('max(1 - close / peak) * 100', 2)} END AS maximum_drawdown_percent,
    CAST(sum(CASE WHEN split > 0 AND split < 1 THEN 1 ELSE 0 END) AS BIGINT) AS reverse_split_count_1y
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k,
    close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS rr,
    max(close) OVER (PARTITION BY ticker ORDER BY d) AS peak FROM sb) q GROUP BY 1)"""


@register("w17_maximum_drawdown", "px", f"WITH {SPLITS_SQL}, {RISK_SQL} SELECT ticker, maximum_drawdown_percent FROM rk")
def _(v: Views):
    return price_report.market_risk(split_bars(v)).select("ticker", "maximum_drawdown_percent")


@register("w18_volatility_dollar_volume", "px", f"""WITH {SPLITS_SQL}, {RISK_SQL}
  SELECT ticker, price_observations, average_dollar_volume_30d, annualized_volatility_percent FROM rk""")
def _(v: Views):
    return price_report.market_risk(split_bars(v)).select(
        "ticker", "price_observations", "average_dollar_volume_30d", "annualized_volatility_percent")


# Share counts: cumulative traded quantity at each month end stands for shares.
@register("w19_market_risk_snapshot", "px", f"""WITH {SPLITS_SQL}, {RISK_SQL},
  sh AS (SELECT ticker, d, sum(volume) OVER (PARTITION BY ticker ORDER BY d) AS shares FROM px
    QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('quarter', d) ORDER BY d DESC) = 1),
  sp AS (SELECT ticker, min(d) AS f, max(d) AS t, min_by(shares, d) AS a, max_by(shares, d) AS z FROM sh
    GROUP BY 1 HAVING count(*) >= 2 AND max(d) - min(d) >= 180),
  mm AS (SELECT sp.ticker, product(split) AS m FROM sp JOIN sb ON sb.ticker = sp.ticker AND sb.d > f AND sb.d <= t AND split > 0 GROUP BY 1),
  c AS (SELECT sp.ticker, {r('(z / (a * COALESCE(m, 1)) - 1) * 100', 2)} AS share_count_change_percent FROM sp LEFT JOIN mm USING (ticker))
  SELECT ticker, CAST(pf AS VARCHAR) AS price_start_date, CAST(pt AS VARCHAR) AS price_end_date, share_count_change_percent,
    CASE WHEN share_count_change_percent IS NOT NULL THEN greatest(share_count_change_percent, 0.0) END AS dilution_percent, reverse_split_count_1y,
    CASE WHEN average_dollar_volume_30d IS NOT NULL AND annualized_volatility_percent IS NOT NULL AND maximum_drawdown_percent IS NOT NULL
      THEN CASE WHEN share_count_change_percent IS NOT NULL THEN 'complete' ELSE 'price_only' END ELSE 'partial' END AS data_status
  FROM rk LEFT JOIN c USING (ticker)""")
def _(v: Views):
    own = Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    running = v.px.withColumn("shares", F.sum("volume").over(own))
    shares = running.groupBy("ticker", F.trunc("d", "quarter").alias("q")).agg(
        F.max_by(F.struct("d", "shares"), "d").alias("x")).select("ticker", "x.d", "x.shares")
    return price_report.market_risk(split_bars(v), shares).select(
        "ticker", F.col("price_start_date").cast("string").alias("price_start_date"),
        F.col("price_end_date").cast("string").alias("price_end_date"), "share_count_change_percent",
        "dilution_percent", "reverse_split_count_1y", "data_status")


@register("w20_split_factor", "px", f"""WITH {SPLITS_SQL},
  ev AS (SELECT ticker, d AS on_d, split FROM sb WHERE split > 0 AND split <> 1),
  q AS (SELECT ticker, max(d) AS boundary, CAST(max(d) + INTERVAL 60 DAY AS DATE) AS filed FROM px
    GROUP BY ticker, date_trunc('quarter', d)),
  f AS (SELECT q.ticker, boundary, product(split) AS f FROM q JOIN ev ON ev.ticker = q.ticker AND on_d > boundary GROUP BY 1, 2)
  SELECT q.ticker, CAST(q.boundary AS VARCHAR) AS boundary,
    {r('ln(COALESCE(CASE WHEN f > 0 AND isfinite(f) THEN f END, 1))', 6)} AS log_factor,
    EXISTS (SELECT 1 FROM ev WHERE ev.ticker = q.ticker AND on_d > q.boundary AND on_d <= filed) AS split_ambiguous
  FROM q LEFT JOIN f ON f.ticker = q.ticker AND f.boundary = q.boundary""")
def _(v: Views):
    events = prices.split_events(split_bars(v))
    asked = v.px.groupBy("ticker", F.trunc("d", "quarter").alias("q")).agg(F.max("d").alias("boundary")).drop("q")
    asked = asked.withColumn("filed", F.date_add("boundary", 60))
    both = prices.split_between(
        prices.split_factor_after(asked, events, "boundary"), events, "boundary", "filed")
    return both.select("ticker", F.col("boundary").cast("string").alias("boundary"),
                       half_even(F.log("split_factor"), 6).alias("log_factor"), "split_ambiguous")


MONTH_SQL = """me AS (SELECT benchmark, strftime(d, '%Y-%m') AS period, max(d) AS d FROM bench
    GROUP BY 1, 2 QUALIFY strftime(d, '%Y-%m') < max(strftime(d, '%Y-%m')) OVER (PARTITION BY benchmark))"""


@register("w21_month_ends", "bench", """SELECT benchmark, period, CAST(d AS VARCHAR) AS d FROM (
    SELECT *, max(period) OVER (PARTITION BY benchmark) AS lp FROM (
      SELECT benchmark, strftime(d, '%Y-%m') AS period, max(d) AS d FROM bench GROUP BY 1, 2) a) b WHERE period < lp""")
def _(v: Views):
    return prices.month_ends(v.bench).withColumn("d", F.col("d").cast("string"))


POINTS_SQL = f"""bf AS (SELECT benchmark, d, CASE WHEN row_number() OVER o >= 126 THEN
    {r('(close - lag(close, 125) OVER o) / lag(close, 125) OVER o * 100', 6)} END AS br FROM bench
    WINDOW o AS (PARTITION BY benchmark ORDER BY d)),
  tp AS (SELECT pf.*, benchmark, {r('period_return - br', 6)} AS relative_strength_6m FROM pf JOIN listing USING (ticker)
    LEFT JOIN bf USING (benchmark, d)),
  pts AS (SELECT *, CASE WHEN volume_ratio >= 3 THEN 25 WHEN volume_ratio >= 2 THEN 20 WHEN volume_ratio >= 1.5 THEN 14
      WHEN volume_ratio >= 1.2 THEN 8 ELSE 0 END AS volume_score,
    CASE WHEN relative_strength_6m >= 50 THEN 25 WHEN relative_strength_6m >= 30 THEN 20
      WHEN relative_strength_6m >= 15 THEN 14 WHEN relative_strength_6m >= 0 THEN 8 ELSE 0 END AS relative_strength_score,
    CASE WHEN close > sma_short AND close > sma_long THEN 15 WHEN close > sma_short OR close > sma_long THEN 7.95 ELSE 0 END AS trend_score,
    CASE WHEN average_dollar_volume_30d >= 5e6 THEN 10 WHEN average_dollar_volume_30d >= 1e6 THEN 7
      WHEN average_dollar_volume_30d >= 250000 THEN 4 ELSE 0 END AS liquidity_score FROM tp)"""


def technical(v: Views, strength: bool = True):
    """Technical points per (ticker, session) against the ticker's benchmark.

    If ``strength`` is asked for, the benchmarks are stored, so Spark knows that they are small and no session is shuffled to
    meet them; else nothing reads them.
    """
    bench = prices.price_features(v.bench.withColumn("volume", F.lit(0.0)), by="benchmark").select(
        "benchmark", "d", F.col("period_return").alias("benchmark_period_return"))
    joined = features(v).join(v.listing.select("ticker", "benchmark", "sector", "market_cap"), "ticker").join(
        cut(bench) if strength else bench, ["benchmark", "d"], "left")
    return prices.technical_points(joined)


for _name, _columns in {
    "x01_volume_acceleration": ["volume_ratio", "volume_score"],
    "x02_relative_strength": ["relative_strength_6m", "relative_strength_score"],
    "x03_trend_points": ["sma_short", "sma_long", "trend_score"],
}.items():
    def _plan(v: Views, columns=_columns):
        own = technical(v, "relative_strength_6m" in columns).select("ticker", "d", *columns)
        return monthly(own).select("ticker", F.col("d").cast("string").alias("d"), *[half_even(c, 6).alias(c) for c in columns])

    register(_name, "px bench listing", "WITH " + FEATURES_SQL + ", " + POINTS_SQL
             + " SELECT ticker, CAST(d AS VARCHAR) AS d, " + ", ".join(
                 f"{r(c, 6)} AS {c}" for c in _columns)
             + " FROM pts QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', d) ORDER BY d DESC) = 1")(_plan)


@register("j02_close_on_or_before", "px", """WITH q AS (
    SELECT ticker, CAST(max(d) + to_days(CAST(ticker % 15 AS INTEGER)) AS DATE) AS target FROM px GROUP BY ticker, date_trunc('month', d))
  SELECT q.ticker, CAST(target AS VARCHAR) AS target, CAST(max(px.d) AS VARCHAR) AS found_date, max_by(px.close, px.d) AS found_close
  FROM q LEFT JOIN px ON px.ticker = q.ticker AND px.d <= target AND px.d >= target - to_days(10) GROUP BY 1, 2""")
def _(v: Views):
    asked = v.px.groupBy("ticker", F.trunc("d", "month").alias("m")).agg(F.max("d").alias("last")).select(
        "ticker", F.date_add("last", (F.col("ticker") % 15).cast("int")).alias("target")).distinct()
    return asof.close_on_or_before(asked, v.px, "target", 10, prefix="found_").select(
        "ticker", F.col("target").cast("string").alias("target"),
        F.col("found_date").cast("string").alias("found_date"), "found_close")


@register("j03_calendar_alignment", "px bench listing", """SELECT ticker, CAST(c.d AS VARCHAR) AS d,
    last_value(px.close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY c.d ROWS 5 PRECEDING) AS aligned_close
  FROM listing JOIN (SELECT benchmark, d FROM bench) c USING (benchmark) LEFT JOIN px USING (ticker, d)""")
def _(v: Views):
    grid = asof.calendar_grid(v.listing.select("ticker", "benchmark"), v.bench.select("benchmark", "d"))
    joined = grid.join(v.px.select("ticker", "d", "close"), ["ticker", "d"], "left")
    return asof.forward_fill(joined, "ticker", "close", 5, "aligned_close").select(
        "ticker", F.col("d").cast("string").alias("d"), "aligned_close")


@register("j08_benchmark_lookup", "listing bench", """WITH h AS (SELECT benchmark, count(*) AS n FROM bench GROUP BY 1),
  t AS (SELECT ticker, CASE WHEN benchmark < 3 THEN benchmark ELSE 0 END AS b FROM listing)
  SELECT t.b AS benchmark, count(*) AS tickers, CAST(sum(CASE WHEN h.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_benchmark
  FROM t LEFT JOIN h ON h.benchmark = t.b AND h.benchmark <> 1 GROUP BY 1""")
def _(v: Views):
    # Countries 0-2 have their own benchmark, all others fall back to 0; benchmark 1 has no history.
    history = v.bench.where(F.col("benchmark") != 1).groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))
    mapping = F.create_map(*[F.lit(x) for pair in {0: 0, 1: 1, 2: 2}.items() for x in pair])
    chosen = v.listing.select("ticker", F.coalesce(F.try_element_at(mapping, F.col("benchmark")), F.lit(0)).alias("benchmark"))
    return chosen.join(history, "benchmark", "left").groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("tickers"), F.sum(F.col("n").isNull().cast("bigint")).alias("missing_benchmark"))
