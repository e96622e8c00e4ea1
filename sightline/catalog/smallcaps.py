"""Small-cap and exit queries: F21, X16-X18, R5, A35, A49, J13, X20, A29."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog.quotes import quotes
from sightline.catalog.registry import register
from sightline.catalog.rows import CLASS_SQL
from sightline.catalog.views import Views, r
from sightline.operators import exits, rules, smallcap
from sightline.session import cut


def candidates(v: Views):
    """Quotes scaled into the small-cap band, with price-risk figures derived from the key."""
    base = rules.classify_asset(quotes(v)).withColumns({
        "market_cap": F.col("market_cap") / 10, "average_dollar_volume_30d": F.col("volume"),
        "annualized_volatility_percent": F.when(F.col("ticker") % 6 != 0, (F.col("ticker") * 7 % 150).cast("double")),
        "maximum_drawdown_percent": (F.col("ticker") * 11 % 90).cast("double"),
        "dilution_percent": F.when(F.col("ticker") % 4 != 0, (F.col("ticker") * 3 % 120).cast("double")),
        "reverse_split_count_1y": (F.col("ticker") % 3).cast("double"),
        "usable": F.coalesce(F.col("age_days") <= 550, F.lit(True)),
        "quality_ratio": F.when(F.col("age_days").isNull(), 0.75).when(F.col("age_days") <= 550, 1.0).otherwise(0.0)})
    return smallcap.eligible(base)


def classified(v: Views):
    return cut(smallcap.classify(cut(smallcap.factor_shares(candidates(v)))).select(
        "ticker", "country", "sector", "size_tier", "classification", "upside_score", "risk_of_ruin_score", "confidence", "market_risk_confidence"))


def _ladder(value: str, steps, compare: str, last: str = "0") -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL " + " ".join(f"WHEN {value} {compare} {b} THEN {s}" for b, s in steps) + f" ELSE {last} END"


SHARES = {
    "u_revenue_growth": _ladder("g", ((.5, 1), (.3, .8), (.15, .55), (0, .2)), ">="), "u_earnings_growth": _ladder("e", ((.5, 1), (.3, .8), (.15, .55), (0, .2)), ">="),
    "u_profitability": _ladder("m", ((.2, 1), (.1, .75), (0, .45), (-.1, .2)), ">="), "u_cash_generation": _ladder("(o / cap)", ((.2, 1), (.1, .75), (0, .4)), ">="),
    "u_sales_valuation": _ladder("ps", ((1, 1), (2, .75), (4, .4)), "<="), "u_market_cap_headroom": "CASE WHEN cap < 1e7 THEN 1 WHEN cap < 2.5e7 THEN .67 ELSE .33 END",
    "r_size_fragility": "CASE WHEN cap < 5e6 THEN 1 WHEN cap < 1e7 THEN .67 WHEN cap < 2.5e7 THEN .33 ELSE .13 END",
    "r_cash_runway": "CASE WHEN c IS NULL OR f IS NULL THEN NULL WHEN f >= 0 OR c / -f >= 2 THEN 0 WHEN c / -f >= 1 THEN .33 WHEN c / -f >= .5 THEN .67 ELSE 1 END",
    "r_balance_sheet": "CASE WHEN NOT fin THEN " + _ladder("((d - c) / cap)", ((.75, 1), (.25, .6), (0, .25)), ">") + " END",
    "r_profitability": _ladder("m", ((0, 0), (-.1, .33), (-.3, .67)), ">=", "1"), "r_leverage": "CASE WHEN NOT fin THEN " + _ladder("l", ((150, 1), (75, .6), (25, .3)), ">") + " END",
    "r_disclosure_gaps": "gaps / 7.0::DOUBLE", "r_liquidity": _ladder("volume", ((25000, 1), (100000, .75), (250000, .5), (1000000, .25)), "<="),
    "r_volatility": _ladder("vol", ((120, 1), (80, .75), (50, .4), (30, .15)), ">"), "r_maximum_drawdown": _ladder("dd", ((70, 1), (50, .75), (30, .4), (15, .15)), ">"),
    "r_dilution": _ladder("dil", ((100, 1), (50, .75), (20, .4), (5, .15)), ">"), "r_reverse_splits": _ladder("rs", ((2, 1), (1, .75)), ">="),
}


def _total(prefix: str, weights) -> str:
    points = " + ".join(f"COALESCE({r(f'CAST({prefix}{n} AS DOUBLE) * {w}', 2)}, 0)" for n, w in weights.items())
    known = " + ".join(f"CASE WHEN {prefix}{n} IS NOT NULL THEN {w} ELSE 0 END" for n, w in weights.items())
    applicable = " + ".join(f"CASE WHEN fin THEN 0 ELSE {w} END" if prefix == "r_" and n in ("balance_sheet", "leverage") else str(w) for n, w in weights.items())
    sure = " + ".join(f"CASE WHEN {prefix}{n} IS NOT NULL THEN {w} * {'1' if n in smallcap.MARKET_FACTORS and prefix == 'r_' else 'q'} ELSE 0 END" for n, w in weights.items())
    return f"COALESCE({r(f'({points}) / nullif(({known})::DOUBLE, 0) * 100', 2)}, 0) AS {prefix}score, {r(f'({sure})::DOUBLE / ({applicable})::DOUBLE * 100', 2)} AS {prefix}conf"


SMALL_SQL = CLASS_SQL + f""", b0 AS (SELECT *, market_cap / 10 AS cap, COALESCE(age_days <= 550, TRUE) AS ok, CASE WHEN age_days IS NULL THEN 0.75 WHEN age_days <= 550 THEN 1.0 ELSE 0.0 END::DOUBLE AS q, sector LIKE '%Financial%' AS fin,
    CASE WHEN ticker % 6 <> 0 THEN CAST(ticker * 7 % 150 AS DOUBLE) END AS vol, CAST(ticker * 11 % 90 AS DOUBLE) AS dd, CASE WHEN ticker % 4 <> 0 THEN CAST(ticker * 3 % 120 AS DOUBLE) END AS dil, CAST(ticker % 3 AS DOUBLE) AS rs,
    CAST(revenue_growth IS NULL AS INTEGER) + CAST(earnings_growth IS NULL AS INTEGER) + CAST(free_cash_flow IS NULL AS INTEGER) + CAST(total_cash IS NULL AS INTEGER) + CAST(total_debt IS NULL AS INTEGER) + CAST(price_to_sales IS NULL AS INTEGER) + CAST(COALESCE(operating_margin, profit_margin) IS NULL AS INTEGER) AS gaps
    FROM pf WHERE asset_type = 'operating_equity' AND upper(COALESCE(quote_type, '')) = 'EQUITY' AND market_cap / 10 BETWEEN 2e6 AND 5e7),
  b1 AS (SELECT *, CASE WHEN ok THEN revenue_growth END AS g, CASE WHEN ok THEN earnings_growth END AS e, CASE WHEN ok THEN COALESCE(operating_margin, profit_margin) END AS m, CASE WHEN ok THEN operating_cash_flow END AS o,
    CASE WHEN ok AND price_to_sales > 0 THEN price_to_sales END AS ps, CASE WHEN ok THEN total_cash END AS c, CASE WHEN ok THEN total_debt END AS d, CASE WHEN ok THEN free_cash_flow END AS f, CASE WHEN ok THEN debt_to_equity END AS l FROM b0),
  b2 AS (SELECT ticker, country, sector, cap, fin, q, {", ".join(f"{e} AS {n}" for n, e in SHARES.items())} FROM b1),
  b3 AS (SELECT ticker, country, sector, cap, {_total('u_', smallcap.UPSIDE_WEIGHTS)}, {_total('r_', smallcap.RISK_WEIGHTS)}, {r(f"({' + '.join(f'CASE WHEN r_{n} IS NOT NULL THEN {smallcap.RISK_WEIGHTS[n]} ELSE 0 END' for n in smallcap.MARKET_FACTORS)})::DOUBLE / 30 * 100", 2)} AS mk FROM b2),
  b4 AS (SELECT *, least(u_conf, r_conf) AS sure, CASE WHEN least(u_conf, r_conf) < 50 THEN 'insufficient_evidence' WHEN mk < 70 THEN 'market_data_required' WHEN least(u_conf, r_conf) >= 80 AND u_score >= 75 AND r_score <= 35 THEN 'priority_research'
    WHEN u_score >= 60 AND r_score <= 55 THEN 'asymmetric_watch' WHEN u_score >= 70 THEN 'speculative_watch' ELSE 'low_upside_signal' END AS classification FROM b3)"""


@register("x16_smallcap_scores", "xs quotes", "WITH " + SMALL_SQL + " SELECT ticker, u_score AS upside_score, r_score AS risk_of_ruin_score, sure AS confidence, classification FROM b4")
def _(v: Views):
    return classified(v).select("ticker", "upside_score", "risk_of_ruin_score", "confidence", "classification")


@register("r05_smallcap_rank", "xs quotes", "WITH " + SMALL_SQL + """ SELECT ticker, row_number() OVER (ORDER BY CASE classification WHEN 'priority_research' THEN 0 WHEN 'asymmetric_watch' THEN 1 WHEN 'speculative_watch' THEN 2 WHEN 'low_upside_signal' THEN 3 WHEN 'market_data_required' THEN 4 ELSE 5 END,
    u_score DESC, r_score, sure DESC, ticker) AS rank FROM b4""")
def _(v: Views):
    return smallcap.rank(classified(v)).select("ticker", "rank")


@register("a35_selection_rates", "xs quotes", "WITH " + SMALL_SQL + """ SELECT country, count(*) AS total, count(*) FILTER (classification IN ('priority_research', 'asymmetric_watch', 'speculative_watch')) AS selected,
    round_even(count(*) FILTER (classification IN ('priority_research', 'asymmetric_watch', 'speculative_watch'))::DOUBLE / count(*) * 10000, 0) / 100 AS selection_rate_percent FROM b4 GROUP BY 1""")
def _(v: Views):
    return smallcap.selection_rates(classified(v), "country")


EXIT_SQL = """nt AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderpriority = '1-URGENT'),
  ex AS (SELECT cik, max(filed) AS exit_date, count(*) AS notices FROM nt WHERE filed BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = cik AND c_acctbal > 5000) GROUP BY 1)"""


def exit_rows(v: Views):
    notices = v.table("orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("filed"))
    current = v.table("customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("cik"))
    return exits.delisted_candidates(notices, current, "1996-01-01", "2000-12-31")


@register("j13_delisted_candidates", "", "WITH " + EXIT_SQL + " SELECT cik, CAST(exit_date AS VARCHAR) AS exit_date, notices FROM ex")
def _(v: Views):
    return exit_rows(v).withColumn("exit_date", F.col("exit_date").cast("string"))


@register("x20_exit_type", "", "WITH " + EXIT_SQL + """, fl AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS filed, o_orderkey % 9 AS k FROM orders),
  jx AS (SELECT ex.cik, bool_or(k = 1 AND filed - exit_date BETWEEN -730 AND 60) AS b, bool_or(k = 2 AND filed - exit_date BETWEEN -365 AND 30) AS m, bool_or(k = 3 AND filed - exit_date BETWEEN -60 AND 30) AS c, bool_or(k = 4 AND filed - exit_date BETWEEN -365 AND 0) AS n FROM ex JOIN fl USING (cik) GROUP BY 1)
  SELECT cik, CASE WHEN b THEN 'bankruptcy' WHEN m OR c THEN 'acquired' WHEN n THEN 'delisted_noncompliance' ELSE 'other' END AS exit_type FROM jx""")
def _(v: Views):
    kind = F.col("o_orderkey") % 9
    item = F.when(kind == 1, "1.03").when(kind == 3, "5.01").when(kind == 4, "3.01").otherwise("9.01")
    filings = v.table("orders").select(F.col("o_custkey").alias("cik"), F.when(kind == 2, "DEFM14A").otherwise("8-K").alias("form"),
                                       F.to_date("o_orderdate").alias("filed"), F.array(item).alias("items"))
    return exits.classify_exits(exit_rows(v), filings).select("cik", "exit_type")
