"""Row-rule and queue queries: F1-F5, F8-F11, F20, X4-X10, X33, X35, X36, X41, J9, R1, R2, R9-R11, P1, P15, A1-A4."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import config as C
from sightline.catalog.quotes import quotes
from sightline.catalog.registry import register
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.operators import coverage, queue, rules

CLASS_SQL = """ac AS (SELECT *, CASE WHEN upper(trim(COALESCE(quote_type, ''))) IN ('ETF', 'MUTUALFUND', 'INDEX', 'FUTURE', 'OPTION', 'CRYPTOCURRENCY') THEN 'non_common_equity'
    WHEN lower(industry) LIKE '%shell companies%' THEN 'shell_company'
    WHEN regexp_matches(company_name, '\\b(acquisition|acquisitions) (corp(oration)?|co(mpany)?)\\b', 'i') THEN 'acquisition_vehicle'
    WHEN regexp_matches(company_name, '\\b(warrant|warrants|rights|units|preferred shares?)\\b', 'i') THEN 'non_common_equity' END AS blocked FROM quotes),
  pf AS (SELECT *, COALESCE(blocked, 'operating_equity') AS asset_type, CASE WHEN blocked IS NOT NULL THEN CASE blocked WHEN 'shell_company' THEN 'Excluded industry: Shell Companies'
      WHEN 'acquisition_vehicle' THEN 'Acquisition or SPAC vehicle' ELSE CASE WHEN upper(COALESCE(quote_type, '')) = 'ETF' THEN 'Excluded quote type: ETF' ELSE 'Non-common-equity security' END END
    WHEN market_cap IS NULL THEN 'Missing market cap' WHEN market_cap < 1e7 THEN 'Below minimum market cap' WHEN market_cap > 1e9 THEN 'Above maximum market cap' END AS filter_reason FROM ac)"""


@register("f01_asset_classification", "xs quotes", "WITH " + CLASS_SQL + " SELECT ticker, COALESCE(blocked, 'operating_equity') AS asset_type, blocked IS NULL AS asset_eligible FROM ac")
def _(v: Views):
    return rules.classify_asset(quotes(v)).select("ticker", "asset_type", "asset_eligible")


@register("f02_pre_filter", "xs quotes", "WITH " + CLASS_SQL + " SELECT ticker, filter_reason IS NULL AS passed, filter_reason FROM pf")
def _(v: Views):
    return rules.pre_filter(quotes(v)).select("ticker", "passed", "filter_reason")


@register("f05_liquidity_floor", "xs quotes", """WITH b AS (SELECT ticker, CASE WHEN ticker % 3 = 0 THEN NULL ELSE volume END AS adv,
    CASE WHEN ticker % 3 = 0 AND ticker % 2 = 0 THEN volume END AS fallback FROM quotes)
  SELECT ticker, round_even(COALESCE(adv, fallback) * 100, 0) / 100 AS adv, COALESCE(COALESCE(adv, fallback) >= 100000, FALSE) AS liquid FROM b""")
def _(v: Views):
    raw = quotes(v).select(
        "ticker", F.when(F.col("ticker") % 3 != 0, F.col("volume")).alias("stored"),
        F.when((F.col("ticker") % 3 == 0) & (F.col("ticker") % 2 == 0), F.to_json(F.struct(F.struct(
            F.col("volume").alias("raw_value")).alias("liquidity")))).alias("breakdown"))
    volume = rules.average_dollar_volume("stored", "breakdown")
    return raw.select("ticker", half_even(volume, 2).alias("adv"), rules.liquidity_eligible(volume, 100000.0).alias("liquid"))


@register("f08_investment_fund_type", "", """WITH f AS (SELECT o_custkey AS cik, CASE o_orderpriority WHEN '1-URGENT' THEN 'NPORT-P' WHEN '2-HIGH' THEN 'N-54A' WHEN '3-MEDIUM' THEN 'N-54C' ELSE '10-K' END AS form,
      CAST(o_orderdate AS DATE) AS filed FROM orders),
  d AS (SELECT cik, max(CASE WHEN form = 'NPORT-P' THEN filed END) AS rp, max(CASE WHEN form = 'N-54A' THEN filed END) AS el, max(CASE WHEN form = 'N-54C' THEN filed END) AS wd FROM f GROUP BY 1)
  SELECT cik, CASE WHEN DATE '2000-01-01' - rp <= 400 THEN 'closed_end_fund' WHEN el IS NOT NULL AND NOT COALESCE(wd >= el, FALSE) THEN 'business_development_company' END AS investment_fund FROM d""")
def _(v: Views):
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "NPORT-P").when(F.col("o_orderpriority") == "2-HIGH", "N-54A") \
        .when(F.col("o_orderpriority") == "3-MEDIUM", "N-54C").otherwise("10-K")
    forms = v.table("orders").select(F.col("o_custkey").alias("cik"), form.alias("form"), F.to_date("o_orderdate").alias("filed"),
                                     F.lit("2000-01-01").cast("date").alias("retrieved"))
    return rules.investment_fund_type(forms)


@register("f20_banks_and_sic_sectors", "xs quotes", """WITH s AS (SELECT sector = 'Financial Services' AND industry LIKE 'Banks%' AS bank, CAST(5900 + ticker % 1000 AS INTEGER) AS sic, ticker FROM quotes)
  SELECT bank, CASE WHEN ticker % 50 = 0 THEN 'Unknown' WHEN sic = 6798 OR sic BETWEEN 6500 AND 6553 THEN 'Real Estate' WHEN sic BETWEEN 6000 AND 6799 THEN 'Financial Services' ELSE 'Unknown' END AS sic_sector, count(*) AS n FROM s GROUP BY 1, 2""")
def _(v: Views):
    sic = F.when(F.col("ticker") % 50 == 0, "n/a").otherwise((5900 + F.col("ticker") % 1000).cast("string"))
    return quotes(v).select(rules.is_bank().alias("bank"), rules.sector_for_sic(sic).alias("sic_sector")).groupBy(
        "bank", "sic_sector").agg(F.count(F.lit(1)).alias("n"))


@register("x04_static_points", "xs quotes", """SELECT ticker, CASE WHEN market_cap BETWEEN 5e7 AND 7.5e8 THEN 15.0 WHEN market_cap >= 2.5e7 AND market_cap < 5e7 THEN 7.95 WHEN market_cap > 7.5e8 AND market_cap <= 1e9 THEN 7.95
    WHEN market_cap >= 1e7 AND market_cap < 2.5e7 THEN 3.0 ELSE 0 END AS market_cap_score, CASE sector WHEN 'Technology' THEN 10 WHEN 'Biotechnology' THEN 10 WHEN 'Financial Services' THEN 4 ELSE 0 END AS sector_score FROM quotes""")
def _(v: Views):
    return quotes(v).select("ticker", half_even(rules.market_cap_points(F.col("market_cap")), 6).alias("market_cap_score"),
                            rules.sector_points(F.col("sector")).alias("sector_score"))


@register("x05_reason_flags", "xs quotes", """SELECT ticker, array_to_string(list_filter([CASE WHEN s3 / 5 >= 2 THEN 'Volume acceleration' END, CASE WHEN s1 / 100 >= 30 THEN 'Strong relative strength' END,
    CASE WHEN market_cap BETWEEN 5e7 AND 7.5e8 THEN 'Sweet spot market cap' END, CASE WHEN market_cap < 2.5e7 THEN 'Tiny market cap / exceptional risk' END,
    CASE WHEN ticker % 2 = 0 THEN 'Strong technical trend' END, 'Sector: ' || sector], lambda x: x IS NOT NULL), '; ') AS reason_flags FROM quotes""")
def _(v: Views):
    return quotes(v).select("ticker", rules.reason_flags(
        F.col("s3") / 5, F.col("s1") / 100, F.col("market_cap"), F.when(F.col("ticker") % 2 == 0, 15.0).otherwise(0.0),
        F.col("sector")).alias("reason_flags"))


def _factor_sql() -> str:
    """SQL twin of the eleven factors: value, state, points per factor."""
    raw = {
        "revenue_growth": ("revenue_growth", "FALSE"), "earnings_growth": ("earnings_growth", "FALSE"),
        "profitability": ("COALESCE(operating_margin, profit_margin)", "FALSE"),
        "free_cash_flow": ("CASE WHEN market_cap > 0 THEN free_cash_flow / market_cap END", "FALSE"),
        "balance_sheet": ("CASE WHEN market_cap > 0 THEN (total_cash - total_debt) / market_cap END", "FALSE"),
        "earnings_yield": ("CASE WHEN trailing_pe > 0 THEN 1.0::DOUBLE / trailing_pe END", "COALESCE(trailing_pe <= 0, FALSE)"),
        "sales_yield": ("CASE WHEN price_to_sales > 0 THEN 1.0::DOUBLE / price_to_sales END", "COALESCE(price_to_sales <= 0, FALSE)"),
        "enterprise_value_ebitda": ("CASE WHEN enterprise_to_ebitda > 0 THEN enterprise_to_ebitda END", "COALESCE(enterprise_to_ebitda <= 0, FALSE)"),
        "liquidity": ("CASE WHEN current_ratio > 0 THEN current_ratio END", "COALESCE(current_ratio <= 0, FALSE)"),
        "leverage": ("CASE WHEN debt_to_equity >= 0 THEN debt_to_equity END", "COALESCE(debt_to_equity < 0, FALSE)"),
        "earnings_quality": ("CASE WHEN net_income > 0 THEN operating_cash_flow / net_income END", "FALSE"),
    }
    parts = []
    for name, (weight, direction, steps, (low, high, action)) in C.FUNDAMENTAL_FACTORS.items():
        value, invalid = raw[name]
        barred = [s for s, names in C.FACTOR_SECTOR_EXCLUSIONS.items() if name in names]
        applicable = f"sector NOT IN ({', '.join(repr(b) for b in barred)})" if barred else "TRUE"
        kept = f"CASE WHEN v < {low} OR v > {high} THEN NULL ELSE v END" if action == "invalid" else f"CASE WHEN v IS NOT NULL THEN greatest(least(v, {high}), {low}) END"
        flag = "'invalid'" if action == "invalid" else "'capped'"
        compare = "<=" if direction == "lower" else ">="
        chain = " ".join(f"WHEN w {compare} {bound} THEN {weight * share!r}::DOUBLE" for bound, share in steps)
        parts.append(f"""SELECT ticker, sector, country, '{name}' AS factor, source_value, raw_value, {weight} AS max_points, applicable, state,
          applicable AND raw_value IS NOT NULL AND state NOT IN ('stale', 'invalid') AS available,
          CASE WHEN applicable AND raw_value IS NOT NULL AND state NOT IN ('stale', 'invalid') THEN (CASE {chain.replace('w ', 'raw_value ')} ELSE 0 END) ELSE 0 END AS points FROM (
          SELECT ticker, sector, country, v AS source_value, {kept} AS raw_value, {applicable} AS applicable,
            CASE WHEN bad OR (COALESCE(v < {low} OR v > {high}, FALSE) AND {flag} = 'invalid') THEN 'invalid' WHEN quality = 'fresh' AND COALESCE(v < {low} OR v > {high}, FALSE) THEN {flag} ELSE quality END AS state
          FROM (SELECT *, {value} AS v, {invalid} AS bad FROM qq) a) b""")
    return """qq AS (SELECT *, CASE WHEN age_days IS NULL THEN 'undated' WHEN age_days > 550 THEN 'stale' ELSE 'fresh' END AS quality FROM quotes),
      fl AS (SELECT *, CASE WHEN NOT applicable THEN 'not_applicable' WHEN state IN ('stale', 'invalid') THEN state WHEN raw_value IS NULL THEN 'missing' ELSE state END AS data_quality FROM (""" + " UNION ALL ".join(parts) + """) z),
      fs AS (SELECT ticker, any_value(sector) AS sector, any_value(country) AS country, round_even(sum(points) * 100, 0) / 100 AS fundamental_score,
        round_even(round_even(sum(points) * 100, 0) / 100 / nullif(sum(CASE WHEN available THEN max_points ELSE 0 END)::DOUBLE, 0) * 100 * 100, 0) / 100 AS fundamental_score_normalized,
        round_even(COALESCE(sum(CASE WHEN available THEN max_points * CASE data_quality WHEN 'fresh' THEN 1.0 WHEN 'capped' THEN 1.0 WHEN 'undated' THEN 0.75 ELSE 0 END ELSE 0 END)::DOUBLE
          / nullif(sum(CASE WHEN applicable THEN max_points ELSE 0 END)::DOUBLE, 0), 0) * 100 * 100, 0) / 100 AS fundamental_confidence FROM fl GROUP BY 1)"""


FACTOR_SQL = _factor_sql()


def scored_quotes(v: Views):
    base = F.lit("2001-12-31").cast("date")
    stamped = quotes(v).withColumn("stamp", F.date_sub(base, F.col("age_days")))
    return rules.fundamental_factors(stamped.withColumn("quality", rules.data_quality(F.col("stamp"), base)))


def factor_rows(v: Views):
    # Stored before it is unpivoted: the optimizer would copy the whole array
    # expression into filters it infers for the explode.
    from sightline.session import cut
    return coverage.factor_rows(cut(scored_quotes(v).select("ticker", "country", "sector", "factors")), ["ticker", "country", "sector"])


@register("x06_fundamental_scores", "xs quotes", "WITH " + FACTOR_SQL + " SELECT ticker, fundamental_score, fundamental_score_normalized FROM fs")
def _(v: Views):
    return scored_quotes(v).select("ticker", "fundamental_score", "fundamental_score_normalized")


@register("x07_input_policies", "xs quotes", "WITH " + FACTOR_SQL + f" SELECT ticker, factor, {r('source_value', 6)} AS source_value, {r('raw_value', 6)} AS raw_value, data_quality FROM fl")
def _(v: Views):
    return factor_rows(v).select("ticker", "factor", half_even("source_value", 6).alias("source_value"),
                                 half_even("raw_value", 6).alias("raw_value"), "data_quality")


@register("x08_data_quality", "xs quotes", "WITH " + FACTOR_SQL + " SELECT quality, count(*) AS n FROM qq GROUP BY 1")
def _(v: Views):
    return scored_quotes(v).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@register("x09_score_confidence", "xs quotes", "WITH " + FACTOR_SQL + " SELECT ticker, fundamental_confidence FROM fs")
def _(v: Views):
    return scored_quotes(v).select("ticker", "fundamental_confidence")


@register("x35_ratio_factors", "xs quotes", "WITH " + FACTOR_SQL + f""" SELECT ticker, factor, {r('raw_value', 6)} AS raw_value, {r('points', 4)} AS points FROM fl
  WHERE factor IN ('earnings_yield', 'sales_yield', 'free_cash_flow', 'balance_sheet', 'earnings_quality')""")
def _(v: Views):
    return factor_rows(v).where(F.col("factor").isin("earnings_yield", "sales_yield", "free_cash_flow", "balance_sheet", "earnings_quality")).select(
        "ticker", "factor", half_even("raw_value", 6).alias("raw_value"), half_even("points", 4).alias("points"))


@register("x36_sector_applicability", "xs quotes", "WITH " + FACTOR_SQL + " SELECT sector, factor, count(*) AS n, count(*) FILTER (applicable) AS applicable FROM fl GROUP BY 1, 2")
def _(v: Views):
    return factor_rows(v).groupBy("sector", "factor").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("applicable").cast("bigint")).alias("applicable"))


@register("x10_name_match", "", """WITH w AS (SELECT p_partkey, regexp_split_to_array(lower(p_name || ' ' || p_type || ' inc'), '[^a-z0-9]+') AS a, regexp_split_to_array(lower(p_name || ' holdings ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END), '[^a-z0-9]+') AS b FROM part),
  t AS (SELECT p_partkey, list_distinct(list_filter(a, lambda x: x NOT IN ('', 'inc', 'holdings'))) AS a, list_distinct(list_filter(b, lambda x: x NOT IN ('', 'inc', 'holdings'))) AS b FROM w)
  SELECT p_partkey, round_even(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) * 1e6, 0) / 1e6 AS similarity,
    list_sort(a) = list_sort(b) OR (len(list_intersect(a, b)) >= 2 AND len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) >= 0.5) AS matched FROM t""")
def _(v: Views):
    left = rules.name_tokens(F.concat_ws(" ", "p_name", "p_type", F.lit("inc")))
    right = rules.name_tokens(F.concat_ws(" ", "p_name", F.lit("holdings"), F.when(
        F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))))
    tokens = v.table("part").select("p_partkey", left.alias("a"), right.alias("b"))
    return tokens.select("p_partkey", half_even(rules.name_similarity(F.col("a"), F.col("b")), 6).alias("similarity"),
                         rules.names_match(F.col("a"), F.col("b")).alias("matched"))


@register("x33_blend_score", "xs quotes", f"""SELECT ticker, {r('s1 * 0.8 + COALESCE(revenue_growth, 50) * 0.2', 2)} AS blend FROM quotes""")
def _(v: Views):
    from sightline.operators.calibration import blend_score
    return quotes(v).select("ticker", blend_score(F.col("s1"), F.col("revenue_growth"), 0.8, 0.2).alias("blend"))


@register("x41_same_currency", "xs quotes", """SELECT ticker, COALESCE(quote_type, '') = '' OR upper(quote_type) = upper(COALESCE(CASE WHEN ticker % 2 = 0 THEN 'equity' END, 'USD')) AS same FROM quotes""")
def _(v: Views):
    return quotes(v).select("ticker", rules.same_currency(
        F.col("quote_type"), F.when(F.col("ticker") % 2 == 0, "equity")).alias("same"))


# Interlistings: Canadian rows point at the US ticker with the same number.
def interlisted(v: Views):
    q = quotes(v)
    us = q.where("country = 'US'").select(F.concat(F.lit("N"), F.col("ticker")).alias("ticker"), "country", "company_name",
                                          F.lit(False).alias("interlisted"), F.lit(None).cast("string").alias("root_ticker"),
                                          (F.col("volume") >= 150000).alias("liquid"), F.lit("OK").alias("status"))
    ca = q.where("country = 'US' AND ticker % 4 = 1").select(
        F.concat(F.lit("N"), F.col("ticker"), F.lit(".TO")).alias("ticker"), F.lit("CA").alias("country"),
        F.when(F.col("ticker") % 5 == 0, F.lit("Other Mining Corp")).otherwise(F.col("company_name")).alias("company_name"),
        (F.col("ticker") % 8 != 5).alias("interlisted"), F.concat(F.lit("N"), F.col("ticker")).alias("root_ticker"),
        (F.col("s2") % 2 < 1).alias("liquid"), F.lit("OK").alias("status"))
    return us.unionByName(ca)


INTER_SQL = """us AS (SELECT 'N' || ticker AS t, company_name AS n, volume >= 150000 AS liquid FROM quotes WHERE country = 'US'),
  ca AS (SELECT 'N' || ticker || '.TO' AS t, 'N' || ticker AS root, ticker % 5 <> 0 AS same, ticker % 8 <> 5 AS inter, s2 % 2 < 1 AS liquid FROM quotes WHERE country = 'US' AND ticker % 4 = 1)"""


@register("f11_duplicate_listings", "xs quotes", "WITH " + INTER_SQL + """ SELECT CASE WHEN u.liquid OR NOT c.liquid THEN c.t ELSE u.t END AS ticker, CASE WHEN u.liquid OR NOT c.liquid THEN u.t ELSE c.t END AS duplicate_of
  FROM ca c JOIN us u ON u.t = c.root WHERE inter AND same""")
def _(v: Views):
    return rules.duplicate_listings(interlisted(v).withColumn("liquid", F.coalesce("liquid", F.lit(False))))


@register("j09_registrant_mapping", "xs quotes", "WITH " + INTER_SQL + """ SELECT t AS ticker, CASE WHEN CAST(substr(t, 2) AS INTEGER) % 6 <> 0 THEN t END AS sec_ticker,
    CASE WHEN CAST(substr(t, 2) AS INTEGER) % 6 <> 0 THEN 'direct' ELSE 'no SEC CIK mapping' END AS sec_reason FROM us
  UNION ALL SELECT t, CASE WHEN inter AND same AND CAST(substr(root, 2) AS INTEGER) % 6 <> 0 THEN root END,
    CASE WHEN NOT inter THEN 'not interlisted' WHEN CAST(substr(root, 2) AS INTEGER) % 6 = 0 THEN 'interlisted but no SEC CIK mapping for root symbol'
    WHEN same THEN 'interlisted:' || root || ' name match 1.00' ELSE 'interlisted root maps to another name' END FROM ca""")
def _(v: Views):
    listed = quotes(v).where("country = 'US' AND ticker % 6 <> 0").select(
        F.concat(F.lit("N"), F.col("ticker")).alias("symbol"), F.col("company_name").alias("title"))
    return rules.registrant_mapping(interlisted(v), listed).select("ticker", "sec_ticker", "sec_reason")


# Queue fixture: three scores with gaps, funds, duplicates and an illiquid tail.
def queue_rows(v: Views):
    return quotes(v).select(
        "ticker", F.lit("OK").alias("status"), "sector", "industry", "country", "company_name",
        F.when((F.col("ticker") % 3 != 1) & (F.col("ticker") % 5 != 0), F.floor(F.col("s2") / 50000).cast("double")).alias("score_v3"),
        F.when(F.col("ticker") % 4 != 0, F.col("s1")).alias("score_v2"), F.col("s4").alias("discovery_score"),
        (F.col("ticker") % 5 == 0).alias("score_v3_excluded"), (F.col("ticker") % 7 != 0).alias("liquid"),
        F.when(F.col("ticker") % 41 == 0, "X").alias("duplicate_of"), F.when(F.col("ticker") % 37 == 0, "closed_end_fund").alias("investment_fund"),
        F.col("s3").alias("v2_high_proximity"), F.when(F.col("ticker") % 6 != 0, F.col("s1")).alias("v2_volatility"),
        (F.col("s4") / F.col("s2")).alias("pit_earnings_yield"), "s2")


QUEUE_SQL = """qr AS (SELECT ticker, sector, industry, country, CASE WHEN ticker % 3 <> 1 AND ticker % 5 <> 0 THEN floor(s2 / 50000) END AS score_v3, CASE WHEN ticker % 4 <> 0 THEN s1 END AS score_v2, s4 AS discovery_score,
      ticker % 5 = 0 AS score_v3_excluded, ticker % 7 <> 0 AS liquid, ticker % 41 = 0 AS dup, ticker % 37 = 0 AS fund, s3 AS v2_high_proximity, CASE WHEN ticker % 6 <> 0 THEN s1 END AS v2_volatility, s4 / s2 AS pit_earnings_yield FROM quotes),
  qb AS (SELECT *, CASE WHEN dup THEN 'duplicate_listing' WHEN NOT liquid THEN 'below_liquidity_floor' WHEN fund THEN 'investment_fund' WHEN score_v3 IS NOT NULL THEN 'score_v3'
    WHEN score_v2 IS NOT NULL THEN 'score_v2' WHEN discovery_score IS NOT NULL THEN 'discovery_score' END AS ranking_basis FROM qr),
  qs AS (SELECT *, CASE ranking_basis WHEN 'score_v3' THEN score_v3 WHEN 'score_v2' THEN score_v2 ELSE discovery_score END AS ranking_score FROM qb WHERE ranking_basis IS NOT NULL),
  qn AS (SELECT *, row_number() OVER (ORDER BY CASE ranking_basis WHEN 'score_v3' THEN 0 WHEN 'score_v2' THEN 1 WHEN 'discovery_score' THEN 2 WHEN 'investment_fund' THEN 3 WHEN 'below_liquidity_floor' THEN 4 ELSE 5 END,
    CASE WHEN ranking_basis = 'duplicate_listing' THEN 0 ELSE -ranking_score END NULLS LAST, ticker) AS research_rank FROM qs),
  qg AS (SELECT *, CASE WHEN ranking_basis = 'score_v3' THEN CAST(5 - least(floor((research_rank - 1) * 5 / (SELECT count(*) FROM qn WHERE ranking_basis = 'score_v3')), 4) AS INTEGER) END AS v3_quintile FROM qn),
  qt AS (SELECT *, CASE WHEN ranking_basis IN ('duplicate_listing', 'below_liquidity_floor', 'investment_fund') THEN ranking_basis WHEN v3_quintile >= 3 THEN 'passes' WHEN ranking_basis = 'score_v3' THEN 'low_v3_quintile'
    WHEN score_v3_excluded THEN 'rejected_by_filters' ELSE 'not_scored_by_v3' END AS base_status FROM qg),
  qk AS (SELECT ticker, (rank() OVER (ORDER BY pit_earnings_yield) + (count(*) OVER (PARTITION BY pit_earnings_yield) - 1) / 2.0) / count(*) OVER () * 100 AS pr FROM qt
    WHERE base_status = 'not_scored_by_v3' AND sector = 'Financial Services' AND industry LIKE 'Banks%' AND pit_earnings_yield IS NOT NULL),
  qz AS (SELECT qt.*, round_even(pr * 100, 0) / 100 AS bank_earnings_yield_percentile, CASE WHEN pr > 50 THEN 'passes_bank_lane' WHEN pr IS NOT NULL THEN 'bank_dearer_half' ELSE base_status END AS screen_status FROM qt LEFT JOIN qk USING (ticker))"""


def screened_queue(v: Views):
    from sightline.session import cut
    return queue.screen_status(cut(queue.research_queue(queue_rows(v))))


@register("r01_research_queue", "xs quotes", "WITH " + QUEUE_SQL + " SELECT ticker, research_rank, ranking_basis, ranking_score FROM qn")
def _(v: Views):
    return queue.research_queue(queue_rows(v)).select("ticker", "research_rank", "ranking_basis", "ranking_score")


@register("r02_screen_status", "xs quotes", "WITH " + QUEUE_SQL + " SELECT ticker, v3_quintile, screen_status, bank_earnings_yield_percentile FROM qz")
def _(v: Views):
    return screened_queue(v).select("ticker", "v3_quintile", "screen_status", "bank_earnings_yield_percentile")


@register("r10_review_names", "xs quotes", "WITH " + QUEUE_SQL + " SELECT ticker, research_rank FROM qz WHERE screen_status = 'passes' ORDER BY research_rank LIMIT 25")
def _(v: Views):
    passing = screened_queue(v).where(F.col("screen_status") == "passes")
    return passing.select("ticker", "research_rank").orderBy("research_rank").limit(25)


@register("p15_defensive_scores", "xs quotes", "WITH " + QUEUE_SQL + f""", dp AS (SELECT * FROM qz WHERE screen_status = 'passes'), dl AS ({" UNION ALL ".join(
    f"SELECT ticker, '{s}' AS s, {s} * {d} AS x FROM dp WHERE {s} IS NOT NULL" for s, d in (('v2_high_proximity', 1), ('v2_volatility', -1), ('pit_earnings_yield', 1)))}),
  dr AS (SELECT ticker, (rank() OVER (PARTITION BY s ORDER BY x) + (count(*) OVER (PARTITION BY s, x) - 1) / 2.0) / count(*) OVER (PARTITION BY s) AS pr FROM dl),
  dm AS (SELECT ticker, avg(pr) AS m FROM dr GROUP BY 1)
  SELECT qz.ticker, {r("CASE WHEN screen_status = 'passes' THEN COALESCE(m * 100, 50) END", 4)} AS score_defensive FROM qz LEFT JOIN dm USING (ticker)""")
def _(v: Views):
    signals = (("v2_high_proximity", 1), ("v2_volatility", -1), ("pit_earnings_yield", 1))
    return queue.defensive_scores(screened_queue(v), signals=signals).select("ticker", "score_defensive")


@register("r09_balanced_ranked_rows", "xs quotes", """SELECT country, ticker, CAST(place AS INTEGER) AS place FROM (SELECT country, ticker, row_number() OVER (PARTITION BY country ORDER BY s2 DESC NULLS LAST, ticker) AS place FROM quotes) q WHERE place <= 15""")
def _(v: Views):
    return queue.balanced(quotes(v), "country", [F.col("s2").desc_nulls_last(), F.col("ticker")], 15).select("country", "ticker", "place")


@register("f10_universe_selection", "xs quotes", """SELECT ticker, country, CAST(n AS INTEGER) AS place FROM (SELECT ticker, country, row_number() OVER (PARTITION BY country ORDER BY ticker) AS n FROM quotes) q WHERE n <= 40""")
def _(v: Views):
    return queue.balanced(quotes(v).where(F.col("country").isin("CA", "US")), "country", [F.col("ticker")], 40).select("ticker", "country", "place")


@register("r11_factor_drivers", "xs quotes", "WITH " + FACTOR_SQL + """, dd AS (SELECT ticker, factor, row_number() OVER (PARTITION BY ticker ORDER BY points / max_points DESC, factor DESC) AS b,
    row_number() OVER (PARTITION BY ticker ORDER BY points / max_points, factor) AS w FROM fl WHERE available)
  SELECT ticker, string_agg(factor, '; ' ORDER BY b) FILTER (b <= 3) AS strongest, string_agg(factor, '; ' ORDER BY w) FILTER (w <= 3) AS weakest FROM dd GROUP BY 1""")
def _(v: Views):
    rows = factor_rows(v).withColumn("explanation", F.lit(""))
    best = queue.drivers(rows, ["ticker"], True).withColumnRenamed("drivers", "strongest")
    return best.join(queue.drivers(rows, ["ticker"], False).withColumnRenamed("drivers", "weakest"), "ticker")


@register("f09_backtest_universe", "xs quotes", "WITH " + CLASS_SQL + """ SELECT CAST(ticker AS VARCHAR) AS ticker, filter_reason IS NULL AS scored FROM pf WHERE filter_reason IS NULL OR filter_reason IN ('Below minimum market cap', 'Above maximum market cap')""")
def _(v: Views):
    return coverage.backtest_universe(rules.pre_filter(quotes(v)).withColumn(
        "status", F.when(F.col("passed"), "OK").otherwise("FILTERED")), None, "filter_reason").select(
        "ticker", (F.col("status") == "OK").alias("scored"))


@register("p01_official_score", "xs quotes", """WITH z AS (SELECT ticker, s3 AS sessions, market_cap, CASE WHEN s3 < 6 THEN 'Insufficient price history' WHEN market_cap IS NULL THEN 'Missing market cap' WHEN market_cap < 1e7 OR market_cap > 1e9 THEN 'Outside market cap range' END AS fail,
    CASE WHEN market_cap BETWEEN 5e7 AND 7.5e8 THEN 15.0 WHEN market_cap >= 2.5e7 AND market_cap < 5e7 THEN 7.95 WHEN market_cap > 7.5e8 AND market_cap <= 1e9 THEN 7.95 WHEN market_cap >= 1e7 AND market_cap < 2.5e7 THEN 3.0 ELSE 0 END
    + CASE sector WHEN 'Technology' THEN 10 WHEN 'Biotechnology' THEN 10 WHEN 'Financial Services' THEN 4 ELSE 0 END + CAST(ticker % 60 AS DOUBLE) AS total FROM quotes)
  SELECT ticker, CASE WHEN fail IS NULL THEN 'OK' ELSE 'FAILED' END AS status, fail AS failure, CASE WHEN fail IS NULL THEN round_even(total * 100, 0) / 100 ELSE 0 END AS discovery_score FROM z""")
def _(v: Views):
    rows = quotes(v).withColumns({"sessions": F.col("s3"), "technical_score": (F.col("ticker") % 60).cast("double")})
    return coverage.official_score(rows, minimum_sessions=6).select("ticker", "status", "failure", "discovery_score")
