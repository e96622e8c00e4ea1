"""The whole point-in-time panel and its models: P4, P3, X11 in full, A30 with owners, the size gate of filed shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import config as C
from sightline.catalog import filings
from sightline.catalog.backtests import OBS_SQL
from sightline.catalog.registry import register
from sightline.catalog.scores import score_sql
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.operators import fundamentals, insiders
from sightline.plans import panel
from sightline.session import cut

VIEWS = "px bench listing facts"
FLOOR, BAND, THROUGH = 80_000.0, (1e7, 2e9), "1997-06-30"
MODELS = tuple({**model, "minimum_group": 3, "sector_exclusions": {"GERMANY": C.MODEL_V3["sector_exclusions"]["Financial Services"]}
                if model["sector_exclusions"] else {}} for model in C.MODELS)
PIT = ("pit_revenue_ttm", "pit_revenue_growth_ttm", "pit_operating_margin_ttm", "pit_net_income_ttm", "pit_free_cash_flow_ttm",
       "pit_fcf_margin_ttm", "pit_cash", "pit_total_debt", "pit_net_cash", "pit_shares_outstanding", "pit_split_factor",
       "pit_share_change_1y", "pit_market_cap", "pit_net_cash_to_market_cap", "pit_fcf_yield", "pit_earnings_yield", "pit_sales_yield")
WORDS = ("pit_debt_coverage", "pit_shares_basis", "pit_market_cap_basis", "pit_split_ambiguous")
INS = ("ins_purchase_count_short", "ins_sale_count_short", "ins_net_count_short", "ins_distinct_buyers_short",
       "ins_officer_purchase_count_short", "ins_purchase_value_short", "ins_net_value_short", "ins_cluster_buy_short",
       "ins_purchase_count_long", "ins_purchase_value_long", "ins_net_value_long", "ins_days_since_last_purchase",
       "ins_net_value_to_market_cap_short", "ins_net_value_to_market_cap_long")


# A supplier files as one of the (nation, segment) companies; some have none, some report in another currency.
def filers(v: Views):
    return v.table("supplier").select(
        F.col("s_suppkey").alias("ticker"), F.when(F.col("s_suppkey") % 11 != 5, F.col("s_nationkey") * 10 + F.col("s_suppkey") % 5 + 1).alias("company"),
        (F.col("s_suppkey") % 40).alias("issuer"), (F.col("s_nationkey") % 9 != 4).alias("same_currency"))


def facts(v: Views):
    """Durations, balance-sheet values and average share counts of the fixture companies in one table."""
    durations = filings.filed_facts(v)
    return cut(durations.unionByName(filings.weighted(v)).unionByName(filings.instants(v)))


def splits(v: Views):
    return v.facts.where("company % 7 = 3").select(
        F.col("company").alias("ticker"), F.expr("date'1996-06-15'").alias("on"), F.lit(2.0).alias("ratio")).distinct()


# Every event is a filed transaction; two kinds are open-market trades, the others are dropped by the operator.
TX_SQL = """it AS MATERIALIZED (SELECT user_id % 40 AS issuer, [CAST(user_id AS VARCHAR), CAST(user_id * 7 % 50 AS VARCHAR)] AS owners, CAST(DATE '1993-01-01' + CAST(event_id % 2200 AS INTEGER) AS DATE) AS filed,
    CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'sale' WHEN 'view' THEN 'award' ELSE '' END AS kind, CASE WHEN event_id % 23 <> 0 THEN value END AS shares,
    CASE WHEN event_id % 17 <> 0 THEN value END AS value, user_id % 3 = 0 AS officer FROM events),
  iu AS MATERIALIZED (SELECT * FROM it WHERE kind IN ('purchase', 'sale') AND shares IS NOT NULL AND COALESCE(value >= 5, TRUE))"""


def transactions(v: Views):
    kind = F.when(F.col("event_type") == "purchase", "purchase").when(F.col("event_type") == "error", "sale").when(
        F.col("event_type") == "view", "award").otherwise("")
    return v.table("events").select(
        (F.col("user_id") % 40).alias("issuer"), F.array(F.col("user_id").cast("string"), (F.col("user_id") * 7 % 50).cast("string")).alias("owners"),
        F.date_add(F.lit("1993-01-01").cast("date"), (F.col("event_id") % 2200).cast("int")).alias("filed"), kind.alias("kind"),
        F.when(F.col("event_id") % 23 != 0, F.col("value")).alias("shares"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"),
        (F.col("user_id") % 3 == 0).alias("officer"))


def insider_sql(grid: str, short: int, long: int, through: str) -> str:
    """CTE iv: signals per (ticker, as_of) of grid(ticker, issuer, as_of, cap); unknown long after the data ends."""
    s, l = f"filed > as_of - {short}", f"filed > as_of - {long}"
    total = lambda span, kind: f"COALESCE(sum(value) FILTER ({span} AND kind = '{kind}'), 0)"
    return f"""ic AS (SELECT g.ticker, g.as_of, g.cap, CAST(count(*) FILTER ({s} AND kind = 'purchase') AS DOUBLE) AS pn, CAST(count(*) FILTER ({s} AND kind = 'sale') AS DOUBLE) AS sn,
      CAST(count(*) FILTER ({s} AND kind = 'purchase' AND officer) AS DOUBLE) AS opn, {total(s, 'purchase')} AS pv, {total(s, 'purchase')} - {total(s, 'sale')} AS nv,
      CAST(count(*) FILTER ({l} AND kind = 'purchase') AS DOUBLE) AS lpn, {total(l, 'purchase')} AS lpv, {total(l, 'purchase')} - {total(l, 'sale')} AS lnv,
      CAST(g.as_of - max(filed) FILTER (kind = 'purchase') AS DOUBLE) AS days, len(list_distinct(flatten(COALESCE(list(owners) FILTER ({s} AND kind = 'purchase'), [])))) AS buyers
    FROM {grid} g JOIN (SELECT DISTINCT issuer FROM iu) k USING (issuer) LEFT JOIN iu ON iu.issuer = g.issuer AND filed <= as_of
    WHERE as_of <= DATE '{through}' + 400 GROUP BY g.ticker, g.as_of, g.cap),
  iv AS (SELECT ticker, as_of, pn AS ins_purchase_count_short, sn AS ins_sale_count_short, pn - sn AS ins_net_count_short, CAST(buyers AS DOUBLE) AS ins_distinct_buyers_short, opn AS ins_officer_purchase_count_short,
    {r('pv', 6)} AS ins_purchase_value_short, {r('nv', 6)} AS ins_net_value_short, CASE WHEN buyers >= 2 THEN 1.0 ELSE 0.0 END AS ins_cluster_buy_short, lpn AS ins_purchase_count_long, {r('lpv', 6)} AS ins_purchase_value_long,
    {r('lnv', 6)} AS ins_net_value_long, days AS ins_days_since_last_purchase, {r('CASE WHEN cap > 0 THEN nv / cap END', 6)} AS ins_net_value_to_market_cap_short, {r('CASE WHEN cap > 0 THEN lnv / cap END', 6)} AS ins_net_value_to_market_cap_long FROM ic)"""


_GRID = "gr AS MATERIALIZED (SELECT DISTINCT company, CAST(end_d + 45 AS DATE) AS as_of FROM facts)"


def _held(kind: str, source: str, order: str) -> str:
    """Latest version per (company, as_of, period end) of one share basis, as known on the date."""
    return (f"SELECT '{kind}' AS kind, g.company, as_of, end_d, max_by(val, {order}) AS val, max(filed) AS filed FROM gr g JOIN {source}"
            " AND filed <= as_of AND end_d <= as_of GROUP BY 1, 2, 3, 4")


#: Statement signals, balance and shares for the companies and dates of ``gr``; ends in ``fp`` per (company, as_of).
FILED_SQL = (
    filings.SIGNAL_SQL.replace(", " + _GRID, "").replace(",\n  " + _GRID, "") + ", "
    + filings.DEBT_SQL.replace(_GRID + ",", "") + ", " + filings.WEIGHTED_SQL[len(filings.FACTS_SQL) + 2:]
    + f""", ag AS (SELECT gr.*, COALESCE(age_limit, 400) AS lim FROM gr LEFT JOIN lm USING (company, as_of)),
  cv AS (SELECT cb.company, cb.as_of, be, max_by(val, filed) AS cash FROM cb JOIN ag ON ag.company = cb.company AND ag.as_of = cb.as_of AND cb.as_of - be <= lim
    JOIN ins ON ins.company = cb.company AND concept = 'cash' AND end_d = be AND filed <= cb.as_of GROUP BY 1, 2, 3),
  dw AS (SELECT company, as_of, {", ".join(f"max(CASE WHEN concept = '{c}' THEN val END) AS {c}" for c in fundamentals.DEBT_COMBINE)} FROM dc GROUP BY 1, 2),
  dx AS (SELECT *, greatest(long_term_debt, debt_noncurrent_parts) AS nc, greatest(short_term_debt, debt_current_parts) AS cu FROM dw),
  dy AS (SELECT *, greatest(debt_broad, CASE WHEN nc IS NOT NULL OR cu IS NOT NULL THEN COALESCE(nc, 0) + COALESCE(cu, 0) END,
    CASE WHEN debt_credit_lines IS NOT NULL OR debt_notes IS NOT NULL THEN COALESCE(debt_credit_lines, 0) + COALESCE(debt_notes, 0) END) AS rd FROM dx),
  bl AS (SELECT cv.company, cv.as_of, cash, COALESCE(debt_total_reported, rd, 0) AS debt, CASE WHEN debt_total_reported IS NOT NULL THEN 'reported_total' WHEN rd IS NOT NULL THEN 'components' ELSE 'none_found' END AS coverage
    FROM cv LEFT JOIN dy ON dy.company = cv.company AND dy.as_of = cv.as_of),
  sh AS MATERIALIZED ({_held('p', "ins ON ins.company = g.company AND concept = 'shares_outstanding'", 'filed')} UNION ALL {_held('w', 'wc ON wc.company = g.company', 'row(filed, seq)')}),
  sn AS (SELECT company, as_of, kind, max(end_d) AS e, max_by(val, end_d) AS val, max_by(filed, end_d) AS f FROM sh GROUP BY 1, 2, 3),
  sk AS (SELECT ag.company, ag.as_of, lim, max(CASE WHEN kind = 'p' AND ag.as_of - e <= lim AND val > 0 THEN {{'e': e, 'f': f, 'v': val}} END) AS p, max(CASE WHEN kind = 'w' AND ag.as_of - e <= lim AND val > 0 THEN {{'e': e, 'f': f, 'v': val}} END) AS w
    FROM ag JOIN sn ON sn.company = ag.company AND sn.as_of = ag.as_of GROUP BY 1, 2, 3),
  sc0 AS (SELECT company, as_of, lim, p, CASE WHEN p IS NOT NULL AND w.v > p.v * 10 THEN NULL ELSE w END AS w FROM sk),
  sc1 AS (SELECT company, as_of, lim, CASE WHEN p IS NOT NULL AND NOT COALESCE(p.v * 1.2 < w.v, FALSE) THEN p ELSE w END AS s, CASE WHEN p IS NOT NULL AND NOT COALESCE(p.v * 1.2 < w.v, FALSE) THEN 'period_end' WHEN w IS NOT NULL THEN 'weighted_average' END AS basis FROM sc0),
  ya AS (SELECT sc1.company, sc1.as_of, max(end_d) AS ye, max_by(val, end_d) AS yv FROM sc1 JOIN sh ON sh.company = sc1.company AND sh.as_of = sc1.as_of AND kind = CASE basis WHEN 'period_end' THEN 'p' ELSE 'w' END AND end_d <= s.e - 350 WHERE s IS NOT NULL GROUP BY 1, 2),
  sp AS (SELECT DISTINCT company, DATE '1996-06-15' AS spon FROM facts WHERE company % 7 = 3),
  ss AS (SELECT sc1.company, sc1.as_of, basis, s.v * CASE WHEN spon > s.e THEN 2.0 ELSE 1.0 END AS shares, CASE WHEN spon > s.e THEN 2.0 ELSE 1.0 END AS factor, COALESCE(spon > s.e AND spon <= s.f, FALSE) AS ambiguous,
    CASE WHEN yv > 0 AND s.e - 350 - ye <= lim AND s.e - ye <= lim + 30 THEN s.v * CASE WHEN spon > s.e THEN 2.0 ELSE 1.0 END / (yv * CASE WHEN spon > ye THEN 2.0 ELSE 1.0 END) - 1 END AS change
    FROM sc1 LEFT JOIN ya USING (company, as_of) LEFT JOIN sp USING (company) WHERE s IS NOT NULL),
  fp AS (SELECT gr.company, gr.as_of, rev, CASE WHEN rev IS NOT NULL AND rv4 > 0 THEN rev / rv4 - 1 END AS growth, CASE WHEN rev > 0 AND oie0 = rve0 THEN oi0 / rev END AS omargin, inc, fcf,
    CASE WHEN rve0 = oce0 AND rev > 0 THEN fcf / rev END AS fmargin, cash, debt, coverage, shares, factor, basis, ambiguous, change
    FROM gr LEFT JOIN wm USING (company, as_of) LEFT JOIN bl USING (company, as_of) LEFT JOIN ss USING (company, as_of))""")


def priced_sql(requests: str, name: str) -> str:
    """CTE: the signals of requests(ticker, company, as_of, price, final), rounded to 6."""
    ratios = {"pit_net_cash_to_market_cap": "cash - debt", "pit_fcf_yield": "fcf", "pit_earnings_yield": "inc", "pit_sales_yield": "rev"}
    plain = {"pit_revenue_ttm": "rev", "pit_revenue_growth_ttm": "growth", "pit_operating_margin_ttm": "omargin", "pit_net_income_ttm": "inc",
             "pit_free_cash_flow_ttm": "fcf", "pit_fcf_margin_ttm": "fmargin", "pit_cash": "cash", "pit_total_debt": "debt", "pit_net_cash": "cash - debt",
             "pit_shares_outstanding": "shares", "pit_split_factor": "factor", "pit_share_change_1y": "change", "pit_market_cap": "cap",
             **{k: f"({x}) / cap" for k, x in ratios.items()}}
    return f"""{name} AS MATERIALIZED (SELECT ticker, as_of, final, {", ".join(f"{r(x, 6)} AS {k}" for k, x in plain.items())}, coverage AS pit_debt_coverage, basis AS pit_shares_basis,
      CASE WHEN cap IS NOT NULL THEN 'reported_shares' END AS pit_market_cap_basis, ambiguous AS pit_split_ambiguous
    FROM (SELECT q.*, fp.* EXCLUDE (company, as_of), CASE WHEN price > 0 AND shares > 0 THEN shares * price END AS cap FROM {requests} q JOIN fp ON fp.company = q.company AND fp.as_of = q.as_of) z)"""


PANEL_SQL = OBS_SQL + f""", fl AS (SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 11 <> 5 THEN s_nationkey * 10 + s_suppkey % 5 + 1 END AS company, s_suppkey % 40 AS issuer, s_nationkey % 9 <> 4 AS same_currency FROM supplier),
  lc AS (SELECT ticker, max(d) AS as_of, max_by(close, d) AS lcl FROM px GROUP BY 1),
  rq AS MATERIALIZED (SELECT ticker, company, d AS as_of, CASE WHEN same_currency AND start_close > 0 THEN start_close END AS price, FALSE AS final FROM obs JOIN fl USING (ticker) WHERE company IS NOT NULL
    UNION ALL SELECT ticker, company, as_of, lcl, TRUE FROM lc JOIN fl USING (ticker) WHERE company IS NOT NULL),
  gr AS MATERIALIZED (SELECT DISTINCT company, as_of FROM rq), """ + FILED_SQL + ", " + priced_sql("rq", "pq") + f""",
  uf AS (SELECT ticker, CASE WHEN market_cap > 0 AND pit_market_cap > 0 AND (market_cap / pit_market_cap >= 2 OR market_cap / pit_market_cap <= 0.5) THEN market_cap / pit_market_cap ELSE 1 END AS unit FROM pq JOIN listing USING (ticker) WHERE final),
  ig AS (SELECT obs.ticker, issuer, d AS as_of, pit_market_cap AS cap FROM obs JOIN fl USING (ticker) LEFT JOIN pq ON pq.ticker = obs.ticker AND pq.as_of = d AND NOT final), """ + TX_SQL.replace(" AND COALESCE(value >= 5, TRUE)", "") + ", " + insider_sql("ig", 180, 365, THROUGH) + f""",
  pu AS (SELECT obs.*, pq.* EXCLUDE (ticker, as_of, final), iv.* EXCLUDE (ticker, as_of), lcl, CASE WHEN pit_market_cap > 0 THEN pit_market_cap * COALESCE(unit, 1) WHEN obs.market_cap > 0 AND start_close > 0 AND lcl > 0 THEN obs.market_cap * start_close / lcl END AS universe_market_cap,
      CASE WHEN pit_market_cap > 0 AND COALESCE(unit, 1) <> 1 THEN 'filed_shares_unit_corrected' WHEN pit_market_cap > 0 THEN 'filed_shares' WHEN obs.market_cap > 0 AND start_close > 0 AND lcl > 0 THEN 'price_scaled_approximation' ELSE 'unavailable' END AS universe_cap_basis
    FROM obs LEFT JOIN pq ON pq.ticker = obs.ticker AND pq.as_of = obs.d AND NOT final LEFT JOIN uf ON uf.ticker = obs.ticker LEFT JOIN iv ON iv.ticker = obs.ticker AND iv.as_of = obs.d LEFT JOIN lc ON lc.ticker = obs.ticker),
  pn AS MATERIALIZED (SELECT *, CASE WHEN NOT COALESCE(average_dollar_volume_30d >= {FLOOR}, FALSE) THEN 'below_liquidity_floor' WHEN COALESCE(universe_market_cap BETWEEN {BAND[0]} AND {BAND[1]}, FALSE) THEN 'inside_band' ELSE 'outside_band' END AS gate FROM pu)"""


def observed(v: Views):
    listing = v.listing.join(filers(v), "ticker")
    return panel.full_observations(v.bars, v.bench, listing, facts(v), transactions(v), splits(v),
                                   {"liquidity_floor": FLOOR, "band": BAND}, THROUGH)


@register("p04_full_observations", VIEWS, "WITH " + PANEL_SQL + f""" SELECT period, ticker, CAST(d AS VARCHAR) AS d, technical_score, relative_strength_6m, {", ".join(PIT + WORDS + INS)},
    {r('universe_market_cap', 2)} AS universe_market_cap, universe_cap_basis, gate, {", ".join(r(f"excess_{h}", 4) + f" AS excess_{h}" for h in C.BACKTEST['horizons'])} FROM pn""")
def _(v: Views):
    return observed(v).select(
        "period", "ticker", F.col("d").cast("string").alias("d"), "technical_score", "relative_strength_6m", *PIT, *WORDS, *INS,
        half_even("universe_market_cap", 2).alias("universe_market_cap"), "universe_cap_basis", "gate",
        *[half_even(f"excess_{h}", 4).alias(f"excess_{h}") for h in C.BACKTEST["horizons"]])


SCORES = [f"{model['prefix']}{end}" for model in MODELS for end in ("", "_confidence", "_excluded", "_exclusion_reasons")]


@register("p03_all_models", VIEWS, "WITH " + PANEL_SQL + ", ib AS MATERIALIZED (SELECT * FROM pn WHERE gate = 'inside_band'), "
          + ", ".join(score_sql("ib", "period", "ticker", model, f"m{i}", [*model["signals"], *[rule[0] for rule in model["exclusions"]]]) for i, model in enumerate(MODELS))
          + f""" SELECT period, ticker, {", ".join(SCORES)} FROM ib JOIN m0 USING (period, ticker) JOIN m1 USING (period, ticker) JOIN m2 USING (period, ticker)""")
def _(v: Views):
    return panel.all_models(observed(v), MODELS).select("period", "ticker", *SCORES)


@register("x11_all_signals", "facts", "WITH " + _GRID + f""", rq AS (SELECT company AS ticker, company, as_of, CASE WHEN company % 4 <> 1 THEN 20.0 + company % 13 END AS price, FALSE AS final FROM gr), """ + FILED_SQL + ", "
          + priced_sql("rq", "pq") + f" SELECT ticker AS company, CAST(as_of AS VARCHAR) AS as_of, {', '.join(PIT + WORDS)} FROM pq")
def _(v: Views):
    grid = filings.grid(v).withColumns({"price": F.when(F.col("company") % 4 != 1, 20.0 + F.col("company") % 13),
                                        "supplied_cap": F.lit(None).cast("double")})
    found = fundamentals.signals_as_of(cut(grid), facts(v), splits(v))
    return found.select("company", F.col("as_of").cast("string").alias("as_of"), *[half_even(name, 6).alias(name) for name in PIT], *WORDS)


@register("a30_owner_signals", "", "WITH " + TX_SQL + """, ig AS (SELECT DISTINCT issuer AS ticker, issuer, filed AS as_of, CASE WHEN issuer % 5 <> 0 THEN 997.0 * issuer END AS cap FROM it), """
          + insider_sql("ig", 60, 180, "1997-06-30") + f""" SELECT ig.issuer, CAST(ig.as_of AS VARCHAR) AS as_of, {", ".join(INS)} FROM ig LEFT JOIN iv ON iv.ticker = ig.ticker AND iv.as_of = ig.as_of""")
def _(v: Views):
    tx = transactions(v)
    grid = tx.select("issuer", F.col("filed").alias("as_of"), F.when(F.col("issuer") % 5 != 0, 997.0 * F.col("issuer")).alias("market_cap")).distinct()
    found = insiders.signals_as_of(grid, tx, 60, 180, data_through="1997-06-30", minimum_value=5.0)
    return found.select("issuer", F.col("as_of").cast("string").alias("as_of"), *INS)
