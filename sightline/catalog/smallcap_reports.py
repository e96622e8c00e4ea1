"""Calibration of the small-cap model: P12, A36-A38, A49, A50, A52, F15, F17, J24, J25, X18, X37."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.smallcaps import SMALL_SQL, candidates
from sightline.catalog.views import Views, r
from sightline.operators import smallcap
from sightline.plans import smallcap_calibration as cal
from sightline.session import cut

COMPLETED = "1998-01-01"
PLACE = "CASE {0} WHEN 'priority_research' THEN 0 WHEN 'asymmetric_watch' THEN 1 WHEN 'speculative_watch' THEN 2 WHEN 'low_upside_signal' THEN 3 WHEN 'market_data_required' THEN 4 ELSE 5 END"


def _used(factor: str) -> str:
    weight = f"{cal.SIDES[factor[:2]][1][factor[2:]]!r}::DOUBLE"
    return f"({r(f'CAST({factor} AS DOUBLE) * {weight}', 2)} / {weight})"


def _applies(factor: str) -> str:
    return "NOT fin" if factor in ("r_balance_sheet", "r_leverage") else "TRUE"


def _scored(prefix: str, multipliers) -> str:
    weights = {prefix + name: f"{value!r}::DOUBLE" for name, value in smallcap.scenario_weights(cal.SIDES[prefix][1], multipliers).items()}
    traded = [f"r_{name}" for name in smallcap.MARKET_FACTORS if prefix == "r_"]
    points = " + ".join(f"COALESCE({_used(f)} * {w}, 0)" for f, w in weights.items())
    known = {f: f"CASE WHEN {f} IS NOT NULL THEN {w} ELSE 0::DOUBLE END" for f, w in weights.items()}
    sure = " + ".join(k if f in traded else f"{k} * q" for f, k in known.items())
    applicable = " + ".join(f"CASE WHEN {_applies(f)} THEN {w} ELSE 0::DOUBLE END" for f, w in weights.items())
    score = r(f"COALESCE(({points}) / nullif({' + '.join(known.values())}, 0), 0) * 100", 2)
    out = f"{score} AS {prefix}s, {r(f'COALESCE(({sure}) / nullif({applicable}, 0), 0) * 100', 2)} AS {prefix}c"
    if traded:
        most = repr(sum(smallcap.scenario_weights(smallcap.RISK_WEIGHTS, multipliers)[name] for name in smallcap.MARKET_FACTORS))
        out += ", " + r(f"({' + '.join(k for f, k in known.items() if f in traded)}) / {most}::DOUBLE * 100", 2) + " AS market"
    return out


SCENARIO_SQL = " UNION ALL ".join(f"SELECT ticker, '{name}' AS scenario, {_scored('u_', up)}, {_scored('r_', ruin)} FROM b2" for name, (up, ruin) in cal.SCENARIOS.items())
BASE_SQL = SMALL_SQL + f""", nw AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS captured, ['unavailable', 'partial', 'price_only', 'complete', 'complete'][1 + o_orderkey % 5] AS status, o_orderkey % 3 = 0 AS bad FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, 3 DESC, o_orderkey % 3 = 0 DESC) = 1),
  o0 AS (SELECT b4.*, CASE WHEN b4.cap < 1e7 THEN 'nano_cap' ELSE 'micro_cap' END AS size_tier, row_number() OVER (ORDER BY {PLACE.format('classification')}, u_score DESC, r_score, sure DESC, ticker) AS brank,
    CASE WHEN sure <= 50 OR mk < 70 THEN 'unresolved' WHEN r_score <= 30 THEN 'controlled' WHEN r_score <= 55 THEN 'elevated' ELSE 'severe' END AS band FROM b4),
  ev AS (SELECT *, CASE WHEN outcome = 'loaded' THEN status ELSE 'unavailable' END AS mstatus, CASE WHEN outcome = 'loaded' THEN captured END AS mcap, outcome = 'loaded' AND bad AS merr FROM
    (SELECT o0.ticker, status, captured, bad, CASE WHEN captured IS NULL THEN 'missing' WHEN captured > DATE '{COMPLETED}' THEN 'newer_than_run' WHEN status = 'unavailable' THEN 'read_errors' ELSE 'loaded' END AS outcome FROM o0 LEFT JOIN nw USING (ticker))),
  es AS (SELECT count(*) AS n, count(*) FILTER (mstatus <> 'unavailable') AS covered, {r("count(*) FILTER (mstatus <> 'unavailable')::DOUBLE / count(*) * 100", 2)} AS coverage, CAST(max(mcap) - min(mcap) AS DOUBLE) AS span FROM ev)"""
RANK_SQL = BASE_SQL + f""", sn AS ({SCENARIO_SQL}),
  s1 AS (SELECT *, least(u_c, r_c) AS conf, CASE WHEN least(u_c, r_c) < 50 THEN 'insufficient_evidence' WHEN market < 70 THEN 'market_data_required' WHEN least(u_c, r_c) >= 80 AND u_s >= 75 AND r_s <= 35 THEN 'priority_research'
    WHEN u_s >= 60 AND r_s <= 55 THEN 'asymmetric_watch' WHEN u_s >= 70 THEN 'speculative_watch' ELSE 'low_upside_signal' END AS cls FROM sn),
  sr AS (SELECT s1.*, o0.brank, o0.classification AS ocls, o0.u_score, o0.r_score, row_number() OVER (PARTITION BY scenario ORDER BY {PLACE.format('cls')}, u_s DESC, r_s, conf DESC, ticker) AS rank FROM s1 JOIN o0 USING (ticker)),
  ov AS (SELECT scenario, cutoff, count(*) FILTER (rank <= cutoff AND base <= cutoff) AS overlap_count, least(cutoff, count(*)) AS actual FROM (SELECT a.scenario, a.rank, b.rank AS base FROM sr a JOIN sr b ON a.ticker = b.ticker AND b.scenario = 'baseline' WHERE a.scenario <> 'baseline' AND a.rank <= 50) x, (VALUES (10), (25), (50)) c(cutoff) GROUP BY 1, 2)"""
FACTOR_SQL = SMALL_SQL + ", ft AS (" + " UNION ALL ".join(
    f"SELECT ticker, '{side}' AS side, '{name}' AS factor, '{cal.LABELS[prefix + name]}' AS label, {i} AS place, {_applies(prefix + name)} AS applicable, {_used(prefix + name)} AS used FROM b2"
    for prefix, (side, weights) in cal.SIDES.items() for i, name in enumerate(weights)) + ")"
WARNED = """concat_ws(',', CASE WHEN volume <= 100000 THEN 'very_low_liquidity' END, CASE WHEN vol >= 80 THEN 'extreme_volatility' END, CASE WHEN dd >= 50 THEN 'severe_drawdown' END,
    CASE WHEN dil >= 20 THEN 'material_dilution' END, CASE WHEN rs >= 1 THEN 'reverse_split' END, CASE WHEN sure < 80 THEN 'limited_overall_confidence' END)"""
DETAIL_SQL = RANK_SQL + FACTOR_SQL[len(SMALL_SQL):] + f""", tx AS (SELECT ticker, side, label || ': ' || CAST({r('used * 100', 1)} AS VARCHAR) || '% of factor capacity' AS line FROM ft WHERE used IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, side ORDER BY used DESC, place) = 1),
  sg AS (SELECT ticker, max(rank) - min(rank) AS scenario_rank_range, string_agg(scenario || ':' || cls || ':' || rank, ';' ORDER BY scenario) AS scenarios FROM sr GROUP BY 1),
  dt AS (SELECT o0.*, b0.company_name, {WARNED} AS risk_warnings, CASE WHEN classification IN ('priority_research', 'asymmetric_watch') THEN COALESCE(a.line, 'unavailable') END AS strongest_upside_driver,
    CASE WHEN classification IN ('priority_research', 'asymmetric_watch') THEN COALESCE(b.line, 'unavailable') END AS largest_risk_driver, scenario_rank_range, scenarios
    FROM o0 JOIN b0 USING (ticker) LEFT JOIN tx a ON a.ticker = o0.ticker AND a.side = 'upside' LEFT JOIN tx b ON b.ticker = o0.ticker AND b.side = 'risk' LEFT JOIN sg ON sg.ticker = o0.ticker)"""
CHOSEN = "classification IN ('priority_research', 'asymmetric_watch', 'speculative_watch')"


def rows(v: Views):
    return cut(smallcap.rank(cut(smallcap.classify(cut(smallcap.factor_shares(candidates(v)))))))


def snapshots(v: Views):
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("unavailable", "partial", "price_only", "complete", "complete"))), (key % 5 + 1).cast("int"))
    return v.table("orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").cast("timestamp").alias("captured_at"),
                                    status.alias("data_status"), F.when(key % 3 == 0, F.array(F.lit("late"))).alias("errors"))


def evidenced(v: Views):
    return cal.price_evidence(rows(v), snapshots(v), F.lit(COMPLETED).cast("timestamp"))


def ranks(v: Views):
    return cut(cal.scenario_candidates(rows(v)))


def details(v: Views):
    found = rows(v)
    told = cal.candidate_details(found, cut(cal.scenario_candidates(found)))
    lines = F.transform("scenarios", lambda x: F.concat_ws(":", x["scenario"], x["classification"], x["rank"].cast("string")))
    return told.withColumns({"risk_warnings": F.array_join("risk_warnings", ","), "scenarios": F.array_join(lines, ";")})


@register("p12_scenario_candidates", "xs quotes", "WITH " + RANK_SQL + """ SELECT ticker, scenario, u_s AS upside_score, r_s AS risk_of_ruin_score, conf AS confidence, market AS market_risk_confidence, cls AS classification, rank, brank - rank AS rank_change FROM sr""")
def _(v: Views):
    return ranks(v).select("ticker", "scenario", "upside_score", "risk_of_ruin_score", "confidence", "market_risk_confidence", "classification", "rank", "rank_change")


@register("a50_scenario_classes", "xs quotes", "WITH " + RANK_SQL + """ SELECT scenario, cls AS classification, count(*) AS candidates, count(*) FILTER (cls IN ('priority_research', 'asymmetric_watch', 'speculative_watch')) AS selected FROM sr GROUP BY 1, 2""")
def _(v: Views):
    return cal.scenario_classes(ranks(v))


@register("p12_baseline_overlaps", "xs quotes", "WITH " + RANK_SQL + f" SELECT scenario, cutoff, overlap_count, {r('overlap_count::DOUBLE / actual * 100', 2)} AS overlap_percent FROM ov")
def _(v: Views):
    return cal.baseline_overlaps(ranks(v))


@register("p12_baseline_integrity", "xs quotes", "WITH " + RANK_SQL + """ SELECT count(*) AS candidate_count, count(*) FILTER (rank <> brank OR cls <> ocls OR abs(u_s - u_score) > 0.05 OR abs(r_s - r_score) > 0.05) AS mismatch_count FROM sr WHERE scenario = 'baseline'""")
def _(v: Views):
    return cal.baseline_integrity(ranks(v))


@register("a49_factor_coverage", "xs quotes", "WITH " + FACTOR_SQL + f""" SELECT side, factor, count(used) AS available, count(*) FILTER (applicable) AS applicable, {r('count(used)::DOUBLE / nullif(count(*) FILTER (applicable), 0) * 100', 2)} AS coverage_percent FROM ft GROUP BY 1, 2""")
def _(v: Views):
    return cal.factor_coverage(cal.factor_table(rows(v)))


@register("a36_factor_distributions", "xs quotes", "WITH " + FACTOR_SQL + f""", fr AS (SELECT side, factor, applicable, {r('used * 100', 2)} AS x FROM ft)
  SELECT side, factor, count(x) AS available, count(*) FILTER (applicable) AS applicable, {r('count(x)::DOUBLE / nullif(count(*) FILTER (applicable), 0) * 100', 2)} AS coverage_percent, min(x) AS minimum, {r('quantile_cont(x, 0.25)', 2)} AS p25, {r('quantile_cont(x, 0.5)', 2)} AS median, {r('quantile_cont(x, 0.75)', 2)} AS p75, max(x) AS maximum FROM fr GROUP BY 1, 2""")
def _(v: Views):
    return cal.factor_distributions(cut(cal.factor_table(rows(v))))


@register("a49_cohort_counts", "xs quotes", "WITH " + BASE_SQL + """ SELECT field, value, count(*) AS count FROM (SELECT unnest([{'field': 'country', 'value': COALESCE(country, 'UNKNOWN')}, {'field': 'size_tier', 'value': size_tier}, {'field': 'classification', 'value': classification},
    {'field': 'risk_band', 'value': band}, {'field': 'market_data_status', 'value': mstatus}], recursive := true) FROM o0 JOIN ev USING (ticker)) GROUP BY 1, 2""")
def _(v: Views):
    band = smallcap.risk_band(F.col("risk_of_ruin_score"), F.col("confidence"), F.col("market_risk_confidence"))
    return cal.cohort_counts(evidenced(v).withColumn("risk_band", band), ["country", "size_tier", "classification", "risk_band", "market_data_status"])


@register("x18_risk_band", "xs quotes", "WITH " + BASE_SQL + f" SELECT ticker, band AS risk_band, {WARNED} AS risk_warnings FROM o0 JOIN (SELECT ticker, volume, vol, dd, dil, rs FROM b0) USING (ticker)")
def _(v: Views):
    band = smallcap.risk_band(F.col("risk_of_ruin_score"), F.col("confidence"), F.col("market_risk_confidence"))
    return rows(v).select("ticker", band.alias("risk_band"), F.array_join(cal.risk_warnings(), ",").alias("risk_warnings"))


@register("j24_price_evidence", "xs quotes", "WITH " + BASE_SQL + " SELECT ticker, outcome AS evidence_outcome, mstatus AS market_data_status, CAST(mcap AS VARCHAR) AS captured FROM ev")
def _(v: Views):
    return evidenced(v).select("ticker", "evidence_outcome", "market_data_status", F.to_date("market_data_captured_at").cast("string").alias("captured"))


@register("a52_collection_summary", "xs quotes", "WITH " + BASE_SQL + """ SELECT count(*) AS evidence_count, count(*) FILTER (mstatus = 'complete') AS complete, count(*) FILTER (mstatus = 'price_only') AS price_only, count(*) FILTER (mstatus = 'partial') AS partial,
    count(*) FILTER (mstatus = 'unavailable') AS unavailable, count(*) FILTER (merr) AS with_errors FROM ev""")
def _(v: Views):
    return cal.collection_summary(evidenced(v))


@register("a38_evidence_summary", "xs quotes", "WITH " + BASE_SQL + " SELECT n, covered AS covered_candidates, coverage AS coverage_percent, span AS capture_span_days, COALESCE(coverage >= 99 AND span <= 7, FALSE) AS cross_section_comparable FROM es")
def _(v: Views):
    return cal.evidence_summary(evidenced(v))


def _outlier(name: str, test: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) AS count, COALESCE((SELECT string_agg(ticker, ',' ORDER BY brank) FROM (SELECT ticker, brank FROM ol WHERE {test} ORDER BY brank LIMIT 50)), '') AS tickers, count(*) > 50 AS truncated FROM ol WHERE {test}"


@register("f17_outliers", "xs quotes", "WITH " + BASE_SQL + ", ol AS (SELECT ticker, brank, volume, vol, dd, dil, rs FROM o0 JOIN (SELECT ticker, volume, vol, dd, dil, rs FROM b0) USING (ticker)) " + " UNION ALL ".join(_outlier(*x) for x in (
    ("zero_dollar_volume", "volume = 0"), ("very_low_dollar_volume", "volume <= 25000"), ("extreme_volatility", "vol >= 120"), ("severe_drawdown", "dd >= 70"), ("heavy_dilution", "dil >= 50"), ("reverse_split", "rs >= 1"))))
def _(v: Views):
    return cal.outliers(rows(v)).withColumn("tickers", F.array_join(F.transform("tickers", lambda t: t.cast("string")), ","))


GATE_SQL = RANK_SQL + f""", sl AS (SELECT field, count(*) FILTER ({CHOSEN})::DOUBLE / count(*) AS share FROM (SELECT classification, 'country' AS field, COALESCE(country, 'UNKNOWN') AS value FROM o0 UNION ALL SELECT classification, 'size_tier', size_tier FROM o0) GROUP BY field, value),
  rr AS (SELECT field, CASE WHEN min(x) = 0 THEN CASE WHEN max(x) = 0 THEN 1.0 END ELSE {r('max(x) / min(x)', 2)} END AS spread FROM (SELECT field, {r('share * 100', 2)} AS x FROM sl) GROUP BY 1),
  mv AS (SELECT count(*) FILTER (lo <= 25 AND hi >= 50) AS moved FROM (SELECT min(brank) AS lo, max(rank) - min(rank) AS hi FROM sr GROUP BY ticker)),
  gt AS (SELECT 'comparable_market_cohort' AS gate, COALESCE(coverage >= 99 AND span <= 7, FALSE) AS passed, coverage AS actual, 'fail' AS severity FROM es
    UNION ALL SELECT 'baseline_reproduction', x = 0, x, 'fail' FROM (SELECT count(*) FILTER (rank <> brank OR cls <> ocls OR abs(u_s - u_score) > 0.05 OR abs(r_s - r_score) > 0.05) AS x FROM sr WHERE scenario = 'baseline')
    UNION ALL SELECT 'priority_risk_resolved', x = 0, x, 'fail' FROM (SELECT count(*) AS x FROM o0 WHERE classification = 'priority_research' AND band = 'unresolved')
    UNION ALL SELECT 'zero_liquidity_penalty', x = 0, x, 'fail' FROM (SELECT count(*) AS x FROM b0 JOIN b2 USING (ticker) WHERE volume = 0 AND COALESCE(r_liquidity, 0) < 1)
    UNION ALL SELECT 'top_25_scenario_overlap', x >= 60, x, 'review' FROM (SELECT min({r('overlap_count::DOUBLE / actual * 100', 2)}) AS x FROM ov WHERE cutoff = 25)
    UNION ALL SELECT 'top_25_rank_sensitivity', moved <= 5, moved, 'review' FROM mv
    UNION ALL SELECT field || '_selection_rate_dispersion', COALESCE(spread <= 2.5, FALSE), spread, 'review' FROM rr)"""


def gates(v: Views):
    found = evidenced(v)
    return cal.validation_gates(found, cut(cal.scenario_candidates(found)))


@register("a37_validation_gates", "xs quotes", "WITH " + GATE_SQL + " SELECT gate, passed, CAST(actual AS DOUBLE) AS actual, severity FROM gt")
def _(v: Views):
    return gates(v)


@register("p12_calibration_status", "xs quotes", "WITH " + GATE_SQL + """ SELECT count(*) FILTER (NOT passed AND severity = 'fail') AS failed, count(*) FILTER (NOT passed AND severity = 'review') AS to_review,
    CASE WHEN bool_or(NOT passed AND severity = 'fail') THEN 'fail' WHEN bool_or(NOT passed) THEN 'needs_review' ELSE 'pass' END AS status FROM gt""")
def _(v: Views):
    return cal.overall_status(gates(v))


SEEN = "ticker, company_name, size_tier, classification, {0}, risk_warnings, strongest_upside_driver, largest_risk_driver, scenario_rank_range, scenarios"


@register("j25_candidate_details", "xs quotes", "WITH " + DETAIL_SQL + " SELECT " + SEEN.format("brank AS rank, band AS risk_band") + " FROM dt")
def _(v: Views):
    return details(v).select(*SEEN.format("rank, risk_band").split(", "))


@register("f15_smallcap_browse", "xs quotes", "WITH " + DETAIL_SQL + f" SELECT {SEEN.format('brank AS rank, band AS risk_band')} FROM dt WHERE {CHOSEN} AND country = 'US' AND contains(upper(company_name), 'CORP') ORDER BY brank LIMIT 100")
def _(v: Views):
    return cal.browse(details(v), country="us", search=" corp ").select(*SEEN.format("rank, risk_band").split(", "))
