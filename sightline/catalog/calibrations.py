"""Calibration and coverage queries: A1-A4, A31-A33, A40, A51, F18, P10, P26, R6, R8."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog.quotes import quotes
from sightline.catalog.registry import register
from sightline.catalog.rows import CLASS_SQL, FACTOR_SQL, factor_rows, scored_quotes
from sightline.catalog.views import Views
from sightline.functions.scalars import half_even
from sightline.functions import ranking
from sightline.operators import calibration as cal
from sightline.operators import coverage, rules
from sightline.session import cut


@register("a01_run_summary", "xs quotes", "WITH " + CLASS_SQL + """ SELECT 'country' AS dimension, country AS value, count(*) AS n FROM pf GROUP BY 1, 2 UNION ALL SELECT 'status', CASE WHEN filter_reason IS NULL THEN 'OK' ELSE 'FILTERED' END, count(*) FROM pf GROUP BY 1, 2
  UNION ALL SELECT 'reason', split_part(COALESCE(filter_reason, 'UNKNOWN'), ':', 1), count(*) FROM pf GROUP BY 1, 2""")
def _(v: Views):
    return coverage.count_by(rules.pre_filter(quotes(v)), {
        "country": F.col("country"), "status": F.when(F.col("passed"), "OK").otherwise("FILTERED"),
        "reason": coverage.failure_stage(F.col("filter_reason"))})


@register("a03_factor_coverage", "xs quotes", "WITH " + FACTOR_SQL + """, u AS (SELECT 'all' AS dimension, 'all' AS value, * FROM fl UNION ALL SELECT 'country', country, * FROM fl UNION ALL SELECT 'sector', sector, * FROM fl)
  SELECT dimension, value, factor, count(*) FILTER (available) AS available, count(*) FILTER (applicable) AS applicable, count(*) AS total,
    COALESCE(round_even(count(*) FILTER (available)::DOUBLE / nullif(count(*) FILTER (applicable), 0) * 100 * 100, 0) / 100, 0) AS percentage FROM u GROUP BY 1, 2, 3""")
def _(v: Views):
    return coverage.factor_coverage(factor_rows(v), ["country", "sector"])


@register("a04_confidence_buckets", "xs quotes", "WITH " + FACTOR_SQL + """, b AS (SELECT CASE WHEN fundamental_confidence >= 100 THEN '100' WHEN fundamental_confidence >= 75 THEN '75-99' WHEN fundamental_confidence >= 50 THEN '50-74' WHEN fundamental_confidence >= 25 THEN '25-49' ELSE '0-24' END AS bucket FROM fs)
  SELECT n.bucket, count(b.bucket) AS n FROM (VALUES ('0-24'), ('25-49'), ('50-74'), ('75-99'), ('100')) n(bucket) LEFT JOIN b ON b.bucket = n.bucket GROUP BY 1""")
def _(v: Views):
    return coverage.confidence_buckets(cut(scored_quotes(v).select("ticker", "fundamental_confidence")), "fundamental_confidence")


@register("a32_factor_readiness", "xs quotes", "WITH " + FACTOR_SQL + """, c AS (SELECT factor, COALESCE(round_even(count(*) FILTER (available)::DOUBLE / nullif(count(*) FILTER (applicable), 0) * 10000, 0) / 100, 0) AS percentage FROM fl GROUP BY 1)
  SELECT factor, percentage, CASE WHEN percentage >= 75 THEN 'ready' WHEN percentage >= 40 THEN 'limited' ELSE 'shadow_only' END AS readiness FROM c""")
def _(v: Views):
    return coverage.factor_readiness(coverage.factor_coverage(factor_rows(v))).select("factor", "percentage", "readiness")


@register("f18_outlier_flags", "xs quotes", "WITH " + FACTOR_SQL + """, o AS (SELECT ticker, factor || CASE WHEN COALESCE(source_value, raw_value) < lo THEN ' below' ELSE ' above' END AS flag FROM fl JOIN (VALUES """ + ", ".join(
    f"('{name}', {p[0]}, {p[1]})" for name, (_, _, _, p) in __import__("sightline.config", fromlist=["C"]).FUNDAMENTAL_FACTORS.items()) + """) b(f, lo, hi) ON f = factor WHERE COALESCE(source_value, raw_value) < lo OR COALESCE(source_value, raw_value) > hi)
  SELECT ticker, string_agg(flag, '; ' ORDER BY flag) AS outlier_flags FROM o GROUP BY 1""")
def _(v: Views):
    return cal.outlier_flags(factor_rows(v), ["ticker"])


def blended(v: Views):
    """Official order by s2, technical percentile of s2, peer percentile of s1 in the sector."""
    base = v.xs.where(F.col("s2").isNotNull()).select("ticker", "country", "sector", F.col("s2"), F.col("s1"))
    ranked = ranking.positions(base, [], [-F.col("s2"), F.col("ticker")], name="official_rank")
    placed = ranking.attach_ladder(cut(ranked), [], "s2", "t_")
    both = ranking.attach_ladder(placed, ["sector"], "s1", "p_")
    return cut(both.select(
        "ticker", "country", "sector", "official_rank",
        ranking.percent_spread("t_n", "t_below", "t_total", alone=100.0, digits=2).alias("technical_percentile"),
        ranking.percent_spread("p_n", "p_below", "p_total", alone=100.0, digits=2).alias("peer_percentile")))


BLEND_SQL = """bb AS (SELECT ticker, sector, row_number() OVER (ORDER BY s2 DESC, ticker) AS official_rank, round_even((rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2.0 - 1) / (count(*) OVER () - 1) * 100 * 100, 0) / 100 AS tp,
    round_even((rank() OVER (PARTITION BY sector ORDER BY s1) + (count(*) OVER (PARTITION BY sector, s1) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY sector) - 1) * 100 * 100, 0) / 100 AS pp FROM xs WHERE s2 IS NOT NULL),
  sx AS (SELECT ticker, official_rank, scenario, fw, CASE WHEN fw = 0 OR official_rank <= 100 THEN round_even((tp * tw + COALESCE(pp, 50) * fw) * 100, 0) / 100 END AS score FROM bb, (VALUES ('technical_100', 1.0::DOUBLE, 0.0::DOUBLE), ('technical_80_fundamental_20', 0.8::DOUBLE, 0.2::DOUBLE), ('technical_70_fundamental_30', 0.7::DOUBLE, 0.3::DOUBLE)) s(scenario, tw, fw)),
  sr AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, ticker) AS rank FROM sx WHERE fw = 0
    UNION ALL SELECT *, floor((official_rank - 1) / 25) * 25 + row_number() OVER (PARTITION BY scenario, floor((official_rank - 1) / 25) ORDER BY score DESC NULLS LAST, ticker) FROM sx WHERE fw > 0 AND official_rank <= 100)"""


def ranks(v: Views):
    return cut(cal.scenario_ranks(cut(cal.scenario_scores(blended(v)))))


@register("r06_banded_rerank", "xs", "WITH " + BLEND_SQL + " SELECT ticker, scenario, official_rank, score, CAST(rank AS BIGINT) AS rank FROM sr")
def _(v: Views):
    return ranks(v).select("ticker", "scenario", "official_rank", "score", "rank")


@register("r08_scenario_promotions", "xs", "WITH " + BLEND_SQL + """ SELECT scenario, ticker, CAST(official_rank - rank AS BIGINT) AS rank_movement FROM sr QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY official_rank - rank DESC, ticker) <= 20""")
def _(v: Views):
    return cal.movements(ranks(v), True).select("scenario", "ticker", "rank_movement")


@register("a33_scenario_acceptance", "xs", "WITH " + BLEND_SQL + """ SELECT scenario, count(*) FILTER (official_rank <= 20 AND rank <= 20) AS top_20, count(*) FILTER (official_rank <= 50 AND rank <= 50) AS top_50, CAST(max(abs(official_rank - rank)) AS BIGINT) AS largest_movement FROM sr GROUP BY 1""")
def _(v: Views):
    return cal.scenario_acceptance(ranks(v), gap=0.0).select("scenario", "top_20", "top_50", "largest_movement")


@register("a31_percentile_correlation", "xs", "WITH " + BLEND_SQL + " SELECT count(*) AS count, round_even(corr(tp, pp) * 1e4, 0) / 1e4 AS value FROM bb WHERE pp IS NOT NULL")
def _(v: Views):
    return cal.percentile_correlation(blended(v), "technical_percentile", "peer_percentile")


@register("a40_scenario_agreement", "xs", "WITH " + BLEND_SQL + """, vt AS (SELECT cutoff, ticker, count(DISTINCT scenario) AS votes FROM sr JOIN (VALUES (10), (25), (50), (100)) c(cutoff) ON rank <= cutoff GROUP BY 1, 2)
  SELECT cutoff, count(*) FILTER (votes = 3) AS common_candidates, count(*) AS union_candidates, round_even(count(*) FILTER (votes = 3)::DOUBLE / count(*) * 10000, 0) / 100 AS jaccard_percentage FROM vt GROUP BY 1""")
def _(v: Views):
    return cal.scenario_agreement(ranks(v), 3)


@register("p26_consensus_ranking", "xs", "WITH " + BLEND_SQL + """, mg AS (SELECT ticker, round_even(avg(rank)::DOUBLE * 100, 0) / 100 AS average_rank, min(rank) AS lo, max(rank) AS hi FROM sr GROUP BY 1)
  SELECT ticker, row_number() OVER (ORDER BY average_rank, ticker) AS consensus_rank, CASE WHEN hi - lo <= 5 THEN 'stable' ELSE 'weight_sensitive' END AS rank_sensitivity FROM mg""")
def _(v: Views):
    return cal.consensus(ranks(v)).select("ticker", "consensus_rank", "rank_sensitivity")
