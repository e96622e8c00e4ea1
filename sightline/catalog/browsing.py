"""Browse queries: A2, A41, F13, R4."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.views import Views, r
from sightline.operators import browse, coverage, history
from sightline.session import cut

RANKED_SQL = """rn AS (SELECT *, CASE WHEN status = 'OK' THEN row_number() OVER (PARTITION BY status ORDER BY discovery_score DESC, ticker) END AS rank FROM runs WHERE run_id = (SELECT max(run_id) FROM runs))"""


@register("f13_candidates", "runs", "WITH " + RANKED_SQL + f""", o AS (SELECT discovery_score AS s FROM rn WHERE status = 'OK'),
  p AS (SELECT s, {r('((SELECT count(*) FROM o o2 WHERE o2.s <= o1.s) - 1)::DOUBLE / nullif((SELECT count(*) FROM o) - 1, 0) * 100.0', 2)} AS discovery_percentile FROM (SELECT DISTINCT s FROM o) o1)
  SELECT ticker, sector, rank, discovery_percentile FROM rn LEFT JOIN p ON s = discovery_score AND status = 'OK' WHERE status = 'OK' AND sector = 'BUILDING' AND contains(CAST(ticker AS VARCHAR), '7') ORDER BY rank, ticker LIMIT 40""")
def _(v: Views):
    rows = cut(browse.newest(v.runs))
    return browse.candidates(rows, "ok", "7", {"sector": "building"}, 40).select("ticker", "sector", "rank", "discovery_percentile")


@register("a41_top_composition", "runs", "WITH " + RANKED_SQL + """ SELECT cutoff, 'sector' AS field, COALESCE(sector, 'UNKNOWN') AS value, count(*) AS n FROM rn, (SELECT unnest([25, 100]) AS cutoff) WHERE rank <= cutoff GROUP BY ALL
  UNION ALL SELECT cutoff, 'status', status, count(*) FROM rn, (SELECT unnest([25, 100]) AS cutoff) WHERE rank <= cutoff GROUP BY ALL""")
def _(v: Views):
    return browse.top_composition(history.with_ranks(cut(browse.newest(v.runs))), "rank", ["sector", "status"])


@register("r04_report_ranks", "runs", """WITH rn AS (SELECT ticker, discovery_score, CASE WHEN ticker % 4 > 0 THEN CAST(ticker * 37 % 101 AS DOUBLE) END AS f FROM runs WHERE run_id = (SELECT max(run_id) FROM runs)),
  k AS (SELECT ticker, row_number() OVER (ORDER BY discovery_score DESC, ticker) AS official_rank, row_number() OVER (ORDER BY f DESC NULLS LAST, ticker) AS fundamental_rank FROM rn)
  SELECT * FROM k""")
def _(v: Views):
    rows = browse.newest(v.runs).select("ticker", "discovery_score", F.when(F.col("ticker") % 4 > 0, (F.col("ticker") * 37 % 101).cast("double")).alias("f"))
    return browse.report_ranks(rows, {"official_rank": F.col("discovery_score"), "fundamental_rank": F.col("f")}).select(
        "ticker", "official_rank", "fundamental_rank")


@register("a02_run_analytics", "runs", """SELECT 'status' AS dimension, status AS value, count(*) AS n FROM runs GROUP BY 2 UNION ALL SELECT 'sector', sector, count(*) FROM runs GROUP BY 2
  UNION ALL SELECT 'run', CAST(run_id AS VARCHAR), count(*) FROM runs GROUP BY 2""")
def _(v: Views):
    return coverage.count_by(v.runs, {"status": F.col("status"), "sector": F.col("sector"), "run": F.col("run_id")})
