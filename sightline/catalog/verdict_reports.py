"""Cohort outcomes by review verdict: J19, A20."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.timelines import MEMBER_SQL, resolved
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.plans import verdicts
from sightline.session import cut

REVIEW = {"verdict": "CASE ticker % 6 WHEN 0 THEN 'clear' WHEN 1 THEN 'caution' WHEN 2 THEN 'avoid' WHEN 5 THEN 'clear' END",
          "status": "CASE ticker % 6 WHEN 3 THEN 'not_reviewed' ELSE 'validation_failed' END",
          "defensive": "CASE WHEN ticker % 4 <> 0 THEN CAST(ticker * 7 % 10 AS DOUBLE) END", "discount": "CASE ticker % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END"}
REVIEW_SQL = MEMBER_SQL + ", nm AS (SELECT ticker FROM listing UNION ALL SELECT ticker + 1000000 FROM listing WHERE ticker % 9 = 0), re AS (SELECT ticker, " + ", ".join(f"{e} AS {n}" for n, e in REVIEW.items()) + f""" FROM nm),
  ro AS (SELECT horizon, ticker, COALESCE(verdict, re.status) AS verdict, defensive, discount, {r('x', 4)} AS excess FROM rv JOIN re USING (ticker) WHERE rv.status = 'resolved' AND x IS NOT NULL),
  tg AS (SELECT ro.*, g AS grp FROM ro, (VALUES ('clear', 'clear'), ('caution', 'caution'), ('avoid', 'avoid'), ('not_reviewed', 'not_reviewed'), ('validation_failed', 'validation_failed'), ('caution', 'flagged'), ('avoid', 'flagged'), ('clear', 'rest'), ('caution', 'rest')) m(v, g) WHERE v = verdict
    UNION ALL SELECT ro.*, CASE discount WHEN 'no' THEN 'unexplained' ELSE 'explained' END FROM ro WHERE discount IS NOT NULL)"""


def _less(a: str, b: str) -> str:
    return r(f"quantile_cont(excess, 0.5) FILTER (grp = '{a}') - quantile_cont(excess, 0.5) FILTER (grp = '{b}')", 2)


def reviews(v: Views):
    names = v.listing.select("ticker")
    more = names.where("ticker % 9 = 0").select((F.col("ticker") + 1000000).alias("ticker"))
    return names.unionByName(more).selectExpr("ticker", *[f"{expression} AS {name}" for name, expression in REVIEW.items()])


def outcomes(v: Views):
    rounded = resolved(v).withColumn("excess_return_percent", half_even("excess_return_percent", 4))
    return cut(verdicts.reviewed_outcomes(rounded, reviews(v)))


@register("j19_reviews_outside_cohort", "px bench listing", "WITH " + REVIEW_SQL + " SELECT ticker FROM re WHERE ticker NOT IN (SELECT ticker FROM mb)")
def _(v: Views):
    return verdicts.outside_cohort(reviews(v), resolved(v))


@register("a20_verdict_outcomes", "px bench listing", "WITH " + REVIEW_SQL + f""" SELECT horizon, grp AS "group", count(*) AS resolved, {r('quantile_cont(excess, 0.5)', 2)} AS median_excess_percent, {r('count(*) FILTER (excess > 0) * 100.0::DOUBLE / count(*)', 2)} AS win_rate_percent FROM tg GROUP BY 1, 2""")
def _(v: Views):
    return verdicts.verdict_outcomes(outcomes(v))


@register("a20_verdict_spreads", "px bench listing", "WITH " + REVIEW_SQL + f" SELECT horizon, {_less('rest', 'avoid')} AS rest_minus_avoid, {_less('clear', 'flagged')} AS clear_minus_flagged, {_less('unexplained', 'explained')} AS unexplained_minus_explained FROM tg GROUP BY 1")
def _(v: Views):
    return verdicts.verdict_spreads(outcomes(v))


@register("a20_defensive_thirds", "px bench listing", "WITH " + REVIEW_SQL + f""", th AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY horizon ORDER BY defensive, ticker) * 3.0::DOUBLE / count(*) OVER (PARTITION BY horizon)) AS INTEGER) AS third, count(*) OVER (PARTITION BY horizon) AS size
    FROM ro WHERE verdict IN ('clear', 'caution', 'avoid') AND defensive IS NOT NULL)
  SELECT horizon, third, count(*) AS names, {r("quantile_cont(excess, 0.5) FILTER (verdict IN ('clear', 'caution')) - quantile_cont(excess, 0.5) FILTER (verdict = 'avoid')", 2)} AS rest_minus_avoid FROM th WHERE size >= 3 GROUP BY 1, 2""")
def _(v: Views):
    return verdicts.defensive_thirds(outcomes(v))


#: The least names of a horizon here: the operator asks for 50, which no horizon of the small tables has.
SCREENED = 20
SCREEN_SQL = MEMBER_SQL + f""", sc AS (SELECT horizon, ticker, CAST(ticker * 7 % 10 AS DOUBLE) AS d, CAST(ticker * 31 % 97 AS DOUBLE) AS v, {r('x', 4)} AS x FROM rv WHERE status = 'resolved' AND x IS NOT NULL AND ticker % 7 <> 0 AND ticker % 5 <> 0),
  sk AS (SELECT *, count(*) OVER h AS n, row_number() OVER (PARTITION BY horizon ORDER BY d, ticker) AS k, rank() OVER (PARTITION BY horizon ORDER BY d) + (count(*) OVER (PARTITION BY horizon, d) - 1) / 2.0 AS rd,
    rank() OVER (PARTITION BY horizon ORDER BY v) + (count(*) OVER (PARTITION BY horizon, v) - 1) / 2.0 AS rv_, rank() OVER (PARTITION BY horizon ORDER BY x) + (count(*) OVER (PARTITION BY horizon, x) - 1) / 2.0 AS rx FROM sc WINDOW h AS (PARTITION BY horizon))"""


def screened(v: Views):
    key = F.col("ticker")
    rows = resolved(v).where("status = 'resolved'").select(
        "horizon", "ticker", F.when(key % 7 != 0, "passes").otherwise("fails").alias("screen_status"), (key * 7 % 10).cast("double").alias("score_defensive"),
        F.when(key % 5 != 0, (key * 31 % 97).cast("double")).alias("score_v3"), half_even("excess_return_percent", 4).alias("excess"))
    return cut(verdicts.screened(rows))


@register("a19_screen_correlations", "px bench listing", "WITH " + SCREEN_SQL + f""", cc AS (SELECT horizon, count(*) AS resolved, CASE WHEN count(*) >= 20 THEN {r('corr(rd, rx)', 4)} END AS a, CASE WHEN count(*) >= 20 THEN {r('corr(rv_, rx)', 4)} END AS b FROM sk GROUP BY 1)
  SELECT horizon, resolved, a AS ic_defensive, b AS ic_v3, {r('a - b', 4)} AS defensive_minus_v3 FROM cc""")
def _(v: Views):
    return verdicts.screen_correlations(screened(v), SCREENED)


@register("a19_screen_terciles", "px bench listing", "WITH " + SCREEN_SQL + f""" SELECT horizon, least(2, (k - 1) * 3 // n) + 1 AS tercile, count(*) AS resolved, {r('quantile_cont(x, 0.5)', 2)} AS median_excess_percent, {r('count(*) FILTER (x > 0) * 100.0::DOUBLE / count(*)', 2)} AS win_rate_percent FROM sk WHERE n >= 20 GROUP BY 1, 2""")
def _(v: Views):
    return verdicts.screen_terciles(screened(v), SCREENED)
