"""Sinks, read back: K1, K2, K3, K4, K5; scenarios and small summaries: A29, A34, A51, U4, X19."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.smallcaps import EXIT_SQL, exit_rows
from sightline.catalog.views import Views, r
from sightline.operators import calibration, coverage, exits, smallcap
from sightline.session import recovery_directory
from sightline.sinks import tables


def folder(v: Views) -> str:
    return f"{recovery_directory(v.spark)}/sinks-{uuid.uuid4().hex}"


@register("k01_indexed_runs", "runs", "SELECT run_id, ticker, status, discovery_score FROM runs")
def _(v: Views):
    """All runs, then the even ones again: each is there once."""
    path = folder(v)
    rows = v.runs.select("run_id", "ticker", "status", "discovery_score")
    tables.index_runs(rows, path)
    tables.index_runs(rows.where("run_id % 2 = 0"), path)
    return v.spark.read.schema("ticker long, status string, discovery_score double, run_id int").parquet(path).select(*rows.columns)


@register("k02_score_report", "runs", "SELECT ticker, run_id, round_even(discovery_score * 100, 0) / 100 AS score FROM runs WHERE discovery_score IS NOT NULL")
def _(v: Views):
    path = folder(v)
    rows = v.runs.where("discovery_score is not null").select("ticker", "run_id", F.expr("rint(discovery_score * 100) / 100").alias("score"))
    tables.score_report(rows, path, F.col("score"), [F.col("run_id"), F.col("ticker")])
    return v.spark.read.schema("ticker long, run_id int, score double").option("header", "true").csv(path)


@register("k03_observation_export", "runs", """SELECT run_id, ticker, 'score' AS measure, round_even(discovery_score * 100, 0) / 100 AS value FROM runs WHERE discovery_score IS NOT NULL
  UNION ALL SELECT run_id, ticker, 'listed', CASE WHEN status = 'OK' THEN 1.0 ELSE 0.0 END FROM runs""")
def _(v: Views):
    path = folder(v)
    wide = v.runs.select("run_id", "ticker", F.expr("rint(discovery_score * 100) / 100").alias("score"),
                         F.when(F.col("status") == "OK", 1.0).otherwise(0.0).alias("listed"))
    tables.observations(tables.flat_periods(wide, ["run_id", "ticker"], ["score", "listed"]), path)
    return v.spark.read.schema("run_id int, ticker long, measure string, value double").option("header", "true").csv(path)


@register("k04_frozen_cohort", "runs", "SELECT run_id, ticker, TRUE AS refused FROM runs WHERE status = 'OK'")
def _(v: Views):
    """Freeze a cohort, try to freeze another one under its id, read the first."""
    path = folder(v)
    cohort = v.runs.where("status = 'OK'").select("run_id", "ticker")
    stored = tables.freeze(cohort, path, "ok-names")
    try:
        tables.freeze(cohort.limit(1), path, "ok-names")
        refused = False
    except FileExistsError:
        refused = True
    return v.spark.read.parquet(stored).withColumn("refused", F.lit(refused))


@register("k05_resolved_rows", "runs", "SELECT run_id, ticker, status FROM runs WHERE status IS DISTINCT FROM 'FAILED'")
def _(v: Views):
    path = folder(v)
    tables.observations(tables.resolved_rows(v.runs.select("run_id", "ticker", "status"), pending="FAILED"), path)
    return v.spark.read.schema("run_id int, ticker long, status string").option("header", "true").csv(path)


@register("a29_monthly_rates", "", "WITH " + EXIT_SQL + f""", d AS (SELECT ex.cik, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'bankruptcy' ELSE 'acquired' END AS t FROM ex JOIN orders ON o_custkey = ex.cik),
  m AS (SELECT *, count(*) OVER (PARTITION BY cik) AS n FROM d)
  SELECT cik AS ticker, k, {r("(power(1.0 + CASE t WHEN 'bankruptcy' THEN -0.9 ELSE 0.2 END, 1.0 / n) - 1.0) * 100.0", 6)} AS monthly_rate FROM m""")
def _(v: Views):
    months = v.table("orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("k"),
                                      F.when(F.col("o_orderkey") % 3 == 0, "bankruptcy").otherwise("acquired").alias("exit_type"))
    dead = exit_rows(v).join(months, "cik").withColumnRenamed("cik", "ticker")
    return exits.monthly_rates(dead, {"bankruptcy": -0.9, "acquired": 0.2}).select("ticker", "k", "monthly_rate")


@register("a51_reason_counts", "", """SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(o_comment, '; ')) AS reason FROM (
  SELECT o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '; ' || o_orderstatus ELSE '' END AS o_comment FROM orders)) GROUP BY 1""")
def _(v: Views):
    listed = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("; "), "o_orderstatus")).otherwise(""))
    return coverage.reason_counts(v.table("orders").select(listed.alias("reasons")), "reasons")


@register("u04_top_overlap", "", """WITH a AS (SELECT c_custkey AS ticker, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS a, row_number() OVER (ORDER BY c_custkey % 97, c_custkey) AS b FROM customer),
  n AS (SELECT unnest([25, 100]) AS cutoff)
  SELECT cutoff, count(*) FILTER (a <= cutoff AND b <= cutoff) AS shared, round_even(count(*) FILTER (a <= cutoff AND b <= cutoff)::DOUBLE / least(cutoff, count(*) FILTER (a <= cutoff), count(*) FILTER (b <= cutoff)) * 100 * 100, 0) / 100 AS percentage
  FROM a CROSS JOIN n GROUP BY 1""")
def _(v: Views):
    from sightline.functions import ranking

    rows = v.table("customer").select(F.col("c_custkey").alias("ticker"), "c_acctbal")
    first = ranking.positions(rows, [], [-F.col("c_acctbal"), F.col("ticker")], name="a")
    both = ranking.positions(first, [], [F.col("ticker") % 97, F.col("ticker")], name="b")
    return calibration.top_overlap(both, "a", "b", [25, 100])


BASE = {"a": 50.0, "b": 30.0, "c": 20.0}
SCENARIOS = {"base": {}, "growth": {"a": 1.5}, "thrift": {"c": 0.5, "b": 1.2}}
SCENARIO_SQL = "f AS (SELECT c_custkey AS ticker, (c_custkey % 11) / 10.0::DOUBLE AS a, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey * 7 % 13) / 12.0::DOUBLE END AS b, (c_custkey % 17) / 16.0::DOUBLE AS c FROM customer), sc AS (" + \
    " UNION ALL ".join("SELECT ticker, '" + name + "' AS scenario, " + r(
        " + ".join(f"COALESCE({k}, 0) * {w!r}::DOUBLE" for k, w in smallcap.scenario_weights(BASE, m).items()), 6) + " AS score FROM f"
        for name, m in SCENARIOS.items()) + \
    "), rk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, ticker) AS rank FROM sc)"


def scenario_rows(v: Views):
    key = F.col("c_custkey")
    rows = v.table("customer").select(key.alias("ticker"), ((key % 11) / 10.0).alias("a"),
                                      F.when(key % 5 > 0, (key * 7 % 13) / 12.0).alias("b"), ((key % 17) / 16.0).alias("c"))
    return smallcap.scenario_ranks(rows, BASE, SCENARIOS)


@register("x19_scenario_ranks", "", "WITH " + SCENARIO_SQL + " SELECT ticker, scenario, score, rank FROM rk")
def _(v: Views):
    return scenario_rows(v).select("ticker", "scenario", "score", "rank")


@register("a34_rank_sensitivity", "", "WITH " + SCENARIO_SQL + f""" SELECT ticker, min(rank) AS minimum_rank, max(rank) AS maximum_rank, max(rank) - min(rank) AS rank_range, {r('stddev_pop(rank)', 2)} AS rank_standard_deviation FROM rk GROUP BY 1""")
def _(v: Views):
    return smallcap.rank_sensitivity(scenario_rows(v))


@register("a34_scenario_overlaps", "", "WITH " + SCENARIO_SQL + """ SELECT a.scenario AS first, b.scenario AS second, count(*) AS shared FROM rk a JOIN rk b ON a.ticker = b.ticker AND a.scenario < b.scenario WHERE a.rank <= 50 AND b.rank <= 50 GROUP BY 1, 2""")
def _(v: Views):
    return smallcap.scenario_overlaps(scenario_rows(v), 50)


@register("a34_sensitivity_summary", "", "WITH " + SCENARIO_SQL + f""", s AS (SELECT max(rank) - min(rank) AS g FROM rk GROUP BY ticker)
  SELECT {r('quantile_cont(g, 0.5)', 2)} AS median_rank_range, {r('quantile_cont(g, 0.9)', 2)} AS p90_rank_range FROM s""")
def _(v: Views):
    return smallcap.sensitivity_summary(smallcap.rank_sensitivity(scenario_rows(v)))
