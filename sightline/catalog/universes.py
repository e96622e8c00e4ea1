"""Universe queries and small summaries: S1, F3, F4, F22, A44, A53, J15, S19."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog.quotes import quotes
from sightline.catalog.registry import register
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.operators import coverage, floats
from sightline.sources import universe


@register("s01_universe_scan", "", """SELECT upper('n' || p_partkey % 700) AS ticker, min_by(p_brand, p_partkey) AS source_brand FROM part WHERE p_size % 4 <> 0 GROUP BY 1""")
def _(v: Views):
    rows = v.table("part").select(F.concat(F.lit(" n"), F.col("p_partkey") % 700).alias("ticker"), F.col("p_brand").alias("source_brand"),
                                  F.when(F.col("p_size") % 4 == 0, "false").otherwise("true").alias("enabled"), "p_partkey")
    return universe.enabled_listings(rows, [F.col("p_partkey")]).select("ticker", "source_brand")


@register("f03_clean_us_universe", "xs quotes", """SELECT 'N' || ticker || CASE WHEN ticker % 12 = 5 THEN '$A' ELSE '' END AS ticker FROM quotes WHERE NOT regexp_matches(company_name, 'Warrant|Right|Unit|Preferred|Depositary|Notes|Bond|ETF|Fund', 'i') AND ticker % 12 <> 5""")
def _(v: Views):
    rows = quotes(v).select(F.concat(F.lit("N"), F.col("ticker"), F.when(F.col("ticker") % 12 == 5, "$A").otherwise("")).alias("ticker"), "company_name")
    return universe.clean_us(rows).select("ticker")


@register("f04_clean_canadian_universe", "xs quotes", """SELECT CAST(ticker AS VARCHAR) AS ticker FROM quotes WHERE ticker % 6 <> 1 AND ticker % 8 <> 2 AND ticker % 10 <> 3 AND NOT regexp_matches(company_name, '\\bwarrant\\b|\\brights?\\b', 'i') AND ticker % 9 <> 4 AND market_cap BETWEEN 1e7 AND 1e9""")
def _(v: Views):
    t = F.col("ticker")
    rows = quotes(v).select(
        t.cast("string").alias("ticker"), "company_name", F.when(t % 6 == 1, "CSE").otherwise("TSX").alias("exchange"),
        F.when(t % 8 == 2, "ETP").otherwise("Mining").alias("sector"), F.when(t % 10 == 3, "Y").alias("trust"),
        F.when(t % 9 == 4, "ABC.W").otherwise("ABC").alias("root_ticker"), F.col("market_cap").alias("market_cap_source_cad"))
    return universe.clean_canadian(rows, [F.col("root_ticker")]).select("ticker")


@register("j14_dead_observations", "", f"""WITH ex AS (SELECT c_custkey AS cik, DATE '1996-03-10' + CAST(c_custkey % 900 AS INTEGER) AS exit_date FROM customer WHERE c_custkey % 3 = 0),
  mo AS (SELECT cik, exit_date, last_day(CAST(unnest(generate_series(DATE '1995-01-01', exit_date, INTERVAL 1 MONTH)) AS DATE)) AS as_of FROM ex),
  q AS (SELECT * FROM mo WHERE as_of < exit_date),
  fl AS (SELECT cik, exit_date, as_of, max_by(o_totalprice, row(o_orderdate, o_orderkey)) AS f FROM q JOIN orders ON o_custkey = cik AND CAST(o_orderdate AS DATE) + 45 <= as_of AND as_of - CAST(o_orderdate AS DATE) <= 550 GROUP BY 1, 2, 3)
  SELECT cik, CAST(exit_date AS VARCHAR) AS exit_date, CAST(as_of AS VARCHAR) AS as_of, {r('f / 0.75', 4)} AS estimated_cap FROM fl WHERE f / 0.75 BETWEEN 100000 AND 300000""")
def _(v: Views):
    held = v.table("orders").select(F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("end"), F.col("o_totalprice").alias("val"),
                                    F.date_add(F.to_date("o_orderdate"), 45).alias("filed"), F.col("o_orderkey").alias("frame"))
    gone = v.table("customer").where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("cik"), F.expr("date_add(date'1996-03-10', int(c_custkey % 900))").alias("exit_date"))
    found = floats.dead_observations(gone, held, "1995-01-01", 100000.0, 300000.0, ["frame"])
    return found.select("cik", F.col("exit_date").cast("string").alias("exit_date"), F.col("as_of").cast("string").alias("as_of"),
                        half_even("estimated_cap", 4).alias("estimated_cap"))


@register("f22_allowed_urls", "", """WITH h AS (SELECT page_id, url LIKE 'https://%' AS s, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)
  SELECT page_id, COALESCE(s AND (host = 'example.com' OR host LIKE '%.example.com'), FALSE) AS allowed FROM h""")
def _(v: Views):
    return v.table("pages").select("page_id", universe.allowed_url(F.col("url"), ["example.com"]).alias("allowed"))


@register("a44_discovery_quality", "runs", """SELECT run_id, count(*) AS total, round_even(count(*) FILTER (discovery_score < 20000)::DOUBLE / count(*) * 1e6, 0) / 1e6 AS error_rate, count(*) FILTER (discovery_score < 20000)::DOUBLE / count(*) <= 0.02 AS passed FROM runs GROUP BY 1""")
def _(v: Views):
    return coverage.discovery_quality(v.runs, ["run_id"], F.col("discovery_score") < 20000)


@register("a53_score_median", "runs", f"""WITH m AS (SELECT run_id, quantile_cont(discovery_score, 0.5) AS md FROM runs WHERE status = 'OK' GROUP BY 1)
  SELECT runs.run_id, ticker, {r('discovery_score - md', 3)} AS above_median FROM runs JOIN m ON m.run_id = runs.run_id WHERE status = 'OK'""")
def _(v: Views):
    return coverage.from_median(v.runs.where(F.col("status") == "OK"), ["run_id"], "discovery_score").select(
        "run_id", "ticker", "above_median")


@register("s19_latest_public_floats", "", """SELECT o_custkey AS cik, max_by(o_totalprice, row(o_orderdate, -o_orderkey)) AS public_float FROM orders WHERE o_totalprice > 0 GROUP BY 1""")
def _(v: Views):
    frames = v.table("orders").select(F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("end"),
                                      F.col("o_totalprice").alias("val"), F.col("o_orderkey").alias("frame"))
    return floats.latest_public_floats(frames)


@register("j15_public_float_as_of", "", """WITH q AS (SELECT c_custkey AS cik, DATE '1994-06-30' + CAST(c_custkey % 1500 AS INTEGER) AS as_of FROM customer)
  SELECT cik, strftime(as_of, '%Y-%m-%d') AS as_of, max_by(o_totalprice, row(o_orderdate, o_orderkey)) AS public_float FROM q JOIN orders ON o_custkey = cik AND CAST(o_orderdate AS DATE) + 45 <= as_of AND as_of - CAST(o_orderdate AS DATE) <= 550 GROUP BY 1, 2""")
def _(v: Views):
    held = v.table("orders").select(F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("end"), F.col("o_totalprice").alias("val"),
                                    F.date_add(F.to_date("o_orderdate"), 45).alias("filed"), F.col("o_orderkey").alias("frame"))
    asked = v.table("customer").select(F.col("c_custkey").alias("cik"), F.expr("date_add(date'1994-06-30', int(c_custkey % 1500))").alias("as_of"))
    return floats.public_float_as_of(asked, held, ["frame"]).withColumn("as_of", F.col("as_of").cast("string"))
