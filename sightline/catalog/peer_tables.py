"""Peer queries: A45, J16, J17, S18, X29."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.operators import peers
from sightline.session import cut

# Industry code from the nation and the segment; size is the order total in thousands, so that ties occur.
PEER_SQL = """pr AS (SELECT ticker, CAST(3000 + country_key * 10 + length(sector) % 3 AS VARCHAR) AS sic, floor(s2 / 1000) AS size, s2 IS NOT NULL AND ticker % 3 <> 0 AS usable, s1, s4 FROM xs),
  cn AS (SELECT sic, sum(CAST(usable AS INTEGER)) AS n FROM pr GROUP BY 1),
  ic AS (SELECT pr.*, n - CAST(usable AS INTEGER) < 15 AS widened, CASE WHEN n - CAST(usable AS INTEGER) < 15 THEN substr(pr.sic, 1, 3) ELSE pr.sic END AS industry FROM pr JOIN cn ON cn.sic = pr.sic),
  us AS (SELECT * FROM ic WHERE usable AND size > 0),
  cp AS (SELECT a.industry, a.ticker, b.ticker AS peer, round_even(abs(ln(b.size / a.size)) * 1e9, 0) / 1e9 AS distance FROM us a JOIN us b ON a.industry = b.industry AND a.ticker <> b.ticker),
  cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY distance, peer) AS place FROM cp) q WHERE place <= 8)"""


def coded(v: Views):
    rows = v.xs.select(
        "ticker", (3000 + F.col("country_key") * 10 + F.length("sector") % 3).cast("string").alias("sic"),
        F.floor(F.col("s2") / 1000).cast("double").alias("size"), (F.col("s2").isNotNull() & (F.col("ticker") % 3 != 0)).alias("usable"), "s1", "s4")
    return peers.industry_codes(rows, minimum=15)


@register("j17_industry_code", "xs", "WITH " + PEER_SQL + " SELECT ticker, industry, widened FROM ic")
def _(v: Views):
    return coded(v).select("ticker", "industry", "widened")


@register("j16_closest_peers", "xs", "WITH " + PEER_SQL + " SELECT ticker, peer, CAST(place AS INTEGER) AS place FROM cl")
def _(v: Views):
    return peers.closest_by_size(cut(coded(v).where("usable")), ["industry"], "size").select("ticker", "peer", "place")


@register("a45_peer_summary", "xs", "WITH " + PEER_SQL + f""", lm AS (SELECT ticker, 's1' AS metric, s1 AS value FROM us UNION ALL SELECT ticker, 's4', s4 FROM us)
  SELECT cl.ticker, o.metric, o.value AS company, {r('quantile_cont(p.value, 0.5)', 6)} AS median, count(*) AS count,
    round_even((count(*) FILTER (p.value < o.value) + count(*) FILTER (p.value = o.value) / 2.0::DOUBLE) / count(*) * 100 * 10, 0) / 10 AS percentile
  FROM cl JOIN lm p ON p.ticker = cl.peer JOIN lm o ON o.ticker = cl.ticker AND o.metric = p.metric WHERE p.value IS NOT NULL GROUP BY 1, 2, 3""")
def _(v: Views):
    rows = cut(coded(v).where("usable"))
    pairs = cut(peers.closest_by_size(rows, ["industry"], "size").select("ticker", "peer"))
    return peers.peer_summary(pairs, rows.where(F.col("size") > 0), ["s1", "s4"])


# Exchange rates: order priorities stand for currencies, mean prices for closes.
FX_SQL = """fc AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'CAD' WHEN '2-HIGH' THEN 'EUR' WHEN '3-MEDIUM' THEN 'USD' WHEN '5-LOW' THEN 'CHF' ELSE 'SEK' END AS base, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'GBP' ELSE 'USD' END AS quote,
    CAST(o_orderdate AS DATE) AS d, round_even(avg(o_totalprice), 0) / 100000 AS close FROM orders GROUP BY 1, 2, 3),
  l AS (SELECT base, quote, max_by(close, d) AS rate FROM fc WHERE close > 0 GROUP BY 1, 2),
  dr AS (SELECT * FROM l UNION ALL SELECT quote, base, 1.0::DOUBLE / rate FROM l),
  cr AS (SELECT a.base, b.quote, a.rate * b.rate AS rate FROM dr a JOIN dr b ON a.quote = 'USD' AND b.base = 'USD' AND a.base <> b.quote),
  fx AS (SELECT * FROM dr UNION ALL SELECT * FROM cr ANTI JOIN dr USING (base, quote))"""


def rates(v: Views):
    base = F.when(F.col("o_orderpriority") == "1-URGENT", "CAD").when(F.col("o_orderpriority") == "2-HIGH", "EUR").when(
        F.col("o_orderpriority") == "3-MEDIUM", "USD").when(F.col("o_orderpriority") == "5-LOW", "CHF").otherwise("SEK")
    closes = v.table("orders").groupBy(
        base.alias("base"), F.when(F.col("o_orderpriority") == "3-MEDIUM", "GBP").otherwise("USD").alias("quote"), F.to_date("o_orderdate").alias("d"),
    ).agg((F.rint(F.avg("o_totalprice")) / 100000).alias("close"))
    return peers.fx_rates(closes)


@register("s18_fx_table", "", "WITH " + FX_SQL + f" SELECT base, quote, {r('rate', 6)} AS rate FROM fx")
def _(v: Views):
    return rates(v).select("base", "quote", half_even("rate", 6).alias("rate"))


@register("x29_money_to_usd", "xs", "WITH " + FX_SQL + f""", m AS (SELECT ticker, s2, CASE ticker % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'cad' WHEN 2 THEN 'JPY' WHEN 3 THEN NULL ELSE 'USD' END AS cur FROM xs)
  SELECT ticker, {r("CASE WHEN upper(COALESCE(cur, 'USD')) = 'USD' THEN s2 ELSE s2 * rate END", 2)} AS usd FROM m LEFT JOIN fx ON quote = 'USD' AND base = upper(cur)""")
def _(v: Views):
    kind = F.col("ticker") % 5
    rows = v.xs.select("ticker", "s2", F.when(kind == 0, "EUR").when(kind == 1, "cad").when(kind == 2, "JPY").when(kind == 4, "USD").alias("cur"))
    return peers.to_usd(rows, rates(v), "s2", "cur", "usd").select("ticker", "usd")
