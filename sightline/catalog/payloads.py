"""Payload queries: S7, S13, S20, S24, R12."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.views import Views
from sightline.sources import filings, pages


def payloads(v: Views):
    """Each order as one company-facts document: odd keys report a duration, even ones an instant."""
    start = F.when(F.col("o_orderkey") % 2 == 1, F.lit("1995-01-01"))
    entry = F.struct(start.alias("start"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"),
                     F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("filed"), F.lit("10-K").alias("form"))
    unit = F.when(F.col("o_orderkey") % 7 == 0, "shares").otherwise("USD")
    body = F.struct(F.create_map(unit, F.array(entry)).alias("units"))
    # Both alias tags carry the same fact, so the first one must win.
    tags = F.create_map(F.lit("SalesRevenueNet"), body, F.lit("Revenues"), body, F.lit("Assets"), body, F.lit("Other"), body)
    return v.table("orders").select(F.col("o_custkey").alias("company"), F.to_json(F.struct(
        F.create_map(F.lit("us-gaap"), tags).alias("facts"))).alias("payload"))


@register("s07_company_facts", "", """WITH f AS (SELECT o_custkey AS company, CASE WHEN o_orderkey % 2 = 1 THEN '1995-01-01' END AS s, strftime(o_orderdate, '%Y-%m-%d') AS "end", o_totalprice AS val, o_orderkey % 7 = 0 AS bad FROM orders)
  SELECT DISTINCT company, CASE WHEN s IS NULL THEN 'assets' ELSE 'revenue' END AS concept, s AS start, "end", val, CASE WHEN s IS NULL THEN 'us-gaap:Assets' ELSE 'us-gaap:Revenues' END AS tag FROM f WHERE NOT bad""")
def _(v: Views):
    catalogue = v.spark.createDataFrame(
        [("us-gaap:Revenues", "revenue", 0, "duration", True), ("us-gaap:SalesRevenueNet", "revenue", 1, "duration", True),
         ("us-gaap:Assets", "assets", 0, "instant", True)], "tag string, concept string, place int, kind string, money boolean")
    return filings.company_facts(payloads(v), catalogue).select("company", "concept", "start", "end", "val", "tag")


def submissions(v: Views):
    items = F.when(F.col("o_orderkey") % 5 == 0, "1.03,9.01").when(F.col("o_orderkey") % 5 == 1, "9.01").otherwise("3.01")
    return v.table("orders").select(
        F.col("o_custkey").alias("cik"), F.array(F.lit("8-K"), F.when(F.col("o_orderkey") % 4 == 0, "15-12G").otherwise("10-K")).alias("form"),
        F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", 9), "yyyy-MM-dd")).alias("filed"),
        F.array(items).alias("items"))


SUB_SQL = """sb AS (SELECT o_custkey AS cik, '8-K' AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, CASE o_orderkey % 5 WHEN 0 THEN '1.03,9.01' WHEN 1 THEN '9.01' ELSE '3.01' END AS items FROM orders
  UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN '15-12G' ELSE '10-K' END, strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d'), NULL FROM orders)"""


@register("s24_submission_rows", "", "WITH " + SUB_SQL + " SELECT cik, form, filed, items FROM sb")
def _(v: Views):
    return filings.submission_rows(submissions(v))


@register("s13_exit_filings", "", "WITH " + SUB_SQL + " SELECT cik, form, filed FROM sb WHERE form = '15-12G' OR (form = '8-K' AND (contains(items, '1.03') OR contains(items, '3.01')))")
def _(v: Views):
    return filings.exit_filings(filings.submission_rows(submissions(v)), ["15-12G", "25"]).select("cik", "form", "filed")


def _text_sql() -> str:
    """The page's text in DuckDB: the same fixed patterns, references replaced part by part."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    cut = lambda text, steps: reduce(lambda t, s: f"regexp_replace({t}, {quoted(s[0])}, {quoted(s[1])}, 'g')", steps, text)
    names = "MAP {" + ", ".join(f"{quoted(name)}: {quoted(char)}" for name, char in pages.NAMED.items()) + "}"
    return f"""WITH c AS (SELECT page_id, url, string_split({cut("html", pages.CUTS)}, '&') AS parts FROM pages),
  u AS (SELECT page_id, i, parts[i + 1] AS part FROM c, unnest(range(len(parts))) AS r(i)),
  e AS (SELECT *, regexp_extract(part, '^(#[0-9]+|[A-Za-z][A-Za-z0-9]*);', 1) AS name FROM u),
  d AS (SELECT *, CASE WHEN name LIKE '#%' THEN chr(CAST(substr(name, 2) AS INT)) WHEN name <> '' THEN names[name] END AS char FROM e, (SELECT {names} AS names)),
  j AS (SELECT page_id, string_agg(CASE WHEN i = 0 THEN part WHEN char IS NULL THEN '&' || part ELSE char || substr(part, length(name) + 2) END, '' ORDER BY i) AS text FROM d GROUP BY 1),
  t AS (SELECT page_id, {cut("text", pages.TIDY)} || chr(10) AS text FROM j)
  SELECT page_id, url, sha256(text) AS content_hash, length(text) AS characters FROM pages LEFT JOIN t USING (page_id)"""


@register("s20_page_text", "", _text_sql())
def _(v: Views):
    return pages.page_text(v.table("pages")).select("page_id", "url", "content_hash", F.length("text").alias("characters"))


@register("r12_latest_documents", "", """SELECT regexp_replace(url, '/+$', '') AS url, max(page_id) AS page_id FROM pages GROUP BY regexp_replace(url, '/+$', ''), sha256(html)""")
def _(v: Views):
    docs = v.table("pages").select("url", F.sha2("html", 256).alias("content_hash"), "page_id", F.col("page_id").alias("sequence"))
    return filings.latest_documents(docs).select("url", "page_id")
