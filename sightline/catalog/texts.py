"""Document and index queries: S2, S11, X24, X26, X27."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.sources import documents


@register("s02_other_listed", "", """SELECT 'P' || p_partkey AS ticker, p_name AS company_name, CASE p_size % 4 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'AMEX' WHEN 2 THEN 'NYSE_ARCA' ELSE 'Q' END AS exchange, 'US' AS country, 'TRUE' AS enabled
  FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0""")
def _(v: Views):
    code = F.element_at(F.array(F.lit("N"), F.lit("A"), F.lit("P"), F.lit("Q")), (F.col("p_size") % 4 + 1).cast("int"))
    flag = lambda n: F.when(F.col("p_size") % n == 0, "Y").otherwise("N")
    lines = v.table("part").select(F.concat_ws("|", F.concat(F.lit("P"), F.col("p_partkey")), "p_name", code, flag(5), flag(7)).alias("line"))
    return documents.other_listed(lines)


@register("s11_filing_index", "", """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CASE o_orderstatus WHEN 'F' THEN '10-K' ELSE '10-Q' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, '0-' || o_orderkey AS accession
  FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def _(v: Views):
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    lines = v.table("orders").select(F.concat_ws(
        "|", "o_custkey", F.lit("name"), form, F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.concat(F.lit("edgar/data/0-"), F.col("o_orderkey"), F.lit(".txt"))).alias("line"))
    return documents.filing_index(lines, ["10-K", "10-Q"])


TERMS = "[" + ", ".join(repr(term) for term in documents.MATERIAL_TERMS) + "]"


@register("x24_claim_risk_level", "", f"""WITH c AS (SELECT conv_id, turn, text, CASE role WHEN 'assistant' THEN 'risks' ELSE role END AS section, turn % 2 = 0 AS interp, turn % 3 AS cites, list_filter({TERMS}, lambda t: contains(lower(text), t)) AS terms FROM conversations)
  SELECT conv_id, turn, CASE WHEN interp AND (section = 'risks' OR len(terms) > 0) THEN 'high' WHEN interp OR section = 'risks' OR regexp_matches(text, '[0-9]|%|\\$') OR len(terms) > 0 OR cites > 1 THEN 'medium' ELSE 'low' END AS risk_level,
    regexp_matches(text, '[0-9]|%|\\$') AS numeric_claim FROM c""")
def _(v: Views):
    section = F.when(F.col("role") == "assistant", "risks").otherwise(F.col("role"))
    level, reasons = documents.risk_level(F.col("text"), section, F.col("turn") % 2 == 0, F.col("turn") % 3)
    return v.table("conversations").select("conv_id", "turn", level.alias("risk_level"),
                                           F.array_contains(reasons, "numeric_claim").alias("numeric_claim"))


@register("x26_hash_sample", "", f"""SELECT conv_id, turn, {r("CAST('0x' || substr(sha256('v0.3-review-1:' || conv_id || '-' || turn), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE * 100", 6)} AS sample_value FROM conversations""")
def _(v: Views):
    claim = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return v.table("conversations").select("conv_id", "turn", half_even(documents.sample_value("v0.3-review-1", claim), 6).alias("sample_value"))


# Each document cites a slice of a neighbour's or its own text.
@register("x27_quote_check", "", """WITH q AS (SELECT doc_id AS quote_id, doc_id - doc_id % 3 AS doc_id, substr(text, 5, 40) AS quote FROM documents),
  t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS text FROM documents)
  SELECT quote_id, q.doc_id, COALESCE(length(trim(regexp_replace(quote, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) >= 10 AND contains(t.text, trim(regexp_replace(quote, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')), FALSE) AS found FROM q LEFT JOIN t ON t.doc_id = q.doc_id""")
def _(v: Views):
    docs = v.table("documents")
    cited = docs.select(F.col("doc_id").alias("quote_id"), (F.col("doc_id") - F.col("doc_id") % 3).alias("doc_id"),
                        F.substring("text", 5, 40).alias("quote"))
    return documents.quote_hits(cited, docs)
