"""Ingestion queries: S3, S8, S12, S14, S15, S16, S17, S23. Raw texts are made from the driver tables, then parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.session import recovery_directory
from sightline.sources import canadian, indexes, insider_filings, instances, statements

# --- S15, S16, S23: orders are filings, line items their transactions ---------------------------------------------------

MISSING = 3  # every fifth quarter from this one is not published
TRADES_SQL = f"""tr AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') || 'q' || quarter(o_orderdate) AS quarter, (year(o_orderdate) * 4 + quarter(o_orderdate)) % 5 = {MISSING} AS gone, CAST(o_orderdate AS DATE) AS filed,
    o_custkey, o_orderpriority, o_orderstatus, l_linenumber, CAST(l_shipdate AS DATE) AS shipped, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' END AS code, l_quantity AS shares,
    CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND l_linenumber <> 7)"""
ROWS_SQL = f"""SELECT CAST(o_orderkey AS VARCHAR) AS accession, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS issuer_cik, 'C' || o_custkey AS symbol, CAST(filed AS VARCHAR) AS filed, CAST(shipped AS VARCHAR) AS trans_date, code,
    CASE code WHEN 'P' THEN 'purchase' ELSE 'sale' END AS kind, shares, price, {r('shares * price', 2)} AS value, code = 'P' AS acquired, array_to_string(list_sort(list_distinct([CAST(o_orderkey % 50 AS VARCHAR), CAST(o_orderkey * 7 % 50 AS VARCHAR)])), ',') AS owner_ciks,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS officer_or_director, o_orderpriority = '3-MEDIUM' AS ten_percent_owner FROM tr"""


def _filed(v: Views):
    lines = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.concat(F.year("o_orderdate"), F.lit("q"), F.quarter("o_orderdate"))
    code = F.when(F.col("l_returnflag") == "A", " p").when(F.col("l_returnflag") == "R", "S").otherwise("A")
    return lines.withColumns({
        "quarter": label, "gone": (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")) % 5 == MISSING, "code": code,
        "shares": F.when(F.col("l_linenumber") == 7, "0").otherwise(F.col("l_quantity").cast("string")),
        "price": F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("l_extendedprice").cast("string"))})


def relations():
    """Relationships in several spellings; one of them only sounds like an officer."""
    urgency = F.col("o_orderpriority")
    return F.when(urgency == "1-URGENT", "Officer").when(urgency == "2-HIGH", "DIRECTOR").when(
        urgency == "3-MEDIUM", "TenPercentOwner").when(urgency == "5-LOW", "").otherwise("Officer of a subsidiary")


def publish(v: Views, everything: bool) -> str:
    """Write the three TSV tables by quarter and return their path pattern; status P has no submission."""
    folder = f"{recovery_directory(v.spark)}/quarters-{uuid.uuid4().hex}"
    rows = _filed(v) if everything else _filed(v).where("not gone")
    key = F.col("o_orderkey").cast("string").alias("ACCESSION_NUMBER")
    orders = rows.dropDuplicates(["o_orderkey"])
    day = lambda name: F.upper(F.date_format(name, "dd-MMM-yyyy"))
    tables = {
        "SUBMISSION": orders.where("o_orderstatus <> 'P'").select(
            "quarter", key, day("o_orderdate").alias("FILING_DATE"), F.lit("4").alias("DOCUMENT_TYPE"), F.col("o_custkey").alias("ISSUERCIK"),
            F.concat(F.lit("c"), "o_custkey").alias("ISSUERTRADINGSYMBOL")),
        "REPORTINGOWNER": orders.select("quarter", F.explode(F.array(F.col("o_orderkey") % 50, F.col("o_orderkey") * 7 % 50)).alias("RPTOWNERCIK"),
                                        relations().alias("RPTOWNER_RELATIONSHIP"), key),
        "NONDERIV_TRANS": rows.select("quarter", key, day("l_shipdate").alias("TRANS_DATE"), F.col("code").alias("TRANS_CODE"), F.col("shares").alias("TRANS_SHARES"),
                                      F.col("price").alias("TRANS_PRICEPERSHARE"), F.when(F.col("l_returnflag") == "A", "A").otherwise("D").alias("TRANS_ACQUIRED_DISP_CD")),
    }
    for name, table in tables.items():
        table.repartition("quarter").write.partitionBy("quarter").option("sep", "\t").option("header", "true").option("emptyValue", "").csv(f"{folder}/{name}.tsv")
    return folder + "/{table}.tsv/quarter={quarter}"


def _shown(rows):
    return rows.withColumns({"owner_ciks": F.array_join("owner_ciks", ","), "filed": F.col("filed").cast("string"),
                             "trans_date": F.col("trans_date").cast("string")})


@register("s15_insider_quarter", "", "WITH " + TRADES_SQL + " " + ROWS_SQL + " WHERE o_orderstatus <> 'P'")
def _(v: Views):
    rows, _ = insider_filings.load_quarters(v.spark, publish(v, True), "1992q1", "2002q4")
    return _shown(rows)


@register("s23_quarter_load", "", "WITH " + TRADES_SQL + """, ql AS (SELECT year || 'q' || quarter AS quarter FROM range(1991, 2003) y(year), range(1, 5) q(quarter)),
  pb AS (SELECT DISTINCT strftime(o_orderdate, '%Y') || 'q' || quarter(o_orderdate) AS quarter FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND (year(o_orderdate) * 4 + quarter(o_orderdate)) % 5 <> 3),
  tc AS (SELECT quarter, count(*) AS transactions FROM tr WHERE o_orderstatus <> 'P' AND NOT gone GROUP BY 1),
  dt AS (SELECT CAST(last_day(make_date(CAST(max(quarter)[1:4] AS INTEGER), CAST(max(quarter)[6:6] AS INTEGER) * 3, 1)) AS VARCHAR) AS data_through FROM pb)
  SELECT ql.quarter, pb.quarter IS NOT NULL AS loaded, data_through, COALESCE(transactions, 0) AS transactions FROM ql LEFT JOIN pb USING (quarter) LEFT JOIN tc USING (quarter), dt""")
def _(v: Views):
    rows, status = insider_filings.load_quarters(v.spark, publish(v, False), "1991q1", "2002q4")
    label = F.concat(F.year("filed"), F.lit("q"), F.quarter("filed"))
    counts = rows.groupBy(label.alias("quarter")).agg(F.count("*").alias("transactions"))
    return status.join(counts, "quarter", "left").select(
        "quarter", "loaded", F.col("data_through").cast("string").alias("data_through"), F.coalesce("transactions", F.lit(0)).alias("transactions"))


@register("s16_ownership_documents", "", "WITH " + TRADES_SQL + " " + ROWS_SQL)
def _(v: Views):
    value = lambda tag, column: F.concat(F.lit(f"<{tag}><value>"), column, F.lit(f"</value></{tag}>"))
    price = F.when(F.col("price") == "", F.lit("<transactionPricePerShare><footnoteId id='F1'/></transactionPricePerShare>")).otherwise(
        value("transactionPricePerShare", F.col("price")))
    trade = F.concat(
        F.lit("<nonDerivativeTransaction>"), value("transactionDate", F.date_format("l_shipdate", "yyyy-MM-dd")),
        F.lit("<transactionCoding><transactionCode>"), F.col("code"), F.lit("</transactionCode></transactionCoding><transactionAmounts>"),
        value("transactionShares", F.col("shares")), price, value("transactionAcquiredDisposedCode", F.when(F.col("l_returnflag") == "A", "A").otherwise("D")),
        F.lit("</transactionAmounts></nonDerivativeTransaction>"))
    filed = _filed(v).groupBy("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("filed")).agg(F.array_join(F.collect_list(trade), "").alias("trades"))
    flags = F.when(F.col("o_orderpriority") == "1-URGENT", "<isOfficer>1</isOfficer>").when(F.col("o_orderpriority") == "2-HIGH", "<isDirector>true</isDirector>").when(
        F.col("o_orderpriority") == "3-MEDIUM", "<isTenPercentOwner>TRUE</isTenPercentOwner>").otherwise("<isOfficer>0</isOfficer>")
    owner = lambda number: F.concat(F.lit("<reportingOwner><reportingOwnerId><rptOwnerCik>"), number.cast("string"), F.lit("</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship>"),
                                    flags, F.lit("</reportingOwnerRelationship></reportingOwner>"))
    document = F.concat(
        F.lit("<?xml version='1.0'?><ownershipDocument><issuer><issuerCik>"), F.col("o_custkey"), F.lit("</issuerCik><issuerTradingSymbol>c"), F.col("o_custkey"),
        F.lit("</issuerTradingSymbol></issuer>"), owner(F.col("o_orderkey") % 50), owner(F.col("o_orderkey") * 7 % 50),
        F.lit("<nonDerivativeTable>"), F.col("trades"), F.lit("</nonDerivativeTable></ownershipDocument>"))
    return _shown(insider_filings.ownership_documents(filed.select(F.col("o_orderkey").cast("string").alias("accession"), "filed", document.alias("document"))))


# --- S12, S14: indexes and listings -------------------------------------------------------------------------------------

@register("s12_delisting_notices", "", """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'Company  ' || o_custkey AS name, CASE o_orderstatus WHEN 'F' THEN '25' ELSE '25-NSE' END AS form,
    strftime(o_orderdate, '%Y-%m-%d') AS filed, 0 AS broken, o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 9 <> 4
  UNION ALL SELECT NULL, NULL, NULL, NULL, 1, NULL FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 9 = 4""")
def _(v: Views):
    form = F.when(F.col("o_orderstatus") == "F", "25").when(F.col("o_orderstatus") == "P", "25-NSE").otherwise("253G2")
    broken = F.col("o_orderkey") % 9 == 4
    line = F.concat(F.rpad(form, 12, " "), F.rpad(F.concat(F.lit("Company  "), "o_custkey", F.lit("~"), "o_orderkey"), 40, " "), F.lit("  "), F.rpad(F.col("o_custkey").cast("string"), 12, " "),
                    F.when(broken, "1996-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("  edgar/data/x.txt"))
    notices, bad = indexes.delisting_notices(v.table("orders").select(line.alias("value")))
    parts = F.split("name", "~")
    good = notices.select("cik", parts[0].alias("name"), "form", F.col("filed").cast("string").alias("filed"), F.lit(0).alias("broken"), parts[1].cast("long").alias("o_orderkey"))
    none = [F.lit(None).cast("string").alias(name) for name in ("cik", "name", "form", "filed")]
    return good.union(bad.select(*none, F.lit(1), F.lit(None).cast("long")))


FUND_FORMS = ("N-CSR", "N-54A")


@register("s14_ownership_listing", "", """WITH f AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS filed, CAST(o_orderkey AS VARCHAR) AS accession, CASE o_orderpriority WHEN '1-URGENT' THEN '4' WHEN '2-HIGH' THEN '3/A' WHEN '3-MEDIUM' THEN 'N-CSR' WHEN '4-NOT SPECIFIED' THEN 'N-54A' ELSE '10-K' END AS form,
    'doc' || o_orderkey || '.xml' AS document, o_orderkey % 40 = 3 AS more FROM orders),
  m AS (SELECT o_custkey, form, max(filed) AS filed FROM f WHERE form IN ('N-CSR', 'N-54A') GROUP BY 1, 2)
  SELECT lpad(CAST(f.o_custkey AS VARCHAR), 10, '0') AS cik, min(f.filed) AS earliest_listed, bool_or(more) AS truncated,
    COALESCE(string_agg(f.filed || '/' || accession || '/' || f.form || '/' || document, ',' ORDER BY f.filed, accession) FILTER (f.form IN ('4', '3/A')), '') AS filings,
    (SELECT COALESCE(string_agg(form || '=' || filed, ',' ORDER BY form), '') FROM m WHERE m.o_custkey = f.o_custkey) AS fund_forms FROM f GROUP BY f.o_custkey""")
def _(v: Views):
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "4").when(F.col("o_orderpriority") == "2-HIGH", " 3/A").when(
        F.col("o_orderpriority") == "3-MEDIUM", "N-CSR").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "N-54A").otherwise("10-K")
    document = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "xslF345X05/").otherwise(""), F.lit("doc"), "o_orderkey", F.lit(".xml"))
    rows = v.table("orders").select(F.col("o_custkey").alias("cik"), form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"),
                                    F.col("o_orderkey").cast("string").alias("accession"), document.alias("document"), (F.col("o_orderkey") % 40 == 3).alias("more"))
    found = indexes.ownership_listing(rows, FUND_FORMS)
    pairs = F.transform(F.map_entries("fund_forms"), lambda e: F.concat_ws("=", e.key, e.value))
    return found.select("cik", "earliest_listed", "truncated", F.array_join(F.transform("filings", lambda e: F.concat_ws("/", e.filed, e.accession, e.form, e.document)), ",").alias("filings"),
                        F.array_join(F.array_sort(pairs), ",").alias("fund_forms"))


# --- S17: statement tables ----------------------------------------------------------------------------------------------

@register("s17_statement_facts", "", f"""WITH o AS (SELECT o_orderkey, 'T' || o_custkey AS ticker, CASE WHEN o_orderkey % 3 = 0 THEN 'annual' ELSE 'quarterly' END AS frequency, o_orderkey % 4 AS kind, CAST(last_day(o_orderdate) AS DATE) AS e, o_totalprice AS p, CASE o_orderkey % 5 WHEN 0 THEN 'CAD' ELSE 'USD' END AS unit FROM orders),
  c AS (SELECT *, 'revenue' AS concept, CASE WHEN o_orderkey % 7 = 0 THEN 'Operating Revenue' ELSE 'Total Revenue' END AS label, p AS val, FALSE AS inst FROM o WHERE kind = 0
    UNION ALL SELECT *, 'net_income', 'Net Income Common Stockholders', -p, FALSE FROM o WHERE kind = 0 AND o_orderkey % 11 = 0
    UNION ALL SELECT *, 'capital_expenditure', 'Capital Expenditure', -1 * (0 - p / 4), FALSE FROM o WHERE kind = 1
    UNION ALL SELECT *, 'cash', 'Cash And Cash Equivalents', p, TRUE FROM o WHERE kind = 2 AND frequency = 'quarterly')
  SELECT o_orderkey, upper(ticker) AS ticker, concept, CAST(CASE WHEN NOT inst THEN CAST(e - CASE frequency WHEN 'annual' THEN INTERVAL 12 MONTH ELSE INTERVAL 3 MONTH END AS DATE) + 1 END AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end",
    CAST(e + CASE frequency WHEN 'annual' THEN 120 ELSE 60 END AS VARCHAR) AS filed, 'statement-' || frequency AS form, CAST(year(e) AS INTEGER) AS fy, {r('val', 4)} AS val, 'statement:' || label AS tag, unit, 'estimated_filing_dates' AS data_quality FROM c""")
def _(v: Views):
    price = F.col("o_totalprice").cast("string")
    income = F.when(F.col("o_orderkey") % 7 == 0, F.create_map(F.lit("Total Revenue"), F.lit("n/a"), F.lit("Operating Revenue"), price)).otherwise(
        F.create_map(F.lit("Total Revenue"), price, F.lit("Operating Revenue"), F.lit("1")))
    extra = F.when(F.col("o_orderkey") % 11 == 0, F.create_map(F.lit("Net Income"), F.lit("NaN"), F.lit("Net Income Common Stockholders"), F.concat(F.lit("-"), price))).otherwise(
        F.create_map().cast("map<string,string>"))
    kind = F.col("o_orderkey") % 4
    values = F.when(kind == 0, F.map_concat(income, extra)).when(kind == 1, F.create_map(F.lit("Capital Expenditure"), (-F.col("o_totalprice") / 4).cast("string"))).when(
        kind == 2, F.create_map(F.lit("Cash And Cash Equivalents"), price))
    tables = v.table("orders").select(
        F.concat(F.lit("t"), "o_custkey", F.lit("#"), "o_orderkey").alias("ticker"), F.when(F.col("o_orderkey") % 5 == 0, "CAD").otherwise("USD").alias("currency"),
        F.when(F.col("o_orderkey") % 3 == 0, "annual").otherwise("quarterly").alias("frequency"),
        F.when(kind == 0, "income").when(kind == 1, "cashflow").otherwise("balance").alias("statement"), F.last_day("o_orderdate").cast("string").alias("end"), values.alias("values"))
    found = statements.statement_facts(tables)
    parts = F.split("ticker", "#")
    text = {name: F.col(name).cast("string") for name in ("start", "end", "filed")}
    return found.withColumns({**text, "o_orderkey": parts[1].cast("long"), "ticker": parts[0], "val": half_even("val", 4)})


# --- S3: directory sheets -----------------------------------------------------------------------------------------------

@register("s03_canadian_sheets", "", """SELECT 'R' || c_custkey AS root_ticker, c_name AS company_name, CASE c_nationkey % 3 WHEN 0 THEN 'TSX' WHEN 1 THEN 'TSXV' ELSE 'NEO' END AS exchange, c_mktsegment AS sector,
    CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'first' WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'other' END AS sub_sector, CAST(date '1990-01-01' + CAST(c_custkey % 9000 AS INTEGER) AS VARCHAR) AS listing_date,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS market_cap_source_cad, CASE c_custkey % 2 WHEN 0 THEN '2025-12-31' ELSE '2026-01-30' END AS source_date,
    'R' || c_custkey || CASE c_nationkey % 3 WHEN 0 THEN '.TO' WHEN 1 THEN '.V' ELSE '' END AS ticker, CASE WHEN c_custkey % 13 = 0 AND c_custkey % 2 = 0 THEN 'Trust' ELSE 'Equity' END AS asset_type
  FROM customer WHERE c_custkey % 17 <> 0""")
def _(v: Views):
    """Two sheets with other headers, as two exchanges publish them."""
    rows = v.table("customer")
    even = F.col("c_custkey") % 2 == 0
    root = F.when(F.col("c_custkey") % 17 != 0, F.concat(F.lit(" r"), "c_custkey", F.lit(" "))).otherwise("nan")
    exchange = F.when(F.col("c_nationkey") % 3 == 0, "TSX").when(F.col("c_nationkey") % 3 == 1, "TSXV").otherwise("NEO")
    cap = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal").cast("string")).otherwise("n.a.")
    listed = F.date_format(F.expr("date_add(date'1990-01-01', int(c_custkey % 9000))"), "yyyyMMdd")
    first = rows.where(even).select(
        root.alias("Root\nTicker"), F.col("c_name").alias("Name"), exchange.alias("Exchange"), F.col("c_mktsegment").alias("SECTOR "),
        F.when(F.col("c_custkey") % 5 != 0, "first").alias("Sub-Sector"), F.lit("second").alias("Sub\nSector"), listed.alias("Listing  Date"),
        cap.alias("Market Cap (C$)\n31-December-2025"), F.when(F.col("c_custkey") % 13 == 0, "y").otherwise("").alias("Trust"), F.lit(1).alias("placed"))
    second = rows.where(~even).select(
        exchange.alias("exchange"), F.col("c_name").alias("NAME"), root.alias("Root Ticker"), F.col("c_mktsegment").alias("Sector"), F.lit("other").alias("Sub Sector"),
        F.concat(listed, F.lit(".0")).alias("Listing Date"), cap.alias("MARKET CAP (C$) 30-January-2026"), F.lit("x").alias("market cap"))
    both = canadian.standard_sheet(first).unionByName(canadian.standard_sheet(second))
    return both.select(F.upper("root_ticker").alias("root_ticker"), "company_name", "exchange", "sector", "sub_sector", F.col("listing_date").cast("string").alias("listing_date"),
                       "market_cap_source_cad", F.col("source_date").cast("string").alias("source_date"), "ticker", "asset_type")


# --- S8: XBRL instances -------------------------------------------------------------------------------------------------

@register("s08_instance_facts", "facts", """SELECT company || '-' || strftime(filed, '%Y%m%d') AS accession, 'revenue' AS concept, 'us-gaap:Revenues' AS tag, CAST(start_d AS VARCHAR) AS start, CAST(end_d AS VARCHAR) AS "end", val, 'USD' AS unit FROM facts
  UNION ALL SELECT company || '-' || strftime(filed, '%Y%m%d'), 'shares', 'dei:SharesOutstanding', NULL, CAST(end_d AS VARCHAR), floor(val / 100), 'shares' FROM facts WHERE nk % 3 <> 1""")
def _(v: Views):
    """One document per filing; prefixes differ by company, and every document holds facts that do not count."""
    prefix = F.when(F.col("nk") % 2 == 0, "us-gaap").otherwise("ug")
    key = F.concat_ws("", F.lit("D"), F.date_format("end_d", "yyyyMMdd"))
    entity = "<xbrli:entity><xbrli:identifier scheme='http://www.sec.gov/CIK'>1</xbrli:identifier>{0}</xbrli:entity>"
    period = F.concat(F.lit("<xbrli:period><xbrli:startDate>"), F.col("start_d"), F.lit("</xbrli:startDate><xbrli:endDate>"), F.col("end_d"), F.lit("</xbrli:endDate></xbrli:period></xbrli:context>\n"))
    segment = entity.format("<xbrli:segment><x:member dimension='d'>m</x:member></xbrli:segment>")
    number = F.format_string("%.2f", "val")
    fact = lambda name, context, unit, value: F.concat(F.lit("<"), name, F.lit(" contextRef='"), context, F.lit(f"' decimals='2' unitRef=\"{unit}\">"), value, F.lit("</"), name, F.lit(">\n"))
    revenue = F.concat(prefix, F.lit(":Revenues"))
    body = F.concat(
        F.lit("<xbrli:context id='"), key, F.lit("'>" + entity.format("")), period, F.lit("<xbrli:context id='S"), key, F.lit("'>" + segment), period,
        F.lit("<xbrli:context id='I"), key, F.lit("'>" + entity.format("") + "<xbrli:period><xbrli:instant>"), F.col("end_d"), F.lit("</xbrli:instant></xbrli:period></xbrli:context>\n"),
        fact(revenue, key, "usd", number), fact(revenue, key, "usd", number), fact(revenue, F.concat(F.lit("S"), key), "usd", F.lit("7")),
        fact(revenue, F.concat(F.lit("I"), key), "usd", F.lit("8")), fact(revenue, key, "rate", F.lit("9")), fact(F.lit("own:Revenues"), key, "usd", F.lit("5")),
        F.when(F.col("nk") % 3 != 1, fact(F.lit("dei:SharesOutstanding"), F.concat(F.lit("I"), key), "sh", F.format_string(" %.0f ", F.floor(F.col("val") / 100).cast("double")))).otherwise(
            F.concat(F.lit("<dei:SharesOutstanding xsi:nil='true' unitRef='sh' contextRef='I"), key, F.lit("'>0</dei:SharesOutstanding>"))))
    docs = v.facts.groupBy("company", "nk", "filed").agg(F.array_join(F.collect_list(body), "").alias("body"))
    document = F.concat(
        F.lit("<?xml version='1.0'?><xbrli:xbrl xmlns:xbrli='http://www.xbrl.org/2003/instance' xmlns:own='http://own/2024' xmlns:dei=\"http://xbrl.sec.gov/dei/2024\" xmlns:"), prefix,
        F.lit("='http://fasb.org/us-gaap/2024'><!-- <us-gaap:Revenues contextRef='x' unitRef='usd'>1</us-gaap:Revenues> -->"), F.col("body"),
        F.lit("<xbrli:unit id='usd'><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id='sh'><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unit>"
              "<xbrli:unit id='rate'><xbrli:divide><xbrli:measure>a</xbrli:measure><xbrli:measure>b</xbrli:measure></xbrli:divide></xbrli:unit></xbrli:xbrl>"))
    catalogue = v.spark.createDataFrame([("us-gaap:Revenues", "revenue", "duration", True, None), ("dei:SharesOutstanding", "shares", "instant", False, "shares")],
                                        "tag string, concept string, kind string, money boolean, unit string")
    found = instances.instance_facts(docs.select(
        F.concat_ws("-", F.col("company").cast("string"), F.date_format("filed", "yyyyMMdd")).alias("accession"), F.lit("10-Q").alias("form"), "filed", document.alias("document")), catalogue)
    return found.select("accession", "concept", "tag", "start", "end", "val", "unit")
