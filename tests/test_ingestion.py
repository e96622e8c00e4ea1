"""Raw filings, sheets, indexes and statements on literal inputs with nulls, repeats and broken rows."""

import datetime

from pyspark.sql import functions as F

from sightline.sources import canadian, indexes, insider_filings, instances, statements

DAY = datetime.date


def write(folder, quarter, table, rows):
    target = folder / quarter
    target.mkdir(parents=True, exist_ok=True)
    (target / f"{table}.tsv").write_text("\n".join("\t".join(row) for row in rows) + "\n", encoding="utf-8")


def test_insider_quarters(spark, tmp_path):
    write(tmp_path, "2015q1", "SUBMISSION", [("ACCESSION_NUMBER", "FILING_DATE", "DOCUMENT_TYPE", "ISSUERCIK", "ISSUERTRADINGSYMBOL"),
                                             ("a1", "31-MAR-2015", "4", "77", " abc "), ("a2", "", "4", "78", "x"), ("a1", "01-FEB-2015", "4", "70", "old")])
    write(tmp_path, "2015q1", "REPORTINGOWNER", [("RPTOWNERCIK", "ACCESSION_NUMBER", "RPTOWNER_RELATIONSHIP"),
                                                 ("9", "a1", "Other"), ("10", "a1", "Officer"), ("9", "a1", ""), ("", "a1", "TenPercentOwner")])
    trade = ("ACCESSION_NUMBER", "TRANS_DATE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE", "TRANS_ACQUIRED_DISP_CD")
    write(tmp_path, "2015q1", "NONDERIV_TRANS", [
        trade, ("a1", "30-MAR-2015", "p", "100", "2.005", "a"), ("a1", "bad", "S", "5", "", "D"), ("a1", "", "A", "5", "1", "A"), ("a1", "", "P", "0", "1", "A"),
        ("a1", "", "P", "many", "1", "A"), ("a2", "", "P", "5", "1", "A"), ("zz", "", "P", "5", "1", "A"), ("a1", "30-MAR-2015", "p", "100", "2.005", "a")])
    write(tmp_path, "2015q3", "SUBMISSION", [("ISSUERCIK", "ACCESSION_NUMBER", "FILING_DATE"), ("5", "b1", "2015-08-01T00:00")])
    write(tmp_path, "2015q3", "REPORTINGOWNER", [("ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNER_RELATIONSHIP")])
    write(tmp_path, "2015q3", "NONDERIV_TRANS", [trade, ("b1", "31-JUL-2015", "S", "7", "3", "D")])
    rows, status = insider_filings.load_quarters(spark, f"{tmp_path}/{{quarter}}/{{table}}.tsv", "2014q4", "2015q4")
    found = sorted(rows.collect(), key=lambda r: (r.accession, r.code))
    assert [(r.accession, r.code, r.shares, r.price, r.value) for r in found] == [
        ("a1", "P", 100.0, 2.005, 200.5), ("a1", "P", 100.0, 2.005, 200.5), ("a1", "S", 5.0, None, None), ("b1", "S", 7.0, 3.0, 21.0)]
    first, last = found[0], found[-1]
    assert (first.issuer_cik, first.symbol, first.filed, first.trans_date) == ("0000000077", "ABC", DAY(2015, 3, 31), DAY(2015, 3, 30))
    assert (first.owner_ciks, first.officer_or_director, first.ten_percent_owner, first.acquired) == (["10", "9"], True, True, True)
    assert (last.owner_ciks, last.officer_or_director, last.filed, last.symbol) == ([], False, DAY(2015, 8, 1), "")
    assert found[2].trans_date is None
    assert {r.quarter: (r.loaded, r.data_through) for r in status.collect()} == {
        label: (label in ("2015q1", "2015q3"), DAY(2015, 9, 30)) for label in ("2014q4", "2015q1", "2015q2", "2015q3", "2015q4")}
    none, gone = insider_filings.load_quarters(spark, f"{tmp_path}/{{quarter}}/{{table}}.tsv", "2016q1", "2016q2")
    assert none.count() == 0 and [(r.loaded, r.data_through) for r in gone.collect()] == [(False, None)] * 2


def test_ownership_document(spark):
    document = """<?xml version="1.0"?><ownershipDocument><issuer><issuerCik>77</issuerCik><issuerTradingSymbol>ab</issuerTradingSymbol></issuer>
      <reportingOwner><reportingOwnerId><rptOwnerCik>2</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><isDirector>0</isDirector></reportingOwnerRelationship></reportingOwner>
      <reportingOwner><reportingOwnerId><rptOwnerCik>10</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><isOfficer>true</isOfficer></reportingOwnerRelationship></reportingOwner>
      <nonDerivativeTable>{0}</nonDerivativeTable></ownershipDocument>"""
    trade = ("<nonDerivativeTransaction><transactionDate><value>2015-03-30-05:00</value></transactionDate><transactionCoding><transactionCode>{0}</transactionCode></transactionCoding>"
             "<transactionAmounts><transactionShares><value>{1}</value></transactionShares></transactionAmounts></nonDerivativeTransaction>")
    docs = [("a", DAY(2015, 4, 1), document.format(trade.format("P", 12) + trade.format("M", 5) + trade.format("S", 0))), ("b", DAY(2015, 4, 1), "no xml"), ("c", None, None),
            ("d", DAY(2015, 4, 1), document.format(""))]
    found = insider_filings.ownership_documents(spark.createDataFrame(docs, "accession string, filed date, document string")).collect()
    assert len(found) == 1 and found[0].owner_ciks == ["10", "2"] and found[0].officer_or_director and not found[0].ten_percent_owner
    assert (found[0].shares, found[0].price, found[0].value, found[0].trans_date, found[0].acquired) == (12.0, None, None, DAY(2015, 3, 30), False)


def test_notices_and_listing(spark):
    lines = ["25-NSE       ACME  CORP          123         2015-01-02  edgar/x.txt", "25           Old Co  1234567890123  2015-02-30  edgar/y.txt", "253G2        Other   5  2015-01-02  z", "",
             "25           B Inc   42  2015-01-03  f.txt", "25-NSE  short"]
    notices, broken = indexes.delisting_notices(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert sorted(map(tuple, notices.collect())) == [("0000000042", "B Inc", "25", DAY(2015, 1, 3)), ("0000000123", "ACME  CORP", "25-NSE", DAY(2015, 1, 2))]
    assert sorted(r.value for r in broken.collect()) == sorted([lines[1], lines[5]])
    rows = [("7", "4 ", "2015-01-02", "x", "xslF345/doc.xml", False), ("7", "4 ", "2015-01-02", "x", "xslF345/doc.xml", False), ("7", "3", "2014-01-01", "w", None, None),
            ("7", "N-CSR", "2013-01-01", "v", "d", True), ("7", "N-CSR", "2015-05-01", "u", "d", False), ("8", "10-K", None, "t", "d", None)]
    found = {r.cik: r for r in indexes.ownership_listing(spark.createDataFrame(
        rows, "cik string, form string, filed string, accession string, document string, more boolean"), ("N-CSR",)).collect()}
    assert [(e.form, e.document) for e in found["0000000007"].filings] == [("4", "doc.xml")] and found["0000000007"].truncated
    assert found["0000000007"].fund_forms == {"N-CSR": "2015-05-01"} and found["0000000007"].earliest_listed == "2013-01-01"
    assert found["0000000008"].filings == [] and found["0000000008"].fund_forms == {} and not found["0000000008"].truncated


def test_statement_tables(spark):
    rows = [("abc", "USD", "quarterly", "income", "2024-05-31", {"Total Revenue": None, "Operating Revenue": "5", "Gross Profit": "x"}),
            ("abc", "USD", "annual", "income", "2024-02-29", {"Total Revenue": "9"}), ("abc", "USD", "annual", "balance", "2024-02-29", {"Current Debt": "3"}),
            ("abc", None, "quarterly", "cashflow", "2024-12-31", {"Capital Expenditure": "-4"}), ("abc", "USD", "quarterly", "income", "soon", {"Total Revenue": "1"}),
            ("abc", "USD", "weekly", "income", "2024-05-31", {"Total Revenue": "1"}), (None, "USD", "quarterly", "balance", "2024-06-30", {"Current Debt": "2"}), ("abc", "USD", "quarterly", "income", "2024-05-31", None)]
    frame = spark.createDataFrame(rows, "ticker string, currency string, frequency string, statement string, end string, values map<string,string>")
    found = sorted(((r.ticker, r.concept, r.start, r.end, r.filed, r.val, r.tag) for r in statements.statement_facts(frame).collect()), key=str)
    assert found == sorted([
        ("ABC", "revenue", DAY(2024, 3, 1), DAY(2024, 5, 31), DAY(2024, 7, 30), 5.0, "statement:Operating Revenue"),
        ("ABC", "revenue", DAY(2023, 3, 1), DAY(2024, 2, 29), DAY(2024, 6, 28), 9.0, "statement:Total Revenue"),
        ("ABC", "capital_expenditure", DAY(2024, 10, 1), DAY(2024, 12, 31), DAY(2025, 3, 1), 4.0, "statement:Capital Expenditure"),
        (None, "short_term_debt", None, DAY(2024, 6, 30), DAY(2024, 8, 29), 2.0, "statement:Current Debt")], key=str)
    assert statements.statement_facts(frame.limit(0)).count() == 0


def test_two_sheets_give_the_same_columns(spark):
    first = spark.createDataFrame([(" abc", "Abc Inc", "TSX", "None", "nan", "x", "20200131", "5e7"), ("", "No ticker", "TSX", None, None, None, None, None), ("cap", "Cap Pool", "TSXV", "CPC", "s", None, "bad", "many")],
                                  "`Root\nTicker` string, Name string, Exchange string, Sector string, `Sub-Sector` string, `Sub Sector` string, `Listing Date` string, `Market Cap (C$)\n31-December-2025` string")
    second = spark.createDataFrame([("Y", "Trusted", "r", "NEO")], "TRUST string, name string, `root  ticker` string, exchange string")
    a, b = canadian.standard_sheet(first), canadian.standard_sheet(second)
    assert a.dtypes == b.dtypes
    found = {r.ticker: r for r in a.unionByName(b).collect()}
    assert sorted(found) == ["ABC.TO", "CAP.V", "R"]
    assert (found["ABC.TO"].sector, found["ABC.TO"].sub_sector, found["ABC.TO"].market_cap_source_cad, found["ABC.TO"].source_date) == (None, "x", 5e7, DAY(2025, 12, 31))
    assert found["ABC.TO"].listing_date == DAY(2020, 1, 31) and found["CAP.V"].listing_date is None and found["CAP.V"].market_cap_source_cad is None
    assert (found["CAP.V"].asset_type, found["R"].asset_type, found["R"].source_date, found["R"].sub_sector) == ("CPC", "Trust", None, None)


def test_instance(spark):
    document = """<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:gaap='http://fasb.org/us-gaap/2024' xmlns:us-gaap="http://own/">
      <context id="c1"><entity/><period><startDate> 2024-01-01 </startDate><endDate>2024-03-31T00:00</endDate></period></context>
      <context id="c2"><entity><segment><m/></segment></entity><period><instant>2024-03-31</instant></period></context>
      <context id="c3"><entity/><period><instant>2024-03-31</instant></period></context>
      <unit id="u"><measure>iso4217:USD</measure></unit><unit id="v"><measure>a</measure><measure>b</measure></unit>
      <gaap:Revenues unitRef="u" contextRef="c1">1e3</gaap:Revenues><gaap:Revenues contextRef="c1" unitRef="u">1000.0</gaap:Revenues>
      <gaap:Revenues contextRef="c1" unitRef="v">2</gaap:Revenues><us-gaap:Revenues contextRef="c1" unitRef="u">3</us-gaap:Revenues>
      <gaap:Cash contextRef="c2" unitRef="u">4</gaap:Cash><gaap:Cash contextRef="c3" unitRef="u"> -5 </gaap:Cash><gaap:Cash contextRef="c1" unitRef="u">6</gaap:Cash>
      <gaap:Cash contextRef="c3" unitRef="u" xsi:nil="true"></gaap:Cash><gaap:Cash contextRef="none" unitRef="u">7</gaap:Cash><gaap:Cash contextRef="c3" unitRef="u">n/a</gaap:Cash></xbrl>"""
    catalogue = spark.createDataFrame([("us-gaap:Revenues", "revenue", "duration", True, None), ("us-gaap:Cash", "cash", "instant", True, None)],
                                      "tag string, concept string, kind string, money boolean, unit string")
    docs = spark.createDataFrame([("a", "10-Q", "2024-05-01", document), ("b", None, None, None), ("c", None, None, "nothing"), ("d", "x", "y", "")], "accession string, form string, filed string, document string")
    found = sorted((r.concept, r.start, r.end, r.val, r.unit) for r in instances.instance_facts(docs, catalogue).withColumn("start", F.coalesce("start", F.lit(""))).collect())
    assert found == [("cash", "", "2024-03-31", -5.0, "USD"), ("revenue", "2024-01-01", "2024-03-31", 1000.0, "USD")]
