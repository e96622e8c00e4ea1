"""Insider filings: quarterly data sets of three relational TSV tables, and single ownership documents, to one row shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.scalars import finite, half_even
from sightline.operators.insiders import quarter_end

#: Transaction codes of the open market and the relationships that count as insiders.
OPEN_MARKET = {"P": "purchase", "S": "sale"}
INSIDERS = ("officer", "director")
LARGE_OWNER = "tenpercentowner"

COLUMNS = ("accession", "issuer_cik", "symbol", "filed", "trans_date", "code", "kind", "shares", "price", "value", "acquired",
           "owner_ciks", "officer_or_director", "ten_percent_owner")


def filed_date(text: Column) -> Column:
    """31-MAR-2015 (any case) or an ISO date in front; anything else is null."""
    trimmed = F.trim(text)
    return F.coalesce(F.to_date(F.try_to_timestamp(trimmed, F.lit("d-MMM-yyyy"))),
                      F.to_date(F.try_to_timestamp(F.substring(trimmed, 1, 10), F.lit("yyyy-MM-dd"))))


def cik(text: Column) -> Column:
    return F.lpad(F.trim(F.coalesce(text, F.lit(""))), 10, "0")


def open_market(rows: DataFrame) -> DataFrame:
    """The last common steps: code, positive shares, value. Needs code, shares, price as text and all other columns."""
    code = F.upper(F.trim("code"))
    kinds = F.create_map(*[F.lit(part) for pair in OPEN_MARKET.items() for part in pair])
    shares, price = finite("shares"), finite("price")
    kept = rows.withColumns({"code": code, "shares": shares, "price": price}).where(
        F.col("code").isin(*OPEN_MARKET) & (F.col("shares") > 0) & F.col("filed").isNotNull())
    return kept.withColumns({
        "kind": kinds[F.col("code")], "value": half_even(F.col("shares") * F.col("price"), 2),
        "acquired": F.coalesce(F.upper(F.trim("acquired")) == "A", F.lit(False))}).select(*COLUMNS)


def quarter_transactions(submissions: DataFrame, owners: DataFrame, trades: DataFrame) -> DataFrame:
    """Open-market transactions with their filing and the sorted owners of the filing.

    A transaction needs a submission with a filing date; owners are optional. Repeated submissions of an accession count
    once (the one filed last); equal transaction rows stay, as a filing may list them twice.
    """
    filing = submissions.select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        F.struct(filed_date(F.col("FILING_DATE")).alias("filed"), cik(F.col("ISSUERCIK")).alias("issuer_cik"),
                 F.upper(F.trim(F.coalesce("ISSUERTRADINGSYMBOL", F.lit("")))).alias("symbol")).alias("s"))
    filing = filing.where("accession is not null").groupBy("accession").agg(F.max("s").alias("s"))
    relation = F.lower(F.trim("RPTOWNER_RELATIONSHIP"))
    held = owners.groupBy(F.col("ACCESSION_NUMBER").alias("accession")).agg(
        F.array_sort(F.collect_set(F.nullif(F.trim("RPTOWNERCIK"), F.lit("")))).alias("owner_ciks"),
        F.coalesce(F.bool_or(relation.isin(*INSIDERS)), F.lit(False)).alias("officer_or_director"),
        F.coalesce(F.bool_or(relation == LARGE_OWNER), F.lit(False)).alias("ten_percent_owner"))
    rows = trades.select(
        F.col("ACCESSION_NUMBER").alias("accession"), filed_date(F.col("TRANS_DATE")).alias("trans_date"), F.col("TRANS_CODE").alias("code"),
        F.col("TRANS_SHARES").alias("shares"), F.col("TRANS_PRICEPERSHARE").alias("price"), F.col("TRANS_ACQUIRED_DISP_CD").alias("acquired"))
    joined = rows.where(F.upper(F.trim("code")).isin(*OPEN_MARKET)).join(filing, "accession").join(held, "accession", "left")
    none = F.array().cast("array<string>")
    return open_market(joined.select(
        "accession", "s.*", "trans_date", "code", "shares", "price", "acquired", F.coalesce("owner_ciks", none).alias("owner_ciks"),
        F.coalesce("officer_or_director", F.lit(False)).alias("officer_or_director"),
        F.coalesce("ten_percent_owner", F.lit(False)).alias("ten_percent_owner")))


def quarter_label(path: Column) -> Column:
    return F.regexp_extract(path, r"([0-9]{4}q[1-4])[^/]*(?=/)", 1)


def tsv_table(spark: SparkSession, paths: list[str], columns: tuple[str, ...]) -> DataFrame:
    """The named columns, as text, and the ``quarter`` of all files; every file has its own header and column order.

    A column that a file lacks is null in its rows. Headers are one row per file.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    first = F.split("value", "\t")
    is_header = F.array_contains(first, "ACCESSION_NUMBER")
    headers = lines.where(is_header).groupBy("path").agg(F.first("value").alias("header"))
    cells = lines.where(~is_header & (F.col("value") != "")).join(headers, "path").select("path", F.split("header", "\t").alias("names"), first.alias("cells"))
    return cells.select(quarter_label(F.col("path")).alias("quarter"), *[
        F.try_element_at("cells", F.nullif(F.array_position("names", name), F.lit(0)).cast("int")).alias(name) for name in columns])


SUBMISSION = ("ACCESSION_NUMBER", "FILING_DATE", "ISSUERCIK", "ISSUERTRADINGSYMBOL")
OWNER = ("ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNER_RELATIONSHIP")
TRADE = ("ACCESSION_NUMBER", "TRANS_DATE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE", "TRANS_ACQUIRED_DISP_CD")


def quarter_status(spark: SparkSession, files: list[str], start: str, end: str) -> DataFrame:
    """quarter, loaded for every quarter from ``start`` to ``end`` ('2015q1'); ``files`` are the paths that exist."""
    asked = spark.range(1).select(F.explode(F.sequence(
        F.trunc(quarter_end(F.lit(start)), "quarter"), F.trunc(quarter_end(F.lit(end)), "quarter"), F.expr("interval 3 months"))).alias("d"))
    labels = asked.select(F.concat(F.year("d"), F.lit("q"), F.quarter("d")).alias("quarter"))
    present = spark.createDataFrame([(path,) for path in files], "path string").select(quarter_label(F.col("path")).alias("quarter")).distinct()
    return labels.join(present.withColumn("loaded", F.lit(True)), "quarter", "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))


def load_quarters(spark: SparkSession, pattern: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """All transactions of the quarters that exist, and the status of every quarter asked for.

    ``pattern`` holds {quarter} and {table}, as in ``/data/{quarter}/{table}.tsv``; only file names are listed on the driver.
    The status has quarter, loaded and data_through, the end of the last loaded quarter (null if none is).
    """
    found = spark.read.text(pattern.format(quarter="*", table="SUBMISSION")).inputFiles()
    status = quarter_status(spark, found, start, end)
    through = status.agg(F.max(F.when(F.col("loaded"), quarter_end(F.col("quarter")))).alias("data_through"))
    status = status.join(F.broadcast(through))  # one row
    loaded = sorted(row["quarter"] for row in status.where("loaded").select("quarter").collect())  # one row a quarter
    if not loaded:
        empty = [spark.createDataFrame([], ", ".join(f"{name} string" for name in names)) for names in (SUBMISSION, OWNER, TRADE)]
        return quarter_transactions(*empty), status
    tables = [tsv_table(spark, [pattern.format(quarter=f"{quarter}", table=name) for quarter in loaded], columns)
              for name, columns in (("SUBMISSION", SUBMISSION), ("REPORTINGOWNER", OWNER), ("NONDERIV_TRANS", TRADE))]
    return quarter_transactions(*tables), status


VALUE = "struct<value:string>"
FORM4 = f"""issuer struct<issuerCik:string,issuerTradingSymbol:string>,
  reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string>,
    reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string>>>,
  nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:{VALUE},transactionCoding:struct<transactionCode:string>,
    transactionAmounts:struct<transactionShares:{VALUE},transactionPricePerShare:{VALUE},transactionAcquiredDisposedCode:{VALUE}>>>>"""


def ownership_documents(documents: DataFrame) -> DataFrame:
    """Rows of documents(accession, filed date, document XML) in the shape of ``quarter_transactions``.

    A flag is set by 1 or true. A document that is no XML, or has no open-market transaction, gives no rows.
    """
    parsed = documents.where("document is not null").select("accession", "filed", F.from_xml("document", FORM4).alias("x"))
    flag = lambda owner, name: F.coalesce(F.lower(F.trim(owner.reportingOwnerRelationship[name])).isin("1", "true"), F.lit(False))
    owners = F.coalesce("x.reportingOwner", F.array().cast("array<struct<reportingOwnerId:struct<rptOwnerCik:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string>>>"))
    ids = F.transform(owners, lambda owner: F.nullif(F.trim(owner.reportingOwnerId.rptOwnerCik), F.lit("")))
    rows = parsed.select(
        "accession", "filed", cik(F.col("x.issuer.issuerCik")).alias("issuer_cik"),
        F.upper(F.trim(F.coalesce("x.issuer.issuerTradingSymbol", F.lit("")))).alias("symbol"),
        F.array_sort(F.array_distinct(F.array_compact(ids))).alias("owner_ciks"),
        F.exists(owners, lambda owner: flag(owner, "isOfficer") | flag(owner, "isDirector")).alias("officer_or_director"),
        F.exists(owners, lambda owner: flag(owner, "isTenPercentOwner")).alias("ten_percent_owner"),
        F.explode("x.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    return open_market(rows.select(
        "accession", "issuer_cik", "symbol", "filed", "owner_ciks", "officer_or_director", "ten_percent_owner",
        filed_date(F.col("t.transactionDate.value")).alias("trans_date"), F.col("t.transactionCoding.transactionCode").alias("code"),
        F.col("t.transactionAmounts.transactionShares.value").alias("shares"), F.col("t.transactionAmounts.transactionPricePerShare.value").alias("price"),
        F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value").alias("acquired")))
