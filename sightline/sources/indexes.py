"""Fixed-width filing indexes and ownership listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Forms that remove a security from listing, forms of insiders, and forms of investment companies.
NOTICE_FORMS = ("25-NSE", "25")
OWNERSHIP_FORMS = ("3", "3/A", "4", "4/A", "5", "5/A")


def delisting_notices(lines: DataFrame, forms: tuple[str, ...] = NOTICE_FORMS) -> tuple[DataFrame, DataFrame]:
    """Notices of an index with columns form, name, cik, date and file, two spaces or more apart; and the broken lines.

    ``lines``: value. Lines of other forms are none of ours. A line that starts with one of the forms but does not hold all
    five columns goes to the second frame (``value``), so that nothing is lost in silence.
    """
    listed = "|".join(sorted((form.replace("-", r"\-") for form in forms), key=len, reverse=True))
    ours = lines.where(F.col("value").rlike(rf"^(?:{listed})\s"))
    pattern = rf"^({listed})\s{{2,}}(.*?)\s{{2,}}([0-9]+)\s{{2,}}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\s{{2,}}\S"
    part = lambda i: F.regexp_extract("value", pattern, i)
    filed = F.to_date(F.try_to_timestamp(part(4), F.lit("yyyy-MM-dd")))
    good = F.coalesce(F.col("value").rlike(pattern) & filed.isNotNull(), F.lit(False))
    notices = ours.where(good).select(
        F.when(F.length(part(3)) < 10, F.lpad(part(3), 10, "0")).otherwise(part(3)).alias("cik"), F.trim(part(2)).alias("name"),
        part(1).alias("form"), filed.alias("filed"))
    return notices, ours.where(~good).select("value")


def ownership_listing(filings: DataFrame, fund_forms: tuple[str, ...]) -> DataFrame:
    """Per company its ownership filings, the latest date of every fund form, the earliest date and whether pages are missing.

    ``filings``: cik, form, filed (ISO text), accession, document, more (the listing continues on further pages). One row per
    cik: filings array<struct> by (filed, accession), fund_forms map, earliest_listed, truncated. The document of an
    ownership filing is named without the folder of its rendered view. Equal rows count once.
    """
    form = F.trim("form")
    document = F.when(F.col("document").rlike("^xsl[^/]*/"), F.regexp_replace("document", "^[^/]*/", "")).otherwise(F.col("document"))
    owned = form.isin(*OWNERSHIP_FORMS) & (F.coalesce("document", F.lit("")) != "")
    entry = F.struct("filed", "accession", form.alias("form"), document.alias("document"))
    listed = filings.groupBy("cik").agg(
        F.array_sort(F.collect_set(F.when(owned, entry))).alias("filings"), F.min("filed").alias("earliest_listed"),
        F.coalesce(F.bool_or("more"), F.lit(False)).alias("truncated"))
    latest = filings.where(form.isin(*fund_forms)).groupBy("cik", form.alias("form")).agg(F.max("filed").alias("filed"))
    funds = latest.groupBy("cik").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("form", "filed")))).alias("fund_forms"))
    none = F.create_map().cast("map<string,string>")
    return listed.join(funds, "cik", "left").withColumn("fund_forms", F.coalesce("fund_forms", none)).withColumn(
        "cik", F.lpad(F.col("cik").cast("string"), 10, "0"))
