"""Universe scans and clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions.ranking import first_rows


def enabled_listings(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Enabled rows with a trimmed upper-case ticker, the first per ticker in file order."""
    kept = rows.where(F.upper(F.col("enabled").cast("string")) == "TRUE").withColumn("ticker", F.upper(F.trim("ticker"))).where(
        F.col("ticker") != "")
    return first_rows(kept, "ticker", order)


def clean_us(rows: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Drop names with non-common terms and tickers with '$', the first row per trimmed ticker in ``order``."""
    pattern = "(?i)" + "|".join(C.US_NAME_TERMS)
    named = ~F.coalesce(F.col("company_name").rlike(pattern), F.lit(False))
    return first_rows(rows.withColumn("ticker", F.trim("ticker")).where(named & ~F.col("ticker").contains("$")), "ticker", order)


def canadian_asset_type(name: str = "company_name", sector: str = "sector", trust: str = "trust") -> Column:
    kind = F.upper(F.trim(F.coalesce(sector, F.lit(""))))
    names = "(?i)" + "|".join(C.CANADIAN_NAME_TERMS)
    return (
        F.when(kind.isin("ETP", "CDR", "SPAC", "CPC"), kind).when(kind == "CLOSED-END FUNDS", "Fund")
        .when(F.upper(F.coalesce(trust, F.lit(""))) == "Y", "Trust")
        .when(F.coalesce(F.col(name).rlike(names), F.lit(False)), "Non-Common Equity").otherwise("Equity")
    )


def clean_canadian(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """TSX and TSXV equities in the source-cap band, suffix classes out, first row per ticker."""
    low, high = C.CANADIAN_CAP_BAND
    kept = rows.withColumn("asset_type", canadian_asset_type()).where(
        F.col("exchange").isin("TSX", "TSXV") & (F.col("asset_type") == "Equity")
        & ~F.coalesce(F.col("sector").isin(*C.CANADIAN_EXCLUDED_SECTORS), F.lit(False))
        & ~F.upper(F.trim("root_ticker")).rlike(r"\.[PRWU]$") & F.col("market_cap_source_cad").between(low, high))
    rest = [name for name in kept.columns if name != "ticker"]
    return kept.groupBy("ticker").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select("ticker", "x.*")


def allowed_url(url: Column, domains: Sequence[str]) -> Column:
    """https and a host equal to an allowed domain or below one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    hit = F.lit(False)
    for domain in domains:
        hit = hit | (host == domain) | host.endswith("." + domain)
    return F.coalesce(url.startswith("https://") & hit, F.lit(False))
