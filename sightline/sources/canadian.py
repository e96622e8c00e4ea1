"""Exchange directory sheets with changing headers to one set of columns: the plan is made from the sheet's own columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.sources.universe import canadian_asset_type

#: Accepted headers of each text column, all tried in order; ``first`` takes the first header that exists,
#: ``all`` fills a cell from the next header.
TEXTS = {
    "root_ticker": ("first", ("Root Ticker",)), "company_name": ("first", ("Name",)), "exchange": ("first", ("Exchange",)),
    "sector": ("first", ("Sector",)), "sub_sector": ("all", ("Sub-Sector", "Sub Sector")),
    "technology_sub_sector": ("all", ("Technology Sub-Sector",)), "life_sciences_sub_sector": ("first", ("Life Sciences Sub-Sector",)),
    "consumer_sub_sector": ("first", ("Consumer Products & Services Sub-Sector",)),
    "clean_technology_sub_sector": ("all", ("Clean Technology Sub-Sector", "Cleantech Sub-Sector")),
    "real_estate_sub_sector": ("all", ("Real Estate Sub-Sector",)), "hq_location": ("first", ("HQ Location",)),
    "hq_region": ("first", ("HQ Region",)), "listing_type": ("first", ("Listing Type",)),
    "interlisted": ("all", ("Interlisted", "Interlisted I", "Interlisted II")), "otc_listing": ("all", ("Trading on OTC",)),
    "former_cpc": ("all", ("Former CPC", "CPC/ Former CPC")), "trust": ("first", ("Trust",)),
}
#: Headers that go on with a date, as "Market Cap (C$) 31-December-2025".
DATED = {"market_cap_source_cad": "Market Cap (C$)", "shares_outstanding_source": "O/S Shares", "volume_ytd_source": "Volume YTD",
         "value_traded_ytd_source_cad": "Value (C$) YTD", "trades_ytd_source": "Number of Trades YTD"}
SUFFIXES = {"TSX": ".TO", "TSXV": ".V"}
NULLS = ("", "nan", "None", "<NA>")


def plain(header: str) -> str:
    """A header in lower case with single spaces."""
    return " ".join(str(header).lower().split())


def _cell(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`").cast("string")


def text(name: str) -> Column:
    trimmed = F.trim(_cell(name))
    return F.when(~trimmed.isin(*NULLS), trimmed)


def _found(columns: Sequence[str], header: str) -> list[str]:
    """The columns with this header; as in a lookup, the last of equal headers counts first."""
    return [name for name in reversed(columns) if plain(name) == plain(header)][:1]


def standard_sheet(sheet: DataFrame) -> DataFrame:
    """One row per listing with the columns of ``TEXTS`` and ``DATED``, listing_date, source_date, ticker and asset_type.

    Headers match whatever their case, spaces and line breaks. A header that the sheet lacks gives nulls. The source date is
    read from the header of the market caps. Rows without ticker, name or exchange go; numbers that can't be read are null.
    """
    columns = sheet.columns
    chosen = {}
    for name, (how, headers) in TEXTS.items():
        found = [column for header in headers for column in _found(columns, header)]
        found = found[:1] if how == "first" else found
        chosen[name] = F.coalesce(*map(text, found)) if found else F.lit(None).cast("string")
    source_date = F.lit(None).cast("date")
    for name, prefix in DATED.items():
        match = next((column for column in columns if plain(column) == plain(prefix) or plain(column).startswith(plain(prefix) + " ")), None)
        chosen[name] = F.trim(_cell(match)).try_cast("double") if match else F.lit(None).cast("double")
        date = re.search(r"\b\d{1,2}-[A-Za-z]+-\d{4}\b", plain(match or ""))
        if name == "market_cap_source_cad" and date:
            source_date = F.to_date(F.try_to_timestamp(F.lit(date.group()), F.lit("d-MMMM-yyyy")))
    listed = _found(columns, "Listing Date")
    day = F.regexp_replace(F.trim(_cell(listed[0])), r"\.0$", "") if listed else F.lit(None).cast("string")
    chosen["listing_date"] = F.to_date(F.try_to_timestamp(day, F.lit("yyyyMMdd")))
    rows = sheet.select(*[value.alias(name) for name, value in chosen.items()], source_date.alias("source_date"), F.lit("CA").alias("country"))
    rows = rows.dropna(subset=["root_ticker", "company_name", "exchange"])
    ending = F.coalesce(*[F.when(F.col("exchange") == exchange, suffix) for exchange, suffix in SUFFIXES.items()], F.lit(""))
    return rows.withColumns({"ticker": F.concat(F.upper("root_ticker"), ending), "asset_type": canadian_asset_type()})
