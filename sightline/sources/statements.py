"""Published statement tables (labels by period end) to filed facts with estimated filing dates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalars import finite

#: Statement, labels in order of preference, whether a value is taken at a date, and its sign, per concept.
LABELS: Mapping[str, tuple[str, tuple[str, ...], bool, int]] = {
    "revenue": ("income", ("Total Revenue", "Operating Revenue"), False, 1),
    "gross_profit": ("income", ("Gross Profit",), False, 1),
    "operating_income": ("income", ("Operating Income", "Total Operating Income As Reported"), False, 1),
    "net_income": ("income", ("Net Income", "Net Income Common Stockholders"), False, 1),
    "operating_cash_flow": ("cashflow", ("Operating Cash Flow",), False, 1),
    "capital_expenditure": ("cashflow", ("Capital Expenditure",), False, -1),
    "cash": ("balance", ("Cash And Cash Equivalents", "Cash Cash Equivalents And Short Term Investments"), True, 1),
    "long_term_debt": ("balance", ("Long Term Debt", "Long Term Debt And Capital Lease Obligation"), True, 1),
    "short_term_debt": ("balance", ("Current Debt", "Current Debt And Capital Lease Obligation"), True, 1),
    "stockholders_equity": ("balance", ("Stockholders Equity", "Common Stock Equity"), True, 1),
    "shares_outstanding": ("balance", ("Ordinary Shares Number", "Share Issued"), True, 1),
}
#: Days from a period's end to its estimated filing, and months of a period.
LAGS, MONTHS = {"quarterly": 60, "annual": 120}, {"quarterly": 3, "annual": 12}
QUALITY = "estimated_filing_dates"


def first_number(values: Column, labels: tuple[str, ...], sign: int = 1) -> Column:
    """struct(label, val) of the first label with a finite number in map values; null if there is none."""
    picks = []
    for label in labels:
        number = finite(F.try_element_at(values, F.lit(label)))
        picks.append(F.when(number.isNotNull(), F.struct(F.lit(label).alias("label"), (number * sign).alias("val"))))
    return F.coalesce(*picks)


def statement_facts(tables: DataFrame) -> DataFrame:
    """Facts of tables(ticker, currency, frequency, statement, end, values map<string, string or double>).

    ``end`` is ISO text; rows without a valid date, of another frequency or without values give nothing. Balance-sheet
    values come from the quarterly tables only. ``filed`` is an estimate and every row says so in ``data_quality``. A period
    starts on the day after the same day of the month three or twelve months before its end (the last day of shorter months).
    """
    end = F.to_date(F.try_to_timestamp(F.substring("end", 1, 10), F.lit("yyyy-MM-dd")))
    concepts = F.array_compact(F.array(*[
        F.when((F.col("statement") == statement) & (F.lit(not instant) | (F.col("frequency") == "quarterly")),
               F.struct(F.lit(concept).alias("concept"), F.lit(instant).alias("instant"), first_number(F.col("values"), labels, sign).alias("n")))
        for concept, (statement, labels, instant, sign) in LABELS.items()]))
    rows = tables.withColumn("end", end).where(F.col("end").isNotNull() & F.col("frequency").isin(*LAGS)).select(
        "ticker", "currency", "frequency", "end", F.explode(concepts).alias("c")).where("c.n is not null")
    quarterly = F.col("frequency") == "quarterly"
    start = F.date_add(F.add_months("end", -F.when(quarterly, MONTHS["quarterly"]).otherwise(MONTHS["annual"])), 1)
    return rows.select(
        F.upper("ticker").alias("ticker"), "c.concept", F.when(~F.col("c.instant"), start).alias("start"), "end",
        F.date_add("end", F.when(quarterly, LAGS["quarterly"]).otherwise(LAGS["annual"])).alias("filed"),
        F.concat(F.lit("statement-"), "frequency").alias("form"), F.year("end").alias("fy"), F.col("c.n.val").alias("val"),
        F.concat(F.lit("statement:"), "c.n.label").alias("tag"), F.col("currency").alias("unit"), F.lit(QUALITY).alias("data_quality"))
