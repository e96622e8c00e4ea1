"""A quote table over the cross-section, written once for both engines.

Every column is arithmetic on the company's own rows, so the table grows with
the customers and orders it is read from.
"""

from __future__ import annotations

from sightline.catalog.views import VIEW_SQL, Views

QUOTE_COLUMNS = {
    "ticker": "ticker",
    "company_name": "'Company ' || CAST(ticker AS STRING) || CASE ticker % 17 WHEN 0 THEN ' Acquisition Corp' WHEN 1 THEN ' Warrants' WHEN 2 THEN ' Holdings Inc' WHEN 3 THEN ' units' ELSE ' Mining Corp' END",
    "quote_type": "CASE WHEN ticker % 19 = 0 THEN 'etf' WHEN ticker % 23 = 0 THEN NULL ELSE 'EQUITY' END",
    "industry": "CASE WHEN ticker % 29 = 0 THEN 'shell companies' WHEN ticker % 3 = 0 THEN 'Banks - Regional' ELSE 'Software' END",
    "sector": "CASE sector WHEN 'AUTOMOBILE' THEN 'Technology' WHEN 'BUILDING' THEN 'Real Estate' WHEN 'FURNITURE' THEN 'Financial Services' WHEN 'HOUSEHOLD' THEN 'Biotechnology' ELSE 'Utilities' END",
    "country": "CASE WHEN country_key % 3 = 0 THEN 'CA' ELSE 'US' END",
    "market_cap": "CASE WHEN ticker % 31 = 0 THEN NULL ELSE s2 * (1 + ticker % 400) END",
    "revenue_growth": "CASE WHEN ticker % 11 = 0 THEN NULL ELSE CAST((ticker * 37) % 300 - 120 AS DOUBLE) / 100 END",
    "earnings_growth": "CASE WHEN ticker % 13 = 0 THEN NULL ELSE CAST((ticker * 53) % 260 - 110 AS DOUBLE) / 100 END",
    "operating_margin": "CASE WHEN ticker % 7 = 0 THEN NULL ELSE CAST((ticker * 41) % 90 - 40 AS DOUBLE) / 100 END",
    "profit_margin": "CAST((ticker * 17) % 80 - 40 AS DOUBLE) / 100",
    "free_cash_flow": "CASE WHEN ticker % 9 = 0 THEN NULL ELSE s2 * ((ticker * 29) % 41 - 20) END",
    "total_cash": "CASE WHEN ticker % 10 = 0 THEN NULL ELSE s2 * (ticker % 37) END",
    "total_debt": "s2 * ((ticker * 3) % 43)",
    "trailing_pe": "CAST((ticker * 7) % 60 - 6 AS DOUBLE)",
    "price_to_sales": "CAST((ticker * 11) % 90 - 3 AS DOUBLE) / 10",
    "enterprise_to_ebitda": "CAST((ticker * 19) % 130 - 8 AS DOUBLE)",
    "current_ratio": "CAST((ticker * 23) % 70 - 2 AS DOUBLE) / 10",
    "debt_to_equity": "CAST((ticker * 13) % 400 - 10 AS DOUBLE)",
    "operating_cash_flow": "s2 * ((ticker * 5) % 31 - 10)",
    "net_income": "s2 * ((ticker * 3) % 23 - 6)",
    "age_days": "CASE WHEN ticker % 14 = 0 THEN NULL ELSE CAST((ticker * 31) % 800 AS INTEGER) END",
    "volume": "s2 / 10",
    "s1": "s1", "s2": "s2", "s3": "s3", "s4": "s4",
}


def quotes(v: Views):
    return v.xs.selectExpr(*[f"{expression} AS {name}" for name, expression in QUOTE_COLUMNS.items()])


VIEW_SQL["quotes"] = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in QUOTE_COLUMNS.items()) + " FROM xs"
