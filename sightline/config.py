"""Settings. Plain dictionaries and tuples that operators turn into columns.

Fixed values: weights, thresholds, windows and labels below must equal the
published model settings for results to agree.
"""

from __future__ import annotations

MARKET_CAP = {"minimum": 10_000_000, "sweet_minimum": 50_000_000, "sweet_maximum": 750_000_000,
              "maximum": 1_000_000_000, "tiny": 25_000_000}
MINIMUM_DOLLAR_VOLUME = 250_000.0

# Price windows, in sessions.
LOOKBACKS = {
    "minimum_price_history_days": 200,
    "long_window": 240, "medium_window": 126, "skip_window": 21, "reversal_window": 21,
    "volatility_window": 63, "volume_short": 21, "volume_long": 240, "high_window": 240,
    "relative_strength_days": 126, "score_volume_short": 30, "score_volume_long": 90,
    "moving_average_short": 50, "moving_average_long": 200,
}

PRICE_SIGNALS = ("momentum_long", "momentum_medium", "short_term_reversal", "high_proximity",
                 "volatility", "volume_trend")

# Official score: points per part, and the share of points at each threshold.
WEIGHTS = {"volume_acceleration": 25.0, "relative_strength": 25.0, "trend_strength": 15.0,
           "market_cap": 15.0, "sector_bonus": 10.0, "liquidity": 10.0}
VOLUME_STEPS = ((3, 1.0), (2, 0.80), (1.5, 0.56), (1.2, 0.32))
STRENGTH_STEPS = ((50, 1.0), (30, 0.80), (15, 0.56), (0, 0.32))
LIQUIDITY_STEPS = ((5_000_000, 1.0), (1_000_000, 0.70), (250_000, 0.40))
MIXED_TREND_SHARE = 0.53
SECTOR_BONUS = (
    ("Technology", 10.0), ("Software", 10.0), ("Cybersecurity", 10.0), ("Energy", 8.0), ("Industrials", 6.0),
    ("Healthcare", 6.0), ("Biotechnology", 6.0), ("Financial Services", 4.0), ("Basic Materials", 4.0),
)

# Cross-sectional models: signal -> (weight, direction).
MODEL_V2 = {
    "prefix": "score_v2", "version": "v2.0-shadow", "minimum_group": 20, "minimum_confidence": 0.0,
    "sector_exclusions": {}, "exclusions": (),
    "signals": {
        "v2_momentum_long": (30.0, "higher"), "v2_high_proximity": (20.0, "higher"),
        "v2_momentum_medium": (15.0, "higher"), "v2_volatility": (15.0, "lower"),
        "v2_volume_trend": (10.0, "higher"), "v2_short_term_reversal": (10.0, "lower"),
    },
}
_FUNDAMENTAL_EXCLUSIONS = (
    # signal, exclude below, exclude above, reason
    ("pit_operating_margin_ttm", 20.0, None, "Bottom-quintile operating margin"),
    ("pit_share_change_1y", None, 80.0, "Top-quintile share dilution"),
    ("pit_revenue_growth_ttm", None, 80.0, "Top-quintile revenue growth"),
)
_FINANCIAL_GAPS = ("pit_sales_yield", "pit_net_cash_to_market_cap", "pit_fcf_yield",
                   "pit_fcf_margin_ttm", "pit_operating_margin_ttm")
_V3_SIGNALS = {
    "pit_sales_yield": (25.0, "higher"), "pit_net_cash_to_market_cap": (15.0, "higher"),
    "pit_fcf_yield": (10.0, "higher"), "pit_fcf_margin_ttm": (10.0, "higher"),
    "pit_operating_margin_ttm": (5.0, "higher"), "pit_share_change_1y": (10.0, "lower"),
    "ins_purchase_count_long": (10.0, "higher"), "v2_high_proximity": (10.0, "higher"),
    "v2_momentum_long": (5.0, "higher"), "v2_volatility": (5.0, "lower"),
}
MODEL_V3 = {
    "prefix": "score_v3", "version": "v3.2-shadow-composite", "minimum_group": 20, "minimum_confidence": 50.0,
    "sector_exclusions": {"Financial Services": _FINANCIAL_GAPS},
    "exclusions": _FUNDAMENTAL_EXCLUSIONS, "signals": _V3_SIGNALS,
}
MODEL_V3_CHALLENGER = {
    **MODEL_V3, "prefix": "score_v3_challenger", "version": "v3.0-shadow-composite",
    "signals": {
        ("ins_net_count_short" if name == "ins_purchase_count_long" else name): spec
        for name, spec in _V3_SIGNALS.items()
    },
}
MODELS = (MODEL_V2, MODEL_V3, MODEL_V3_CHALLENGER)

BACKTEST = {
    "horizons": {"1M": 21, "3M": 63, "6M": 126, "1Y": 252}, "stale_sessions": 5,
    "compounding_horizon": "1M", "top_n": (10, 25, 50, 100), "quantiles": 5, "minimum_cross_section": 50,
    "minimum_history": 200,
}
# Newey-West lags per horizon of overlapping monthly returns.
NEWEY_WEST_LAGS = {"1M": 0, "3M": 2, "6M": 5, "1Y": 11}
FIT_SPLIT = "2022-01"
MINIMUM_PAIRS = 50
T_THRESHOLD = 2.0

# Price report.
RETURN_PERIODS = {"1W": 7, "1M": 30, "3M": 91, "6M": 182, "1Y": 365}
ANOMALY_RISE, ANOMALY_FALL = 300.0, -75.0
SPLIT_JUMP_FACTOR = 1.5

# Cohorts.
COHORT_HORIZON_DAYS = {"1M": 30, "3M": 91, "6M": 182, "1Y": 365}
COHORT = {"staleness_days": 10, "minimum_size": 5, "top_n": 25, "quantiles": 5,
          "selected": ("priority_research", "asymmetric_watch", "speculative_watch"),
          "control": ("low_upside_signal", "insufficient_evidence")}

# Asset classification rules, first match wins.
EXCLUDED_QUOTE_TYPES = ("ETF", "MUTUALFUND", "INDEX", "FUTURE", "OPTION", "CRYPTOCURRENCY")
EXCLUDED_INDUSTRIES = ("Shell Companies",)
NAME_RULES = (
    # pattern, asset type, reason
    (r"\b(acquisition|acquisitions) (corp(oration)?|co(mpany)?)\b", "acquisition_vehicle", "Acquisition or SPAC vehicle"),
    (r"\b(blank check|special purpose acquisition|SPAC)\b", "acquisition_vehicle", "Acquisition or SPAC vehicle"),
    (r"\b(warrant|warrants|rights|units|preferred shares?)\b", "non_common_equity", "Non-common-equity security"),
)

# US listing clean-up and Canadian directory exclusions.
US_NAME_TERMS = ("Warrant", "Right", "Unit", "Preferred", "Depositary", "Notes", "Bond", "ETF", "Fund")
EXCHANGE_CODES = {"N": "NYSE", "A": "AMEX", "P": "NYSE_ARCA", "Z": "CBOE", "V": "IEXG"}
CANADIAN_EXCLUDED_SECTORS = ("ETP", "CDR", "Closed-End Funds", "SPAC", "CPC")
CANADIAN_NAME_TERMS = (r"\bETF\b", r"\bETN\b", r"\bfund\b", r"\bclosed[- ]end\b", r"\bwarrant\b", r"\brights?\b",
                       r"\bdebenture\b", r"\bpreferred\b", r"\bdepositary receipt\b", r"\bsubscription receipt\b",
                       r"\bcapital pool\b")
CANADIAN_CAP_BAND = (10_000_000.0, 1_000_000_000.0)

# Company-name words that carry no identity.
NAME_STOPWORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "holdings",
                  "holding", "group", "the", "of", "and", "class", "common", "shares", "stock", "trust", "lp", "llc",
                  "sa", "nv")

# Fund registration forms.
FUND_REPORT_FORMS = ("N-CSR", "N-CSRS", "N-CSR/A", "N-CSRS/A", "NPORT-P", "NPORT-P/A", "N-CEN", "N-CEN/A")
BDC_ELECTION_FORMS = ("N-54A", "N-54A/A")
BDC_WITHDRAWAL_FORMS = ("N-54C", "N-54C/A")
FUND_REPORT_DAYS = 400

# Fundamental factors: weight, direction, ladder of (bound, share of points), input policy (low, high, action).
FUNDAMENTAL_FACTORS = {
    "revenue_growth": (10.0, "higher", ((0.30, 1.0), (0.15, 0.8), (0.05, 0.5), (0.0, 0.2), (-1000, 0.0)), (-1.0, 10.0, "invalid")),
    "earnings_growth": (8.0, "higher", ((0.30, 1.0), (0.15, 0.8), (0.05, 0.5), (0.0, 0.2), (-1000, 0.0)), (-1.0, 10.0, "invalid")),
    "profitability": (8.0, "higher", ((0.20, 1.0), (0.10, 0.75), (0.0, 0.4), (-1000, 0.0)), (-5.0, 1.0, "invalid")),
    "free_cash_flow": (7.0, "higher", ((0.10, 1.0), (0.05, 0.75), (0.0, 0.4), (-1000, 0.0)), (-10.0, 10.0, "cap")),
    "balance_sheet": (7.0, "higher", ((0.20, 1.0), (0.0, 0.7), (-0.25, 0.4), (-1000, 0.0)), (-10.0, 10.0, "cap")),
    "earnings_yield": (5.0, "higher", ((0.10, 1.0), (0.05, 0.75), (0.0, 0.35), (-1000, 0.0)), (0.0, 1.0, "cap")),
    "sales_yield": (4.0, "higher", ((1.0, 1.0), (0.5, 0.75), (0.2, 0.4), (0.0, 0.1)), (0.0, 10.0, "cap")),
    "enterprise_value_ebitda": (4.0, "lower", ((8.0, 1.0), (15.0, 0.7), (25.0, 0.35), (1_000_000, 0.0)), (0.0, 100.0, "cap")),
    "liquidity": (4.0, "higher", ((2.0, 1.0), (1.25, 0.7), (1.0, 0.35), (-1000, 0.0)), (0.0, 50.0, "cap")),
    "leverage": (4.0, "lower", ((25.0, 1.0), (75.0, 0.7), (150.0, 0.35), (1_000_000, 0.0)), (0.0, 1000.0, "cap")),
    "earnings_quality": (4.0, "higher", ((1.25, 1.0), (1.0, 0.75), (0.5, 0.35), (-1000, 0.0)), (-20.0, 20.0, "invalid")),
}
FACTOR_SECTOR_EXCLUSIONS = {
    "Financial Services": ("free_cash_flow", "enterprise_value_ebitda", "liquidity"),
    "Real Estate": ("earnings_growth", "earnings_quality"),
}
MAXIMUM_DATA_AGE_DAYS = 550
QUALITY_RATIOS = {"fresh": 1.0, "capped": 1.0, "flagged": 1.0, "undated": 0.75}

# Research queue and screen.
SCREEN = {"quantiles": 5, "minimum_quintile": 3, "bank_lane": True, "bank_minimum_percentile": 50.0}
BANK_SECTOR, BANK_INDUSTRY_PREFIX = "Financial Services", "Banks"
DEFENSIVE_SIGNALS = (("v2_high_proximity", 1), ("v2_volatility", -1), ("pit_earnings_yield", 1),
                     ("pit_net_cash_to_market_cap", -1), ("pit_market_cap", 1))

# Peers.
PEERS = {"minimum": 3, "closest": 8, "leaders": 5, "shortlist": 10}
