"""Row rules: classification, filters, name matching, factor ladders. All column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions.scalars import finite, half_even, ladder, messages, positive, ratio


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def classify_asset(frame: DataFrame) -> DataFrame:
    """Adds asset_type, asset_eligible and asset_reason from quote type, industry and name."""
    quote, name, industry = F.upper(_text("quote_type")), _text("company_name"), _text("industry")
    rules = [(quote.isin(*C.EXCLUDED_QUOTE_TYPES), "non_common_equity", F.concat(F.lit("Excluded quote type: "), quote))]
    rules += [(F.lower(industry).contains(item.lower()), "shell_company", F.lit(f"Excluded industry: {item}"))
              for item in C.EXCLUDED_INDUSTRIES]
    rules += [(name.rlike(f"(?i){pattern}"), kind, F.lit(reason)) for pattern, kind, reason in C.NAME_RULES]
    empty = (name == "") & (quote == "") & (industry == "")
    kind, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for condition, label, text in rules:
        kind, reason = kind.when(condition, label), reason.when(condition, text)
    blocked = kind.otherwise(None)
    return frame.withColumns({
        "asset_type": F.coalesce(blocked, F.when(empty, "unknown").otherwise("operating_equity")),
        "asset_eligible": blocked.isNull(),
        "asset_reason": F.coalesce(reason.otherwise(None), F.when(
            empty, "Insufficient metadata for structural classification").otherwise("No excluded asset structure detected")),
    })


def pre_filter(frame: DataFrame) -> DataFrame:
    """Adds passed and filter_reason: asset rule, then missing, invalid, small or large market cap."""
    raw, cap = F.col("market_cap"), F.col("market_cap").try_cast("double")
    reason = (
        F.when(~F.col("asset_eligible"), F.col("asset_reason"))
        .when(raw.isNull(), "Missing market cap").when(cap.isNull(), "Invalid market cap")
        .when(cap < C.MARKET_CAP["minimum"], "Below minimum market cap")
        .when(cap > C.MARKET_CAP["maximum"], "Above maximum market cap")
    )
    return classify_asset(frame).withColumn("filter_reason", reason).withColumn("passed", F.col("filter_reason").isNull())


def average_dollar_volume(value: str, breakdown: str) -> Column:
    """The stored figure, else the raw value of the liquidity factor in the breakdown JSON."""
    return F.coalesce(finite(value), finite(F.get_json_object(breakdown, "$.liquidity.raw_value")))


def liquidity_eligible(volume: Column, floor: float = C.MINIMUM_DOLLAR_VOLUME) -> Column:
    """True at or above the floor; unknown liquidity fails; a floor of 0 passes everything."""
    return F.lit(True) if floor <= 0 else F.coalesce(volume >= floor, F.lit(False))


def name_tokens(name: Column) -> Column:
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.array_except(words, F.array(F.lit(""), *[F.lit(word) for word in C.NAME_STOPWORDS])))


def name_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of meaningful tokens; 0 when a side has none."""
    shared = F.size(F.array_intersect(left, right))
    return F.coalesce(shared / F.nullif(F.size(F.array_union(left, right)), F.lit(0)), F.lit(0.0))


def names_match(left: Column, right: Column, minimum: float = 0.5) -> Column:
    """Token arrays match when equal as sets, or share two tokens at the minimum similarity."""
    known = (F.size(left) > 0) & (F.size(right) > 0)
    shared = F.size(F.array_intersect(left, right))
    same = F.array_sort(left) == F.array_sort(right)
    return known & (same | ((shared >= 2) & (name_similarity(left, right) >= minimum)))


def investment_fund_type(forms: DataFrame, retrieved: str = "retrieved") -> DataFrame:
    """Per cik: closed_end_fund, business_development_company or null from fund forms and dates."""
    def latest(names: Sequence[str]) -> Column:
        return F.max(F.when(F.col("form").isin(*names), F.col("filed")))

    dates = forms.groupBy("cik").agg(
        latest(C.FUND_REPORT_FORMS).alias("report"), latest(C.BDC_ELECTION_FORMS).alias("elected"),
        latest(C.BDC_WITHDRAWAL_FORMS).alias("withdrawn"), F.max(retrieved).alias("retrieved"))
    recent = F.datediff("retrieved", "report") <= C.FUND_REPORT_DAYS
    standing = F.col("elected").isNotNull() & ~F.coalesce(F.col("withdrawn") >= F.col("elected"), F.lit(False))
    return dates.select("cik", F.when(recent, "closed_end_fund").when(
        standing, "business_development_company").alias("investment_fund"))


def sector_for_sic(sic: Column) -> Column:
    code = sic.try_cast("int")
    return (F.when((code == 6798) | code.between(6500, 6553), "Real Estate")
            .when(code.between(6000, 6799), "Financial Services").otherwise("Unknown"))


def is_bank(sector: str = "sector", industry: str = "industry") -> Column:
    return F.coalesce((F.col(sector) == C.BANK_SECTOR) & F.col(industry).startswith(C.BANK_INDUSTRY_PREFIX), F.lit(False))


def market_cap_points(cap: Column) -> Column:
    band, points = C.MARKET_CAP, C.WEIGHTS["market_cap"]
    return (
        F.when(cap.between(band["sweet_minimum"], band["sweet_maximum"]), points)
        .when((cap >= band["tiny"]) & (cap < band["sweet_minimum"]), points * 0.53)
        .when((cap > band["sweet_maximum"]) & (cap <= band["maximum"]), points * 0.53)
        .when((cap >= band["minimum"]) & (cap < band["tiny"]), points * 0.20).otherwise(0.0)
    )


def sector_points(sector: Column) -> Column:
    """Points of the first configured name contained in the sector; order matters."""
    chain = F.when(F.coalesce(sector, F.lit("")) == "", 0.0)
    for name, points in C.SECTOR_BONUS:
        chain = chain.when(F.lower(sector).contains(name.lower()), min(points, C.WEIGHTS["sector_bonus"]))
    return chain.otherwise(0.0)


def reason_flags(volume_ratio: Column, strength: Column, cap: Column, trend: Column, sector: Column) -> Column:
    band = C.MARKET_CAP
    return F.array_join(messages(
        (volume_ratio >= 2, "Volume acceleration"), (strength >= 30, "Strong relative strength"),
        (cap.between(band["sweet_minimum"], band["sweet_maximum"]), "Sweet spot market cap"),
        (cap < band["tiny"], "Tiny market cap / exceptional risk"),
        (trend == C.WEIGHTS["trend_strength"], "Strong technical trend"),
        (F.coalesce(sector, F.lit("")) != "", F.concat(F.lit("Sector: "), sector)),
    ), "; ")


def data_quality(stamp: Column, as_of: Column) -> Column:
    """undated, stale (over 550 days) or fresh, from a reporting timestamp."""
    age = F.greatest(F.datediff(as_of, F.to_date(stamp)), F.lit(0))
    return F.when(stamp.isNull(), "undated").when(age > C.MAXIMUM_DATA_AGE_DAYS, "stale").otherwise("fresh")


def _factor_inputs() -> dict[str, tuple[Column, Column]]:
    """Per factor: its value and whether the raw input is invalid."""
    cap, never = positive("market_cap"), F.lit(False)

    def inverse(name: str) -> tuple[Column, Column]:
        return 1.0 / positive(name), F.coalesce(finite(name) <= 0, never)

    def direct(name: str, bad: Column) -> tuple[Column, Column]:
        invalid = F.coalesce(bad, never)
        return F.when(~invalid, finite(name)), invalid

    return {
        "revenue_growth": (finite("revenue_growth"), never), "earnings_growth": (finite("earnings_growth"), never),
        "profitability": (F.coalesce(finite("operating_margin"), finite("profit_margin")), never),
        "free_cash_flow": (finite("free_cash_flow") / cap, never),
        "balance_sheet": ((finite("total_cash") - finite("total_debt")) / cap, never),
        "earnings_yield": inverse("trailing_pe"), "sales_yield": inverse("price_to_sales"),
        "enterprise_value_ebitda": direct("enterprise_to_ebitda", finite("enterprise_to_ebitda") <= 0),
        "liquidity": direct("current_ratio", finite("current_ratio") <= 0),
        "leverage": direct("debt_to_equity", finite("debt_to_equity") < 0),
        "earnings_quality": (finite("operating_cash_flow") / positive("net_income"), never),
    }


def apply_input_policy(value: Column, policy: tuple[float, float, str]) -> tuple[Column, Column]:
    """Out-of-range values become null (invalid), clamped (capped) or kept (flagged)."""
    low, high, action = policy
    outside = F.coalesce((value < low) | (value > high), F.lit(False))
    if action == "invalid":
        return F.when(~outside, value), F.when(outside, "invalid")
    if action == "cap":
        return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low))), F.when(outside, "capped")
    return value, F.when(outside, "flagged")


def fundamental_factors(frame: DataFrame, quality: str = "quality") -> DataFrame:
    """Adds ``factors`` (array of structs), the score, its normalised value and the confidence."""
    raw = _factor_inputs()
    # Staged columns: value and validity, then policy, then state. One big
    # expression would repeat each part many times over.
    first = frame.withColumns({
        **{f"__v_{name}": value for name, (value, _) in raw.items()},
        **{f"__i_{name}": invalid for name, (_, invalid) in raw.items()},
    })
    policies = {name: apply_input_policy(F.col(f"__v_{name}"), spec[3]) for name, spec in C.FUNDAMENTAL_FACTORS.items()}
    second = first.withColumns({
        **{f"__k_{name}": kept for name, (kept, _) in policies.items()},
        **{f"__o_{name}": outcome for name, (_, outcome) in policies.items()},
    })

    def state(name: str) -> Column:
        outcome = F.col(f"__o_{name}")
        return F.when(F.col(f"__i_{name}") | F.coalesce(outcome == "invalid", F.lit(False)), "invalid").when(
            (F.col(quality) == "fresh") & outcome.isNotNull(), outcome).otherwise(F.col(quality))

    def applicable(name: str) -> Column:
        barred = [sector for sector, names in C.FACTOR_SECTOR_EXCLUSIONS.items() if name in names]
        return ~F.coalesce(F.col("sector").isin(*barred), F.lit(False)) if barred else F.lit(True)

    third = second.withColumns({f"__s_{name}": state(name) for name in raw})
    blocked = ("stale", "invalid", "invalid_date")
    staged = third.withColumns({
        f"__a_{name}": applicable(name) & F.col(f"__k_{name}").isNotNull() & ~F.col(f"__s_{name}").isin(*blocked) for name in raw})
    entries = []
    for name, (weight, direction, steps, _) in C.FUNDAMENTAL_FACTORS.items():
        value, status, available = F.col(f"__k_{name}"), F.col(f"__s_{name}"), F.col(f"__a_{name}")
        points = F.when(available, ladder(value, [(b, weight * s) for b, s in steps], lower=direction == "lower")).otherwise(0.0)
        entries.append(F.struct(
            F.lit(name).alias("name"), value.alias("raw_value"), F.col(f"__v_{name}").alias("source_value"),
            points.alias("points"), F.lit(weight).alias("max_points"), available.alias("available"),
            applicable(name).alias("applicable"),
            F.when(~applicable(name), "not_applicable").when(value.isNull() & ~status.isin(*blocked), "missing")
            .otherwise(status).alias("data_quality"),
        ))
    scored = staged.withColumn("factors", F.array(*entries)).drop(
        *[f"__{kind}_{name}" for name in raw for kind in "vikosa"])
    return score_factors(scored)


def factor_total(amount, keep=lambda item: F.lit(True), array: str = "factors") -> Column:
    """Sum of an amount over the factors that pass ``keep``."""
    return F.aggregate(array, F.lit(0.0), lambda total, item: total + F.when(keep(item), amount(item)).otherwise(0.0))


def score_factors(frame: DataFrame) -> DataFrame:
    """Score, score over the available maximum, and quality-weighted confidence of ``factors``."""
    ratios = F.create_map(*[F.lit(x) for pair in C.QUALITY_RATIOS.items() for x in pair])
    usable = lambda item: item["available"] & item["applicable"]
    sums = frame.withColumns({
        "fundamental_score": half_even(factor_total(lambda item: item["points"]), 2),
        "__available": factor_total(lambda item: item["max_points"], usable),
        "__applicable": factor_total(lambda item: item["max_points"], lambda item: item["applicable"]),
        "__confident": factor_total(
            lambda item: item["max_points"] * F.coalesce(F.try_element_at(ratios, item["data_quality"]), F.lit(0.0)), usable),
    })
    return sums.withColumns({
        "fundamental_score_normalized": half_even(ratio("fundamental_score", "__available") * 100, 2),
        "fundamental_confidence": half_even(F.coalesce(ratio("__confident", "__applicable"), F.lit(0.0)) * 100, 2),
    }).drop("__available", "__applicable", "__confident")


def same_currency(reporting: Column, listing: Column) -> Column:
    """Missing reporting currency passes; a missing listing currency is USD."""
    told = F.upper(F.coalesce(reporting, F.lit("")))
    return (told == "") | (told == F.upper(F.coalesce(F.nullif(listing, F.lit("")), F.lit("USD"))))


def duplicate_listings(rows: DataFrame) -> DataFrame:
    """Secondary ticker -> kept ticker for a Canadian interlisting of a US name.

    The root, then the root with '.' as '-', is looked up among US tickers (an
    equality join); the first hit decides, and only when the names match. The
    US listing is kept if liquid or if the Canadian one is not.
    """
    active = rows.where(F.coalesce(F.col("status"), F.lit("OK")) == "OK").withColumn("__t", F.upper("ticker"))
    us = active.where(F.upper("country") == "US").select(
        F.col("__t").alias("candidate"), F.col("company_name").alias("us_name"), F.col("liquid").alias("us_liquid"))
    root = F.upper(F.trim(F.coalesce("root_ticker", F.split("__t", r"\.")[0])))
    canadian = active.where((F.upper("country") == "CA") & F.coalesce("interlisted", F.lit(False))).select(
        "__t", "company_name", "liquid",
        F.posexplode(F.array_distinct(F.array(root, F.regexp_replace(root, r"\.", "-")))).alias("place", "candidate"))
    hits = canadian.join(us, "candidate").groupBy("__t").agg(
        F.min_by(F.struct("candidate", "company_name", "us_name", "liquid", "us_liquid"), "place").alias("h"))
    matched = hits.where(names_match(name_tokens(F.col("h.company_name")), name_tokens(F.col("h.us_name"))))
    keep_us = F.col("h.us_liquid") | ~F.col("h.liquid")
    return matched.select(
        F.when(keep_us, F.col("__t")).otherwise(F.col("h.candidate")).alias("ticker"),
        F.when(keep_us, F.col("h.candidate")).otherwise(F.col("__t")).alias("duplicate_of"))


def registrant_mapping(rows: DataFrame, registrants: DataFrame) -> DataFrame:
    """(sec_ticker, reason) per row: direct for US rows, by root and name for interlisted ones.

    ``registrants``: symbol, title.
    """
    own = rows.withColumn("__t", F.upper(F.trim(F.coalesce("ticker", F.lit("")))))
    root = F.upper(F.trim(F.coalesce("root_ticker", F.split("__t", r"\.")[0])))
    is_us = F.upper("country") == "US"
    probes = F.when(is_us, F.array(F.col("__t"))).otherwise(F.array_distinct(F.array(root, F.regexp_replace(root, r"\.", "-"))))
    exploded = own.select("__t", F.posexplode(probes).alias("place", "symbol"))
    found = exploded.join(registrants, "symbol").groupBy("__t").agg(F.min_by(F.struct("symbol", "title"), "place").alias("r"))
    joined = own.join(found, "__t", "left")
    left, right = name_tokens(F.col("company_name")), name_tokens(F.col("r.title"))
    similarity = name_similarity(left, right)
    interlisted = F.coalesce("interlisted", F.lit(False))
    matched = names_match(left, right)
    reason = (
        F.when(F.col("__t") == "", "missing ticker")
        .when(is_us & F.col("r").isNull(), "no SEC CIK mapping").when(is_us, "direct")
        .when(~interlisted, "not interlisted")
        .when(F.col("r").isNull(), "interlisted but no SEC CIK mapping for root symbol")
        .when(matched, F.concat(F.lit("interlisted:"), F.col("r.symbol"), F.lit(" name match "), F.format_string("%.2f", similarity)))
        .otherwise("interlisted root maps to another name")
    )
    accepted = F.when(is_us, F.col("r.symbol")).when(interlisted & matched, F.col("r.symbol"))
    return joined.select(*rows.columns, F.when(F.col("__t") != "", accepted).alias("sec_ticker"), reason.alias("sec_reason"))
