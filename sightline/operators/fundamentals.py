"""Filed facts as known on a date: quarters, trailing years, share counts, signals.

A fact row is (company, concept, start_d, end_d, filed, val, priority, seq):
``priority`` is the place of its tag in the concept's alias list (0 is best)
and ``seq`` the order it was listed in. Work is keyed by (company, concept) or
finer; the arrays built per (company, concept, date) hold one entry per
quarter or fiscal year, so their size is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.scalars import finite, half_even, known_sum, positive, ratio
from sightline.operators.asof import as_known, known_versions
from sightline.session import cut

# Day ranges and limits of the reporting rules.
RULES = {
    "quarter_days": (75, 105), "annual_days": (340, 380), "half_year_days": (170, 195), "tolerance": 12,
    "maximum_age": 400, "maximum_annual_age": 550, "market_cap_tolerance": 2.0,
    "weighted_share_ratio": 1.2, "weighted_scale_error": 10.0, "weighted_maximum_days": 380,
    "restatement_threshold": 0.05, "debt_date_tolerance": 7,
}
DURATION_CONCEPTS = ("revenue", "gross_profit", "operating_income", "net_income",
                     "operating_cash_flow", "capital_expenditure")
# How the tags of a debt concept combine on one date.
DEBT_COMBINE = {
    "debt_total_reported": "alias", "debt_broad": "max", "long_term_debt": "alias", "short_term_debt": "alias",
    "debt_noncurrent_parts": "sum", "debt_current_parts": "sum", "debt_credit_lines": "sum", "debt_notes": "sum",
}
SHARE_CONCEPTS = ("shares_outstanding", "weighted_average_shares")
KEY = ["company", "concept"]


def without_proxies(facts: DataFrame) -> DataFrame:
    """Drop figures from proxy and information statements (form ends 14A or 14C, /A ignored)."""
    form = F.regexp_replace(F.upper(F.trim(F.coalesce("form", F.lit("")))), "/A$", "")
    return facts.where(~form.rlike("(14A|14C)$"))


def dominant_currency(facts: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Per company: the money unit with most facts (ties: alphabetical), else declared, else USD for us-gaap."""
    money = facts.where(~F.col("concept").isin(*SHARE_CONCEPTS))
    counts = money.where(F.length("unit") > 0).groupBy("company", "unit").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("company").agg(F.min_by("unit", F.struct((-F.col("n")).alias("n"), "unit")).alias("counted"))
    tagged = facts.groupBy("company").agg(
        F.max(F.when(F.col("tag").startswith("us-gaap:"), F.lit("USD"))).alias("gaap"))
    joined = tagged.join(best, "company", "left")
    if declared is not None:
        joined = joined.join(declared.select("company", F.nullif("declared", F.lit("")).alias("declared")), "company", "left")
    else:
        joined = joined.withColumn("declared", F.lit(None).cast("string"))
    return joined.select("company", F.coalesce("counted", "declared", "gaap").alias("currency"))


def single_currency(facts: DataFrame, currency: DataFrame) -> DataFrame:
    """Drop money facts in another currency than the company's dominant one."""
    keep = (
        F.col("concept").isin(*SHARE_CONCEPTS) | F.col("currency").isNull()
        | F.coalesce(F.length("unit") == 0, F.lit(True)) | (F.col("unit") == F.col("currency"))
    )
    return facts.join(currency, "company", "left").where(keep).drop("currency")


def duration_facts(facts: DataFrame) -> DataFrame:
    """Usable duration rows: dates and value present, end after start."""
    return facts.where(
        finite("val").isNotNull() & F.col("filed").isNotNull() & (F.col("end_d") > F.col("start_d")),
    ).withColumn("days", F.datediff("end_d", "start_d"))


def best_tag(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep only the best-priority tag of each key."""
    best = rows.groupBy(*keys).agg(F.min("priority").alias("__best"))
    return rows.join(best, list(keys)).where(F.col("priority") == F.col("__best")).drop("__best")


def differenced_quarters(durations: DataFrame, direct_ends: DataFrame) -> DataFrame:
    """Cumulative period minus the same-start, same-tag period ending about a quarter earlier."""
    tolerance = RULES["tolerance"]
    longer = durations.join(direct_ends, [*KEY, "end_d"], "left_anti")
    shorter = durations.select(
        *KEY, "start_d", "priority", F.col("end_d").alias("s_end"), F.col("filed").alias("s_filed"),
        F.col("val").alias("s_val"), F.col("seq").alias("s_seq"),
    )
    paired = longer.join(shorter, [*KEY, "start_d", "priority"]).where(
        F.abs(F.datediff("end_d", "s_end") - 91) <= tolerance)
    return paired.select(
        *KEY, F.col("s_end").alias("start_d"), "end_d", F.greatest("filed", "s_filed").alias("filed"),
        half_even(F.col("val") - F.col("s_val"), 6).alias("val"), "priority",
        F.struct(F.lit(1).alias("kind"), F.col("seq").alias("a"), F.col("s_seq").alias("b")).alias("seq"),
    )


def exact_sum(value: str) -> Column:
    """Sum that no order of the rows changes: in decimals of 12 places where all values fit, else in doubles."""
    fixed = F.col(value).try_cast("decimal(28,12)")
    return F.when(F.count(fixed) == F.count(value), F.sum(fixed).cast("double")).otherwise(F.sum(value))


def annual_minus_three(durations: DataFrame, quarters: DataFrame, direct_ends: DataFrame) -> DataFrame:
    """Annual figure minus exactly three quarters as they were known when it was filed."""
    low, high = RULES["annual_days"]
    tolerance, shortest = RULES["tolerance"], RULES["quarter_days"][0]
    annual = durations.where(F.col("days").between(low, high)).join(direct_ends, [*KEY, "end_d"], "left_anti")
    annual = annual.join(quarters.select(*KEY, "end_d", "start_d").distinct(), [*KEY, "end_d", "start_d"], "left_anti")
    annual = annual.select(
        *KEY, F.col("start_d").alias("y_start"), F.col("end_d").alias("y_end"), F.col("filed").alias("y_filed"),
        F.col("val").alias("y_val"), F.col("priority").alias("y_priority"), F.col("seq").alias("y_seq"),
    )
    inside = annual.join(quarters, KEY).where(
        (F.col("end_d") > F.col("y_start"))
        & (F.col("end_d") < F.date_sub("y_end", shortest - tolerance)))
    version = F.struct("filed", "seq", "start_d", "val", "priority")
    item = [*KEY, "y_start", "y_end", "y_filed", "y_val", "y_priority", "y_seq"]
    # The version known at the annual's filing, else the first one listed.
    known = inside.groupBy(*item, "end_d").agg(F.coalesce(
        F.max_by(version, F.when(F.col("filed") <= F.col("y_filed"), F.struct("filed", "seq"))),
        F.min_by(version, "seq"),
    ).alias("q")).where(
        (F.col("q.start_d") >= F.date_sub("y_start", tolerance)) & (F.col("q.priority") == F.col("y_priority")))
    summed = known.groupBy(*item).agg(
        F.count(F.lit(1)).alias("n"), F.max("end_d").alias("last_end"), F.max("q.filed").alias("last_filed"),
        exact_sum("q.val").alias("three"),
    ).where((F.col("n") == 3) & (F.abs(F.datediff("last_end", "y_start") - 273) <= 2 * tolerance))
    return summed.select(
        *KEY, F.col("last_end").alias("start_d"), F.col("y_end").alias("end_d"),
        F.greatest("y_filed", "last_filed").alias("filed"),
        half_even(F.col("y_val") - F.col("three"), 6).alias("val"), F.col("y_priority").alias("priority"),
        F.struct(F.lit(2).alias("kind"), F.col("y_seq").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("seq"),
    )


def quarterly_values(durations: DataFrame) -> DataFrame:
    """Direct, differenced and annual-minus-three quarters, best tag per period end."""
    low, high = RULES["quarter_days"]
    direct = durations.where(F.col("days").between(low, high))
    ends = direct.select(*KEY, "end_d").distinct()
    plain = direct.select(
        *KEY, "start_d", "end_d", "filed", F.col("val").cast("double").alias("val"), "priority",
        F.struct(F.lit(0).alias("kind"), F.col("seq").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("seq"),
    )
    known = plain.unionByName(differenced_quarters(durations, ends))
    everything = known.unionByName(annual_minus_three(durations, known, ends))
    single = everything.groupBy(*KEY, "end_d", "filed", "val", "priority").agg(
        F.min_by("start_d", "seq").alias("start_d"), F.min("seq").alias("seq"))
    return best_tag(single, [*KEY, "end_d"])


def period_values(durations: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Annual or half-year figures: periods of a length range, best tag per end."""
    return best_tag(durations.where(F.col("days").between(*days)), [*KEY, "end_d"]).select(
        *KEY, "start_d", "end_d", "filed", F.col("val").cast("double").alias("val"), "priority", "seq")


def weighted_shares(facts: DataFrame) -> DataFrame:
    """Weighted-average counts: at most 380 days, a quarter preferred per end, best tag, never differenced."""
    rows = duration_facts(facts.where(F.col("concept") == "weighted_average_shares")).where(
        F.col("days") <= RULES["weighted_maximum_days"])
    quarter = F.col("days").between(*RULES["quarter_days"]).cast("int")
    preferred = rows.groupBy(*KEY, "end_d").agg(F.max(quarter).alias("__q"))
    chosen = rows.join(preferred, [*KEY, "end_d"]).where(quarter == F.col("__q")).drop("__q")
    return best_tag(chosen, [*KEY, "end_d"]).select(*KEY, "end_d", "filed", F.col("val").cast("double").alias("val"), "priority", "seq")


def instant_facts(facts: DataFrame, concepts: Sequence[str] | None = None) -> DataFrame:
    rows = facts.where(F.col("start_d").isNull() & finite("val").isNotNull() & F.col("filed").isNotNull())
    if concepts:
        rows = rows.where(F.col("concept").isin(*concepts))
    return rows.select(*KEY, "end_d", "filed", F.col("val").cast("double").alias("val"), "priority", "seq")


def instant_as_of(grid: DataFrame, versions: DataFrame, *, cap: str | None = None, prefix: str = "") -> DataFrame:
    """Latest-dated value known on ``as_of`` per (company, concept), ending by ``as_of`` (and ``cap``)."""
    keys = ["company", "as_of", *([cap] if cap else [])]
    asked = grid.select(*keys).distinct()
    limit = F.least("as_of", cap) if cap else F.col("as_of")
    visible = as_known(asked, versions, ["company"], "as_of").where(F.col("end_d") <= limit)
    return visible.groupBy(*keys, "concept").agg(
        F.max_by(F.struct("end_d", "valid_from", "val"), "end_d").alias("x"),
    ).select(*keys, "concept", F.col("x.end_d").alias(f"{prefix}end"), F.col("x.valid_from").alias(f"{prefix}filed"),
             F.col("x.val").alias(f"{prefix}val"))


def quarters_as_of(grid: DataFrame, quarters: DataFrame, depth: int = 8) -> DataFrame:
    """Per (company, concept, as_of): the last ``depth`` known quarters, newest first, as an array."""
    versions = quarter_versions(quarters)
    visible = as_known(grid.select("company", "as_of").distinct(), versions, ["company"], "as_of").where(
        F.col("end_d") <= F.col("as_of"))
    back = F.row_number().over(Window.partitionBy(*KEY, "as_of").orderBy(F.col("end_d").desc()))
    recent = visible.withColumn("__back", back).where(F.col("__back") <= depth)
    entry = F.struct("end_d", F.col("valid_from").alias("filed"), "val", "priority", "previous_val")
    return recent.groupBy(*KEY, "as_of").agg(F.sort_array(F.collect_list(entry), asc=False).alias("q"))


def quarter_versions(quarters: DataFrame) -> DataFrame:
    """Validity intervals of quarters, each with the value it replaced."""
    versions = known_versions(
        quarters.select(*KEY, "end_d", "filed", "val", "priority", "seq"), [*KEY, "end_d"], sequence="seq")
    before = F.lag("val").over(Window.partitionBy(*KEY, "end_d").orderBy("valid_from"))
    return versions.withColumn("previous_val", before)


def _at(array: str, index: int) -> Column:
    return F.get(F.col(array), F.lit(index))


def consecutive(array: str, start: int, count: int) -> Column:
    """True when the quarters follow each other (newest first array)."""
    low, high = RULES["quarter_days"]
    tolerance = RULES["tolerance"]
    result = _at(array, start + count - 1).isNotNull()
    for index in range(start, start + count - 1):
        gap = F.datediff(_at(array, index)["end_d"], _at(array, index + 1)["end_d"])
        result = result & gap.between(low - tolerance, high + tolerance)
    return F.coalesce(result, F.lit(False))


def same_tag(array: str, start: int, count: int) -> Column:
    result = F.lit(True)
    for index in range(start + 1, start + count):
        result = result & (_at(array, index)["priority"] == _at(array, start)["priority"])
    return F.coalesce(result, F.lit(False))


def restatement_ratio(array: str = "q") -> Column:
    """New over old value of the year-ago quarter when the newest filing restated it by more than 5 %."""
    latest, comparable = _at(array, 0), _at(array, 4)
    change = comparable["val"] / F.nullif(comparable["previous_val"], F.lit(0.0))
    usable = (
        (F.col("concept") == "revenue") & consecutive(array, 0, 5) & (comparable["filed"] == latest["filed"])
        & (comparable["previous_val"] > 0) & (comparable["val"] > 0)
        & (F.abs(change - 1.0) > RULES["restatement_threshold"])
    )
    return F.when(usable, change)


def _result(rank: int, ends: Column, value: Column) -> Column:
    """A trailing-year candidate; structs compare by last end, then by rank (higher wins a tie)."""
    return F.struct(F.element_at(ends, -1).alias("last"), F.lit(rank).alias("rank"), ends.alias("ends"), value.alias("val"))


def _quarterly_ttm(offset: int) -> Column:
    window = F.slice("q", offset + 1, 4)
    restated_on = _at("q", 0)["filed"]
    total = F.aggregate(window, F.lit(0.0), lambda acc, item: acc + item["val"] * F.when(
        F.col("__ratio").isNotNull() & (item["filed"] < restated_on), F.col("__ratio")).otherwise(1.0))
    ends = F.reverse(F.transform(window, lambda item: item["end_d"]))
    return F.when(consecutive("q", offset, 4) & same_tag("q", offset, 4), _result(2, ends, total))


def _annual_ttm(years: int) -> Column:
    item = _at("a", years)
    return F.when(item.isNotNull(), _result(1, F.array(item["end_d"]), item["val"]))


def _half_built() -> Column:
    """Year + half - prior half for every half whose parts line up and share a tag (oldest first)."""
    tolerance = RULES["tolerance"]

    def build(half: Column) -> Column:
        year = F.get(F.filter("a", lambda y: F.abs(F.datediff(half["start_d"], y["end_d"]) - 1) <= tolerance), F.lit(0))
        prior = F.get(F.filter("h", lambda o: (F.abs(F.datediff(half["end_d"], o["end_d"]) - 365) <= tolerance)
                               & (F.abs(F.datediff(half["start_d"], o["start_d"]) - 365) <= tolerance)), F.lit(0))
        fits = (year["priority"] == half["priority"]) & (prior["priority"] == half["priority"])
        return F.when(fits, F.struct(half["end_d"].alias("end_d"), (year["val"] + half["val"] - prior["val"]).alias("val")))

    return F.array_compact(F.transform("h", build))


def _half_ttm(years: int) -> Column:
    latest = F.element_at("b", F.lit(-1))["end_d"]
    target = F.date_sub(latest, 365 * years)
    near = F.filter("b", lambda item: F.abs(F.datediff(item["end_d"], target)) <= RULES["tolerance"])
    hit = F.get(near, F.size(near) - 1)
    return F.when((F.size("b") > 0) & hit.isNotNull(), _result(0, F.array(hit["end_d"]), hit["val"]))


def _visible_periods(grid: DataFrame, values: DataFrame, name: str, newest_first: bool) -> DataFrame:
    versions = known_versions(values, [*KEY, "end_d"], sequence="seq")
    visible = as_known(grid.select("company", "as_of").distinct(), versions, ["company"], "as_of").where(
        F.col("end_d") <= F.col("as_of"))
    return visible.groupBy(*KEY, "as_of").agg(
        F.sort_array(F.collect_list(F.struct("end_d", "start_d", "val", "priority")), asc=not newest_first).alias(name))


def trailing_years(grid: DataFrame, facts: DataFrame, quarters: DataFrame | None = None) -> DataFrame:
    """Trailing-twelve-month results now and four quarters back per (company, concept, as_of).

    ``ttm0`` and ``ttm4`` are structs (ends, val): four quarters, else a fiscal
    year, else one built from half-years; the latest end wins. The arrays
    ``q``, ``a`` and ``h`` stay for other signals.
    """
    # Durations feed eight branches and quarters three: both are stored once.
    durations = cut(duration_facts(facts.where(F.col("concept").isin(*DURATION_CONCEPTS))))
    quarters = cut(quarterly_values(durations)) if quarters is None else quarters
    known = quarters_as_of(grid, quarters)
    annuals = _visible_periods(grid, period_values(durations, RULES["annual_days"]), "a", True)
    halves = _visible_periods(grid, period_values(durations, RULES["half_year_days"]), "h", False)
    keys = [*KEY, "as_of"]
    joined = known.join(annuals, keys, "full").join(halves, keys, "full")
    annual_type = "array<struct<end_d:date,start_d:date,val:double,priority:int>>"
    # Staged columns, so that no shared expression is evaluated twice.
    staged = (
        joined.withColumns({"a": F.coalesce("a", F.array().cast(annual_type)), "h": F.coalesce("h", F.array().cast(annual_type))})
        .withColumns({"b": _half_built(), "__ratio": restatement_ratio()})
        .withColumns({
            "q0": _quarterly_ttm(0), "a0": _annual_ttm(0), "h0": _half_ttm(0),
            "q4": _quarterly_ttm(4), "a4": _annual_ttm(1), "h4": _half_ttm(1),
        })
    )
    return staged.select(
        *keys, "q", "a", "h", F.col("__ratio").alias("restatement_ratio"), F.col("h0").alias("half0"), F.col("h4").alias("half4"),
        F.greatest("q0", "a0", "h0").alias("ttm0"), F.greatest("q4", "a4", "h4").alias("ttm4"),
    )


def revenue_acceleration(array: str = "q") -> Column:
    """Year-over-year growth of the newest quarter minus that of the one before."""
    def value(index: int) -> Column:
        return _at(array, index)["val"]

    usable = consecutive(array, 0, 6) & same_tag(array, 0, 6) & (value(4) > 0) & (value(5) > 0)
    return F.when(usable, value(0) / value(4) - value(1) / value(5))


def report_age_limit(trailing: DataFrame) -> DataFrame:
    """400 days, or 550 when the latest fiscal year known was reported without quarters."""
    latest = trailing.groupBy("company", "as_of").agg(F.max(_at("a", 0)["end_d"]).alias("year_end"))
    ends = trailing.select("company", "as_of", F.explode("q").alias("e")).select("company", "as_of", "e.end_d")
    inside = latest.join(ends, ["company", "as_of"]).where(
        (F.col("end_d") > F.date_sub("year_end", RULES["annual_days"][1])) & (F.col("end_d") <= F.col("year_end")),
    ).select("company", "as_of", F.lit(True).alias("quarterly")).distinct()
    return latest.join(inside, ["company", "as_of"], "left").select(
        "company", "as_of",
        F.when(F.col("year_end").isNull() | F.col("quarterly"), RULES["maximum_age"])
        .otherwise(RULES["maximum_annual_age"]).alias("age_limit"),
    )


def latest_period_end(grid: DataFrame, *versions: DataFrame) -> DataFrame:
    """Most recent period end known on the date over every kind of value."""
    tables = [table.select("company", "valid_from", "valid_to", "end_d") for table in versions]
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return as_known(grid.select("company", "as_of").distinct(), union, ["company"], "as_of").groupBy(
        "company", "as_of").agg(F.max("end_d").alias("latest_end"))


def debt_components(balances: DataFrame, instants: DataFrame, combine: Mapping[str, str] = DEBT_COMBINE) -> DataFrame:
    """Each debt concept on a balance date: its tags' latest values dated up to 7 days before, combined.

    ``balances``: company, as_of, balance_end. ``instants`` keep every tag.
    """
    rows = instants.where(F.col("concept").isin(*combine))
    near = balances.select("company", "as_of", "balance_end").distinct().join(rows, "company").where(
        F.col("end_d").between(F.date_sub("balance_end", RULES["debt_date_tolerance"]), F.col("balance_end"))
        & (F.col("filed") <= F.col("as_of")))
    keys = ["company", "as_of", "balance_end", "concept"]
    tags = near.groupBy(*keys, "priority").agg(F.max_by("val", F.struct("end_d", "filed", "seq")).alias("val"))
    mode = F.element_at(F.create_map(*[F.lit(x) for pair in combine.items() for x in pair]), F.col("concept"))
    return tags.groupBy(*keys).agg(
        F.sum("val").alias("__sum"), F.max("val").alias("__max"), F.min_by("val", "priority").alias("__first"),
    ).withColumn("val", F.when(mode == "sum", F.col("__sum")).when(mode == "max", F.col("__max"))
                 .otherwise(F.col("__first"))).select(*keys, "val")


def total_debt(components: DataFrame) -> DataFrame:
    """Reported total, else the largest of three readings, with how it was found."""
    keys = ["company", "as_of", "balance_end"]
    wide = components.groupBy(*keys).pivot("concept", list(DEBT_COMBINE)).agg(F.max("val"))

    def largest(*names: str) -> Column:
        return F.greatest(*[F.col(name) for name in names])

    readings = F.greatest(
        F.col("debt_broad"),
        known_sum(largest("long_term_debt", "debt_noncurrent_parts"), largest("short_term_debt", "debt_current_parts")),
        known_sum(F.col("debt_credit_lines"), F.col("debt_notes")),
    )
    return wide.select(
        *keys, F.coalesce("debt_total_reported", readings).alias("total_debt"),
        F.when(F.col("debt_total_reported").isNotNull(), "reported_total")
        .when(readings.isNotNull(), "components").alias("debt_coverage"),
    )


def share_choice(period: Column, average: Column) -> tuple[Column, Column]:
    """Pick the period-end count unless missing or the average is over 1.2 times (and not 10 times) it."""
    sane = F.when(~F.coalesce(average["val"] > period["val"] * RULES["weighted_scale_error"], F.lit(False)), average)
    larger = F.coalesce(period["val"] * RULES["weighted_share_ratio"] < sane["val"], F.lit(False))
    use_period = period.isNotNull() & ~larger
    chosen = F.when(use_period, period).otherwise(sane)
    basis = F.when(use_period, "period_end").when(sane.isNotNull(), "weighted_average")
    return chosen, basis


def share_counts(grid: DataFrame, period_versions: DataFrame, average_versions: DataFrame, *,
                 cap: str | None = None, basis: str | None = None) -> DataFrame:
    """Share count to value a company with, per grid row (company, as_of, age_limit[, cap, basis])."""
    keys = ["company", "as_of", *([cap] if cap else [])]
    reference = F.col(cap) if cap else F.col("as_of")

    def usable(prefix: str) -> Column:
        fresh = (F.datediff(reference, F.col(f"{prefix}end")) <= F.col("age_limit")) & (F.col(f"{prefix}val") > 0)
        return F.when(fresh, F.struct(
            F.col(f"{prefix}end").alias("end"), F.col(f"{prefix}filed").alias("filed"), F.col(f"{prefix}val").alias("val")))

    period = instant_as_of(grid, period_versions, cap=cap, prefix="p_").drop("concept")
    average = instant_as_of(grid, average_versions, cap=cap, prefix="w_").drop("concept")
    joined = grid.join(period, keys, "left").join(average, keys, "left").withColumns(
        {"__p": usable("p_"), "__w": usable("w_")})
    chosen, found = share_choice(F.col("__p"), F.col("__w"))
    if basis:
        chosen = F.when(F.col(basis) == "period_end", F.col("__p")).when(F.col(basis) == "weighted_average", F.col("__w"))
        found = F.when(chosen.isNotNull(), F.col(basis))
    return joined.withColumns({"shares": chosen, "shares_basis": found}).select(*grid.columns, "shares", "shares_basis")


def reconciled_market_cap(shares: Column, price: Column, supplied: Column) -> tuple[Column, Column]:
    """Shares times price unless it is off from the supplied cap by a factor of 2; nothing without a price."""
    derived = F.when(positive(price).isNotNull() & positive(shares).isNotNull(), shares * price)
    known = positive(supplied)
    off = derived / known
    limit = RULES["market_cap_tolerance"]
    replaced = F.coalesce((off >= limit) | (off <= 1.0 / limit), F.lit(False))
    cap = F.when(derived.isNotNull(), F.when(replaced, known).otherwise(derived))
    basis = F.when(derived.isNotNull(), F.when(replaced, "reported_shares_unreconciled").otherwise("reported_shares"))
    return cap, basis


def share_unit_factor(provider_cap: Column, derived_cap: Column) -> Column:
    """Constant correction for share counts in other units; 1 within the tolerance or when unknown."""
    off = positive(provider_cap) / positive(derived_cap)
    limit = RULES["market_cap_tolerance"]
    return F.coalesce(F.when((off >= limit) | (off <= 1.0 / limit), off), F.lit(1.0))


def statement_signals(trailing: DataFrame, limits: DataFrame) -> DataFrame:
    """Margins, growth, cash flow and two-year variants per (company, as_of)."""
    keys = ["company", "as_of"]

    def pick(name: str, field: str, alias: str) -> Column:
        return F.max(F.when(F.col("concept") == name, F.col(field))).alias(alias)

    short = {"revenue": "rev", "gross_profit": "gp", "operating_income": "oi", "net_income": "ni",
             "operating_cash_flow": "ocf", "capital_expenditure": "cx"}
    fields = []
    for concept, name in short.items():
        for result, digit in (("ttm0", "0"), ("ttm4", "4")):
            fields += [pick(concept, f"{result}.val", f"{name}{digit}"), pick(concept, f"{result}.ends", f"{name}{digit}_ends"),
                       pick(concept, f"{result}.last", f"{name}{digit}_last")]
    growth = trailing.withColumn("__acc", F.when(F.col("concept") == "revenue", revenue_acceleration()))
    wide = growth.groupBy(*keys).agg(*fields, F.max("__acc").alias("acceleration")).join(limits, keys)

    def fresh(name: str) -> Column:
        return F.when(F.datediff("as_of", f"{name}0_last") <= F.col("age_limit"), F.col(f"{name}0"))

    def aligned(name: str, ends: str) -> Column:
        return F.when(F.col(f"{name}_ends") == F.col(ends), F.col(name))

    first = wide.withColumns({
        "sales": fresh("rev"), "income": fresh("ni"), "cash_flow": fresh("ocf"),
        "gap": F.datediff("ocf0_last", "ocf4_last"),
        "aligned_sales": aligned("rev0", "ocf0_ends"),
    })
    second = first.withColumns({
        "margin": F.when(F.col("sales") > 0, aligned("gp0", "rev0_ends") / F.col("sales")),
        "fcf": F.col("cash_flow") - F.coalesce(aligned("cx0", "ocf0_ends"), F.lit(0.0)),
        "prior_fcf": F.when(F.col("cash_flow").isNotNull() & F.col("gap").between(330, 400),
                            F.col("ocf4") - F.coalesce(aligned("cx4", "ocf4_ends"), F.lit(0.0))),
        "same_window": F.coalesce((F.col("rev0_ends") == F.col("ocf0_ends")) & (F.col("sales") > 0), F.lit(False)),
    })
    third = second.withColumns({
        "prior_sales": F.when(F.col("prior_fcf").isNotNull(), aligned("rev4", "ocf4_ends")),
        "fcf_margin": F.when(F.col("aligned_sales") > 0, F.col("fcf") / F.col("aligned_sales")),
    })
    sales, fcf, prior_fcf, fcf_margin = F.col("sales"), F.col("fcf"), F.col("prior_fcf"), F.col("fcf_margin")
    both = prior_fcf.isNotNull() & (F.col("prior_sales") > 0) & fcf_margin.isNotNull()
    before = F.when(sales.isNotNull() & (F.col("rev4") > 0), F.col("rev4"))
    return third.select(
        *keys, "age_limit", sales.alias("pit_revenue_ttm"),
        F.when(sales.isNotNull(), F.datediff("as_of", "rev0_last").cast("double")).alias("pit_report_age_days"),
        (sales / before - 1.0).alias("pit_revenue_growth_ttm"),
        F.when(sales.isNotNull(), F.col("acceleration")).alias("pit_revenue_acceleration"),
        F.col("margin").alias("pit_gross_margin_ttm"),
        F.when(F.col("gp4_ends") == F.col("rev4_ends"), F.col("margin") - F.col("gp4") / before).alias("pit_gross_margin_change"),
        F.when(sales > 0, aligned("oi0", "rev0_ends") / sales).alias("pit_operating_margin_ttm"),
        F.col("income").alias("pit_net_income_ttm"), F.col("cash_flow").alias("pit_operating_cash_flow_ttm"),
        F.when(F.col("same_window"), F.col("cash_flow") / sales).alias("pit_ocf_margin_ttm"),
        fcf.alias("pit_free_cash_flow_ttm"),
        F.when(F.col("same_window"), fcf / sales).alias("pit_fcf_margin_ttm"),
        F.when((F.col("ni0_ends") == F.col("ocf0_ends")) & (F.col("ni0") > 0),
               F.col("cash_flow") / F.col("ni0")).alias("pit_cash_conversion"),
        prior_fcf.alias("pit_free_cash_flow_prior_ttm"),
        F.when(both, (fcf + prior_fcf) / (F.col("aligned_sales") + F.col("prior_sales"))).otherwise(fcf_margin)
        .alias("pit_fcf_margin_2y"),
        F.when(both, F.least(fcf_margin, prior_fcf / F.col("prior_sales"))).otherwise(fcf_margin).alias("pit_fcf_margin_low"),
        F.when(prior_fcf.isNotNull(), (fcf + prior_fcf) / 2.0).otherwise(fcf).alias("fcf_2y"),
        F.when(prior_fcf.isNotNull(), F.least(fcf, prior_fcf)).otherwise(fcf).alias("fcf_low"),
    )


def valuation_signals(signals: DataFrame) -> DataFrame:
    """Ratios to market cap. Needs pit_market_cap, pit_market_cap_basis and the money columns."""
    cap = F.col("pit_market_cap")
    return signals.withColumns({
        "pit_share_change_1y": F.when(
            F.coalesce(F.col("pit_market_cap_basis") != "reported_shares_unreconciled", F.lit(True)), F.col("pit_share_change_1y")),
        "pit_net_cash_to_market_cap": ratio("pit_net_cash", cap), "pit_fcf_yield": ratio("pit_free_cash_flow_ttm", cap),
        "pit_fcf_yield_2y": ratio("fcf_2y", cap), "pit_fcf_yield_low": ratio("fcf_low", cap),
        "pit_earnings_yield": ratio("pit_net_income_ttm", cap), "pit_sales_yield": ratio("pit_revenue_ttm", cap),
    }).drop("fcf_2y", "fcf_low")


def signals_as_of(grid: DataFrame, facts: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Every point-in-time signal per grid row (company, as_of, price, supplied_cap).

    ``facts`` are proxy-free and single-currency. ``splits``: ticker (=company), on, ratio.
    """
    from sightline.operators.prices import split_between, split_factor_after

    keys = ["company", "as_of"]
    dates = cut(grid.select(*keys).distinct())
    trailing = cut(trailing_years(dates, facts))
    limits = cut(dates.join(report_age_limit(trailing), keys, "left").withColumn(
        "age_limit", F.coalesce("age_limit", F.lit(RULES["maximum_age"]))))
    statements = statement_signals(trailing, limits).drop("age_limit")
    instants = instant_facts(facts)
    single = best_tag(instants.where(F.col("concept").isin("cash", "shares_outstanding")), [*KEY, "end_d"])
    versions = cut(known_versions(single, [*KEY, "end_d"], sequence="seq"))
    cash = instant_as_of(dates, versions.where(F.col("concept") == "cash"), prefix="c_").drop("concept").join(limits, keys)
    cash = cut(cash.where(F.datediff("as_of", "c_end") <= F.col("age_limit")).select(
        *keys, F.col("c_end").alias("balance_end"), F.col("c_val").alias("pit_cash")))
    debt = total_debt(debt_components(cash, instants))
    balance = cash.join(debt, [*keys, "balance_end"], "left").select(
        *keys, "pit_cash", F.coalesce("total_debt", F.lit(0.0)).alias("pit_total_debt"),
        F.coalesce("debt_coverage", F.lit("none_found")).alias("pit_debt_coverage"),
    ).withColumn("pit_net_cash", F.col("pit_cash") - F.col("pit_total_debt"))
    period_versions = versions.where(F.col("concept") == "shares_outstanding")
    average_versions = cut(known_versions(weighted_shares(facts), [*KEY, "end_d"], sequence="seq"))
    counted = share_counts(limits, period_versions, average_versions).where(F.col("shares").isNotNull())
    counted = counted.withColumns({"s_end": F.col("shares.end"), "s_filed": F.col("shares.filed")}).withColumn(
        "cap_end", F.date_sub("s_end", 350))
    counted = cut(counted)
    year_ago = share_counts(
        counted.select(*keys, "cap_end", "age_limit", F.col("shares_basis").alias("b")),
        period_versions, average_versions, cap="cap_end", basis="b",
    ).select(*keys, F.col("shares.end").alias("y_end"), F.col("shares.val").alias("y_val"))
    both = counted.join(year_ago, keys, "left")
    if splits is not None:
        both = both.withColumnRenamed("company", "ticker")
        both = split_factor_after(both, splits, "s_end", "pit_split_factor")
        both = split_factor_after(both, splits, "y_end", "__y_factor")
        both = split_between(both, splits, "s_end", "s_filed", "pit_split_ambiguous").withColumnRenamed("ticker", "company")
    else:
        both = both.withColumns({"pit_split_factor": F.lit(1.0), "__y_factor": F.lit(1.0), "pit_split_ambiguous": F.lit(False)})
    adjusted = F.col("shares.val") * F.col("pit_split_factor")
    recent = (F.col("y_val") > 0) & (F.datediff("s_end", "y_end") <= F.col("age_limit") + 30)
    shares = both.select(
        *keys, adjusted.alias("pit_shares_outstanding"), F.col("shares_basis").alias("pit_shares_basis"),
        "pit_split_factor", "pit_split_ambiguous",
        F.when(recent, adjusted / (F.col("y_val") * F.col("__y_factor")) - 1.0).alias("pit_share_change_1y"),
    )
    joined = grid.join(statements, keys, "left").join(balance, keys, "left").join(shares, keys, "left")
    cap, basis = reconciled_market_cap(F.col("pit_shares_outstanding"), F.col("price"), F.col("supplied_cap"))
    return valuation_signals(joined.withColumns({"pit_market_cap": cap, "pit_market_cap_basis": basis}))
