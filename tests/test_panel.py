"""Insider signals by owners, and the whole panel with sources that are missing, repeated or late."""

import datetime

import pytest
from pyspark.sql import functions as F

from sightline.operators import insiders
from sightline.plans import panel

DAY = datetime.date


def test_signals_by_owner(spark):
    tx = [("1", DAY(2025, 5, 1), "purchase", 10.0, 100.0, ["a", "b"], True), ("1", DAY(2025, 5, 1), "purchase", 10.0, None, ["a"], False),
          ("1", DAY(2025, 4, 1), "purchase", 1.0, 3.0, ["c", "c"], None), ("1", DAY(2025, 5, 20), "sale", 2.0, 40.0, None, True), ("1", DAY(2025, 5, 20), "award", 2.0, 40.0, ["z"], True),
          ("1", DAY(2025, 6, 2), "purchase", 5.0, 50.0, ["d"], True), ("1", None, "purchase", 5.0, 50.0, ["d"], True), ("1", DAY(2025, 5, 2), "purchase", float("nan"), 50.0, ["e"], True)]
    frame = spark.createDataFrame(tx, "issuer string, filed date, kind string, shares double, value double, owners array<string>, officer boolean")
    grid = spark.createDataFrame([("1", DAY(2025, 6, 1), 1000.0), ("1", DAY(2025, 6, 1), 1000.0), ("2", DAY(2025, 6, 1), 1.0), ("1", DAY(2027, 6, 1), None)], "issuer string, as_of date, market_cap double")
    found = insiders.signals_as_of(grid, frame, data_through="2025-06-30").collect()
    assert len(found) == 4
    row = next(r for r in found if r.issuer == "1" and r.as_of == DAY(2025, 6, 1))
    assert (row.ins_purchase_count_short, row.ins_sale_count_short, row.ins_distinct_buyers_short, row.ins_officer_purchase_count_short) == (3.0, 1.0, 3.0, 1.0)
    assert (row.ins_purchase_value_short, row.ins_net_value_short, row.ins_net_value_to_market_cap_short, row.ins_cluster_buy_short) == (103.0, 63.0, 0.063, 1.0)
    assert (row.ins_days_since_last_purchase, row.ins_data_through) == (31.0, DAY(2025, 6, 30))
    assert all(r.ins_purchase_count_short is None for r in found if r.issuer == "2" or r.as_of == DAY(2027, 6, 1))
    least = insiders.signals_as_of(grid.limit(1), frame, minimum_value=50.0).collect()[0]
    assert (least.ins_purchase_count_short, least.ins_distinct_buyers_short, least.ins_sale_count_short) == (2.0, 2.0, 0.0)
    assert insiders.signals_as_of(grid, frame.limit(0)).where("ins_purchase_count_long is not null").count() == 0


@pytest.fixture(scope="module")
def sources(spark):
    days = spark.range(330).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), "id")
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    bars = names.crossJoin(days).select("ticker", "d", (10 + F.col("id") / 100 + F.when(F.col("ticker") == "B", F.col("id") % 3).otherwise(0)).alias("close"), F.lit(5000.0).alias("volume"))
    bench = days.select(F.lit(1).alias("benchmark"), "d", (100 + F.col("id") / 50).alias("close"))
    listing = spark.createDataFrame([("A", 1, "s", 1e6, 7, "i1", True), ("B", 1, None, 3e8, 8, "i2", False), ("C", 1, "s", 2e8, None, None, True)],
                                    "ticker string, benchmark int, sector string, market_cap double, company long, issuer string, same_currency boolean")
    shares = [(company, "shares_outstanding", None, DAY(2020, 6, 30), filed, val, 0, seq) for company in (7, 8) for filed, val, seq in ((DAY(2020, 7, 15), 1e7, 1), (DAY(2020, 11, 10), 2e7, 2))]
    facts = spark.createDataFrame(shares, "company long, concept string, start_d date, end_d date, filed date, val double, priority int, seq long")
    tx = spark.createDataFrame([("i1", DAY(2020, 9, 1), "purchase", 1.0, 10.0, ["x"], True)], "issuer string, filed date, kind string, shares double, value double, owners array<string>, officer boolean")
    return bars, bench, listing, facts, tx


def test_panel_knows_only_what_was_filed(spark, sources):
    rows = {(r.ticker, r.period): r for r in panel.full_observations(*sources, settings={"band": (1e7, 1e9)}).collect()}
    assert sorted({ticker for ticker, _ in rows}) == ["A", "B", "C"] and max(period for _, period in rows) == "2020-10"
    first = rows["A", "2020-10"]
    assert first.pit_shares_outstanding == 1e7  # the restated count is filed later
    assert first.pit_market_cap == pytest.approx(1e7 * first.start_close) and first.pit_cash is None and first.pit_revenue_ttm is None
    # Twice the shares at the last bar are off from today's cap by more than the tolerance, on every date.
    assert first.universe_cap_basis == "filed_shares_unit_corrected" and first.gate == "outside_band"
    other = rows["B", "2020-10"]  # reports in another currency: no price, so no cap of its own
    assert other.pit_shares_outstanding == 1e7 and other.pit_market_cap is None and other.universe_cap_basis == "price_scaled_approximation"
    assert other.gate == "inside_band" and other.ins_purchase_count_long is None
    none = rows["C", "2020-10"]
    assert none.pit_shares_outstanding is None and none.gate == "inside_band"
    assert first.ins_purchase_count_long == 1.0 and first.ins_net_value_to_market_cap_long == pytest.approx(10 / first.pit_market_cap, abs=1e-6)
    assert rows["A", "2020-08"].ins_purchase_count_long == 0.0  # before the filing


def test_panel_without_filings_and_models(spark, sources):
    bars, bench, listing, facts, tx = sources
    whole = panel.full_observations(bars, bench, listing, facts.limit(0), tx.limit(0), settings={"band": (1.0, 1e12), "liquidity_floor": 1e3})
    scored = panel.all_models(whole).collect()
    assert len(scored) == whole.count() > 0 and all(r.pit_market_cap is None and r.ins_purchase_count_long is None for r in scored)
    assert all(r.score_v3 is None and r.score_v3_challenger is None and not r.score_v3_excluded for r in scored)  # too few signals
    assert any(r.score_v2 is not None for r in scored)
    dry = panel.full_observations(bars, bench, listing, facts.limit(0), tx.limit(0), settings={"liquidity_floor": 1e9})
    assert {r.gate for r in dry.collect()} == {"below_liquidity_floor"}
    assert panel.full_observations(bars.limit(0), bench, listing, facts, tx).count() == 0
