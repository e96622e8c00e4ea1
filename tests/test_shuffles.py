"""How often bars are shuffled and sorted, and what a query works out, read from its plan."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sightline import config as C
from sightline.catalog import views
from sightline.catalog.views import Views
from sightline.functions import ranking
from sightline.operators import prices
from sightline.plans import backtest, studies
from sightline.session import cut

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w03_annualized_volatility", "w04_volume_trend", "w07_period_return", "s04_drop_incomplete_bars"])
def test_bars_are_shuffled_once(spark, name):
    assert plan(entry.queries()[name](spark, FOLDER)).count("Exchange") == 1


@pytest.mark.parametrize("name", ["w03_annualized_volatility", "x01_volume_acceleration", "x02_relative_strength", "x03_trend_points"])
def test_only_the_signals_asked_for_are_worked_out(spark, name):
    # The sliding maximum of 240 closes belongs to none of them.
    assert "max(" not in plan(entry.queries()[name](spark, FOLDER))


def test_bars_equal_the_daily_prices(spark):
    v = Views(spark, FOLDER)
    assert sorted(map(tuple, v.bars.collect())) == sorted(map(tuple, v.px.collect()))


def test_more_trades_take_more_tasks(spark, monkeypatch):
    v = Views(spark, FOLDER)
    trades = v.table("lineitem").count()
    monkeypatch.setattr(views, "TASK_TRADES", 500)
    assert v.bars.rdd.getNumPartitions() == -(-trades // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, v.bars.collect())) == sorted(map(tuple, v.px.collect()))


def test_splits_of_dropped_bars_multiply_into_the_next_complete_one(spark):
    rows = [("A", 1, None, 2.0), ("A", 2, 5.0, 3.0), ("A", 3, -1.0, 0.5), ("A", 4, float("nan"), 0.0), ("A", 5, 6.0, None),
            ("A", 6, None, 4.0), ("A", 7, 0.0, 2.0), ("B", 1, None, 2.0), ("C", 1, 1.0, None)]
    frame = spark.createDataFrame(rows, "ticker string, d int, close double, split double").repartition(3)
    dropped = prices.drop_incomplete_bars(frame)
    assert sorted(map(tuple, dropped.collect())) == [("A", 2, 5.0, 6.0), ("A", 5, 6.0, 4.0), ("C", 1, 1.0, 0.0)]
    assert "Join" not in plan(dropped)


def test_observations_shuffle_the_trades_once(spark):
    v = Views(spark, FOLDER)
    text = plan(backtest.observations(v.bars, v.bench, v.listing))
    # One exchange of the trades, one of the listing; the windows, months and closes need none.
    assert text.count("hashpartitioning(ticker") + text.count("hashpartitioning(l_suppkey") == 2 and text.count("REPARTITION_BY_COL") == 1


def test_a_high_of_short_windows_equals_the_whole_window(spark):
    closes = [None if i % 13 == 4 else float("nan") if i % 17 == 5 else float(i * 37 % 101) for i in range(90)]
    frame = spark.createDataFrame([("A", i, c, 1.0) for i, c in enumerate(closes)], "ticker string, d int, close double, volume double")
    for size in (5, 16, 20, 37):
        found = prices.price_features(frame, settings={"high_window": size, "minimum_price_history_days": 1}).orderBy("d").collect()
        for i, row in enumerate(found):
            known = [c for c in closes[max(i - size + 1, 0):i + 1] if c is not None and c == c]
            own = closes[i] if closes[i] is not None and closes[i] == closes[i] else None
            expected = None if i + 1 < size or own is None or max(known) <= 0 else round(own / max(known), 6)
            assert row.v2_high_proximity == expected, (size, i)


def test_sessions_meet_their_benchmark_where_they_are(spark):
    text = plan(entry.queries()["x02_relative_strength"](spark, FOLDER))
    # One exchange of the trades, one of the listing.
    assert "hashpartitioning(benchmark" not in text and text.count("hashpartitioning") == 2


SHARED = ["a06_information_coefficient", "a15_top_summary", "a22_screen_ic_series", "a26_within_correlation", "x32_screen_groups"]


@pytest.mark.parametrize("name", SHARED)
def test_scored_observations_are_shuffled_by_period_once(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    # Stored rows are dealt by period; after that only sums of periods move, no join, no second scan.
    assert text.count("FileScan") == 1 and "Join" not in text and text.count("REPARTITION_BY_NUM") == 1
    assert text.count("Exchange") <= 2


def test_large_periods_take_ladders_and_give_the_same(spark, monkeypatch):
    signals = {"v2_momentum_long": (30.0, "higher"), "v2_volatility": (15.0, "lower")}
    model = {**C.MODEL_V2, "signals": signals, "minimum_group": 5, "exclusions": (("v2_volatility", None, 80.0, "high"),)}
    columns = ["score_v2", "v2_volatility"]
    pick = random.Random(5)
    value = lambda: pick.choice([None, float("nan"), 0.0, -0.0, 1.5, pick.uniform(-9, 9)])
    rows = [(f"2020-0{1 + i % 3}", i, pick.choice([None, "", "a", "b"]), *[value() for _ in range(4)]) for i in range(150) if i % 3 or i < 40]
    names = [*model["signals"], "excess_1M", "relative_strength_6m"]
    frame = cut(spark.createDataFrame(rows, "period string, ticker int, sector string, " + ", ".join(f"{n} double" for n in names)).withColumns(
        {"return_1M": F.col("excess_1M"), "benchmark_return_1M": F.lit(1.0)}))

    def results():
        def of(plan):
            def scored(part, dealt):
                found = backtest.scored_observations(part, (model,), dealt)
                return plan(found if dealt else cut(found), dealt)
            return sorted(map(repr, ranking.in_groups(frame, ["period"], scored).collect()))

        def long(part, keep=()):
            return backtest.outcomes(part, columns, ["1M"], keep=keep)

        return [
            of(lambda part, dealt: studies.label_groups(part, "score_v2", dealt).select("period", "ticker", "score_v2", "score_v2_confidence",
                                                                                       "score_v2_exclusion_reasons", "quintile", "group")),
            of(lambda part, dealt: backtest.information_coefficients(long(part), 5, dealt).withColumn("ic", F.round("ic", 9))),
            of(lambda part, dealt: studies.signal_series(long(part), 5, dealt).select("period", "horizon", "column", "coverage", F.round("ic", 9))),
            of(lambda part, dealt: backtest.ranked_outcomes(backtest.wide_enough(long(part, ["relative_strength_6m"]), 30, dealt), dealt).select(
                "period", "horizon", "column", "ticker", "position", "members")),
            of(lambda part, dealt: studies.within_periods(part, [("v2_volatility", "excess_1M")], 5, dealt).withColumn("ic", F.round("ic", 9))),
        ]

    whole = results()
    assert all(whole) and len({row.period for row in frame.select("period").collect()}) == 3
    monkeypatch.setattr(ranking, "DEALT", 45)  # two periods have 50 tickers, one has 14
    assert results() == whole
