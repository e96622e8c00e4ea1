"""Filed facts with hand-computed answers."""

from datetime import date

from pyspark.sql import functions as F

from sightline.operators import fundamentals as fx

SCHEMA = "company int, concept string, start_d date, end_d date, filed date, val double, priority int, seq bigint"


def facts(spark):
    d = date
    rows = [
        # 2024: three quarters as year-to-date figures, then the year: Q4 = 470 - 330.
        (d(2024, 1, 1), d(2024, 3, 31), d(2024, 5, 1), 100.0), (d(2024, 1, 1), d(2024, 6, 30), d(2024, 8, 1), 210.0),
        (d(2024, 1, 1), d(2024, 9, 30), d(2024, 11, 1), 330.0), (d(2024, 1, 1), d(2024, 12, 31), d(2025, 3, 1), 470.0),
        # 2025: three single quarters, then the year; the second is restated from 150 to 160.
        (d(2025, 1, 1), d(2025, 3, 31), d(2025, 5, 1), 140.0), (d(2025, 4, 1), d(2025, 6, 30), d(2025, 8, 1), 150.0),
        (d(2025, 4, 1), d(2025, 6, 30), d(2025, 10, 1), 160.0), (d(2025, 7, 1), d(2025, 9, 30), d(2025, 11, 1), 150.0),
        (d(2025, 1, 1), d(2025, 12, 31), d(2026, 3, 1), 640.0),
    ]
    return spark.createDataFrame([(1, "revenue", s, e, f, v, 0, i) for i, (s, e, f, v) in enumerate(rows)], SCHEMA)


def test_derived_quarters(spark):
    found = {(r.end_d, r.filed): r.val for r in fx.quarterly_values(fx.duration_facts(facts(spark))).collect()}
    assert found[(date(2024, 6, 30), date(2024, 8, 1))] == 110.0
    assert found[(date(2024, 12, 31), date(2025, 3, 1))] == 140.0
    assert found[(date(2025, 12, 31), date(2026, 3, 1))] == 640.0 - 140.0 - 160.0 - 150.0


def test_no_look_ahead_and_restatement(spark):
    grid = spark.createDataFrame([(1, date(2025, 9, 1)), (1, date(2025, 10, 2)), (1, date(2024, 12, 31))], "company int, as_of date")
    found = {r.as_of: r.ttm0 for r in fx.trailing_years(grid, facts(spark)).collect()}
    assert found[date(2024, 12, 31)] is None
    assert found[date(2025, 9, 1)].val == 120.0 + 140.0 + 140.0 + 150.0
    assert found[date(2025, 10, 2)].val == 120.0 + 140.0 + 140.0 + 160.0


def test_market_cap_needs_a_price_and_reconciles(spark):
    frame = spark.createDataFrame([(10.0, 5.0, 60.0), (10.0, 5.0, 200.0), (10.0, None, 60.0), (10.0, 5.0, None)],
                                  "shares double, price double, supplied double")
    cap, basis = fx.reconciled_market_cap(F.col("shares"), F.col("price"), F.col("supplied"))
    assert [(r[0], r[1]) for r in frame.select(cap, basis).collect()] == [
        (50.0, "reported_shares"), (200.0, "reported_shares_unreconciled"), (None, None), (50.0, "reported_shares")]


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    for values in ([1e15, 0.07, -1e15], [0.07, 1e15, -1e15], [1e15, -1e15, 0.07, None]):
        rows = spark.createDataFrame([(v,) for v in values], "val double").coalesce(1)
        assert rows.agg(fx.exact_sum("val")).first()[0] == 0.07
    assert spark.createDataFrame([(1e30,), (1e30,)], "val double").agg(fx.exact_sum("val")).first()[0] == 2e30
