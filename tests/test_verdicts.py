"""Cohort outcomes by verdict on literal rows: nulls, ties, repeats, empty tables."""

from sightline.plans import verdicts


def test_outcomes_by_verdict(spark):
    resolved = spark.createDataFrame([("1M", t, s, x) for t, s, x in [
        ("A", "resolved", 4.0), ("B", "resolved", 2.0), ("C", "resolved", -6.0), ("D", "resolved", float("nan")), ("E", "pending", None), ("F", "resolved", 1.0), ("G", "resolved", 9.0), ("X", "resolved", 50.0)]],
        "horizon string, ticker string, status string, excess_return_percent double")
    reviews = spark.createDataFrame([("A", "clear", "done", 1.0, "no"), ("A", "clear", "done", 1.0, "no"), ("B", "caution", "done", 1.0, "yes"), ("C", "avoid", "done", 3.0, None), ("D", "clear", "done", 1.0, "no"),
                                     ("E", "avoid", "done", 1.0, "no"), ("F", None, "not_reviewed", 2.0, None), ("G", None, None, None, "yes"), ("Z", "avoid", "done", None, None), (None, "avoid", None, None, None)],
                                    "ticker string, verdict string, status string, defensive double, discount string")
    rows = verdicts.reviewed_outcomes(resolved, reviews)
    assert sorted(r.ticker for r in rows.collect()) == ["A", "B", "C", "F", "G"]
    assert [r.ticker for r in verdicts.outside_cohort(reviews, resolved).collect()] == ["Z"]
    found = {r.group: (r.resolved, r.median_excess_percent, r.win_rate_percent) for r in verdicts.verdict_outcomes(rows).collect()}
    assert found == {"clear": (1, 4.0, 100.0), "caution": (1, 2.0, 100.0), "avoid": (1, -6.0, 0.0), "not_reviewed": (1, 1.0, 100.0), "flagged": (2, -2.0, 50.0), "rest": (2, 3.0, 100.0),
                     "unexplained": (1, 4.0, 100.0), "explained": (2, 5.5, 100.0)}
    assert verdicts.verdict_spreads(rows).first()[1:] == (9.0, 6.0, -1.5)
    # A and B tie in the score and fall to the ticker; a third without an avoided name has no spread.
    assert sorted(tuple(r) for r in verdicts.defensive_thirds(rows).collect()) == [("1M", 1, 1, None), ("1M", 2, 1, None), ("1M", 3, 1, None)]
    assert verdicts.defensive_thirds(rows.where("ticker <> 'A'")).count() == 0
    assert verdicts.verdict_outcomes(rows.limit(0)).count() == verdicts.verdict_spreads(rows.limit(0)).count() == 0


def test_screen_orders_are_measured_on_the_same_names(spark):
    rows = spark.createDataFrame([("1M", f"T{i}", "passes", float(i), float(-i), float(i)) for i in range(7)] + [("1M", "N", "passes", None, 1.0, 1.0), ("1M", "F", "fails", 1.0, 1.0, 1.0), ("1M", "Q", "passes", 1.0, 1.0, float("nan")),
                                 ("3M", "A", "passes", 1.0, 1.0, 1.0)], "horizon string, ticker string, screen_status string, score_defensive double, score_v3 double, excess double")
    kept = verdicts.screened(rows)
    assert sorted(tuple(r) for r in verdicts.screen_correlations(kept, 5).collect()) == [("1M", 7, 1.0, -1.0, 2.0), ("3M", 1, None, None, None)]
    assert sorted(tuple(r) for r in verdicts.screen_terciles(kept, 5).collect()) == [("1M", 1, 3, 1.0, 66.67), ("1M", 2, 2, 3.5, 100.0), ("1M", 3, 2, 5.5, 100.0)]
    assert verdicts.screen_terciles(kept.limit(0), 5).count() == 0
