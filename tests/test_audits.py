"""Survivorship bounds, rescoring, frozen scores, evidence and review checks on literal rows."""

import pytest
from pyspark.sql import functions as F

from sightline import config as C
from sightline.operators import review
from sightline.plans import comparison, rescore, survivorship
from sightline.sources import documents

MODEL = {**C.MODEL_V3, "sector_exclusions": {}, "signals": {"pit_sales_yield": (1.0, "higher")}, "exclusions": (("pit_share_change_1y", None, 80.0, "Dilution"),)}


def observed(spark, rows):
    return spark.createDataFrame(rows, "period string, ticker string, score_v3 double, score_v3_excluded boolean, return_1M double, benchmark_return_1M double, pit_sales_yield double, pit_share_change_1y double")


def test_survivorship_bounds(spark):
    live = observed(spark, [(p, t, s, x, r, 1.0, 0.1, float(i)) for p in ("2020-01", "2020-02", "2022-01") for i, (t, s, x, r) in enumerate(
        [("A", 50.0, False, 10.0), ("B", 60.0, None, 20.0), ("C", None, False, -10.0), ("D", 70.0, True, 0.0)])]
        + [("2020-01", "E", 1.0, False, None, 1.0, 0.1, 1.0), ("2020-03", "A", 50.0, False, 99.0, 1.0, 0.1, 1.0)])
    dead = spark.createDataFrame([("2020-01", "X", "bankruptcy", 5.0, 5.0, 0.1, 2.0), ("2020-02", "X", "bankruptcy", 5.0, 5.0, 0.1, 2.0), ("2020-02", "A", "acquired", None, 5.0, 0.1, 0.0),
                                  ("2022-01", "X", "bankruptcy", 5.0, 5.0, 0.1, 99.0), ("2020-03", "Y", "other", 5.0, 5.0, 0.1, 1.0)],
                                 "period string, ticker string, exit_type string, pit_revenue_ttm double, pit_cash double, pit_sales_yield double, pit_share_change_1y double")
    windows = {"first": ("2016-01", "2021-12"), "second": ("2022-01", "2026-12")}
    panel = survivorship.survivorship_panel(live, dead, MODEL, windows, 3, 1)
    gone = {(r.period, r.ticker): r.group for r in panel.where("exit_type is not null").collect()}
    # A vanished name may share its ticker with a listed one; 2020-03 has too few rows; a late dilution is filtered.
    assert gone == {("2020-01", "X"): "scored", ("2020-02", "X"): "scored", ("2020-02", "A"): "never_scored", ("2022-01", "X"): "filter_excluded"}
    found = {(r.scenario, r.window, r.group): (r.months, r.compounded_percent) for r in survivorship.compounded_bounds(panel).collect()}
    assert found["observed", "first", "scored"] == (2, pytest.approx((1.15**2 - 1) * 100))
    assert found["observed", "first", "universe"] == (2, pytest.approx((1.05**2 - 1) * 100))
    monthly = (0.05**0.5 - 1) * 100  # the central loss of a bankruptcy over the two months of the window
    assert found["central", "first", "scored"] == (2, pytest.approx(((1 + (30 + monthly) / 300) ** 2 - 1) * 100))
    assert found["severe", "second", "filter_excluded"] == (1, pytest.approx((0.0 - 99.9) / 2))
    assert found["mild", "first", "never_scored"][1] == pytest.approx((0.9 * (1 + (-10 + 20) / 200) - 1) * 100)
    counts = {(r.window, r.group): (r.observed_per_month, r.dead_per_month, r.dead_share_percent) for r in survivorship.group_counts(panel).collect()}
    assert counts["first", "scored"] == (2.0, 1.0, 33.33)
    none = survivorship.survivorship_panel(live, dead.limit(0), MODEL, windows, 3, 1)
    bounds = {(r.scenario, r.window, r.group): r.compounded_percent for r in survivorship.compounded_bounds(none).collect()}
    assert all(value == pytest.approx(bounds["observed", window, group]) for (_, window, group), value in bounds.items())
    assert survivorship.compounded_bounds(survivorship.survivorship_panel(live.limit(0), dead, MODEL, windows, 3, 1)).count() == 0


RUN = "run int, ticker string, country string, status string, discovery_score double, latest_close double, v2_momentum_long double, pit_cash double, sector string"


def test_rescoring_fills_refreshes_and_clears(spark):
    run = spark.createDataFrame([(1, "fill", "US", "OK", 1.0, 5.0, 0.1, None, "s"), (1, "keep", "us", "OK", 2.0, 5.0, 0.1, 3.0, "s"), (1, "gone", "US", "OK", 3.0, None, None, 4.0, "s"),
                                 (1, "none", "US", "OK", 4.0, None, None, None, None), (1, "canada", "CA", "OK", 5.0, None, 0.2, None, "s"), (1, "bad", "US", "FILTERED", None, None, None, None, "s"), (1, "null", None, None, None, None, None, None, None)], RUN)
    facts = spark.createDataFrame([(t, 9.0) for t in ("fill", "keep", "canada", "bad")], "ticker string, pit_cash double")
    insiders = spark.createDataFrame([("fill", 2.0), ("bad", 2.0)], "ticker string, ins_net_count_short double")
    prices = spark.createDataFrame([("gone", 7.0, 0.7), ("canada", 8.0, 0.8), ("none", None, 0.3), ("fill", 1.0, 0.9)], "ticker string, latest_close double, v2_momentum_long double")
    seen = lambda rows: {r.ticker: (r.pit_cash, r.outcome, r.latest_close, r.v2_momentum_long, r.ins_net_count_short, r.insiders_status) for r in rows.collect()}
    plain = rescore.merged_signals(run, facts, insiders, prices)
    assert seen(plain) == {
        "fill": (9.0, "fundamentals_filled", 5.0, 0.1, 2.0, "rescored"), "keep": (3.0, "fundamentals_kept", 5.0, 0.1, None, "no_data"), "gone": (4.0, "fundamentals_kept", 7.0, 0.7, None, "no_data"),
        "none": (None, "fundamentals_unavailable", None, None, None, "no_data"), "canada": (None, "not_applicable", 8.0, 0.8, None, None),
        "bad": (None, "not_scored", None, None, None, None), "null": (None, "not_scored", None, None, None, None)}
    fresh = rescore.merged_signals(run, facts, insiders, prices, refresh=True)
    assert {t: v[:2] for t, v in seen(fresh).items() if t in ("keep", "gone")} == {"keep": (9.0, "fundamentals_filled"), "gone": (None, "fundamentals_cleared")}
    columns = [name for name in fresh.columns if name not in ("outcome", "prices_repaired")]
    again = rescore.merged_signals(fresh, facts, insiders, prices, refresh=True).select(*columns)
    assert again.exceptAll(fresh.select(*columns)).isEmpty() and fresh.select(*columns).exceptAll(again).isEmpty()
    scored = rescore.rescored(run, fresh, ["run"])
    assert scored.count() == 7 and {r.ticker for r in scored.where("score_v2 is not null").collect()} == {"fill", "keep", "gone", "canada"}
    for wrong in (fresh.withColumn("discovery_score", F.lit(0.0)), fresh.limit(3), fresh.union(fresh)):
        with pytest.raises(ValueError):
            rescore.rescored(run, wrong, ["run"])
    assert rescore.merged_signals(run.limit(0), facts, insiders).count() == 0


def test_frozen_scores_and_comparison(spark):
    rows = spark.createDataFrame([(i, float(i), float(-i) if i % 2 else None, i, 1.0, float("nan")) for i in range(10)], "id int, score_a double, score_b double, score_a_rank int, score_b_confidence double, score_c double")
    assert comparison.score_columns(rows) == ["score_a", "score_b", "score_c"]
    scores = comparison.frozen_scores(rows, ["id"]).withColumn("label", F.lit(None).cast("string"))
    assert scores.groupBy("model").count().count() == 2
    outcomes = spark.createDataFrame([(i, None, float(i) if i != 9 else None) for i in range(10)], "id int, label string, excess double").select("id", "excess", "label")
    found = {(r.scope, r.model): (r.resolved, r.ic) for r in comparison.model_comparison(scores.drop("label"), outcomes.drop("label"), [], "id", 4).collect()}
    assert found == {("own", "score_a"): (9, pytest.approx(1.0)), ("own", "score_b"): (4, pytest.approx(-1.0)), ("common", "score_a"): (4, pytest.approx(1.0)), ("common", "score_b"): (4, pytest.approx(-1.0))}
    assert comparison.frozen_scores(rows.select("id"), ["id"]).count() == 0


def test_evidence_documents(spark):
    good = ("https://a.example.com/x", "t", "p", "company_ir", "f" * 64, "2026-01-01", "2026-01-02T00:00:00Z")
    rows = [good, ("http://a.example.com", *good[1:]), ("https://notexample.com/", *good[1:]), (None,) * 7, (*good[:5], "2020-01-01", "x"), (*good[:5], "soon", good[6])]
    found = [r.errors for r in documents.document_errors(spark.createDataFrame(
        rows, "url string, title string, publisher string, source_type string, content_hash string, published_at string, retrieved_at string").coalesce(1), ["example.com"], "2026-06-01").collect()]
    assert found[0] == [] and found[1] == ["Evidence URLs must use HTTPS."] and found[2] == ["Evidence domain is not allowed"] and len(found[3]) == 7
    assert found[4] == ["source is stale", "retrieved_at must be ISO-8601"] and found[5] == ["published_at must be YYYY-MM-DD"]


def a_review(**changes):
    base = {"ticker": "A", "verdict": "clear", "deciding_reason": "sound", "bear_case": "weak", "unanswered_questions": [], "evidence_through": "2026-01-01", "written_by": None,
            "data_check": [{"field": "cash", "ours": "1000000.5", "agrees": True, "cited": True, "sha256": None, "quote": "net  sales were\n12"}],
            "findings": [{"area": "business", "severity": "info", "text": "said", "sha256": None, "quote": "net sales were 12"}],
            "peer_comparison": {"discount_explained": "yes", "text": "t", "metrics_cited": ["margin"]}}
    return {**base, **changes}


def test_reviews_against_their_evidence(spark):
    import hashlib

    text = "The net sales were 12 in the year. net sales were 12 again"
    sha = hashlib.sha256(text.encode()).hexdigest()
    item = lambda **changes: [{**a_review()["findings"][0], "sha256": sha, **changes}]
    figure = lambda **changes: [{**a_review()["data_check"][0], "sha256": sha, **changes}]
    fine = {"data_check": figure(), "findings": item()}
    cases = {
        "A": ({}, []), "B": ({"verdict": "avoid"}, ["verdict avoid needs a serious finding or a disagreement"]), "C": ({"verdict": "avoid", "findings": item(severity="serious")}, []),
        "D": ({"verdict": "not_reviewed", "bear_case": None}, ["only preparation may mark a name not_reviewed"]),
        "E": ({"verdict": None, "deciding_reason": None, "bear_case": None, "unanswered_questions": None, "evidence_through": None, "data_check": None, "findings": None, "peer_comparison": None},
              ["verdict is not in the schema", "deciding_reason is empty", "unanswered_questions must be a list", "evidence_through is not a date", "data_check must be a list", "findings must be a list", "peer_comparison is missing"]),
        "F": ({"findings": item(quote="too short"[:5])}, ["findings: quote is too short"]), "G": ({"findings": item(sha256="0" * 64)}, ["findings: cites a hash that is not one of this name's documents"]),
        "H": ({"data_check": figure(ours="1000001.4")}, []), "I": ({"data_check": figure(ours="1000003")}, ["data_check: cash is not the packet's figure"]),
        "J": ({"data_check": figure(field="magic", agrees=None)}, ["data_check[0]: agrees must be true or false", "data_check: magic is not a figure of the packet"]),
        "K": ({"findings": item(text="Upside of 30 %")}, ["findings[0]: text contains forbidden content"]), "L": ({"peer_comparison": {"discount_explained": "no", "text": "t", "metrics_cited": ["odd", "margin"]}}, ["peer_comparison: odd is not a metric of the peer table"]),
        "M": ({"peer_comparison": {"discount_explained": "no", "text": "t", "metrics_cited": []}, "evidence_through": "2026-03-01"}, ["evidence_through is after the anchor date", "peer_comparison must cite the metrics it used"]),
        "N": ({}, ["data_check: cites a hash that is not one of this name's documents", "findings: cites a hash that is not one of this name's documents", "peer_comparison: the peer table has too few peers"]),
    }
    reviews = spark.createDataFrame([a_review(**{**fine, **changes, "ticker": ticker}) for ticker, (changes, _) in cases.items()], review.SCHEMA)
    saved = spark.createDataFrame([(t, sha, text if t != "N" else text + "!") for t in cases for _ in range(2)], "ticker string, sha256 string, text string")
    packet = spark.createDataFrame([(t, "cash", "1000000.5") for t in cases], "ticker string, field string, value string")
    peers = spark.createDataFrame([(t, "ok", ["margin"]) for t in cases if t != "N"] + [("N", "few", ["margin"])], "ticker string, status string, metrics array<string>")
    checked = review.check_reviews(reviews, saved, packet, peers, "2026-01-31")
    assert {r.ticker: r.errors for r in checked.collect()} == {t: errors for t, (_, errors) in cases.items()}
    counts = {(r.review_status, r.verdict): r.reviews for r in review.review_counts(checked).collect()}
    assert counts == {("valid", "clear"): 2, ("valid", "avoid"): 1, ("validation_failed", None): len(cases) - 3}
    assert review.check_reviews(reviews.limit(0), saved, packet, peers, "2026-01-31").count() == 0


def test_stable_ids(spark):
    rows = spark.createDataFrame([(1, 2.0, 'a"b', None), (1, 2.0000001, 'a"b', None), (1, 3.0, 'a"b', None)], "i int, x double, s string, d date").coalesce(1)
    ids = [tuple(r) for r in rows.select(review.stable_id({"i": F.col("i"), "x": F.col("x"), "s": F.col("s"), "d": F.col("d")}), review.stable_id({"s": F.col("s"), "d": F.col("d"), "x": F.col("x"), "i": F.col("i")})).collect()]
    assert all(a == b and len(a) == 16 for a, b in ids) and ids[0] == ids[1] != ids[2]
