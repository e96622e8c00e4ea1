"""Null groups, values that are no numbers, bad closes, first rows, nearest names and visible text."""

import math
import statistics

from pyspark.sql import functions as F

from sightline.functions import ranking, stats
from sightline.llm import variants
from sightline.operators import coverage, floats, peers, price_report, prices
from sightline.sources import pages, universe

NAN, INF = float("nan"), float("inf")


def test_null_groups_stay(spark):
    data = [("a", 1, 3.0), (None, 2, 1.0), ("a", 3, 2.0), (None, 4, 5.0), (None, 5, None), ("a", 6, NAN), (None, 7, -INF)]
    frame = spark.createDataFrame(data, "g string, id int, v double")
    placed = {r.id: (r.position, r.total) for r in ranking.positions(frame, ["g"], [F.col("id")], total="total").collect()}
    assert placed == {1: (1, 3), 3: (2, 3), 6: (3, 3), 2: (1, 4), 4: (2, 4), 5: (3, 4), 7: (4, 4)}
    ladder = {r.id: (r.n, r.below, r.total) for r in ranking.attach_ladder(frame, ["g"], "v").collect()}
    assert ladder[2] == (1, 0, 2) and ladder[4] == (1, 1, 2) and ladder[5] == ladder[6] == ladder[7] == (None, None, None)
    summary = {r.g: r for r in stats.outcome_summary(frame, ["g"], "v").collect()}
    assert summary[None].observations == 2 and summary[None].mean == 3.0 and summary["a"].median == 2.5
    assert {r.g for r in ranking.leading(frame, ["g"], [F.col("id")], 1).collect()} == {"a", None}


def test_values_that_are_no_numbers(spark):
    frame = spark.createDataFrame([(1.0,), (NAN,), (2.0,), (INF,), (None,)], "v double")
    row = stats.distribution(frame, [], "v").first()
    assert (row["p25"], row["median"], row["maximum"], row["count"]) == (1.25, 1.5, 2.0, 2)
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, NAN), (4.0, 9.0)], "a double, b double")
    assert stats.rank_correlation(pairs, [], "a", "b").first()["pairs"] == 3


def bars(spark, closes, ticker="T"):
    rows = [(ticker, i, c, 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, n int, close double, volume double").withColumn(
        "d", F.expr("date_add(date'2020-01-01', n)"))


def test_bad_closes_null_what_they_touch(spark):
    good = [10 + math.sin(i) for i in range(300)]
    for bad in (0.0, -1.0, None, NAN):
        closes = list(good)
        closes[150] = bad
        out = {r.sessions: r for r in prices.price_features(bars(spark, closes)).collect()}
        clean = {r.sessions: r for r in prices.price_features(bars(spark, good)).collect()}
        # Volatility looks back 63 returns: sessions 151 to 214 touch the bad close, 215 does not.
        assert out[150 + 64].v2_volatility is None and out[152].v2_volatility is None
        assert abs(out[150 + 65].v2_volatility - clean[150 + 65].v2_volatility) < 1e-6
        logs = [math.log(b / a) for a, b in zip(good[-64:], good[-63:])]
        assert abs(out[300].v2_volatility - statistics.stdev(logs) * math.sqrt(252)) < 1e-6
        assert out[151].v2_short_term_reversal is None
        assert out[300].v2_high_proximity is not None


def test_zero_closes_in_the_price_report(spark):
    points = bars(spark, [10.0, 0.0, 10.0, 50.0]).withColumn("split", F.lit(0.0))
    found = price_report.anomalies(points).collect()
    assert sorted(r.change_percent for r in found) == [-100.0, 400.0]
    assert price_report.market_risk(points).first()["price_observations"] == 4
    splits = bars(spark, [100.0, 101.0, 50.0, 51.0, 26.0]).withColumn(
        "split", F.when(F.col("n").isin(2, 4), 2.0).otherwise(0.0))
    adjusted = [r.close for r in price_report.adjust_corporate_actions(splits).orderBy("d").collect()]
    assert adjusted == [25.0, 25.25, 25.0, 25.5, 26.0]


def test_dropped_bars_hand_their_split_on(spark):
    frame = bars(spark, [10.0, None, 5.0, 0.0]).withColumn("split", F.when(F.col("n") == 1, 2.0).when(F.col("n") == 3, 3.0).otherwise(0.0))
    kept = [(r.n, r.split) for r in prices.drop_incomplete_bars(frame).orderBy("d").collect()]
    assert kept == [(0, 0.0), (2, 6.0)]


def test_first_row_of_each_ticker(spark):
    rows = [("aa ", "Second", 2, "OK", ""), ("AA", "First", 1, "OK", ""), ("bb", "Other", 3, "FAILED", ""), ("cc", "No", 4, "FILTERED", "old")]
    frame = spark.createDataFrame(rows, "ticker string, company_name string, place int, status string, reason string").repartition(3)
    out = {r.ticker: r.company_name for r in coverage.backtest_universe(frame, None, "reason", [F.col("place")]).collect()}
    assert out == {"AA": "First", "BB": "Other"}
    names = universe.clean_us(frame.withColumn("ticker", F.upper("ticker")), [F.col("place")]).collect()
    assert {r.ticker: r.company_name for r in names} == {"AA": "First", "BB": "Other", "CC": "No"}


def test_nearest_names(spark):
    sizes = [(f"{i:03d}", "1311", 1e9 + i * 1e-3 / 7) for i in range(40)] + [("big", "1311", 5e12), ("none", "1311", None), ("odd", None, 1.0), ("odd2", None, 2.0)]
    frame = spark.createDataFrame(sizes, "ticker string, industry string, size double")
    out = {}
    for r in peers.closest_by_size(frame, ["industry"], "size").collect():
        out.setdefault(r.ticker, []).append((r.place, r.peer))
    for ticker, industry, size in sizes:
        others = [(t, s) for t, i, s in sizes if t != ticker and i == industry and s is not None]
        key = (lambda x: (abs(math.log(x[1] / size)), x[0])) if size is not None else (lambda x: (-x[1], x[0]))
        want = [t for t, _ in sorted(others, key=key)[:8]]
        assert [peer for _, peer in sorted(out[ticker])] == want, ticker
    asking = spark.createDataFrame([("new", "1311", 2e10), ("020", "1311", 1e9)], "ticker string, industry string, size double")
    found = peers.closest_by_size(frame, ["industry"], "size", 3, asking).collect()
    for ticker, _, size in (("new", "1311", 2e10), ("020", "1311", 1e9)):
        others = [(t, s) for t, i, s in sizes if t != ticker and i == "1311" and s is not None]
        want = [t for t, _ in sorted(others, key=lambda x: (abs(math.log(x[1] / size)), x[0]))[:3]]
        assert [r.peer for r in sorted(found, key=lambda r: r.place) if r.ticker == ticker] == want


def test_visible_text(spark):
    page = ("<html><head><title>x</title></head><body><ix:header>hid</ix:header><p>Net&nbsp;sales</p><table><tr><td>Cash</td>"
            "<td>12</td></tr></table>one<br/>two<dl><dt>a</dt><dd>b\u200bc</dd></dl><template>shown</template><script>no()</script></body></html>")
    cases = [
        (page, "a.htm", "Net sales\n\nCash 12\n\none\ntwo\na\n\nbc\nshown\n"), (None, None, None), ("", None, "\n"),
        ("a &amp;lt; b &lt;p&gt; &#8364;&#x20AC;&#128;&unknown; & &amp", None, "a &lt; b <p> \u20ac\u20ac\x80&unknown; & &amp\n"),
        ("x<!-- <p> --> y<style>p > q</style\n>z<SCRIPT src='a>b'>1</SCRIPT>w<header>h</header>", None, "x yzw\nh\n"),
        ("seen<script>var a = '<p>'; never closed <p>gone", None, "seen\n"), ("1 < 2 and <b title='>'>bold</b>", None, "1 < 2 and bold\n"),
        ("plain &amp; <p>text\r\n\r\n\r\n\r\nmore\u00a0 x", "NOTE.TXT", "plain &amp; <p>text\n\nmore x\n"),
        ("<HTML><p>text", "note.txt", "text\n"),
    ]
    frame = spark.createDataFrame([(i, h, n) for i, (h, n, _) in enumerate(cases)], "id int, html string, name string")
    found = {row["id"]: row["text"] for row in pages.page_text(frame, name="name").collect()}
    assert found == {i: want for i, (_, _, want) in enumerate(cases)}
    assert pages.page_text(frame.limit(0)).count() == 0


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_requests_made_by_explode_do_not_pass_the_driver(spark):
    exits = spark.createDataFrame([(1, "2020-03-15"), (2, "2020-02-20")], "cik int, exit_date string").withColumn("exit_date", F.to_date("exit_date"))
    held = spark.createDataFrame([(1, "2019-12-31", 90.0), (2, "2019-12-31", 15.0)], "cik int, end string, val double").select(
        "cik", F.to_date("end").alias("end"), "val", F.to_date("end").alias("filed"), F.lit(1).alias("frame"))
    found = floats.dead_observations(exits, held, "2020-01-01", 100.0, 300.0, ["frame"])
    assert "BroadcastHashJoin" not in _plan(found)
    assert [(r.cik, str(r.as_of), r.estimated_cap) for r in found.orderBy("as_of").collect()] == [(1, "2020-01-31", 120.0), (1, "2020-02-29", 120.0)]


def test_vocabularies_do_not_pass_the_driver(spark):
    words = spark.createDataFrame([("abcdef", 9), ("abcdeg", 100), ("zzzzzz", 5)], "word string, n long")
    assert "BroadcastHashJoin" not in _plan(variants.near_pairs(words))
    found = variants.variant_groups(words)
    assert "BroadcastHashJoin" not in _plan(found)
    assert {r.word: r.root for r in found.collect()} == {"abcdef": "abcdeg", "abcdeg": "abcdeg", "zzzzzz": "zzzzzz"}
