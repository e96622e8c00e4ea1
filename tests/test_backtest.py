"""Month-end observations against plain Python, and what stored stages leave behind."""

from datetime import date, timedelta

from sightline.plans import backtest
from sightline.session import cut

DAYS = [date(2020, 1, 1) + timedelta(n) for n in range(300)]
CALENDAR = [d for d in DAYS if d.weekday() < 5]


def observed(spark, bars):
    bench = spark.createDataFrame([("X", d, 100.0 + i) for i, d in enumerate(CALENDAR)], "benchmark string, d date, close double")
    listing = spark.createDataFrame([(t, "X", "s", 1e8) for t in "ABC"], "ticker string, benchmark string, sector string, market_cap double")
    frame = spark.createDataFrame(bars, "ticker string, d date, close double, volume double")
    return backtest.observations(frame, bench, listing, {"minimum_history": 2, "horizons": {"1M": 20, "2M": 40}, "stale_sessions": 5})


def test_observations_equal_a_look_at_every_session(spark):
    # A trades every fourth day (also at weekends) with missing closes, B daily until June, C once a month.
    bars = [("A", d, None if i % 5 == 3 else 10.0 + i % 17, 1.0) for i, d in enumerate(DAYS[::4])]
    bars += [("B", d, 20.0 + i % 13, 1.0) for i, d in enumerate(DAYS[:160])] + [("C", d, 5.0 + i, 1.0) for i, d in enumerate(DAYS[26::30])]
    expected = {}
    months = sorted({d.strftime("%Y-%m") for d in CALENDAR})[:-1]
    for ticker in "ABC":
        own = {d: close for t, d, close, _ in bars if t == ticker}

        def close_at(j):
            found = [own[d] for d in CALENDAR[max(j - 5, 0):j + 1] if own.get(d) is not None]
            return found[-1] if j < len(CALENDAR) and found else None

        for period in months:
            i = max(j for j, d in enumerate(CALENDAR) if d.strftime("%Y-%m") == period)
            held = [d for d in own if d <= CALENDAR[i]]
            if len(held) < 2 or max(held) < CALENDAR[max(i - 5, 0)]:
                continue
            start = close_at(i)
            ahead = [close_at(i + days) for days in (20, 40)]
            expected[ticker, period] = (len(held), start, *[None if start is None or a is None else (a / start - 1.0) * 100.0 for a in ahead])
    found = {(r.ticker, r.period): (r.sessions, r.start_close, r.return_1M, r.return_2M) for r in observed(spark, bars).collect()}
    assert {k: (v, found.get(k)) for k, v in expected.items() if found.get(k) != v} == {} and found.keys() == expected.keys()
    assert {t for t, _ in found} == {"A", "B", "C"}
    assert any(value[3] is None and value[2] is not None for value in found.values())


def test_observations_pair_no_ticker_with_the_whole_calendar(spark):
    plan = observed(spark, [("A", d, 10.0, 1.0) for d in DAYS[::4]])._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan


def test_stored_stages_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    frame = cut(spark.range(1000).repartition(3, "id").groupBy("id").count())
    again = cut(frame.repartition(5))
    assert shuffled() == before
    assert again.count() == 1000 and all(name.endswith(".parquet") for name in frame.inputFiles())
