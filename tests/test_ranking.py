"""Rank helpers against brute force."""

import math
import random

from pyspark.sql import functions as F

from sightline.functions import ranking, stats


def rows(spark, seed=3, n=400):
    generator = random.Random(seed)
    data = []
    for i in range(n):
        group = "hot" if i % 3 else f"g{i % 7}"
        # A third of the hot group shares one value; signs and magnitudes vary widely.
        value = 50.0 if i % 3 == 1 else generator.choice([-1, 1]) * 10 ** generator.uniform(-6, 6)
        data.append((group, i, value if i % 11 else None))
    return spark.createDataFrame(data, "g string, id int, v double"), data


def test_value_ladder_matches_counting(spark):
    frame, data = rows(spark)
    for row in ranking.value_ladder(frame, ["g"], "v").collect():
        members = [v for g, _, v in data if g == row.g and v is not None]
        assert row.below == sum(v < row.v for v in members)
        assert row.n == sum(v == row.v for v in members)
        assert row.total == len(members)


def test_bucket_is_monotone(spark):
    values = sorted([s * m * 2.0 ** e for s in (-1, 1) for e in range(-40, 40) for m in (1.0, 1.0000001, 1.9999999)] + [0.0])
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranking.magnitude_bucket("v").alias("b"))
    buckets = [row.b for row in frame.orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_positions_are_a_total_order(spark):
    frame, data = rows(spark)
    order = [F.col("v").isNull(), -F.col("v"), F.col("id")]
    found = {row.id: row.position for row in ranking.positions(frame, ["g"], order).collect()}
    for group in {g for g, _, _ in data}:
        members = sorted((i for g, i, _ in data if g == group),
                         key=lambda i: (data[i][2] is None, -(data[i][2] or 0.0), i))
        assert [found[i] for i in members] == list(range(1, len(members) + 1))


def test_percent_conventions_for_a_single_row(spark):
    frame = spark.createDataFrame([("a", 1.0)], "g string, v double")
    row = ranking.attach_ladder(frame, ["g"], "v").select(
        ranking.percent_spread().alias("a"), ranking.percent_spread(alone=100.0, digits=2).alias("b"),
        ranking.percent_at_or_below().alias("c"), ranking.rank_share().alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (50.0, 100.0, 100.0, 1.0)


def test_quantiles_match_linear_interpolation(spark):
    frame, data = rows(spark)
    result = {row.g: row for row in stats.quantiles(frame, ["g"], "v", {"q1": 0.25, "q2": 0.5}).collect()}
    for group, row in result.items():
        members = sorted(v for g, _, v in data if g == group and v is not None)
        for share, value in ((0.25, row.q1), (0.5, row.q2)):
            place = (len(members) - 1) * share
            low, high = members[math.floor(place)], members[math.ceil(place)]
            assert math.isclose(value, low + (high - low) * (place - math.floor(place)), rel_tol=1e-9, abs_tol=1e-12)


def test_rank_correlation_with_constant_side_is_null(spark):
    frame = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)] + [("b", float(i), float(-i)) for i in range(5)],
                                  "g string, x double, y double")
    found = {row.g: row.ic for row in stats.rank_correlation(frame, ["g"], "x", "y").collect()}
    assert found["a"] is None and round(found["b"], 9) == -1.0


def test_small_groups_shuffle_their_rows_once_and_large_ones_give_the_same(spark, monkeypatch):
    from sightline.session import cut

    data = [(i % 5 or None, i % 3, i, [0.0, -0.0, None, float("nan"), float("inf"), i % 4 / 2, -1.5, float(i)][i % 8]) for i in range(900)]
    frame = cut(spark.createDataFrame(data, "g int, k int, id int, v double").repartition(8))
    order = [-F.coalesce("v", F.lit(0.0)), F.col("id")]

    def results():
        ladder = ranking.attach_ladder(frame, ["g", "k"], "v", sized=True)
        places = ranking.positions(frame, ["g", "k"], order, total="members", sized=True)
        pairs = stats.rank_correlation(frame, ["g", "k"], "v", "id", minimum=2)
        return [sorted(map(repr, rows.collect())) for rows in (ladder, places, pairs.withColumn("ic", F.round("ic", 9)))]

    def written():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    plain = sorted(map(repr, ranking.attach_ladder(frame, ["g", "k"], "v").collect()))
    before = written()
    stats.rank_correlation(frame, ["g", "k"], "v", "id", minimum=2).collect()
    # Every row once, the sizes of 15 groups per task and the last sums of each task.
    assert written() - before <= 900 + 15 * 8 * 3
    small = results()
    for limit in (0, 60):
        monkeypatch.setattr(ranking, "GATHER", limit)
        assert results() == small
    assert small[0] == plain
