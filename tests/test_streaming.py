"""Streams and sinks: repeated batches and runs add nothing twice."""

import pytest
from pyspark.sql import functions as F

from sightline.sinks import tables
from sightline.streaming import incremental


def test_new_filings_arrive_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "held")
    schema = "cik long, filed string, val double"
    spark.createDataFrame([(1, "a", 1.0), (1, "a", 0.5), (None, "b", 2.0)], schema).write.mode("append").parquet(source)
    for turn in range(2):
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.load_available(stream, target, ["cik", "filed"], str(tmp_path / "checkpoint"))
        if turn == 0:
            spark.createDataFrame([(1, "a", 9.0), (2, "a", 3.0), (None, "b", 7.0)], schema).write.mode("append").parquet(source)
    rows = sorted(((r.cik or 0, r.filed, r.val) for r in spark.read.parquet(target).collect()))
    assert rows == [(0, "b", 2.0), (1, "a", 0.5), (2, "a", 3.0)]
    incremental.append_new(spark.createDataFrame([(2, "a", 1.0)], schema), target, ["cik", "filed"])
    assert spark.read.parquet(target).count() == 3


def test_runs_are_replaced_and_cohorts_are_not(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 3.0)], "run_id int, ticker string, score double")
    path = str(tmp_path / "runs")
    tables.index_runs(rows, path)
    tables.index_runs(rows.where("run_id = 2").withColumn("score", F.lit(4.0)), path)
    assert sorted((r.run_id, r.ticker, r.score) for r in spark.read.parquet(path).where("score is not null").collect()) == [
        (1, "a", 1.0), (2, "a", 4.0)]
    assert spark.read.parquet(path).count() == 3
    tables.freeze(rows, str(tmp_path), "x")
    with pytest.raises(FileExistsError):
        tables.freeze(rows.limit(1), str(tmp_path), "x")
    report = str(tmp_path / "report")
    tables.score_report(rows.coalesce(1), report, F.col("score"), [F.col("ticker")])
    assert [r.ticker for r in spark.read.option("header", "true").csv(report).collect()][-1] == "b"
