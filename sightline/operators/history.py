"""Runs over time: diffs, timelines, movers, compatible pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import ranking
from sightline.functions.scalars import half_even, messages


def with_ranks(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` among OK rows of each run: score descending, then ticker."""
    ok = rows.where(F.col("status") == "OK").select("run_id", "ticker", "discovery_score")
    ranked = ranking.positions(ok, ["run_id"], [-F.coalesce("discovery_score", F.lit(0.0)), F.col("ticker")], name="rank")
    return rows.join(ranked.select("run_id", "ticker", "rank"), ["run_id", "ticker"], "left")


def consecutive_pairs(rows: DataFrame) -> DataFrame:
    """old_run_id, new_run_id: each run and the one before it. The window sees one row per run."""
    runs = rows.select("run_id").distinct().withColumn("__one", F.lit(1))
    before = F.lag("run_id").over(Window.partitionBy("__one").orderBy("run_id"))
    return runs.select(before.alias("old_run_id"), F.col("run_id").alias("new_run_id")).where("old_run_id is not null")


def compare_runs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Full outer diff of each pair (old_run_id, new_run_id) with presence and change types. ``rows`` carry ranks.

    ``latest_compatible_pair`` or ``consecutive_pairs`` give the pairs.
    """
    def side(prefix: str) -> DataFrame:
        keyed = rows.join(pairs.withColumn("run_id", F.col(f"{prefix}_run_id")), "run_id")
        return keyed.select("old_run_id", "new_run_id", "ticker", *[
            F.col(name).alias(f"{prefix}_{name}") for name in ("status", "rank", "discovery_score", "sector")])

    both = side("old").join(side("new"), ["old_run_id", "new_run_id", "ticker"], "full")
    presence = F.when(F.col("old_status").isNull(), "entrant").when(F.col("new_status").isNull(), "exit").otherwise("retained")
    compared = both.withColumns({
        "presence": presence, "rank_change": F.col("old_rank") - F.col("new_rank"),
        "score_change": half_even(F.col("new_discovery_score") - F.col("old_discovery_score"), 6),
        "sector": F.coalesce("new_sector", "old_sector"),
    })
    retained = F.col("presence") == "retained"
    changes = messages(
        (~retained, F.col("presence")), (retained & (F.col("old_status") != F.col("new_status")), "status_transition"),
        (F.col("rank_change") != 0, "rank_change"), (F.col("score_change") != 0, "score_change"))
    return compared.withColumn("change_types", F.when(F.size(changes) == 0, F.array(F.lit("unchanged"))).otherwise(changes)) \
        .drop("old_sector", "new_sector")


def status_transitions(compared: DataFrame) -> DataFrame:
    unknown = F.lit("UNKNOWN")
    return compared.where(F.col("presence") == "retained").groupBy(
        "old_run_id", "new_run_id", F.coalesce("old_status", unknown).alias("old_status"), F.coalesce("new_status", unknown).alias("new_status"),
    ).agg(F.count(F.lit(1)).alias("count"))


def composition_changes(rows: DataFrame, pairs: DataFrame, field: str) -> DataFrame:
    """Counts of both runs of each pair per value of a field and their change."""
    counts = rows.groupBy("run_id", F.coalesce(field, F.lit("UNKNOWN")).alias(field)).agg(F.count(F.lit(1)).alias("n"))
    sides = [counts.join(pairs.withColumn("run_id", F.col(f"{side}_run_id")), "run_id").select(
        "old_run_id", "new_run_id", field, F.col("n").alias(f"{side}_count")) for side in ("old", "new")]
    both = sides[0].join(sides[1], ["old_run_id", "new_run_id", field], "full").fillna(0, ["old_count", "new_count"])
    return both.withColumn("change", F.col("new_count") - F.col("old_count"))


def rank_movers(compared: DataFrame, gains: bool, limit: int = 10) -> DataFrame:
    """Largest gains (ticker descending on ties) or declines (ticker ascending) of each pair of runs."""
    moved = compared.where(F.col("rank_change").isNotNull() & (F.col("rank_change") != 0))
    order = [F.col("rank_change").desc(), F.col("ticker").desc()] if gains else [F.col("rank_change").asc(), F.col("ticker").asc()]
    columns = ["old_run_id", "new_run_id", "ticker", "old_rank", "new_rank", "rank_change"]
    return ranking.leading(moved.select(*columns), columns[:2], order, limit, "__place").drop("__place")


def timeline(rows: DataFrame) -> DataFrame:
    """Score and rank change of every ticker against its previous appearance (one row per run)."""
    own = Window.partitionBy("ticker").orderBy("run_id")
    return rows.select(
        "ticker", "run_id", "status", "rank", "discovery_score",
        half_even(F.col("discovery_score") - F.lag("discovery_score").over(own), 6).alias("score_change"),
        (F.lag("rank").over(own) - F.col("rank")).alias("rank_change"),
        F.coalesce(F.lag("status").over(own) != F.col("status"), F.lit(False)).alias("transition"))


def timeline_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("appearances"), F.min("run_id").alias("first_seen"), F.max("run_id").alias("latest_seen"),
        F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"),
        F.sum(F.col("transition").cast("bigint")).alias("status_transition_count"))


def latest_compatible_pair(runs: DataFrame) -> DataFrame:
    """Newest pair of complete runs with the same universe size (runs: run_id, universe_size, completed_count)."""
    complete = runs.where(F.col("universe_size") == F.col("completed_count"))
    older = complete.select(F.col("run_id").alias("old_run_id"), "universe_size")
    return complete.select(F.col("run_id").alias("new_run_id"), "universe_size").join(older, "universe_size").where(
        F.col("old_run_id") < F.col("new_run_id")).orderBy(F.col("new_run_id").desc(), F.col("old_run_id").desc()).limit(1)


def history_summary(rows: DataFrame) -> DataFrame:
    """Number of runs and results, and the latest run."""
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("n").alias("results"), F.max("run_id").alias("latest_run_id"))
