"""Browse and report rows of a run: candidate lists, top-N composition, run analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranking
from sightline.operators.history import with_ranks

MOST_ROWS = 200


def newest(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """The rows of the newest run; one row with its id is broadcast."""
    return rows.join(F.broadcast(rows.agg(F.max(run).alias(run))), run)


def candidates(rows: DataFrame, status: str | None = "OK", search: str | None = None, equal: Mapping[str, str] | None = None,
               limit: int = 100, names: Sequence[str] = ("ticker",)) -> DataFrame:
    """The first rows of one run by rank, unranked rows last, ties by ticker; at most ``limit``, never over 200.

    Ranks and percentiles count all of the run's rows with that status, filters come after. ``search`` is looked for in
    ``names`` whatever the case; ``equal`` compares columns whatever the case.
    """
    ranked = with_ranks(rows)
    scored = ranking.attach_ladder(ranked.withColumn("__s", F.when(F.col("status") == "OK", F.col("discovery_score"))), [], "__s")
    placed = scored.withColumn("discovery_percentile", ranking.percent_at_or_below()).drop("__s", "n", "below", "total")
    kept = placed
    for name, value in {"status": status, **(equal or {})}.items():
        if value:
            kept = kept.where(F.upper(F.coalesce(F.col(name).cast("string"), F.lit(""))) == value.strip().upper())
    if search and search.strip():
        hits = [F.coalesce(F.upper(F.col(name).cast("string")).contains(search.strip().upper()), F.lit(False)) for name in names]
        kept = kept.where(F.greatest(*hits) if len(hits) > 1 else hits[0])
    first = max(1, min(int(limit), MOST_ROWS))
    return ranking.leading(kept, [], [F.col("rank").isNull(), F.col("rank"), F.col("ticker")], first, "place")


def top_composition(ranked: DataFrame, rank: str, fields: Sequence[str], cutoffs: Sequence[int] = (25, 100)) -> DataFrame:
    """cutoff, field, value and the number of names among the first ``cutoff``; a missing value is UNKNOWN."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.coalesce(F.col(name).cast("string"), F.lit("UNKNOWN")).alias("value"))
                                for name in fields]))
    inside = ranked.where(F.col(rank) <= max(cutoffs)).withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).where(F.col(rank) <= F.col("cutoff"))
    return inside.select("cutoff", pairs.alias("p")).groupBy("cutoff", "p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def report_ranks(rows: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    """Adds one rank per score: highest first, missing scores last, ties by ticker."""
    out = rows
    for name, score in scores.items():
        out = ranking.positions(out, [], [score.isNull(), -F.coalesce(score, F.lit(0.0)), F.col("ticker")], name=name)
    return out
