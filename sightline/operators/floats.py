"""Public floats: the latest over many frames, and as known on a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_public_floats(frames: DataFrame) -> DataFrame:
    """Per filer the positive value with the latest ``end``; of equal ends the first frame wins.

    ``frames``: cik, end, val, frame. A combined ``max_by``, so a filer with many frames is no hot group.
    """
    return frames.where(F.col("val") > 0).groupBy("cik").agg(
        F.max_by("val", F.struct("end", (-F.col("frame")).alias("k"))).alias("public_float"))


def public_float_as_of(asked: DataFrame, floats: DataFrame, ties: Sequence[str] = (), max_age_days: int = 550) -> DataFrame:
    """The float known on each asked (cik, as_of): filed by then, at most ``max_age_days`` old, the latest (end, filed).

    Requests without such a float have no row. Both sides are shuffled: requests made by ``explode`` look small to Spark, which
    would broadcast them through the driver.
    """
    known = asked.hint("merge").join(floats.hint("merge"), "cik").where(
        (F.col("filed") <= F.col("as_of")) & (F.datediff("as_of", "end") <= max_age_days))
    return known.groupBy("cik", "as_of").agg(F.max_by("val", F.struct("end", "filed", *ties)).alias("public_float"))


def estimated_market_cap(public_float, insider_share: float = 0.25):
    """Market value when insiders hold ``insider_share`` of it; null for a float that is not positive."""
    return F.when(public_float > 0, public_float / (1.0 - insider_share))


def dead_observations(exits: DataFrame, floats: DataFrame, start: str, minimum_cap: float, maximum_cap: float,
                      ties: Sequence[str] = (), insider_share: float = 0.25, include_unknown_size: bool = False) -> DataFrame:
    """cik, exit_date, exit_type, as_of, estimated_cap: every month-end from ``start`` to the exit on which the company was in the size band.

    Month-ends come from the exit date itself, one row per company and month, so nothing is paired with a calendar. The size is
    estimated from the float that was known on the month-end. A company whose size is unknown then is left out
    unless ``include_unknown_size``.
    """
    months = F.expr(f"sequence(last_day(date'{start}'), exit_date, interval 1 month)")
    asked = exits.where(F.col("exit_date") > F.last_day(F.lit(start).cast("date"))).withColumn("month", F.explode(months))
    asked = asked.withColumn("as_of", F.last_day("month")).drop("month").where(F.col("as_of") < F.col("exit_date"))
    known = public_float_as_of(asked.select("cik", "as_of").distinct(), floats, ties)
    sized = asked.hint("merge").join(known.hint("merge"), ["cik", "as_of"], "left").withColumn(
        "estimated_cap", estimated_market_cap(F.col("public_float"), insider_share)).drop("public_float")
    inside = F.col("estimated_cap").between(minimum_cap, maximum_cap)
    return sized.where(F.coalesce(inside, F.lit(include_unknown_size)))
