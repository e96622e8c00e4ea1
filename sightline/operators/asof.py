"""Point-in-time joins: every one carries an equality key, none is a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def known_versions(facts: DataFrame, keys: Sequence[str], filed: str = "filed", sequence: str | None = None) -> DataFrame:
    """Validity intervals: a version holds from its filing until the next filing of the same key.

    One version per (key, filing day) is kept first (the later-listed one), so
    the window over a key is bounded by its distinct filing days.
    """
    rest = [name for name in facts.columns if name not in (*keys, filed)]
    order = F.col(sequence) if sequence else F.struct(*rest)
    single = facts.groupBy(*keys, filed).agg(F.max_by(F.struct(*rest), order).alias("__v"))
    following = F.lead(filed).over(Window.partitionBy(*keys).orderBy(filed))
    return single.select(*keys, F.col(filed).alias("valid_from"), following.alias("valid_to"), "__v.*")


def as_known(grid: DataFrame, versions: DataFrame, on: Sequence[str], as_of: str) -> DataFrame:
    """Versions visible on each grid date: equality on the keys, interval as residual filter."""
    return grid.join(versions, list(on)).where(
        (F.col("valid_from") <= F.col(as_of))
        & (F.col("valid_to").isNull() | (F.col(as_of) < F.col("valid_to"))),
    )


def close_on_or_before(requests: DataFrame, prices: DataFrame, target: str, tolerance: int, *,
                       key: str = "ticker", close: str = "close", prefix: str = "") -> DataFrame:
    """Last close on or before a date, at most ``tolerance`` days old.

    The tolerance is a small constant, so each request becomes tolerance + 1
    exact-day probes joined on (key, day). Work is spread by key and day, and a
    hot key never meets its whole history in one task.
    """
    asked = requests.select(key, target).where(F.col(target).isNotNull()).distinct()
    probes = asked.withColumn("d", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(tolerance)), lambda back: F.date_sub(F.col(target), back.cast("int")),
    )))
    found = probes.join(prices.select(key, "d", close), [key, "d"]).groupBy(key, target).agg(
        F.max_by(F.struct("d", close), "d").alias("__hit"),
    ).select(
        key, target, F.col("__hit.d").alias(f"{prefix}date"), F.col(f"__hit.{close}").alias(f"{prefix}close"),
    )
    return requests.join(found, [key, target], "left")


def calendar_grid(members: DataFrame, calendar: DataFrame, by: str = "benchmark") -> DataFrame:
    """Every member on every session of its benchmark's calendar (equality on the benchmark)."""
    return members.join(calendar, by)


def forward_fill(grid: DataFrame, key: str, value: str, limit: int, name: str) -> DataFrame:
    """Carry the last known value over at most ``limit`` missing sessions."""
    frame = Window.partitionBy(key).orderBy("d").rowsBetween(-limit, 0)
    return grid.withColumn(name, F.last(value, ignorenulls=True).over(frame))
