"""Industry peers: currency conversion, code widening, nearest names by size, peer percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import ranking
from sightline.functions.scalars import half_even, positive


def fx_rates(closes: DataFrame) -> DataFrame:
    """(base, quote, rate): last close per pair, inverses, and crosses through USD where no direct rate exists.

    ``closes``: base, quote, d, close.
    """
    last = closes.where(F.col("close") > 0).groupBy("base", "quote").agg(F.max_by("close", "d").alias("rate"))
    inverse = last.select(F.col("quote").alias("base"), F.col("base").alias("quote"), (1.0 / F.col("rate")).alias("rate"))
    direct = last.unionByName(inverse.join(last, ["base", "quote"], "left_anti"))
    to_usd = direct.where(F.col("quote") == "USD").select("base", F.col("rate").alias("r1"), F.lit("USD").alias("via"))
    from_usd = direct.where(F.col("base") == "USD").select("quote", F.col("rate").alias("r2"), F.lit("USD").alias("via"))
    # One row per currency on each side: an equality on the pivot currency, bounded by the currencies in use.
    crosses = to_usd.join(from_usd, "via").where(F.col("base") != F.col("quote")).select(
        "base", "quote", (F.col("r1") * F.col("r2")).alias("rate"))
    return direct.unionByName(crosses.join(direct, ["base", "quote"], "left_anti"))


def to_usd(rows: DataFrame, rates: DataFrame, value: str, currency: str, name: str) -> DataFrame:
    """Adds ``name``: the value in USD, null without a rate; a missing currency is USD."""
    usd = rates.where(F.col("quote") == "USD").select(F.col("base").alias("__c"), F.col("rate").alias("__rate"))
    keyed = rows.withColumn("__c", F.upper(F.coalesce(currency, F.lit("USD"))))
    return keyed.join(usd, "__c", "left").withColumn(name, F.when(
        F.col("__c") == "USD", F.col(value)).otherwise(half_even(F.col(value) * F.col("__rate"), 2))).drop("__c", "__rate")


def industry_codes(rows: DataFrame, minimum: int = C.PEERS["minimum"]) -> DataFrame:
    """Adds ``industry``: the 4-digit code, or its first three digits when fewer than three other usable names share it."""
    counts = rows.groupBy("sic").agg(F.sum(F.col("usable").cast("int")).alias("__n"))
    others = F.col("__n") - F.col("usable").cast("int")
    return rows.join(counts, "sic", "left").withColumn(
        "widened", (F.length("sic") >= 4) & (others < minimum),
    ).withColumn("industry", F.when(F.col("widened"), F.substring("sic", 1, 3)).otherwise(F.col("sic"))).drop("__n")


def closest_by_size(rows: DataFrame, groups: Sequence[str], size: str, limit: int = C.PEERS["closest"],
                    asking: DataFrame | None = None) -> DataFrame:
    """The ``limit`` nearest names by |log size ratio| in a group, ties by ticker, without pairing the group.

    ``asking`` (default: all rows) are the companies that get peers; they need not be usable themselves. Only
    ``limit`` distinct sizes on either side can hold a nearest name, and of each size only its first ``limit`` + 1
    tickers, so each name meets a fixed number of candidates found by equality joins. A company without a positive size
    gets the largest names of its group; its distance is null.
    """
    known = rows.where(positive(size).isNotNull()).select(*groups, "ticker", F.col(size).alias("size"))
    wanted = (asking if asking is not None else rows).select(*groups, "ticker", positive(size).alias("size"))
    held = known.select(*groups, "size").distinct()
    spots = ranking.positions(held, groups, [F.col("size")], name="place")
    own = spots.withColumnRenamed("size", "peer_size")
    first = ranking.leading(known, [*groups, "size"], [F.col("ticker")], limit + 1, "__p").select(
        *groups, F.col("size").alias("peer_size"), F.col("ticker").alias("peer"))
    if asking is not None:  # sizes that no usable name has stand where the usable sizes below them end
        others = ranking.join_groups(wanted.where("size is not null").select(*groups, "size").distinct(), held, groups, "left_anti", ["size"])
        among = ranking.positions(held.union(others.select(*groups, "size")), groups, [F.col("size")], name="all_places")
        alone = ranking.positions(others, groups, [F.col("size")], name="other_places")
        moved = ranking.join_groups(among, alone, groups, "inner", ["size"])
        spots = spots.union(moved.select(*groups, "size", (F.col("all_places") - F.col("other_places")).alias("place")))
    asked = ranking.join_groups(wanted.where("size is not null"), spots, groups, "inner", ["size"]).withColumn(
        "place", F.explode(F.transform(F.sequence(F.lit(-limit), F.lit(limit)), lambda step: F.col("place") + step)))
    near = ranking.join_groups(asked, own, groups, "inner", ["place"])
    met = ranking.join_groups(near, first, groups, "inner", ["peer_size"]).where(F.col("peer") != F.col("ticker"))
    distance = F.abs(F.log(F.col("peer_size") / F.col("size")))
    columns = [*groups, "ticker", "peer", "distance", (-F.col("peer_size")).alias("__large")]
    largest = ranking.leading(known, groups, [-F.col("size"), F.col("ticker")], limit + 1, "__p").select(
        *groups, F.col("ticker").alias("peer"), F.col("size").alias("peer_size"))
    unsized = ranking.join_groups(wanted.where("size is null"), largest, groups).where(F.col("peer") != F.col("ticker"))
    found = met.withColumn("distance", distance).select(*columns).union(
        unsized.withColumn("distance", F.lit(None).cast("double")).select(*columns))
    order = [F.coalesce("distance", "__large"), F.col("peer")]
    return ranking.leading(found, ["ticker"], order, limit, "place").select(*groups, "ticker", "peer", "place", "distance")


def peer_summary(pairs: DataFrame, metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Median of each metric over a name's peers and the name's percentile among them.

    A name has at most eight peers, so plain medians are bounded.
    """
    long = metrics.select("ticker", F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value")) for name in names])).alias("m")).select("ticker", "m.*")
    own = long.withColumnRenamed("value", "company")
    peers = pairs.join(long.withColumnRenamed("ticker", "peer"), "peer").where(F.col("value").isNotNull())
    joined = peers.join(own, ["ticker", "metric"])

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    return joined.groupBy("ticker", "metric").agg(
        F.max("company").alias("company"), half_even(F.median("value"), 6).alias("median"), F.count(F.lit(1)).alias("count"),
        F.when(F.max("company").isNotNull(), ranking.percent_half_ties(
            count(F.col("value") < F.col("company")), count(F.col("value") == F.col("company")), F.count(F.lit(1)))).alias("percentile"))
