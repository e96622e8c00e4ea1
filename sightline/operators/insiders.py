"""Insider signals as of a date from public filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.scalars import finite, half_even, positive, ratio


def signals_as_of(grid: DataFrame, tx: DataFrame, short: int = 180, long: int = 365,
                  data_through: str | None = None, minimum_value: float = 0.0) -> DataFrame:
    """Counts, values and buyers over (D - short, D] and (D - long, D], days since the last purchase.

    ``grid``: issuer, as_of[, market_cap]. ``tx``: issuer, filed, kind, value, officer, and the owners of each row as
    ``owners`` array<string> or one ``owner``[, shares]. Rows without a date, of another kind, without a finite share count
    or below ``minimum_value`` don't count; an unknown value counts as a transaction of no value. ``data_through`` is the
    date the data ends; more than 400 days later nothing is known. Issuers without transactions have nulls.

    Transactions are summed per (issuer, day) first and the spans are range frames over days, so an issuer's window is
    bounded by the calendar and no date meets every transaction. Distinct buyers come from +1 / -1 marks where an owner
    enters and leaves the short span.
    """
    if "owners" not in tx.columns:
        tx = tx.withColumn("owners", F.array_compact(F.array(F.col("owner").cast("string"))))
    usable = F.col("filed").isNotNull() & F.col("kind").isin("purchase", "sale")
    if "shares" in tx.columns:
        usable = usable & finite("shares").isNotNull()
    tx = tx.withColumn("value", finite("value")).where(usable & F.coalesce(F.col("value") >= minimum_value, F.lit(True)))
    buy, sell = F.col("kind") == "purchase", F.col("kind") == "sale"

    def amount(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value))

    one = F.lit(1.0)
    daily = tx.groupBy("issuer", F.col("filed").alias("day")).agg(
        amount(buy, one).alias("bn"), amount(sell, one).alias("sn"), amount(buy & F.col("officer"), one).alias("on"),
        amount(buy, F.col("value")).alias("bv"), amount(sell, F.col("value")).alias("sv"),
        F.max(F.when(buy, F.col("filed"))).alias("last"))
    bought = tx.where(buy).select("issuer", F.explode("owners").alias("owner"), F.col("filed").alias("day")).distinct()
    following = F.lead("day").over(Window.partitionBy("issuer", "owner").orderBy("day"))
    leaves = F.least(F.coalesce(following, F.lit("9999-01-01").cast("date")), F.date_add("day", short))
    marks = bought.withColumn("leaves", leaves).select("issuer", F.explode(F.array(
        F.struct(F.col("day").alias("day"), F.lit(1).alias("mark")),
        F.struct(F.col("leaves").alias("day"), F.lit(-1).alias("mark")))).alias("m")).groupBy(
        "issuer", F.col("m.day").alias("day")).agg(F.sum("m.mark").alias("mark"))
    dates = grid.select("issuer", F.col("as_of").alias("day")).distinct().join(
        tx.select("issuer").distinct(), "issuer", "left_semi").withColumn("asked", F.lit(True))
    points = daily.join(marks, ["issuer", "day"], "full").join(dates, ["issuer", "day"], "full").withColumn(
        "__n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    own = Window.partitionBy("issuer").orderBy("__n")
    past = own.rowsBetween(Window.unboundedPreceding, 0)

    def over(name: str, span: int) -> Column:
        return F.coalesce(F.sum(name).over(own.rangeBetween(-(span - 1), 0)), F.lit(0.0))

    measured = points.select(
        "issuer", F.col("day").alias("as_of"), "asked",
        over("bn", short).alias("ins_purchase_count_short"), over("sn", short).alias("ins_sale_count_short"),
        F.coalesce(F.sum("mark").over(past), F.lit(0)).cast("double").alias("ins_distinct_buyers_short"),
        over("on", short).alias("ins_officer_purchase_count_short"), over("bv", short).alias("ins_purchase_value_short"),
        (over("bv", short) - over("sv", short)).alias("ins_net_value_short"),
        over("bn", long).alias("ins_purchase_count_long"), over("bv", long).alias("ins_purchase_value_long"),
        (over("bv", long) - over("sv", long)).alias("ins_net_value_long"), F.max("last").over(past).alias("__last"))
    known = measured.where("asked").drop("asked")
    if data_through is not None:
        known = known.where(F.datediff("as_of", F.lit(data_through).cast("date")) <= 400)
    filled = known.withColumns({
        "ins_net_count_short": F.col("ins_purchase_count_short") - F.col("ins_sale_count_short"),
        "ins_cluster_buy_short": F.when(F.col("ins_distinct_buyers_short") >= 2, 1.0).otherwise(0.0),
        "ins_days_since_last_purchase": F.datediff("as_of", "__last").cast("double"),
    }).drop("__last")
    result = grid.join(filled, ["issuer", "as_of"], "left")
    if "market_cap" in grid.columns:
        cap = positive("market_cap")
        result = result.withColumns({
            f"ins_net_value_to_market_cap_{span}": ratio(f"ins_net_value_{span}", cap) for span in ("short", "long")})
    rounded = {name: half_even(name, 6) for name in result.columns if name.startswith("ins_")}
    return result.withColumns({**rounded, "ins_data_through": F.lit(data_through).cast("date")})


def quarter_end(label: Column) -> Column:
    """Calendar end date of a ``YYYYqN`` label."""
    parts = F.split(F.lower(label), "q")
    return F.last_day(F.make_date(parts[0].cast("int"), parts[1].cast("int") * 3, F.lit(1)))


def supplement(held: DataFrame, recent: DataFrame, cutoff: str) -> DataFrame:
    """Held transactions plus recent filings after the bulk cut-off whose accession is not held."""
    fresh = recent.where(F.col("filed") > F.lit(cutoff).cast("date")).join(held.select("accession"), "accession", "left_anti")
    return held.unionByName(fresh)
