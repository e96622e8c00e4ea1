"""Domain views over the driver tables, for Spark and for the SQL twins.

Prices and money are rounded where they are built, so every branch of a plan
and both engines see the same doubles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.scalars import half_even
from sightline.session import cut


#: Trades that one task sorts on average, whatever the number of shuffle partitions.
TASK_TRADES = 1_000_000


class Views:
    """Lazy domain views of one table folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def px(self) -> DataFrame:
        """Daily bars: a supplier is a ticker, the volume-weighted unit price its close."""
        return (
            self.table("lineitem")
            .groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("d"))
            .agg(
                (half_even(F.sum("l_extendedprice"), 2) / F.sum("l_quantity")).alias("close"),
                F.sum("l_quantity").alias("volume"),
            )
        )

    @cached_property
    def bars(self) -> DataFrame:
        """``px`` for what runs over a ticker's sessions: the trades are dealt and sorted once, and no window after does so again.

        The sums of a day come from a window too, so a task holds one sort and no hash table.
        """
        trades = self.table("lineitem").select(
            F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity")
        number = trades.count()  # from the footers of the files
        if number > TASK_TRADES:
            parts = max(-(-number // TASK_TRADES), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            trades = trades.repartition(parts, "ticker")
        else:
            trades = trades.repartition("ticker")
        day = Window.partitionBy("ticker", "d")
        volume = F.sum("l_quantity").over(day)
        return trades.select(
            "ticker", "d", (half_even(F.sum("l_extendedprice").over(day), 2) / volume).alias("close"), volume.alias("volume"),
            F.row_number().over(day.orderBy("d")).alias("__row")).where(F.col("__row") == 1).drop("__row")

    @cached_property
    def listing(self) -> DataFrame:
        nation = self.table("nation")
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("company_name"),
            F.col("n_name").alias("sector"), F.col("n_regionkey").alias("benchmark"),
            half_even((F.col("s_acctbal") + 1000) * 100000, 2).alias("market_cap"),
        )

    @cached_property
    def bench(self) -> DataFrame:
        # Stored, so Spark knows that it is small and no trade is shuffled to meet it.
        where = cut(self.listing.select(F.col("ticker").alias("l_suppkey"), "benchmark"))
        return (
            self.table("lineitem").join(where, "l_suppkey")
            .groupBy("benchmark", F.to_date("l_shipdate").alias("d"))
            .agg((half_even(F.sum("l_extendedprice"), 2) / F.sum("l_quantity")).alias("close"))
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Quarterly revenue of (nation, segment) companies; every fifth nation restates."""
        start = F.trunc("o_orderdate", "quarter")
        quarters = (
            self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg"), start.alias("start_d"))
            .agg(half_even(F.sum("o_totalprice"), 2).alias("val"))
            .withColumn("end_d", F.last_day(F.add_months("start_d", 2)))
        )
        filings = F.explode(F.when(
            F.col("nk") % 5 == 0,
            F.array(
                F.struct(F.lit(30).alias("lag"), F.lit(1.0).alias("factor")),
                F.struct(F.lit(120).alias("lag"), F.lit(1.08).alias("factor")),
            ),
        ).otherwise(F.array(F.struct(F.lit(30).alias("lag"), F.lit(1.0).alias("factor")))))
        return quarters.withColumn("f", filings).select(
            (F.col("nk") * 10 + F.element_at(
                F.create_map(*[F.lit(x) for pair in SEGMENT_CODES.items() for x in pair]), F.col("seg"),
            )).cast("bigint").alias("company"),
            "nk", "seg", "start_d", "end_d",
            F.date_add("end_d", F.col("f.lag")).alias("filed"),
            half_even(F.col("val") * F.col("f.factor"), 2).alias("val"),
        )

    @cached_property
    def tx(self) -> DataFrame:
        return self.table("events").where(F.col("event_type").isin("purchase", "error")).select(
            F.col("event_id").alias("accession"), (F.col("user_id") % 40).alias("issuer"),
            F.col("user_id").alias("owner"), F.to_date("ts").alias("filed"),
            F.when(F.col("event_type") == "purchase", "purchase").otherwise("sale").alias("kind"),
            "value", (F.col("user_id") % 3 == 0).alias("officer"),
        )

    @cached_property
    def xs(self) -> DataFrame:
        """A customer is a company: one cross-section with four signals."""
        totals = self.table("orders").groupBy("o_custkey").agg(
            half_even(F.sum("o_totalprice"), 2).alias("s2"), F.count("o_orderkey").alias("s3"),
            F.max("o_totalprice").alias("s4"),
        )
        return (
            self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(
                F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("sector"),
                F.col("n_name").alias("country"), F.col("n_nationkey").alias("country_key"),
                F.col("c_acctbal").alias("s1"), "s2",
                F.coalesce("s3", F.lit(0)).cast("double").alias("s3"), "s4",
            )
        )

    @cached_property
    def runs(self) -> DataFrame:
        return (
            self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(
                F.year("o_orderdate").alias("run_id"), F.col("o_custkey").alias("ticker"),
                F.col("c_mktsegment").alias("sector"),
            )
            .agg(half_even(F.sum("o_totalprice"), 2).alias("discovery_score"))
            .withColumn("status", F.when(F.col("discovery_score") >= 250000, "OK").otherwise("FILTERED"))
        )


# Fixed codes that make one numeric company key of nation and segment.
SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}

_CODES = "CASE seg " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENT_CODES.items()) + " END"


def r(expression: str, digits: int) -> str:
    """SQL twin of ``half_even``."""
    scale = f"1e{digits}"
    return f"(round_even(CAST(({expression}) AS DOUBLE) * {scale}, 0) / {scale})"


VIEW_SQL = {
    "px": f"""SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d,
        {r('SUM(l_extendedprice)', 2)} / SUM(l_quantity) AS close, SUM(l_quantity) AS volume
        FROM lineitem GROUP BY 1, 2""",
    "listing": f"""SELECT s_suppkey AS ticker, s_name AS company_name, n_name AS sector,
        n_regionkey AS benchmark, {r('(s_acctbal + 1000) * 100000', 2)} AS market_cap
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "bench": f"""SELECT n_regionkey AS benchmark, CAST(l_shipdate AS DATE) AS d,
        {r('SUM(l_extendedprice)', 2)} / SUM(l_quantity) AS close
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2""",
    "facts": f"""SELECT CAST(nk * 10 + {_CODES} AS BIGINT) AS company, nk, seg, start_d, end_d,
        CAST(end_d + to_days(lag) AS DATE) AS filed, {r('val * factor', 2)} AS val
        FROM (SELECT *, CAST(last_day(CAST(start_d + INTERVAL '2' MONTH AS DATE)) AS DATE) AS end_d FROM (
            SELECT c_nationkey AS nk, c_mktsegment AS seg,
                CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start_d,
                {r('SUM(o_totalprice)', 2)} AS val
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) q) e
        JOIN (VALUES (30, 1.0::DOUBLE), (120, 1.08::DOUBLE)) f(lag, factor) ON lag = 30 OR nk % 5 = 0""",
    "tx": """SELECT event_id AS accession, user_id % 40 AS issuer, user_id AS owner,
        CAST(ts AS DATE) AS filed,
        CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'sale' END AS kind,
        value, user_id % 3 = 0 AS officer
        FROM events WHERE event_type IN ('purchase', 'error')""",
    "xs": f"""SELECT c_custkey AS ticker, c_mktsegment AS sector, n_name AS country, n_nationkey AS country_key,
        c_acctbal AS s1, s2, CAST(COALESCE(s3, 0) AS DOUBLE) AS s3, s4
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, {r('SUM(o_totalprice)', 2)} AS s2, COUNT(o_orderkey) AS s3,
            MAX(o_totalprice) AS s4 FROM orders GROUP BY 1) t ON o_custkey = c_custkey""",
    "runs": f"""SELECT *, CASE WHEN discovery_score >= 250000 THEN 'OK' ELSE 'FILTERED' END AS status FROM (
        SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS run_id, o_custkey AS ticker,
            c_mktsegment AS sector, {r('SUM(o_totalprice)', 2)} AS discovery_score
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""",
}


def twin(views: str, body: str) -> str:
    """A SQL twin: the named views as CTEs, then ``body`` (its own WITH is merged)."""
    ctes = [f"{name} AS ({VIEW_SQL[name]})" for name in views.split()]
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join([*ctes, body[15:]])
    if body[:5].upper() == "WITH ":
        body = body[5:]
        return "WITH " + ", ".join(ctes) + (", " if ctes else "") + body
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
