"""Research queue, screen status, bank lane and defensive order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import ranking
from sightline.functions.scalars import finite, half_even
from sightline.operators.rules import is_bank

TIERS = {"score_v3": 0, "score_v2": 1, "discovery_score": 2, "investment_fund": 3, "below_liquidity_floor": 4,
         "duplicate_listing": 5}


def research_queue(rows: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Order OK rows by the best available basis; funds, illiquid names and duplicates follow.

    Needs ticker, status, the three scores, liquid, duplicate_of, investment_fund.
    """
    ok = rows.where(F.col("status") == "OK")
    basis = (
        F.when(F.col("duplicate_of").isNotNull(), "duplicate_listing")
        .when(~F.col("liquid"), "below_liquidity_floor").when(F.col("investment_fund").isNotNull(), "investment_fund")
        .when(finite("score_v3").isNotNull(), "score_v3").when(finite("score_v2").isNotNull(), "score_v2")
        .when(finite("discovery_score").isNotNull(), "discovery_score")
    )
    tier = F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), F.col("ranking_basis"))
    based = ok.withColumn("ranking_basis", basis).where(F.col("ranking_basis").isNotNull()).withColumn("__tier", tier)
    score = (F.when(F.col("ranking_basis") == "score_v3", finite("score_v3"))
             .when(F.col("ranking_basis") == "score_v2", finite("score_v2")).otherwise(finite("discovery_score")))
    scored = based.withColumn("ranking_score", score)
    sort_score = F.when(F.col("ranking_basis") == "duplicate_listing", F.lit(0.0)).otherwise(-F.col("ranking_score"))
    order = [F.col("__tier"), sort_score.isNull(), sort_score, F.col("ticker")]
    return ranking.positions(scored, groups, order, name="research_rank").drop("__tier")


def screen_status(queue: DataFrame, groups: Sequence[str] = (), rules: Mapping = C.SCREEN) -> DataFrame:
    """Quintile over the primary tier, the screen status, and the bank lane."""
    quantiles, minimum = rules["quantiles"], rules["minimum_quintile"]
    primary = F.col("ranking_basis") == "score_v3"
    totals = queue.where(primary).groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    joined = queue.join(totals, list(groups), "left") if groups else queue.withColumn("__g", F.lit(0)).join(
        F.broadcast(totals.withColumn("__g", F.lit(0))), "__g", "left").drop("__g")
    # The primary tier comes first, so the queue rank is its position.
    bucket = ranking.floor_bucket(F.col("research_rank"), F.col("__n"), quantiles)
    graded = joined.withColumn("v3_quintile", F.when(primary, quantiles - bucket)).drop("__n")
    basis = F.col("ranking_basis")
    status = (
        F.when(basis.isin("duplicate_listing", "below_liquidity_floor", "investment_fund"), basis)
        .when(primary & (F.col("v3_quintile") >= minimum), "passes").when(primary, "low_v3_quintile")
        .when(F.coalesce("score_v3_excluded", F.lit(False)), "rejected_by_filters").otherwise("not_scored_by_v3")
    )
    labelled = graded.withColumn("screen_status", status)
    if not rules["bank_lane"]:
        return labelled.withColumn("bank_earnings_yield_percentile", F.lit(None).cast("double"))
    in_lane = (F.col("screen_status") == "not_scored_by_v3") & is_bank() & finite("pit_earnings_yield").isNotNull()
    marked = labelled.withColumn("__yield", F.when(in_lane, finite("pit_earnings_yield")))
    placed = ranking.attach_ladder(marked, groups, "__yield", "__y_")
    share = ranking.rank_share("__y_n", "__y_below", "__y_total") * 100.0
    return placed.withColumns({
        "bank_earnings_yield_percentile": half_even(share, 2),
        "screen_status": F.when(share > rules["bank_minimum_percentile"], "passes_bank_lane")
        .when(share.isNotNull(), "bank_dearer_half").otherwise(F.col("screen_status")),
    }).drop("__yield", "__y_n", "__y_below", "__y_total")


def defensive_scores(rows: DataFrame, groups: Sequence[str] = (), key: str = "ticker",
                     signals: Sequence[tuple[str, int]] = C.DEFENSIVE_SIGNALS) -> DataFrame:
    """Equal-weight mean of signed rank shares among names passing the screen, times 100; 50 without signals."""
    passing = rows.where(F.col("screen_status") == "passes")
    entries = F.array(*[
        F.struct(F.lit(name).alias("signal"), (finite(name) * sign).alias("value")) for name, sign in signals])
    long = passing.select(*groups, key, F.explode(entries).alias("e")).select(*groups, key, "e.*").where(
        F.col("value").isNotNull())
    placed = ranking.attach_ladder(long, [*groups, "signal"], "value")
    means = placed.groupBy(*groups, key).agg(half_even(F.avg(ranking.rank_share()) * 100.0, 4).alias("__s"))
    joined = rows.join(means, [*groups, key], "left")
    return joined.withColumn("score_defensive", F.when(
        F.col("screen_status") == "passes", F.coalesce("__s", F.lit(50.0)))).drop("__s")


def drivers(factors: DataFrame, keys: Sequence[str], best: bool, limit: int = 3) -> DataFrame:
    """The strongest (or weakest) factors by share of points, joined as text.

    ``factors``: keys, factor, points, max_points, available, explanation.
    """
    share = F.col("points") / F.col("max_points")
    usable = factors.where(F.coalesce("available", F.lit(True)) & (F.col("max_points") > 0) & F.col("points").isNotNull())
    order = [share.desc(), F.col("factor").desc()] if best else [share.asc(), F.col("factor").asc()]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = usable.withColumn("__p", place).where(F.col("__p") <= limit)
    text = F.when(F.length("explanation") > 0, F.concat_ws(": ", "factor", "explanation")).otherwise(F.col("factor"))
    sorted_texts = F.array_sort(F.collect_list(F.struct("__p", text.alias("text"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(sorted_texts, lambda item: item["text"]), "; ").alias("drivers"))


def balanced(rows: DataFrame, by: str, order: Sequence[Column], per_group: int) -> DataFrame:
    """First ``per_group`` rows of each group, interleaved by place then group."""
    return ranking.leading(rows, [by], order, per_group, "place").orderBy("place", by)
