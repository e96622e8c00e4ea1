"""Blend calibration: coverage-neutral peer model, banded reranks, scenario gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import ranking
from sightline.functions.scalars import half_even, messages, ratio

SCENARIOS = {  # name -> (technical weight, fundamental weight)
    "technical_100": (1.0, 0.0), "technical_80_fundamental_20": (0.8, 0.2), "technical_70_fundamental_30": (0.7, 0.3),
}
RULES = {"pool": 100, "band": 25, "minimum_peers": 20, "minimum_coverage": 75.0, "neutral": 50.0,
         "maximum_gap": 15.0, "maximum_movement": 75, "retention": {20: 60.0, 50: 70.0, 100: 100.0}}


def blend_score(technical: Column, fundamental: Column, technical_weight: float, fundamental_weight: float,
                neutral: float = RULES["neutral"]) -> Column:
    """Weighted mean; a missing fundamental side counts as neutral, a missing technical side gives null."""
    return half_even(technical * technical_weight + F.coalesce(fundamental, F.lit(neutral)) * fundamental_weight, 2)


def core_factors(factors: DataFrame, minimum: float = RULES["minimum_coverage"]) -> DataFrame:
    """Factors whose coverage reaches the minimum in every country."""
    by_country = factors.groupBy("factor", "country").agg(
        F.sum((F.col("available") & F.col("applicable")).cast("bigint")).alias("available"),
        F.sum(F.col("applicable").cast("bigint")).alias("applicable"))
    share = F.coalesce(half_even(ratio("available", "applicable") * 100, 2), F.lit(0.0))
    return by_country.groupBy("factor").agg(F.min(share).alias("lowest")).where(F.col("lowest") >= minimum).select("factor")


def core_scores(factors: DataFrame, core: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score and confidence over the core factors per company."""
    kept = factors.join(core, "factor", "left_semi").where(F.col("applicable"))
    usable = F.when(F.col("available"), F.col("max_points")).otherwise(0.0)
    sums = kept.groupBy(*keys).agg(
        F.sum("max_points").alias("applicable"), F.sum(usable).alias("available"),
        F.sum(F.when(F.col("available"), F.col("points")).otherwise(0.0)).alias("points"))
    return sums.select(
        *keys, half_even(ratio("points", "available") * 100, 2).alias("core_score"),
        half_even(ratio("available", "applicable") * 100, 2).alias("core_confidence"))


def peer_percentiles(scores: DataFrame, rules: Mapping = RULES) -> DataFrame:
    """Percentile within (country, sector) of at least 20, else country, shrunk to 50 by confidence."""
    scored = scores.where(F.col("core_score").isNotNull()).withColumns({
        "country": F.coalesce("country", F.lit("UNKNOWN")), "sector": F.coalesce("sector", F.lit("UNKNOWN"))})
    country = ranking.attach_ladder(scored, ["country"], "core_score", "c_")
    both = ranking.attach_ladder(country, ["country", "sector"], "core_score", "s_")
    wide = ranking.percent_spread("c_n", "c_below", "c_total", alone=100.0, digits=2)
    narrow = ranking.percent_spread("s_n", "s_below", "s_total", alone=100.0, digits=2)
    enough = F.col("s_total") >= rules["minimum_peers"]
    base = F.when(enough, narrow).otherwise(wide)
    neutral = rules["neutral"]
    return both.withColumns({
        "country_percentile": wide,
        "peer_group": F.when(enough, F.concat_ws(" / ", "country", "sector")).otherwise(F.col("country")),
        "peer_percentile": half_even(neutral + (base - neutral) * F.col("core_confidence") / 100, 2),
        "adjusted_score": half_even(F.col("core_score") * F.col("core_confidence") / 100, 2),
    }).drop("c_n", "c_below", "c_total", "s_n", "s_below", "s_total")


def scenario_scores(rows: DataFrame, scenarios: Mapping = SCENARIOS, rules: Mapping = RULES) -> DataFrame:
    """One row per (ticker, scenario). Needs ticker, official_rank, technical_percentile, peer_percentile."""
    entries = []
    for name, (technical, fundamental) in scenarios.items():
        score = blend_score(F.col("technical_percentile"), F.col("peer_percentile"), technical, fundamental, rules["neutral"])
        if fundamental > 0:
            score = F.when(F.col("official_rank") <= rules["pool"], score)
        entries.append(F.struct(F.lit(name).alias("scenario"), F.lit(fundamental).alias("fundamental_weight"), score.alias("score")))
    keys = [name for name in ("ticker", "official_rank", "country", "sector") if name in rows.columns]
    return rows.select(*keys, F.explode(F.array(*entries)).alias("s")).select(*keys, "s.*")


def scenario_ranks(scores: DataFrame, rules: Mapping = RULES) -> DataFrame:
    """Free rank for the purely technical scenario; others rerank in bands of 25 inside the top-100 pool."""
    free = scores.where((F.col("fundamental_weight") <= 0) & F.col("score").isNotNull())
    ranked = ranking.positions(free, ["scenario"], [-F.col("score"), F.col("ticker")], name="rank")
    band = F.floor((F.col("official_rank") - 1) / rules["band"])
    pooled = scores.where((F.col("fundamental_weight") > 0) & (F.col("official_rank") <= rules["pool"])).withColumn("__b", band)
    # A band holds at most 25 rows.
    inside = F.row_number().over(Window.partitionBy("scenario", "__b").orderBy(F.col("score").desc_nulls_last(), "ticker"))
    banded = pooled.withColumn("rank", (F.col("__b") * rules["band"] + inside).cast("bigint")).drop("__b")
    return ranked.unionByName(banded)


def movements(ranks: DataFrame, best: bool, limit: int = 20) -> DataFrame:
    """Largest promotions (or demotions) per scenario."""
    moved = ranks.withColumn("rank_movement", F.col("official_rank") - F.col("rank"))
    order = [F.col("rank_movement").desc() if best else F.col("rank_movement").asc(), F.col("ticker")]
    return ranking.leading(moved, ["scenario"], order, limit, "place")


def scenario_acceptance(ranks: DataFrame, gap: float, rules: Mapping = RULES) -> DataFrame:
    """Top-k retention, largest movement and country gap per scenario, with pass or fail."""
    totals = {
        f"top_{cutoff}": F.sum(((F.col("official_rank") <= cutoff) & (F.col("rank") <= cutoff)).cast("bigint"))
        for cutoff in rules["retention"]}
    sizes = {f"size_{cutoff}": F.sum((F.col("official_rank") <= cutoff).cast("bigint")) for cutoff in rules["retention"]}
    wide = ranks.groupBy("scenario").agg(
        *[value.alias(name) for name, value in {**totals, **sizes}.items()],
        F.max(F.abs(F.col("official_rank") - F.col("rank"))).alias("largest_movement"),
        F.max("fundamental_weight").alias("fundamental_weight"))
    texts = []
    for cutoff, minimum in rules["retention"].items():
        share = ratio(f"top_{cutoff}", F.least(F.col(f"size_{cutoff}"), F.lit(cutoff))) * 100
        wide = wide.withColumn(f"retention_{cutoff}", half_even(share, 2))
        texts.append((F.col(f"retention_{cutoff}") < minimum, f"top_{cutoff}_retention"))
    texts.append((F.col("largest_movement") > rules["maximum_movement"], "rank_movement"))
    texts.append(((F.col("fundamental_weight") > 0) & F.lit(gap > rules["maximum_gap"]), "country_gap"))
    return wide.withColumn("failures", messages(*texts)).withColumn(
        "status", F.when(F.size("failures") == 0, "pass").otherwise("fail"))


def percentile_correlation(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson of two percentile columns on rows that have both, rounded 4; null when a side is constant."""
    both = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    spread = F.nullif(F.stddev_pop(left) * F.stddev_pop(right), F.lit(0.0))
    return both.agg(F.count(F.lit(1)).alias("count"), half_even(F.covar_pop(left, right) / spread, 4).alias("value"))


def top_overlap(ranks: DataFrame, first: str, second: str, cutoffs: Sequence[int]) -> DataFrame:
    """Shared members of two top-N sets."""
    entries = F.explode(F.array(*[F.lit(cutoff) for cutoff in cutoffs]))
    long = ranks.withColumn("cutoff", entries)
    inside = lambda name: (F.col(name) <= F.col("cutoff")).cast("bigint")
    counts = long.groupBy("cutoff").agg(
        F.sum(inside(first)).alias("first_size"), F.sum(inside(second)).alias("second_size"),
        F.sum(inside(first) * inside(second)).alias("shared"))
    size = F.least("cutoff", "first_size", "second_size")
    return counts.select("cutoff", "shared", half_even(ratio("shared", size) * 100, 2).alias("percentage"))


def outlier_flags(factors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Factors whose source value is outside its configured range, as text per company."""
    limits = {name: policy for name, (_, _, _, policy) in C.FUNDAMENTAL_FACTORS.items()}

    def bound(index: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for name, policy in limits.items() for x in (name, float(policy[index]))]), F.col("factor"))

    value = F.coalesce("source_value", "raw_value")
    flag = F.when(value < bound(0), F.concat(F.col("factor"), F.lit(" below"))).when(
        value > bound(1), F.concat(F.col("factor"), F.lit(" above")))
    flagged = factors.select(*keys, flag.alias("flag")).where(F.col("flag").isNotNull())
    return flagged.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("flag")), "; ").alias("outlier_flags"))


def consensus(ranks: DataFrame, threshold: int = 5) -> DataFrame:
    """Average, lowest and highest rank over scenarios, the consensus rank and its stability."""
    merged = ranks.groupBy("ticker").agg(
        half_even(F.avg("rank"), 2).alias("average_rank"), F.min("rank").alias("minimum_rank"), F.max("rank").alias("maximum_rank"))
    spread = F.col("maximum_rank") - F.col("minimum_rank")
    ranked = ranking.positions(merged, [], [F.col("average_rank"), F.col("ticker")], name="consensus_rank")
    return ranked.withColumn("rank_sensitivity", F.when(spread <= threshold, "stable").otherwise("weight_sensitive"))


def scenario_agreement(ranks: DataFrame, scenarios: int, cutoffs: Sequence[int] = (10, 25, 50, 100)) -> DataFrame:
    """Names all scenarios share over names any scenario has, at each cutoff."""
    long = ranks.withColumn("cutoff", F.explode(F.array(*[F.lit(cutoff) for cutoff in cutoffs]))).where(F.col("rank") <= F.col("cutoff"))
    votes = long.groupBy("cutoff", "ticker").agg(F.countDistinct("scenario").alias("votes"))
    return votes.groupBy("cutoff").agg(
        F.sum((F.col("votes") == scenarios).cast("bigint")).alias("common_candidates"),
        F.count(F.lit(1)).alias("union_candidates"),
    ).withColumn("jaccard_percentage", half_even(ratio("common_candidates", "union_candidates") * 100, 2))
