"""Cross-sectional percentile scores with exclusions and confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.ranking import attach_ladder, descending_minimum_rank, ladder_over, percent_spread
from sightline.functions.scalars import finite, half_even

UNIVERSE = ""


def _applicable(sector: Column, signal: str, exclusions: Mapping[str, Sequence[str]]) -> Column:
    barred = [name for name, signals in exclusions.items() if signal in signals]
    return ~F.coalesce(sector.isin(*barred), F.lit(False)) if barred else F.lit(True)


def signal_percentiles(frame: DataFrame, groups: Sequence[str], key: str, signals: Sequence[str], *,
                       sector: str | None = None, minimum_group: int = 20,
                       sector_exclusions: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Universe and sector percentiles of many signals in one pass.

    Signals are unpivoted and each value is placed in two scopes, the whole
    cross-section and its sector, so one value ladder serves them all. Returns
    one row per (groups, key) with ``u_<signal>`` (universe) and ``p_<signal>``
    (sector when the group is large enough, else universe), unrounded, higher
    is larger. An empty sector never forms a group.
    """
    sector_value = F.coalesce(F.col(sector), F.lit("")) if sector else F.lit("")
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("signal"),
            F.when(_applicable(sector_value, name, sector_exclusions or {}), finite(name)).alias("value"),
        )
        for name in signals
    ])
    scopes = F.array_distinct(F.array(F.lit(UNIVERSE), sector_value))
    long = (
        frame.select(*groups, key, scopes.alias("__scopes"), F.explode(entries).alias("e"))
        .where(F.col("e.value").isNotNull())
        .select(*groups, key, F.explode("__scopes").alias("scope"), "e.signal", "e.value")
    )
    placed = attach_ladder(long, [*groups, "scope", "signal"], "value", sized=bool(groups)).withColumn("pct", percent_spread())
    is_universe = F.col("scope") == UNIVERSE
    columns = []
    for name in signals:
        own = F.col("signal") == name
        universe = F.max(F.when(own & is_universe, F.col("pct")))
        local = F.max(F.when(own & ~is_universe & (F.col("total") >= minimum_group), F.col("pct")))
        columns += [universe.alias(f"u_{name}"), F.coalesce(local, universe).alias(f"p_{name}")]
    # A key has few rows, each of few bytes: they are shuffled as they are, not as a wide row of partial results each.
    narrow = placed.select(*groups, key, "scope", "signal", "total", "pct").repartition(*groups, key)
    return narrow.groupBy(*groups, key).agg(*columns)


def dealt_percentiles(frame: DataFrame, groups: Sequence[str], signals: Sequence[str], *, sector: str | None = None,
                      minimum_group: int = 20, sector_exclusions: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``signal_percentiles`` as columns of rows whose groups are whole in their tasks: a window a scope, no shuffle, no join."""
    kept = frame.columns
    frame = frame.withColumn("__sector", F.coalesce(F.col(sector), F.lit("")) if sector else F.lit(""))
    for name in signals:
        frame = frame.withColumn("__v", F.when(_applicable(F.col("__sector"), name, sector_exclusions or {}), finite(name)))
        for scope, keys in (("u", []), ("l", ["__sector"])):
            n, below, total = ladder_over([*groups, *keys], "__v")
            frame = frame.select("*", *[c.alias(f"__{scope}{i}") for i, c in enumerate((n, below, total))])
        universe, local = (percent_spread(f"__{scope}0", f"__{scope}1", f"__{scope}2") for scope in "ul")
        large = (F.col("__sector") != UNIVERSE) & (F.col("__l2") >= minimum_group)
        percentiles = {f"u_{name}": universe, f"p_{name}": F.coalesce(F.when(large, local), universe)}
        kept = [*kept, *percentiles]
        frame = frame.withColumns(percentiles).select(*kept, "__sector")
    return frame.drop("__sector")


def score_cross_section(frame: DataFrame, groups: Sequence[str], key: str, model: Mapping, *,
                        sector: str | None = "sector", dealt: bool = False) -> DataFrame:
    """Score every row against its cross-section with one model.

    Adds ``<prefix>``, ``_confidence``, ``_excluded``, ``_exclusion_reasons``
    and ``pct_<signal>``. Percentiles are rounded to 2 before weighting; a
    signal that does not apply to a sector leaves the score but stays in the
    confidence denominator. ``(groups, key)`` must be unique. ``dealt``: see ``ranking.in_groups``.
    """
    signals: Mapping[str, tuple[float, str]] = model["signals"]
    present = [name for name in signals if name in frame.columns]
    rules = [rule for rule in model["exclusions"] if rule[0] in frame.columns]
    wanted = list(dict.fromkeys([*present, *[rule[0] for rule in rules]]))
    prefix = model["prefix"]
    rules_of_groups = {
        "sector": sector, "minimum_group": model["minimum_group"], "sector_exclusions": model["sector_exclusions"]}
    ranked = dealt_percentiles(frame, groups, wanted, **rules_of_groups) if dealt \
        else signal_percentiles(frame, groups, key, wanted, **rules_of_groups)
    hits, reasons = [], []
    for name, below, above, reason in rules:
        universe = F.col(f"u_{name}")
        hit = F.lit(False)
        if below is not None:
            hit = hit | (universe < below)
        if above is not None:
            hit = hit | (universe > above)
        hit = F.coalesce(hit, F.lit(False))
        hits.append(hit)
        reasons.append(F.when(hit, F.lit(reason)))
    excluded = hits[0] if hits else F.lit(False)
    for hit in hits[1:]:
        excluded = excluded | hit
    weighted, available = F.lit(0.0), F.lit(0.0)
    percentiles = {}
    for name in present:
        weight, direction = signals[name]
        local = F.col(f"p_{name}")
        value = half_even(100.0 - local if direction == "lower" else local, 2)
        percentiles[f"pct_{name}"] = value
        weighted = weighted + F.coalesce(value * weight, F.lit(0.0))
        available = available + F.when(value.isNotNull(), weight).otherwise(0.0)
    total = float(sum(weight for weight, _ in signals.values()))
    confidence = half_even(available / total * 100.0, 2)
    scored = ranked.select(
        *(frame.columns if dealt else [*groups, key]),
        *[value.alias(name) for name, value in percentiles.items()],
        confidence.alias("__confidence"), excluded.alias("__excluded"),
        F.array_join(F.array_compact(F.array(*reasons)), "; ").alias("__reasons") if reasons
        else F.lit("").alias("__reasons"),
        half_even(weighted / F.nullif(available, F.lit(0.0)), 2).alias("__raw"),
    )
    joined = scored if dealt else frame.join(scored, [*groups, key], "left")
    sure = F.coalesce("__confidence", F.lit(0.0))
    barred = F.coalesce("__excluded", F.lit(False))
    return joined.withColumns({
        prefix: F.when(~barred & (sure >= model["minimum_confidence"]), F.col("__raw")),
        f"{prefix}_confidence": sure,
        f"{prefix}_excluded": barred,
        f"{prefix}_exclusion_reasons": F.coalesce("__reasons", F.lit("")),
    }).drop("__confidence", "__excluded", "__reasons", "__raw")


def model_rank(scored: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """Adds ``<score>_rank``: 1 for the best, ties share the smallest rank, null when unscored."""
    placed = attach_ladder(scored, groups, score, "__r_")
    rank = descending_minimum_rank("__r_n", "__r_below", "__r_total")
    return placed.withColumn(f"{score}_rank", rank).drop("__r_n", "__r_below", "__r_total")


def breakdown(scored: DataFrame, model: Mapping, keys: Sequence[str], sector: str = "sector") -> DataFrame:
    """One row per (keys, signal): points, availability and applicability."""
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("factor"), F.col(name).cast("double").alias("raw_value"),
            F.col(f"pct_{name}").alias("percentile"), F.lit(weight).alias("max_points"),
            _applicable(F.coalesce(F.col(sector), F.lit("")), name, model["sector_exclusions"]).alias("applicable"),
        )
        for name, (weight, _) in model["signals"].items() if name in scored.columns
    ])
    long = scored.select(*keys, F.explode(entries).alias("f")).select(*keys, "f.*")
    available = F.col("percentile").isNotNull()
    return long.withColumns({
        "available": available,
        "points": half_even(F.coalesce(F.col("percentile") / 100.0 * F.col("max_points"), F.lit(0.0)), 2),
        "data_quality": F.when(~F.col("applicable"), "not_applicable").when(available, "fresh").otherwise("missing"),
    })
