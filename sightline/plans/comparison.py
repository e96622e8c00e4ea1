"""Frozen model scores against resolved outcomes: each model on its own names, and all models on the names they share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import stats
from sightline.functions.scalars import finite
from sightline.session import cut

#: Endings of columns that belong to a score but are none.
NOT_SCORES = ("_confidence", "_rank", "_excluded", "_breakdown", "_reasons", "_version")
NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")
COMMON, OWN = "common", "own"


def score_columns(rows: DataFrame) -> list[str]:
    """Every numeric ``score_`` column that is a model's score, by the schema."""
    return [name for name, kind in rows.dtypes if name.startswith("score_") and not name.endswith(NOT_SCORES)
            and (kind in NUMBERS or kind.startswith("decimal"))]


def frozen_scores(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, model, score: one row for every score that is a finite number. A table without scores gives no rows."""
    names = score_columns(rows)
    entries = F.array(*[F.struct(F.lit(name).alias("model"), finite(name).alias("score")) for name in names]).cast(
        "array<struct<model:string,score:double>>")
    return rows.select(*keys, F.explode(entries).alias("s")).select(*keys, "s.*").where("score is not null")


def model_comparison(scores: DataFrame, outcomes: DataFrame, groups: Sequence[str], key: str, minimum: int = 20) -> DataFrame:
    """groups, scope, model, resolved, ic: rank correlation of scores(groups, key, model, score) with outcomes(groups, key, excess).

    Scope ``own`` takes all names that a model scored, ``common`` the names that every model of the group scored, so a
    difference in coverage can't pass for skill; it needs two models. Fewer than ``minimum`` names give no correlation. A name that was not
    resolved (no finite excess) counts nowhere.
    """
    if not groups:
        whole = [rows.withColumn("__all", F.lit(0)) for rows in (scores, outcomes)]
        return model_comparison(*whole, ["__all"], key, minimum).drop("__all")
    resolved = outcomes.where(finite("excess").isNotNull()).select(*groups, key, F.col("excess").cast("double").alias("excess"))
    pairs = cut(scores.join(resolved, [*groups, key]))
    present = pairs.groupBy(*groups).agg(F.countDistinct("model").alias("models")).where("models > 1")
    held = pairs.groupBy(*groups, key).agg(F.countDistinct("model").alias("scored"))
    shared = held.join(present, list(groups)).where("scored = models").select(*groups, key)
    both = pairs.withColumn("scope", F.lit(OWN)).unionByName(pairs.join(shared, [*groups, key]).withColumn("scope", F.lit(COMMON)))
    return stats.rank_correlation(both, [*groups, "scope", "model"], "score", "excess", minimum=minimum).withColumnRenamed("pairs", "resolved")
