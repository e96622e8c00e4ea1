"""Rescoring of a finished run: signals are filled, refreshed or cleared, models applied again, official fields untouched."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.operators import scoring
from sightline.session import cut

#: A row has fundamentals if it has one of these.
EVIDENCE = ("pit_revenue_ttm", "pit_cash", "pit_shares_outstanding")
OFFICIAL = ("discovery_score", "status", "reason_flags", "score_confidence")


def merged_signals(results: DataFrame, fundamentals: DataFrame, insiders: DataFrame, prices: DataFrame | None = None, *,
                   countries: Sequence[str] = ("US",), refresh: bool = False) -> DataFrame:
    """Results with signals as of the run's completion, and what happened to each row.

    ``results``: ticker, country, status, latest_close and signals; ``fundamentals``, ``insiders``, ``prices``: one row per
    ticker with data, with the columns that they fill (``prices`` with latest_close). Rows that are not OK, or of other
    countries, stay as they are, but for prices: a row without a close gets close and price signals back where ``prices``
    has a close. Fundamentals are filled where a row has none, refreshed everywhere with ``refresh``, and then cleared where
    the source no longer has the ticker. Insiders are always refreshed. Adds fundamentals_status, insiders_status and
    prices_repaired; a second run over the result changes nothing. Repeated result rows stay repeated.
    """
    pit = [name for name in fundamentals.columns if name != "ticker"]
    ins = [name for name in insiders.columns if name != "ticker"]
    tape = [name for name in prices.columns if name != "ticker"] if prices is not None else []
    pack = lambda rows, names, name: rows.select("ticker", F.struct(*names).alias(name))
    joined = results.join(pack(fundamentals, pit, "__f"), "ticker", "left").join(pack(insiders, ins, "__i"), "ticker", "left")
    if prices is not None:
        joined = joined.join(pack(prices, tape, "__p"), "ticker", "left")
    for name, kind in [*fundamentals.dtypes, *insiders.dtypes, *(prices.dtypes if prices is not None else [])]:
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(kind))
    for name in ("fundamentals_status", "insiders_status"):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast("string"))
    fine = F.coalesce(F.col("status") == "OK", F.lit(False))
    ours = fine & F.coalesce(F.upper("country").isin(*[country.upper() for country in countries]), F.lit(False))
    has = F.lit(False)
    for name in [name for name in EVIDENCE if name in joined.columns]:
        has = has | F.col(name).isNotNull()
    asked = ours & (F.lit(refresh) | ~has)
    staged = joined.withColumns({
        "__fill": asked & F.col("__f").isNotNull(), "__clear": asked & F.col("__f").isNull() & has, "__none": asked & F.col("__f").isNull() & ~has,
        "__known": ours & F.col("__i").isNotNull(), "__unknown": ours & F.col("__i").isNull(),
        "prices_repaired": fine & F.col("latest_close").isNull() & F.col("__p.latest_close").isNotNull() if prices is not None else F.lit(False)})
    changed = {name: F.when(F.col("__fill"), F.col(f"__f.{name}")).when(~F.col("__clear"), F.col(name)) for name in pit}
    changed |= {name: F.when(F.col("__known"), F.col(f"__i.{name}")).otherwise(F.col(name)) for name in ins}
    changed |= {name: F.when(F.col("prices_repaired"), F.col(f"__p.{name}")).otherwise(F.col(name)) for name in tape}
    changed["fundamentals_status"] = F.when(F.col("__fill"), "rescored").when(F.col("__clear"), "cleared: source no longer resolves").when(
        F.col("__none"), F.coalesce("fundamentals_status", F.lit("unavailable: not cached"))).otherwise(F.col("fundamentals_status"))
    changed["insiders_status"] = F.when(F.col("__known"), "rescored").when(F.col("__unknown"), "no_data").otherwise(F.col("insiders_status"))
    changed["outcome"] = F.when(~fine, "not_scored").when(~ours, "not_applicable").when(F.col("__fill"), "fundamentals_filled").when(
        F.col("__clear"), "fundamentals_cleared").when(F.col("__none"), "fundamentals_unavailable").otherwise("fundamentals_kept")
    merged = staged.withColumns(changed)
    return merged.drop(*[name for name in merged.columns if name.startswith("__")])


def rescored(results: DataFrame, merged: DataFrame, groups: Sequence[str], models: Sequence[Mapping] = C.MODELS) -> DataFrame:
    """The merged rows scored anew with every model; refuses a merge that changed an official field.

    ``exceptAll`` compares rows as a multiset, so a lost, added or repeated row is found as well.
    """
    official = ["ticker", *groups, *[name for name in OFFICIAL if name in results.columns]]
    merged = cut(merged)
    before, after = results.select(*official), merged.select(*official)
    if not before.exceptAll(after).isEmpty() or not after.exceptAll(before).isEmpty():
        raise ValueError("Rescoring changed an official field or the rows of the run.")
    fine = merged.where("status = 'OK'")
    for model in models:
        fine = scoring.score_cross_section(fine, groups, "ticker", model)
        fine = fine.drop(*[name for name in fine.columns if name.startswith("pct_")])
    rest = merged.where("status is null or status <> 'OK'")
    return fine.unionByName(rest, allowMissingColumns=True)


def rescore_summary(rows: DataFrame) -> DataFrame:
    """Rows of each outcome, repaired prices and insiders per run part."""
    flag = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).cast("long")
    return rows.groupBy("outcome").agg(
        F.count("*").alias("rows"), flag(F.col("prices_repaired")).alias("prices_repaired"),
        flag((F.col("insiders_status") == "rescored") & ~F.col("outcome").isin("not_scored", "not_applicable")).alias("insiders_filled"))
