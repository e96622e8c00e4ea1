"""The whole point-in-time panel: prices, filed facts and insider filings as each month-end knew them.

Every source is brought to one row per (ticker, d), so the last joins share that key and one exchange. Facts and insider
filings are read once for all dates; no date meets a whole history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions.scalars import half_even, positive
from sightline.operators import fundamentals, insiders
from sightline.plans import backtest
from sightline.session import cut


def filed_signals(rows: DataFrame, bars: DataFrame, filers: DataFrame, facts: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Signals of filed facts per row of rows(ticker, d, start_close), and the correction of the share unit.

    ``filers``: ticker, company, market_cap (today's), same_currency. A filer in another currency than its listing has no
    price, so no ratios to market cap: past exchange rates are not replayed. ``share_unit_factor`` compares the cap at the
    last bar with today's, and is 1 within the tolerance. A ticker without a company has nulls and the factor 1.
    """
    known = filers.where(F.col("company").isNotNull())
    asked = rows.join(known, "ticker").select(
        "ticker", "company", F.col("d").alias("as_of"), F.when(F.col("same_currency"), positive("start_close")).alias("price"),
        F.lit(False).alias("final"))
    closing = bars.groupBy("ticker").agg(F.max("d").alias("as_of"), F.max_by("close", "d").alias("close"))
    ending = closing.join(known, "ticker").select("ticker", "company", "as_of", positive("close").alias("price"), F.lit(True).alias("final"))
    grid = cut(asked.union(ending).withColumn("supplied_cap", F.lit(None).cast("double")))
    signals = cut(fundamentals.signals_as_of(grid, facts, splits))
    numbers = [name for name, kind in signals.dtypes if name.startswith("pit_") and kind == "double"]
    rounded = signals.withColumns({name: half_even(name, 6) for name in numbers})
    measured = [name for name in rounded.columns if name.startswith("pit_")]
    today = rounded.where("final").join(known.select("ticker", "market_cap"), "ticker").select(
        "ticker", fundamentals.share_unit_factor(F.col("market_cap"), F.col("pit_market_cap")).alias("share_unit_factor"))
    past = rounded.where("not final").select("ticker", F.col("as_of").alias("d"), *measured)
    return rows.select("ticker", "d").join(past, ["ticker", "d"], "left").join(today, "ticker", "left").withColumn(
        "share_unit_factor", F.coalesce("share_unit_factor", F.lit(1.0)))


def full_observations(bars: DataFrame, bench: DataFrame, listing: DataFrame, facts: DataFrame, tx: DataFrame,
                      splits: DataFrame | None = None, settings: Mapping | None = None, data_through: str | None = None) -> DataFrame:
    """One row per (period, ticker): price features, returns, ``pit_`` and ``ins_`` signals, and the gate of the universe.

    ``listing``: ticker, benchmark, sector, market_cap, company, issuer, same_currency. ``facts``, ``splits`` and ``tx`` as
    in ``fundamentals.signals_as_of`` and ``insiders.signals_as_of``. ``gate`` is inside_band, outside_band or
    below_liquidity_floor, by the market cap at the date. An empty history of any source leaves its signals null.
    """
    rules = {**C.BACKTEST, **(settings or {})}
    members = listing.select("ticker", "benchmark", "sector", "market_cap")
    rows = cut(backtest.observations(bars, bench, members, settings))
    filed = cut(filed_signals(rows, bars, listing.select("ticker", "company", "market_cap", "same_currency"), facts, splits))
    grid = filed.join(listing.select("ticker", "issuer"), "ticker").select(
        "ticker", "issuer", F.col("d").alias("as_of"), F.col("pit_market_cap").alias("market_cap"))
    traded = insiders.signals_as_of(grid, tx, data_through=data_through).drop("issuer", "market_cap").withColumnRenamed("as_of", "d")
    whole = rows.join(filed, ["ticker", "d"], "left").join(traded, ["ticker", "d"], "left")
    last = bars.groupBy("ticker").agg(F.max_by("close", "d").alias("close"))
    return backtest.size_and_liquidity_gate(whole, rules.get("liquidity_floor", 0.0), rules.get("band", (C.MARKET_CAP["minimum"], C.MARKET_CAP["maximum"])), last)


def all_models(panel: DataFrame, models: Sequence[Mapping] = C.MODELS) -> DataFrame:
    """The names inside the band, each period scored with every model."""
    return backtest.scored_observations(cut(panel.where("gate = 'inside_band'")), models)
