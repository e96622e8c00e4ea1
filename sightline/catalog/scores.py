"""Rank conventions and cross-sectional scores: W24, R3, P2, P3, X34, A5, A8, A9, A11, A21."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import config as C
from sightline.catalog.prices import FEATURES_SQL, LAST_SQL, features, latest
from sightline.catalog.registry import register
from sightline.catalog.views import Views, r
from sightline.functions import ranking, stats
from sightline.functions.scalars import half_even
from sightline.operators import prices, scoring
from sightline.session import cut

RANKED_SQL = """rk AS (SELECT *, count(*) OVER (PARTITION BY sector, s2 IS NULL) AS n,
    rank() OVER (PARTITION BY sector, s2 IS NULL ORDER BY s2) AS lo,
    count(*) OVER (PARTITION BY sector, s2 IS NULL ORDER BY s2) AS hi,
    row_number() OVER (PARTITION BY sector, s2 IS NULL ORDER BY s2 DESC, ticker) AS pos FROM
    (SELECT ticker, sector, floor(s2 / 100000) AS s2 FROM xs) q)"""
AVERAGE = "(lo + hi) / 2.0"


def coarse(v: Views):
    return v.xs.select("ticker", "sector", F.floor(F.col("s2") / 100000).cast("double").alias("s2"))


def _convention(name: str, sql: str, build):
    @register(name, "xs", f"WITH {RANKED_SQL} SELECT ticker, CASE WHEN s2 IS NOT NULL THEN {sql} END AS pct FROM rk")
    def plan(v: Views):
        placed = ranking.attach_ladder(coarse(v), ["sector"], "s2")
        return placed.select("ticker", half_even(build(), 6).alias("pct"))


_convention("rank_a_percent_spread", r(f"CASE WHEN n = 1 THEN 50 ELSE ({AVERAGE} - 1) / (n - 1) * 100 END", 6),
            ranking.percent_spread)
_convention("rank_b_percent_rounded", r(f"CASE WHEN n = 1 THEN 100 ELSE ({AVERAGE} - 1) / (n - 1) * 100 END", 2),
            lambda: ranking.percent_spread(alone=100.0, digits=2))
_convention("rank_c_at_or_below", r("CASE WHEN n = 1 THEN 100 ELSE (hi - 1) / (n - 1) * 100 END", 2),
            ranking.percent_at_or_below)
_convention("rank_d_share", r(f"{AVERAGE} / n", 6), ranking.rank_share)
_convention("rank_e_share_percent", r(f"{AVERAGE} / n * 100", 2), lambda: half_even(ranking.rank_share() * 100, 2))


@register("r03_model_rank", "xs", """SELECT ticker, CASE WHEN s2 IS NOT NULL THEN
    rank() OVER (PARTITION BY s2 IS NULL ORDER BY s2 DESC) END AS s2_rank
  FROM (SELECT ticker, floor(s2 / 100000) AS s2 FROM xs) q""")
def _(v: Views):
    return scoring.model_rank(coarse(v), [], "s2").select("ticker", "s2_rank")


@register("rank_positions", "xs", """SELECT ticker, row_number() OVER (PARTITION BY sector ORDER BY s2 DESC NULLS LAST, ticker) AS position,
    count(*) OVER (PARTITION BY sector) AS members FROM (SELECT ticker, sector, floor(s2 / 100000) AS s2 FROM xs) q""")
def _(v: Views):
    order = [F.col("s2").isNull(), -F.col("s2"), F.col("ticker")]
    return ranking.positions(coarse(v), ["sector"], order, total="members").select("ticker", "position", "members")


@register("bucket_conventions", "xs", """WITH p AS (SELECT ticker, row_number() OVER (PARTITION BY sector ORDER BY s2 DESC NULLS LAST, ticker) AS pos,
      count(*) OVER (PARTITION BY sector) AS n FROM (SELECT ticker, sector, floor(s2 / 100000) AS s2 FROM xs) q)
  SELECT ticker, CAST(greatest(ceil(((n - pos + 1) - 1) * 5.0 / (n - 1)) - 1, 0) AS INTEGER) AS edge_bucket,
    CAST(least(floor((pos - 1) * 5 / n), 4) AS INTEGER) AS floor_bucket FROM p""")
def _(v: Views):
    order = [F.col("s2").isNull(), -F.col("s2"), F.col("ticker")]
    placed = ranking.positions(coarse(v), ["sector"], order, total="n")
    return placed.select(
        "ticker",
        ranking.edge_bucket(F.col("n") - F.col("position") + 1, F.col("n"), 5).alias("edge_bucket"),
        ranking.floor_bucket(F.col("position"), F.col("n"), 5).alias("floor_bucket"))


@register("a05_distribution", "xs", f"""SELECT sector, count(s2) AS count, min(s2) AS minimum, {r('quantile_cont(s2, 0.25)', 4)} AS p25,
    {r('quantile_cont(s2, 0.5)', 4)} AS median, {r('quantile_cont(s2, 0.75)', 4)} AS p75, max(s2) AS maximum FROM xs GROUP BY 1""")
def _(v: Views):
    out = stats.distribution(v.xs, ["sector"], "s2")
    return out.select("sector", "count", "minimum", *[half_even(c, 4).alias(c) for c in ("p25", "median", "p75")], "maximum")


@register("a08_winsorised_mean", "xs", f"""WITH q AS (SELECT sector, quantile_cont(s1, 0.02) AS lo, quantile_cont(s1, 0.98) AS hi,
    quantile_cont(s1, 0.5) AS md FROM xs GROUP BY 1)
  SELECT xs.sector, count(*) AS observations, {r('avg(s1)', 4)} AS mean, {r('max(md)', 4)} AS median,
    {r('avg(least(greatest(s1, lo), hi))', 4)} AS winsorised_mean,
    {r('avg(CASE WHEN s1 > 0 THEN 100.0 ELSE 0 END)', 4)} AS win_rate FROM xs JOIN q ON q.sector = xs.sector GROUP BY 1""")
def _(v: Views):
    out = stats.outcome_summary(v.xs, ["sector"], "s1")
    return out.select("sector", "observations", *[
        half_even(c, 4).alias(c) for c in ("mean", "median", "winsorised_mean", "win_rate")])


@register("a09_trimmed_mean", "xs", f"""WITH p AS (SELECT sector, s1, row_number() OVER (PARTITION BY sector ORDER BY s1) AS k,
      count(*) OVER (PARTITION BY sector) AS n FROM xs)
  SELECT sector, {r('avg(s1)', 4)} AS trimmed_mean FROM p
  WHERE n < 3 OR (k > greatest(floor(n * 0.02), 1) AND k <= n - greatest(floor(n * 0.02), 1)) GROUP BY 1""")
def _(v: Views):
    return stats.trimmed_mean(v.xs, ["sector"], "s1").select("sector", half_even("trimmed_mean", 4).alias("trimmed_mean"))


# Monthly order totals per segment make short calendar series.
MONTHLY_SQL = f"""ms AS (SELECT c_mktsegment AS seg, strftime(o_orderdate, '%Y-%m') AS period,
    {r('avg(o_totalprice) / 1000 - 140', 4)} AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def monthly_series(v: Views):
    return v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("seg"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
    ).agg(half_even(F.avg("o_totalprice") / 1000 - 140, 4).alias("x"))


@register("a11_series_summary", "", f"""WITH {MONTHLY_SQL} SELECT seg, count(*) AS periods, {r('avg(x)', 4)} AS mean,
    {r('stddev_samp(x)', 4)} AS std, {r('avg(x) / stddev_samp(x) * sqrt(count(*))', 2)} AS t_stat,
    {r('avg(CASE WHEN x > 0 THEN 100.0 ELSE 0 END)', 2)} AS positive_share_percent FROM ms GROUP BY 1""")
def _(v: Views):
    return stats.series_summary(monthly_series(v), ["seg"], "x")


def newey_west_sql(source: str, groups: str, value: str, lags: int, order: str = "period") -> str:
    """CTE text: mean and Newey-West t of a series per group, as ``nw``."""
    parts = " ".join(
        f"+ {2.0 * (1.0 - k / (lags + 1))!r}::DOUBLE * COALESCE(sum(dv * l{k}), 0)" for k in range(1, lags + 1))
    lagged = "".join(f", lag(dv, {k}) OVER (PARTITION BY {groups} ORDER BY {order}) AS l{k}" for k in range(1, lags + 1))
    return f"""nd AS (SELECT *, {value} - avg({value}) OVER (PARTITION BY {groups}) AS dv FROM {source} WHERE {value} IS NOT NULL),
      nl AS (SELECT *{lagged} FROM nd),
      nw AS (SELECT {groups}, count(*) AS periods, avg({value}) AS mean,
        CASE WHEN count(*) >= {lags + 3} AND (sum(dv * dv) {parts}) > 0 THEN
          avg({value}) / sqrt((sum(dv * dv) {parts}) / count(*) / count(*)) END AS t FROM nl GROUP BY {groups})"""


@register("a21_newey_west", "", f"""WITH {MONTHLY_SQL}, {newey_west_sql('ms', 'seg', 'x', 5)}
  SELECT seg, periods, {r('mean', 6)} AS mean, {r('t', 4)} AS t FROM nw""")
def _(v: Views):
    return stats.newey_west(monthly_series(v), ["seg"], "period", "x", 5).select(
        "seg", "periods", half_even("mean", 6).alias("mean"), half_even("t", 4).alias("t"))


def score_sql(source: str, groups: str, key: str, model: dict, name: str, columns=None) -> str:
    """SQL CTEs that score ``source`` with ``model``; the last CTE is ``name``."""
    columns = columns or list(model["signals"])
    signals = [s for s in model["signals"] if s in columns]
    rules = [rule for rule in model["exclusions"] if rule[0] in columns]
    wanted = list(dict.fromkeys([*signals, *[rule[0] for rule in rules]]))

    def masked(signal):
        barred = [sector for sector, names in model["sector_exclusions"].items() if signal in names]
        if not barred:
            return signal
        return f"CASE WHEN sector IN ({', '.join(repr(b) for b in barred)}) THEN NULL ELSE {signal} END"

    values = f"{name}_v AS (SELECT {groups}, {key}, COALESCE(sector, '') AS sector, " + ", ".join(
        f"{masked(s)} AS {s}" for s in wanted) + f" FROM {source})"

    def pct(signal, part):
        window = f"PARTITION BY {part}, {signal} IS NULL"
        count = f"count(*) OVER ({window})"
        average = f"(rank() OVER ({window} ORDER BY {signal}) + (count(*) OVER ({window}, {signal}) - 1) / 2.0)"
        return f"CASE WHEN {signal} IS NULL THEN NULL WHEN {count} = 1 THEN 50.0 ELSE ({average} - 1) / ({count} - 1) * 100 END"

    ranked = f"{name}_r AS (SELECT {groups}, {key}, " + ", ".join(
        f"{pct(s, groups)} AS u_{s}, CASE WHEN sector <> '' AND count(*) OVER (PARTITION BY {groups}, sector, {s} IS NULL) >= {model['minimum_group']}"
        f" THEN {pct(s, groups + ', sector')} ELSE {pct(s, groups)} END AS p_{s}" for s in wanted) + f" FROM {name}_v)"
    flipped = {s: r(f"100 - p_{s}" if model["signals"][s][1] == "lower" else f"p_{s}", 2) for s in signals}
    pcts = ", ".join(f"{flipped[s]} AS pct_{s}" for s in signals)
    bars = [
        f"COALESCE({' OR '.join(([f'u_{s} < {below}'] if below is not None else []) + ([f'u_{s} > {above}'] if above is not None else []))}, FALSE)"
        for s, below, above, _ in rules]
    excluded = " OR ".join(bars) or "FALSE"
    reasons = "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {bar} THEN '{rule[3]}' END" for bar, rule in zip(bars, rules)) + "], lambda x: x IS NOT NULL), '; ')" if rules else "''"
    middle = f"{name}_p AS (SELECT {groups}, {key}, {pcts}, ({excluded}) AS ex, {reasons} AS reasons FROM {name}_r)"
    weighted = " + ".join(f"COALESCE(pct_{s} * {model['signals'][s][0]}, 0)" for s in signals)
    available = " + ".join(f"CASE WHEN pct_{s} IS NOT NULL THEN {model['signals'][s][0]} ELSE 0 END" for s in signals)
    total = sum(weight for weight, _ in model["signals"].values())
    prefix = model["prefix"]
    final = f"""{name} AS (SELECT *, CASE WHEN NOT {prefix}_excluded AND aw > 0 AND {prefix}_confidence >= {model['minimum_confidence']}
        THEN {r('ws / aw', 2)} END AS {prefix} FROM (SELECT *, ex AS {prefix}_excluded, reasons AS {prefix}_exclusion_reasons,
        CAST({weighted} AS DOUBLE) AS ws, CAST({available} AS DOUBLE) AS aw, {r(f'({available})::DOUBLE / {total} * 100', 2)} AS {prefix}_confidence
        FROM {name}_p) z)"""
    return ", ".join([values, ranked, middle, final])


@register("w24_sector_percentile", "xs", "WITH " + score_sql("(SELECT 1 AS run, * FROM xs)", "run", "ticker", {
    "prefix": "m", "minimum_group": 250, "minimum_confidence": 0, "sector_exclusions": {}, "exclusions": (),
    "signals": {"s2": (1.0, "higher"), "s4": (1.0, "lower")}}, "sc")
    + f" SELECT ticker, {r('pct_s2', 2)} AS pct_s2, {r('pct_s4', 2)} AS pct_s4 FROM sc")
def _(v: Views):
    ranked = scoring.signal_percentiles(v.xs, [], "ticker", ["s2", "s4"], sector="sector", minimum_group=250)
    # A name without any signal keeps its row with null percentiles.
    return v.xs.select("ticker").join(ranked, "ticker", "left").select(
        "ticker", half_even("p_s2", 2).alias("pct_s2"), half_even(100.0 - F.col("p_s4"), 2).alias("pct_s4"))


XS_MODEL = {
    "prefix": "score", "minimum_group": 20, "minimum_confidence": 50.0,
    "sector_exclusions": {"FURNITURE": ("s4",)},
    "exclusions": (("s1", 20.0, None, "Bottom-quintile balance"), ("s4", None, 80.0, "Top-quintile order")),
    "signals": {"s1": (30.0, "higher"), "s2": (40.0, "higher"), "s3": (20.0, "lower"), "s4": (10.0, "lower")},
}


@register("p02_cross_section_score", "xs", "WITH " + score_sql("(SELECT country AS run, * FROM xs)", "run", "ticker", XS_MODEL, "sc")
          + " SELECT ticker, score, score_confidence, score_excluded, score_exclusion_reasons FROM sc")
def _(v: Views):
    scored = scoring.score_cross_section(v.xs, ["country"], "ticker", XS_MODEL)
    return scored.select("ticker", "score", "score_confidence", "score_excluded", "score_exclusion_reasons")


@register("x34_signal_breakdown", "xs", "WITH " + score_sql("(SELECT country AS run, * FROM xs)", "run", "ticker", XS_MODEL, "sc")
          + ", b AS (" + " UNION ALL ".join(
    f"SELECT sc.ticker, '{s}' AS factor, {'TRUE' if s != 's4' else chr(120) + 's.sector <> ' + repr('FURNITURE')} AS applicable, pct_{s} IS NOT NULL AS available, "
    f"{r(f'COALESCE(pct_{s} / 100.0 * {w}, 0)', 2)} AS points FROM sc JOIN xs ON xs.ticker = sc.ticker" for s, (w, _) in XS_MODEL["signals"].items())
          + ") SELECT *, CASE WHEN NOT applicable THEN 'not_applicable' WHEN available THEN 'fresh' ELSE 'missing' END AS data_quality FROM b")
def _(v: Views):
    scored = scoring.score_cross_section(v.xs, ["country"], "ticker", XS_MODEL)
    return scoring.breakdown(scored, XS_MODEL, ["ticker"]).select(
        "ticker", "factor", "applicable", "available", "points", "data_quality")


# Price model over each listing's last closed month-end; sector groups of five
# suit the number of listings per nation.
PRICE_MODEL = {**C.MODEL_V2, "minimum_group": 5}

LAST_MONTH_SQL = """me AS (SELECT benchmark, max(d) AS d FROM bench b
    WHERE strftime(d, '%Y-%m') < (SELECT max(strftime(d, '%Y-%m')) FROM bench c WHERE c.benchmark = b.benchmark) GROUP BY 1),
  src AS (SELECT 1 AS run, l.sector, f.* FROM listing l JOIN me USING (benchmark) JOIN pf f ON f.ticker = l.ticker AND f.d <= me.d
    QUALIFY row_number() OVER (PARTITION BY l.ticker ORDER BY f.d DESC) = 1)"""


@register("p02_price_model_ranking", "px bench listing", "WITH " + FEATURES_SQL + ", " + LAST_MONTH_SQL + ", "
          + score_sql("src", "run", "ticker", PRICE_MODEL, "sc")
          + """ SELECT ticker, score_v2, score_v2_confidence, CASE WHEN score_v2 IS NOT NULL THEN
            rank() OVER (PARTITION BY score_v2 IS NULL ORDER BY score_v2 DESC) END AS score_v2_rank FROM sc""")
def _(v: Views):
    ends = prices.month_ends(v.bench).groupBy("benchmark").agg(F.max("d").alias("end"))
    listed = v.listing.join(ends, "benchmark").select("ticker", "sector", "end")
    known = features(v).join(listed, "ticker").where(F.col("d") <= F.col("end"))
    scored = scoring.score_cross_section(cut(latest(known)), [], "ticker", PRICE_MODEL)
    scored = cut(scored.select("ticker", "score_v2", "score_v2_confidence"))
    return scoring.model_rank(scored, [], "score_v2")
