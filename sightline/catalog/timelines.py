"""History, insider and cohort queries: J10, J11, J12, A16, A30, A39, A46, P13, P14, P16, R7, U2, U3, W35, W36, X31."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.rows import QUEUE_SQL, queue_rows
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.operators import history, insiders, queue
from sightline.plans import cohorts
from sightline.session import cut

RUNS_SQL = """rr AS (SELECT *, CASE WHEN status = 'OK' THEN row_number() OVER (PARTITION BY run_id, status ORDER BY discovery_score DESC, ticker) END AS rank FROM runs),
  pr AS (SELECT * FROM (SELECT lag(run_id) OVER (ORDER BY run_id) AS old_run_id, run_id AS new_run_id FROM (SELECT DISTINCT run_id FROM runs)) WHERE old_run_id IS NOT NULL),
  o AS (SELECT rr.*, old_run_id, new_run_id FROM rr JOIN pr ON run_id = old_run_id), n AS (SELECT rr.*, old_run_id, new_run_id FROM rr JOIN pr ON run_id = new_run_id),
  df AS (SELECT COALESCE(o.old_run_id, n.old_run_id) AS old_run_id, COALESCE(o.new_run_id, n.new_run_id) AS new_run_id, COALESCE(o.ticker, n.ticker) AS ticker, o.status AS old_status, n.status AS new_status, o.rank AS old_rank, n.rank AS new_rank, o.rank - n.rank AS rank_change,
    round_even((n.discovery_score - o.discovery_score) * 1e6, 0) / 1e6 AS score_change, CASE WHEN o.status IS NULL THEN 'entrant' WHEN n.status IS NULL THEN 'exit' ELSE 'retained' END AS presence
    FROM o FULL JOIN n ON n.ticker = o.ticker AND n.new_run_id = o.new_run_id)"""


def compared(v: Views):
    ranked = cut(history.with_ranks(cut(v.runs)))
    return history.compare_runs(ranked, history.consecutive_pairs(ranked))


@register("j12_run_diff", "runs", "WITH " + RUNS_SQL + """ SELECT old_run_id, new_run_id, ticker, presence, old_rank, new_rank, rank_change, round_even(score_change * 100, 0) / 100 AS score_change, COALESCE(nullif(array_to_string(list_filter([CASE WHEN presence <> 'retained' THEN presence END,
    CASE WHEN presence = 'retained' AND old_status <> new_status THEN 'status_transition' END, CASE WHEN rank_change <> 0 THEN 'rank_change' END, CASE WHEN score_change <> 0 THEN 'score_change' END], lambda x: x IS NOT NULL), '|'), ''), 'unchanged') AS change_types FROM df""")
def _(v: Views):
    return compared(v).select("old_run_id", "new_run_id", "ticker", "presence", "old_rank", "new_rank", "rank_change", half_even("score_change", 2).alias("score_change"),
                              F.array_join("change_types", "|").alias("change_types"))


@register("a39_status_transitions", "runs", "WITH " + RUNS_SQL + " SELECT old_run_id, new_run_id, old_status, new_status, count(*) AS count FROM df WHERE presence = 'retained' GROUP BY ALL")
def _(v: Views):
    return history.status_transitions(compared(v))


@register("a39_composition_changes", "runs", "WITH " + RUNS_SQL + """, c AS (SELECT run_id, sector, count(*) AS n FROM runs GROUP BY 1, 2),
  s AS (SELECT old_run_id, new_run_id, sector, n AS a, 0 AS b FROM c JOIN pr ON run_id = old_run_id UNION ALL SELECT old_run_id, new_run_id, sector, 0, n FROM c JOIN pr ON run_id = new_run_id)
  SELECT old_run_id, new_run_id, sector, CAST(sum(a) AS BIGINT) AS old_count, CAST(sum(b) AS BIGINT) AS new_count, CAST(sum(b) - sum(a) AS BIGINT) AS change FROM s GROUP BY 1, 2, 3""")
def _(v: Views):
    return history.composition_changes(v.runs, history.consecutive_pairs(v.runs), "sector")


@register("r07_rank_movers", "runs", "WITH " + RUNS_SQL + """, m AS (SELECT old_run_id, new_run_id, ticker, old_rank, new_rank, rank_change, row_number() OVER (PARTITION BY new_run_id ORDER BY rank_change DESC, ticker DESC) AS up,
    row_number() OVER (PARTITION BY new_run_id ORDER BY rank_change, ticker) AS down FROM df WHERE rank_change <> 0)
  SELECT 'gain' AS side, old_run_id, new_run_id, ticker, old_rank, new_rank, rank_change FROM m WHERE up <= 10 UNION ALL SELECT 'decline', old_run_id, new_run_id, ticker, old_rank, new_rank, rank_change FROM m WHERE down <= 10""")
def _(v: Views):
    rows = cut(compared(v))
    return history.rank_movers(rows, True).withColumn("side", F.lit("gain")).unionByName(
        history.rank_movers(rows, False).withColumn("side", F.lit("decline")))


@register("w35_ticker_timeline", "runs", "WITH " + RUNS_SQL + """, t AS (SELECT ticker, run_id, rank, status, lag(rank) OVER w - rank AS rank_change, COALESCE(lag(status) OVER w <> status, FALSE) AS tr FROM rr WINDOW w AS (PARTITION BY ticker ORDER BY run_id))
  SELECT ticker, count(*) AS appearances, min(run_id) AS first_seen, max(run_id) AS latest_seen, min(rank) AS best_rank, max(rank) AS worst_rank, CAST(sum(CAST(tr AS INTEGER)) AS BIGINT) AS status_transition_count FROM t GROUP BY 1""")
def _(v: Views):
    return history.timeline_summary(history.timeline(history.with_ranks(cut(v.runs))))


@register("w36_compatible_pair", "runs", """WITH u AS (SELECT run_id, count(*) // 50 AS universe_size FROM runs GROUP BY 1)
  SELECT b.run_id AS new_run_id, a.run_id AS old_run_id, b.universe_size FROM u b JOIN u a ON a.universe_size = b.universe_size AND a.run_id < b.run_id ORDER BY 1 DESC, 2 DESC LIMIT 1""")
def _(v: Views):
    sizes = v.runs.groupBy("run_id").agg(F.floor(F.count(F.lit(1)) / 50).alias("universe_size")).withColumn("completed_count", F.col("universe_size"))
    return history.latest_compatible_pair(sizes).select("new_run_id", "old_run_id", "universe_size")


@register("a46_history_summary", "runs", """SELECT count(DISTINCT run_id) AS runs, count(*) AS results, max(run_id) AS latest_run_id FROM runs""")
def _(v: Views):
    return history.history_summary(v.runs)


@register("a30_insider_signals", "tx", """WITH g AS (SELECT DISTINCT issuer, filed + CAST(issuer % 3 AS INTEGER) AS as_of FROM tx)
  SELECT g.issuer, CAST(as_of AS VARCHAR) AS as_of, CAST(count(*) FILTER (filed > as_of - 7 AND kind = 'purchase') AS DOUBLE) AS purchases_short, CAST(count(*) FILTER (filed > as_of - 7 AND kind = 'sale') AS DOUBLE) AS sales_short,
    CAST(count(DISTINCT CASE WHEN filed > as_of - 7 AND kind = 'purchase' THEN owner END) AS DOUBLE) AS buyers_short, CAST(count(*) FILTER (filed > as_of - 7 AND kind = 'purchase' AND officer) AS DOUBLE) AS officer_short,
    round_even((COALESCE(sum(value) FILTER (filed > as_of - 14 AND kind = 'purchase'), 0) - COALESCE(sum(value) FILTER (filed > as_of - 14 AND kind = 'sale'), 0)) * 100, 0) / 100 AS net_value_long,
    CAST(as_of - max(filed) FILTER (kind = 'purchase') AS DOUBLE) AS days_since FROM g JOIN tx ON tx.issuer = g.issuer AND filed <= as_of GROUP BY 1, 2, as_of""")
def _(v: Views):
    grid = v.tx.select("issuer", F.date_add("filed", (F.col("issuer") % 3).cast("int")).alias("as_of")).distinct()
    out = insiders.signals_as_of(grid, v.tx, 7, 14)
    return out.select("issuer", F.col("as_of").cast("string").alias("as_of"), F.col("ins_purchase_count_short").alias("purchases_short"),
                      F.col("ins_sale_count_short").alias("sales_short"), F.col("ins_distinct_buyers_short").alias("buyers_short"),
                      F.col("ins_officer_purchase_count_short").alias("officer_short"), half_even("ins_net_value_long", 2).alias("net_value_long"),
                      F.col("ins_days_since_last_purchase").alias("days_since"))


@register("j11_insider_supplement", "tx", """SELECT issuer, count(*) AS n FROM tx WHERE accession % 3 <> 0 OR filed > DATE '2024-01-20' GROUP BY 1""")
def _(v: Views):
    held = v.tx.where(F.col("accession") % 3 != 0)
    return insiders.supplement(held, v.tx, "2024-01-20").groupBy("issuer").agg(F.count(F.lit(1)).alias("n"))


@register("x31_quarter_end", "", """SELECT strftime(o_orderdate, '%Y') || 'q' || quarter(o_orderdate) AS label, CAST(last_day(CAST(date_trunc('quarter', max(o_orderdate)) + INTERVAL 2 MONTH AS DATE)) AS VARCHAR) AS quarter_end FROM orders GROUP BY 1""")
def _(v: Views):
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit("q"), F.quarter("o_orderdate").cast("string"))
    return v.table("orders").select(label.alias("label")).distinct().withColumn("quarter_end", insiders.quarter_end(F.col("label")).cast("string"))


MEMBER_SQL = """mb AS (SELECT l.ticker, benchmark, sector, CAST(min(d) + 100 + CAST(l.ticker % 7 AS INTEGER) AS DATE) AS baseline FROM listing l JOIN px ON px.ticker = l.ticker GROUP BY 1, 2, 3),
  hz AS (SELECT mb.*, horizon, CAST(baseline + days AS DATE) AS eligible FROM mb, (VALUES ('1M', 30), ('3M', 91), ('6M', 182), ('1Y', 365)) h(horizon, days)),
  rs AS (SELECT hz.*, (SELECT max_by(close, d) FROM px WHERE px.ticker = hz.ticker AND d <= baseline AND d >= baseline - 3) AS ta, (SELECT max_by(close, d) FROM px WHERE px.ticker = hz.ticker AND d <= eligible AND d >= eligible - 3) AS tf,
    (SELECT max_by(close, d) FROM bench b WHERE b.benchmark = hz.benchmark AND d <= baseline AND d >= baseline - 3) AS ba, (SELECT max_by(close, d) FROM bench b WHERE b.benchmark = hz.benchmark AND d <= eligible AND d >= eligible - 3) AS bf FROM hz),
  rv AS (SELECT ticker, sector, horizon, CASE WHEN eligible > DATE '1996-02-01' THEN 'pending' WHEN ta IS NULL THEN 'unresolved' WHEN tf IS NULL THEN 'unresolved_stale' WHEN ba IS NULL OR bf IS NULL THEN 'resolved_without_benchmark' ELSE 'resolved' END AS status,
    CASE WHEN eligible <= DATE '1996-02-01' THEN (tf / ta - 1) * 100 - (bf / ba - 1) * 100 END AS x FROM rs)"""


def resolved(v: Views):
    first = v.px.groupBy("ticker").agg(F.min("d").alias("f"))
    members = v.listing.join(first, "ticker").select(
        "ticker", "benchmark", "sector", F.date_add("f", (F.col("ticker") % 7 + 100).cast("int")).alias("baseline"))
    return cohorts.resolve(cohorts.freeze(members), v.px, v.bench, "1996-02-01", 3)


@register("p14_resolve_cohort", "px bench listing", "WITH " + MEMBER_SQL + f" SELECT ticker, horizon, status, {r('x', 4)} AS excess_return_percent FROM rv")
def _(v: Views):
    return resolved(v).select("ticker", "horizon", "status", "excess_return_percent")


def _summary_sql(by: str) -> str:
    """Cohort figures per ``by`` over the due rows ``rd`` (status, x)."""
    return f""", rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY x) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM rd WHERE x IS NOT NULL),
  tm AS (SELECT {by}, {r('avg(x)', 4)} AS trimmed_mean FROM rk WHERE n < 3 OR (k > greatest(floor(n * 0.02), 1) AND k <= n - greatest(floor(n * 0.02), 1)) GROUP BY ALL),
  st AS (SELECT {by}, {r('quantile_cont(x, 0.5)', 4)} AS median_excess, {r('avg(x)', 4)} AS mean_excess, {r('count(*) FILTER (x > 0)::DOUBLE / count(*) * 100.0', 4)} AS win_rate FROM rk GROUP BY ALL),
  ct AS (SELECT {by}, count(*) AS candidates, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status LIKE 'unresolved%') AS unresolved,
    {r("count(*) FILTER (status LIKE 'resolved%')::DOUBLE / count(*) * 100", 2)} AS resolution_percent FROM rd GROUP BY ALL),
  sm AS (SELECT * FROM ct LEFT JOIN st USING ({by}) LEFT JOIN tm USING ({by}))"""


DUE_SQL = MEMBER_SQL + f""", rd AS (SELECT horizon, ticker % 5 AS label, CASE WHEN ticker % 5 < 2 THEN 'selected' WHEN ticker % 5 < 4 THEN 'control' END AS side, status, {r('x', 4)} AS x FROM rv WHERE status <> 'pending')"""


@register("a16_cohort_summary", "px bench listing", "WITH " + DUE_SQL + _summary_sql("horizon") + " SELECT * FROM sm")
def _(v: Views):
    return cohorts.cohort_summary(cut(resolved(v)), ["horizon"])


@register("a17_selected_minus_control", "px bench listing", "WITH " + DUE_SQL.replace("status <> 'pending'", "status <> 'pending' AND ticker % 5 < 4") + _summary_sql("horizon, side") + f"""
  SELECT horizon, COALESCE(s.resolved, 0) AS selected_resolved, COALESCE(c.resolved, 0) AS control_resolved, {", ".join(f"{r(f's.{x} - c.{x}', 2)} AS {x}_difference" for x in cohorts.FIGURES)},
    COALESCE(s.resolved, 0) >= 5 AND COALESCE(c.resolved, 0) >= 5 AS comparable FROM (SELECT * FROM sm WHERE side = 'selected') s FULL JOIN (SELECT * FROM sm WHERE side = 'control') c USING (horizon)""")
def _(v: Views):
    rows = resolved(v).withColumn("label", (F.col("ticker") % 5).cast("string"))
    return cohorts.selected_minus_control(cut(rows), "label", ["0", "1"], ["2", "3"], ["horizon"])


@register("p13_cohort_labels", "xs quotes", "WITH " + QUEUE_SQL + """ SELECT ticker, CASE WHEN ranking_basis = 'score_v3' AND research_rank <= 25 THEN 'queue_top_n' WHEN ranking_basis = 'score_v3' THEN 'v3_quintile_' || v3_quintile
    WHEN ranking_basis IN ('duplicate_listing', 'below_liquidity_floor', 'investment_fund') THEN ranking_basis WHEN score_v3_excluded THEN 'v3_excluded' WHEN ranking_basis = 'score_v2' THEN 'v2_fallback' ELSE 'official_fallback' END AS classification FROM qg""")
def _(v: Views):
    return cohorts.classify_queue(cut(queue.research_queue(queue_rows(v)))).select("ticker", "classification")


@register("u02_due_horizons", "px listing", """WITH mb AS (SELECT l.ticker, min(d) AS b FROM listing l JOIN px ON px.ticker = l.ticker GROUP BY 1)
  SELECT ticker, horizon FROM mb, (VALUES ('1M', 30), ('3M', 91), ('6M', 182), ('1Y', 365)) h(horizon, days) WHERE b + days <= DATE '1995-09-01' AND NOT (ticker % 2 = 0 AND horizon = '1M')""")
def _(v: Views):
    members = cohorts.freeze(v.px.groupBy("ticker").agg(F.min("d").alias("baseline")))
    done = members.where((F.col("ticker") % 2 == 0) & (F.col("horizon") == "1M"))
    return cohorts.due_horizons(members, done, "1995-09-01").select("ticker", "horizon")
