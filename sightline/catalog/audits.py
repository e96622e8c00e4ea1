"""Survivorship, rescoring, frozen scores and review checks: A18, A28, A47, F16, P5, P9, X25, X28, X38, X43."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import config as C
from sightline.catalog.registry import register
from sightline.catalog.scores import score_sql
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.operators import review
from sightline.plans import comparison, rescore, survivorship
from sightline.session import cut
from sightline.sources import documents

# --- P9, A28: a customer's month is an observation; customers that left have an exit type and no price -------------------

WINDOWS = {"early": ("1992-01", "1996-12"), "late": ("1997-01", "2003-12")}
MINIMUM, SCORED = 20, 10
MODEL = {**C.MODEL_V3, "sector_exclusions": {}, "signals": {"pit_sales_yield": (60.0, "higher"), "pit_share_change_1y": (40.0, "lower")}}

MONTH_SQL = f"""mo AS MATERIALIZED (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_custkey AS ticker, {r('sum(o_totalprice)', 2)} AS v, count(*) AS k FROM orders GROUP BY 1, 2),
  sg AS (SELECT period, ticker, {r('v / 1e6 - 0.1 * k', 6)} AS pit_operating_margin_ttm, CAST(ticker % 37 AS DOUBLE) AS pit_share_change_1y, {r('v / 7e5', 6)} AS pit_revenue_growth_ttm, v AS pit_revenue_ttm, CASE WHEN ticker % 4 <> 1 THEN v END AS pit_cash, {r('v / 3e5', 6)} AS pit_sales_yield, v FROM mo),
  ex0 AS (SELECT ticker, CASE ticker % 4 WHEN 0 THEN 'bankruptcy' WHEN 1 THEN 'acquired' WHEN 2 THEN 'delisted_noncompliance' ELSE 'other' END AS exit_type FROM (SELECT DISTINCT ticker FROM mo WHERE ticker % 3 = 0)),
  ob0 AS MATERIALIZED (SELECT sg.*, CASE WHEN ticker % 10 <> 7 THEN CAST(ticker % 50 AS DOUBLE) END AS score_v3, ticker % 5 = 1 AS score_v3_excluded, {r('v / 1e5 - 1.5', 4)} AS return_1M FROM sg WHERE ticker % 3 <> 0 AND ticker % 16 <> 1)"""


def month_rows(v: Views):
    rows = v.table("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_custkey").alias("ticker")).agg(
        half_even(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("k"))
    return cut(rows.select(
        "period", "ticker", half_even(F.col("v") / 1e6 - 0.1 * F.col("k"), 6).alias("pit_operating_margin_ttm"), (F.col("ticker") % 37).cast("double").alias("pit_share_change_1y"),
        half_even(F.col("v") / 7e5, 6).alias("pit_revenue_growth_ttm"), F.col("v").alias("pit_revenue_ttm"), F.when(F.col("ticker") % 4 != 1, F.col("v")).alias("pit_cash"),
        half_even(F.col("v") / 3e5, 6).alias("pit_sales_yield"), "v"))


def survivors(v: Views):
    rows = month_rows(v)
    kind = F.when(F.col("ticker") % 4 == 0, "bankruptcy").when(F.col("ticker") % 4 == 1, "acquired").when(F.col("ticker") % 4 == 2, "delisted_noncompliance").otherwise("other")
    dead = rows.where("ticker % 3 = 0").withColumn("exit_type", kind)
    observed = rows.where("ticker % 3 <> 0").withColumns({
        "score_v3": F.when(F.col("ticker") % 10 != 7, (F.col("ticker") % 50).cast("double")), "score_v3_excluded": F.col("ticker") % 5 == 1,
        "return_1M": F.when(F.col("ticker") % 16 != 1, half_even(F.col("v") / 1e5 - 1.5, 4)), "benchmark_return_1M": F.lit(0.5)})
    return cut(survivorship.survivorship_panel(observed, dead, MODEL, WINDOWS, MINIMUM, SCORED))


BOTH = "(SELECT period, 'live:' || ticker AS ticker, '' AS sector, pit_sales_yield, pit_share_change_1y, pit_operating_margin_ttm, pit_revenue_growth_ttm FROM ob0 UNION ALL SELECT period, 'dead:' || sg.ticker, '', pit_sales_yield, pit_share_change_1y, pit_operating_margin_ttm, pit_revenue_growth_ttm FROM sg JOIN ex0 USING (ticker))"
SURVIVE_SQL = MONTH_SQL + ", " + score_sql(BOTH, "period", "ticker", MODEL, "ds", [*MODEL["signals"], *[rule[0] for rule in MODEL["exclusions"]]]) + f""",
  lg0 AS (SELECT period, CAST(ticker AS VARCHAR) AS ticker, CASE WHEN score_v3_excluded THEN 'filter_excluded' WHEN score_v3 IS NOT NULL THEN 'scored' ELSE 'never_scored' END AS grp, NULL::VARCHAR AS exit_type, return_1M AS r FROM ob0
    UNION ALL SELECT sg.period, CAST(sg.ticker AS VARCHAR), CASE WHEN ds.score_v3_excluded THEN 'filter_excluded' WHEN pit_revenue_ttm IS NOT NULL AND pit_cash IS NOT NULL THEN 'scored' ELSE 'never_scored' END, exit_type, NULL FROM sg JOIN ex0 USING (ticker) JOIN ds ON ds.period = sg.period AND ds.ticker = 'dead:' || sg.ticker),
  ok0 AS (SELECT period FROM lg0 WHERE exit_type IS NULL GROUP BY 1 HAVING count(*) >= {MINIMUM} AND count(*) FILTER (grp = 'scored') >= {SCORED}),
  sv0 AS MATERIALIZED (SELECT lg0.*, win FROM lg0 JOIN ok0 USING (period) JOIN (VALUES {", ".join(f"('{n}', '{a}', '{b}')" for n, (a, b) in WINDOWS.items())}) w(win, lo, hi) ON period BETWEEN lo AND hi)"""
RATES = ", ".join(f"('{name}', '{kind}', {rate}::DOUBLE)" for name, rates in survivorship.SCENARIOS.items() for kind, rate in rates.items())


@register("a28_survivorship_bounds", "", "WITH " + SURVIVE_SQL + f""", rt AS (SELECT * FROM (VALUES {RATES}) t(scenario, exit_type, life)),
  sr AS (SELECT 'observed' AS scenario, win, grp, period, r FROM sv0 WHERE exit_type IS NULL UNION ALL SELECT scenario, win, grp, period, r FROM sv0, (SELECT DISTINCT scenario FROM rt) s WHERE exit_type IS NULL
    UNION ALL SELECT scenario, win, grp, period, (pow(1 + life, 1.0 / months) - 1) * 100 FROM (SELECT *, count(*) OVER (PARTITION BY win, ticker) AS months FROM sv0 WHERE exit_type IS NOT NULL) d JOIN rt USING (exit_type)),
  mm AS (SELECT scenario, win, g AS grp, period, avg(r) AS m FROM (SELECT scenario, win, unnest([grp, 'universe']) AS g, period, r FROM sr) GROUP BY 1, 2, 3, 4)
  SELECT scenario, win AS "window", grp AS "group", count(*) AS months, {r('(product(1 + m / 100) - 1) * 100', 4)} AS compounded_percent FROM mm GROUP BY 1, 2, 3""")
def _(v: Views):
    return survivorship.compounded_bounds(survivors(v)).withColumn("compounded_percent", half_even("compounded_percent", 4))


@register("p09_survivorship_counts", "", "WITH " + SURVIVE_SQL + f""", mw AS (SELECT win, count(DISTINCT period) AS months FROM sv0 WHERE exit_type IS NULL GROUP BY 1),
  cw AS (SELECT win, grp, count(*) FILTER (exit_type IS NULL) AS live, count(exit_type) AS dead FROM sv0 GROUP BY 1, 2)
  SELECT win AS "window", grp AS "group", {r('live / months', 1)} AS observed_per_month, {r('dead / months', 1)} AS dead_per_month, {r('100.0 * dead / (live + dead)', 2)} AS dead_share_percent FROM cw JOIN mw USING (win)""")
def _(v: Views):
    return survivorship.group_counts(survivors(v))


@register("p09_exit_types", "", "WITH " + SURVIVE_SQL + """ SELECT win AS "window", exit_type, count(DISTINCT ticker) AS companies FROM sv0 WHERE exit_type IS NOT NULL GROUP BY 1, 2""")
def _(v: Views):
    return survivorship.exit_types(survivors(v))


# --- P5: a run is rescored; sources cover part of the names ---------------------------------------------------------------

RESCORE_MODEL = {**C.MODEL_V3, "minimum_group": 5, "minimum_confidence": 0.0, "sector_exclusions": {}, "exclusions": (("pit_operating_margin_ttm", 20.0, None, "Low margin"),),
                 "signals": {"pit_cash": (50.0, "higher"), "v2_momentum_long": (30.0, "higher"), "ins_net_count_short": (20.0, "higher")}}
RESULT_SQL = f"""rs0 AS (SELECT ticker, sector, CASE WHEN ticker % 4 = 3 THEN 'CA' ELSE 'us' END AS country, CASE ticker % 9 WHEN 0 THEN 'FILTERED' WHEN 4 THEN NULL ELSE 'OK' END AS status, s1 AS discovery_score,
    CASE WHEN ticker % 6 <> 0 THEN s4 END AS latest_close, CASE WHEN ticker % 6 <> 0 THEN {r('s1 / 100', 6)} END AS v2_momentum_long, CASE WHEN ticker % 5 < 2 THEN s2 END AS pit_cash, CASE WHEN ticker % 5 < 2 THEN {r('s1 / 1e4', 6)} END AS pit_operating_margin_ttm FROM xs)"""


def rescore_sql(refresh: bool) -> str:
    asked = "ours" if refresh else "ours AND pit_cash IS NULL"
    return RESULT_SQL + f""", st0 AS (SELECT *, COALESCE(status = 'OK', FALSE) AS fine, COALESCE(status = 'OK', FALSE) AND country = 'us' AS ours, ticker % 7 <> 2 AND ticker % 3 <> 0 AS hf, ticker % 8 < 5 AS hi, ticker % 12 < 10 AS hp FROM rs0),
  fl0 AS (SELECT *, {asked} AND hf AS fill, {asked} AND NOT hf AND pit_cash IS NOT NULL AS clr, {asked} AND NOT hf AND pit_cash IS NULL AS none, fine AND latest_close IS NULL AND hp AS fix FROM st0),
  mg0 AS (SELECT 1 AS run, ticker, sector, status, discovery_score, CASE WHEN fix THEN 7.5 + ticker % 11 ELSE latest_close END AS latest_close, CASE WHEN fix THEN (ticker % 13) / 10.0 ELSE v2_momentum_long END AS v2_momentum_long,
    CASE WHEN fill THEN CAST(ticker % 101 AS DOUBLE) WHEN NOT clr THEN pit_cash END AS pit_cash, CASE WHEN fill THEN CAST(ticker % 17 AS DOUBLE) WHEN NOT clr THEN pit_operating_margin_ttm END AS pit_operating_margin_ttm,
    CASE WHEN ours AND hi THEN CAST(ticker % 5 AS DOUBLE) END AS ins_net_count_short, CASE WHEN fill THEN 'rescored' WHEN clr THEN 'cleared: source no longer resolves' WHEN none THEN 'unavailable: not cached' END AS fundamentals_status,
    CASE WHEN ours AND hi THEN 'rescored' WHEN ours THEN 'no_data' END AS insiders_status, fix AS prices_repaired,
    CASE WHEN NOT fine THEN 'not_scored' WHEN NOT ours THEN 'not_applicable' WHEN fill THEN 'fundamentals_filled' WHEN clr THEN 'fundamentals_cleared' WHEN none THEN 'fundamentals_unavailable' ELSE 'fundamentals_kept' END AS outcome FROM fl0)"""


def results(v: Views):
    t = F.col("ticker")
    return cut(v.xs.select(
        F.lit(1).alias("run"), "ticker", "sector", F.when(t % 4 == 3, "CA").otherwise("us").alias("country"), F.when(t % 9 == 0, "FILTERED").when(t % 9 != 4, "OK").alias("status"),
        F.col("s1").alias("discovery_score"), F.when(t % 6 != 0, F.col("s4")).alias("latest_close"), F.when(t % 6 != 0, half_even(F.col("s1") / 100, 6)).alias("v2_momentum_long"),
        F.when(t % 5 < 2, F.col("s2")).alias("pit_cash"), F.when(t % 5 < 2, half_even(F.col("s1") / 1e4, 6)).alias("pit_operating_margin_ttm")))


def merged(v: Views, run, refresh: bool):
    t = F.col("ticker")
    fundamentals = v.xs.where((t % 7 != 2) & (t % 3 != 0)).select("ticker", (t % 101).cast("double").alias("pit_cash"), (t % 17).cast("double").alias("pit_operating_margin_ttm"))
    insiders = v.xs.where(t % 8 < 5).select("ticker", (t % 5).cast("double").alias("ins_net_count_short"))
    prices = v.xs.where(t % 12 < 10).select("ticker", (7.5 + t % 11).alias("latest_close"), ((t % 13) / 10.0).alias("v2_momentum_long"))
    return rescore.merged_signals(run, fundamentals, insiders, prices, refresh=refresh)


RESCORED = ("ticker", "status", "latest_close", "v2_momentum_long", "pit_cash", "pit_operating_margin_ttm", "ins_net_count_short", "fundamentals_status", "insiders_status", "outcome", "score_v3", "score_v3_excluded")
for _name, _refresh in (("p05_rescore_fill", False), ("p05_rescore_refresh", True)):
    @register(_name, "xs", "WITH " + rescore_sql(_refresh) + ", " + score_sql("(SELECT * FROM mg0 WHERE status = 'OK')", "run", "ticker", RESCORE_MODEL, "rc", [*RESCORE_MODEL["signals"], "pit_operating_margin_ttm"])
              + f" SELECT {', '.join('mg0.' + name for name in RESCORED[:10])}, score_v3, score_v3_excluded FROM mg0 LEFT JOIN rc USING (ticker)")
    def _(v: Views, refresh=_refresh):
        run = results(v)
        return rescore.rescored(run, merged(v, run, refresh), ["run"], (RESCORE_MODEL,)).select(*RESCORED)


@register("p05_rescore_summary", "xs", "WITH " + rescore_sql(True) + """ SELECT outcome, count(*) AS rows, count(*) FILTER (prices_repaired) AS prices_repaired,
  count(*) FILTER (insiders_status = 'rescored' AND outcome NOT IN ('not_scored', 'not_applicable')) AS insiders_filled FROM mg0 GROUP BY 1""")
def _(v: Views):
    return rescore.rescore_summary(merged(v, results(v), True))


# --- X38, A18: models of a frozen cohort -----------------------------------------------------------------------------------

SCORES_SQL = """fz AS (SELECT country, ticker, 'score_a' AS model, CAST(s1 AS DOUBLE) AS score FROM xs UNION ALL SELECT country, ticker, 'score_b', s2 FROM xs WHERE ticker % 4 <> 1 AND s2 IS NOT NULL UNION ALL SELECT country, ticker, 'score_c', CAST(ticker % 23 AS DOUBLE) FROM xs WHERE ticker % 5 <> 2)"""


def frozen(v: Views):
    t = F.col("ticker")
    return comparison.frozen_scores(v.xs.select(
        "country", "ticker", F.col("s1").alias("score_a"), F.when(t % 4 != 1, F.col("s2")).otherwise(float("nan")).alias("score_b"), F.when(t % 5 != 2, (t % 23).cast("int")).alias("score_c"),
        F.lit(1.0).alias("score_a_confidence"), F.lit(1).alias("score_a_rank"), F.lit("v1").alias("score_b_version"), F.lit(True).alias("score_flag"), F.lit("x").alias("score_text")), ["country", "ticker"])


@register("x38_frozen_scores", "xs", "WITH " + SCORES_SQL + f" SELECT country, ticker, model, {r('score', 4)} AS score FROM fz")
def _(v: Views):
    return frozen(v).withColumn("score", half_even("score", 4))


@register("a18_model_comparison", "xs", "WITH " + SCORES_SQL + f""", pr AS (SELECT fz.*, ticker * 7919 % 1009 / 10.0 AS excess FROM fz WHERE ticker % 6 <> 0), cm AS (SELECT country, ticker FROM pr GROUP BY 1, 2 HAVING count(*) = 3),
  bs AS (SELECT 'own' AS scope, * FROM pr UNION ALL SELECT 'common', pr.* FROM pr JOIN cm USING (country, ticker)),
  rk AS (SELECT *, rank() OVER (PARTITION BY country, scope, model ORDER BY score) + (count(*) OVER (PARTITION BY country, scope, model, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY country, scope, model ORDER BY excess) + (count(*) OVER (PARTITION BY country, scope, model, excess) - 1) / 2.0 AS b FROM bs)
  SELECT country, scope, model, count(*) AS resolved, CASE WHEN count(*) >= 20 THEN {r('corr(a, b)', 6)} END AS ic FROM rk GROUP BY 1, 2, 3""")
def _(v: Views):
    outcomes = v.xs.select("country", "ticker", F.when(F.col("ticker") % 6 != 0, F.col("ticker") * 7919 % 1009 / 10.0).alias("excess"))
    return comparison.model_comparison(frozen(v), outcomes, ["country"], "ticker", 20).withColumn("ic", half_even("ic", 6))


# --- F16, X25, X28, X43: evidence documents and reviews ---------------------------------------------------------------------

@register("f16_document_errors", "", """WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, 'https:', 'http:') ELSE url END AS u, page_id % 7 AS k, page_id % 11 AS l FROM pages),
  h AS (SELECT *, lower(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM p)
  SELECT page_id, array_to_string(list_filter([CASE WHEN NOT starts_with(u, 'https://') THEN 'Evidence URLs must use HTTPS.' END, CASE WHEN starts_with(u, 'https://') AND NOT (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org') THEN 'Evidence domain is not allowed' END,
    CASE WHEN k = 1 THEN 'title is required' END, CASE WHEN k = 2 THEN 'publisher is required' END, CASE WHEN k = 3 THEN 'source_type is unsupported' END, CASE WHEN l = 1 THEN 'content_hash must be SHA-256' END,
    CASE WHEN l = 2 THEN 'published_at is required' END, CASE WHEN l = 3 THEN 'published_at must be YYYY-MM-DD' END, CASE WHEN l = 4 THEN 'source is stale' END, CASE WHEN k = 5 THEN 'retrieved_at must be ISO-8601' END], lambda x: x IS NOT NULL), '; ') AS errors FROM h""")
def _(v: Views):
    k, m = F.col("page_id") % 7, F.col("page_id") % 11
    rows = v.table("pages").select(
        "page_id", F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "https:", "http:")).otherwise(F.col("url")).alias("url"),
        F.when(k != 1, "a title").otherwise(" ").alias("title"), F.when(k != 2, "a publisher").alias("publisher"), F.when(k == 3, "blog").otherwise("company_ir").alias("source_type"),
        F.when(m == 1, "abc").otherwise(F.sha2("html", 256)).alias("content_hash"), F.when(m == 3, "soon").when(m == 4, "2020-05-05").when(m != 2, "2025-05-05T10:00:00").alias("published_at"),
        F.when(k == 5, "yesterday").otherwise("2026-01-02T03:04:05Z").alias("retrieved_at"))
    return documents.document_errors(rows, ["example.com", "example.org"], "2026-06-01").select("page_id", F.array_join("errors", "; ").alias("errors"))


@register("x25_stable_ids", "xs", f"""SELECT ticker, substr(sha256('{{"acct":' || printf('%.6f', s1) || ',"sector":"' || sector || '","ticker":' || printf('%.6f', ticker::DOUBLE) || ',"total":' || CASE WHEN s2 IS NULL THEN 'null' ELSE printf('%.6f', s2) END || '}}'), 1, 16) AS id FROM xs""")
def _(v: Views):
    return v.xs.select("ticker", review.stable_id({"total": F.col("s2"), "ticker": F.col("ticker"), "sector": F.col("sector"), "acct": F.col("s1")}).alias("id"))


# A conversation is a review of a name; its turns are the cited documents.
REVIEW_SQL = """cv AS (SELECT DISTINCT conv_id AS c FROM conversations),
  d0 AS (SELECT conv_id AS c, CASE WHEN conv_id % 6 = 5 THEN 'tampered' ELSE text END AS body, sha256(text) AS sha, text FROM conversations WHERE text IS NOT NULL AND turn = 0),
  d1 AS (SELECT c, min(text) AS text, bool_and(body = text) AS whole FROM d0 GROUP BY 1),
  nn AS (SELECT c, trim(regexp_replace(substr(text, 3, 30), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS q, text, whole FROM d1),
  e AS (SELECT cv.c, list_filter([CASE WHEN cv.c % 11 = 1 THEN 'verdict is not in the schema' END, CASE WHEN cv.c % 13 = 2 THEN 'deciding_reason is empty' END, CASE WHEN cv.c % 8 = 3 THEN 'evidence_through is not a date' WHEN cv.c % 8 = 4 THEN 'evidence_through is after the anchor date' END,
      CASE WHEN cv.c % 13 = 5 THEN 'deciding_reason contains forbidden content' END, CASE WHEN cv.c % 11 = 2 AND cv.c % 3 <> 0 AND cv.c % 4 <> 2 THEN 'verdict avoid needs a serious finding or a disagreement' END,
      CASE WHEN cv.c % 4 = 3 THEN 'data_check[0]: agrees must be true or false' END, CASE WHEN cv.c % 7 = 6 THEN 'findings[0]: area is not in the schema' END], lambda x: x IS NOT NULL) AS own,
      list_sort(list_filter([CASE WHEN cv.c % 5 = 1 THEN 'data_check: cash is not the packet''s figure' END, CASE WHEN cv.c % 5 = 2 THEN 'data_check: magic is not a figure of the packet' END,
        CASE WHEN nn.c IS NULL OR NOT whole THEN 'findings: cites a hash that is not one of this name''s documents' WHEN length(q) < 10 THEN 'findings: quote is too short' WHEN cv.c % 9 = 8 THEN 'findings: quote is not in the document' END,
        CASE WHEN cv.c % 10 = 9 THEN 'peer_comparison: the peer table has too few peers' END, CASE WHEN cv.c % 10 = 4 THEN 'peer_comparison: odd is not a metric of the peer table' END], lambda x: x IS NOT NULL)) AS linked
    FROM cv LEFT JOIN nn ON nn.c = cv.c)"""


def checked(v: Views):
    c = F.col("c")
    turns = v.table("conversations").where("text is not null and turn = 0").groupBy(F.col("conv_id").alias("c")).agg(F.min("text").alias("text"))
    names = v.table("conversations").select(F.col("conv_id").alias("c")).distinct().join(turns, "c", "left")
    quote = F.when(c % 9 == 8, "words that nobody wrote in here").otherwise(F.substring("text", 3, 30))
    quote = F.when(F.length(F.trim(F.regexp_replace(F.substring("text", 3, 30), r"\s+", " "))) < 10, "short").otherwise(quote)
    agrees = F.when(c % 4 == 2, False).when(c % 4 != 3, True)
    ours = F.when(c % 5 == 1, "12.5").when(c % 5 == 3, "12.0000001").otherwise("12")
    reviews = names.select(
        c.cast("string").alias("ticker"), F.when(c % 11 == 1, "buy").when(c % 11 == 2, "avoid").otherwise("clear").alias("verdict"),
        F.when(c % 13 == 2, " ").when(c % 13 == 5, "Our Price Target is 5").otherwise("sound").alias("deciding_reason"), F.lit("weak demand").alias("bear_case"), F.array(F.lit("?")).alias("unanswered_questions"),
        F.when(c % 8 == 3, "soon").when(c % 8 == 4, "2026-02-02").otherwise("2026-01-01").alias("evidence_through"), F.lit(None).cast("string").alias("written_by"),
        F.array(F.struct(F.when(c % 5 == 2, "magic").otherwise("cash").alias("field"), ours.alias("ours"), agrees.alias("agrees"), F.lit(False).alias("cited"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("quote"))).alias("data_check"),
        F.array(F.struct(F.when(c % 7 == 6, "weather").otherwise("business").alias("area"), F.when(c % 3 == 0, "serious").otherwise("info").alias("severity"), F.lit("said").alias("text"), F.sha2(F.coalesce("text", F.lit("none")), 256).alias("sha256"), quote.alias("quote"))).alias("findings"),
        F.struct(F.lit("partly").alias("discount_explained"), F.lit("t").alias("text"), F.array(F.when(c % 10 == 4, "odd").otherwise("margin")).alias("metrics_cited")).alias("peer_comparison"))
    saved = names.where("text is not null").select(c.cast("string").alias("ticker"), F.sha2("text", 256).alias("sha256"), F.when(c % 6 == 5, "tampered").otherwise(F.col("text")).alias("text"))
    packet = names.select(c.cast("string").alias("ticker"), F.lit("cash").alias("field"), F.lit("12.0").alias("value"))
    peers = names.select(c.cast("string").alias("ticker"), F.when(c % 10 == 9, "insufficient").otherwise("ok").alias("status"), F.array(F.lit("margin"), F.lit("growth")).alias("metrics"))
    return review.check_reviews(reviews, saved, packet, peers, "2026-01-31")


@register("x28_review_errors", "", "WITH " + REVIEW_SQL + " SELECT CAST(c AS VARCHAR) AS ticker, array_to_string(list_concat(own, linked), '; ') AS errors, CASE WHEN len(own) + len(linked) > 0 THEN 'validation_failed' ELSE 'valid' END AS review_status FROM e")
def _(v: Views):
    return checked(v).select("ticker", F.array_join("errors", "; ").alias("errors"), "review_status")


@register("x43_evidence_errors", "", "WITH " + REVIEW_SQL + " SELECT error, count(*) AS reviews FROM (SELECT unnest(linked) AS error FROM e) GROUP BY 1")
def _(v: Views):
    linked = F.filter("errors", lambda text: text.rlike("^(data_check|findings|peer_comparison): "))
    return checked(v).select(F.explode(linked).alias("error")).groupBy("error").agg(F.count("*").alias("reviews"))


@register("a47_review_counts", "", "WITH " + REVIEW_SQL + """ SELECT CASE WHEN len(own) + len(linked) > 0 THEN 'validation_failed' ELSE 'valid' END AS review_status, CASE WHEN len(own) + len(linked) = 0 THEN CASE WHEN c % 11 = 2 THEN 'avoid' ELSE 'clear' END END AS verdict,
  count(*) AS reviews, CAST(sum(CASE WHEN c % 4 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS disagreements FROM e GROUP BY 1, 2""")
def _(v: Views):
    return review.review_counts(checked(v))
