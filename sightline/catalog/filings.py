"""Filed-fact queries: F6, F7, J1, J4-J7, W25-W34, W37, X11-X15."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.catalog.registry import register
from sightline.catalog.views import Views, r
from sightline.functions.scalars import half_even
from sightline.operators import fundamentals as fx
from sightline.operators.asof import as_known, known_versions
from sightline.session import cut

# Factor of each concept on the revenue fixture; nk varies it by company.
CONCEPT_FACTORS = {
    "revenue": "1.0", "gross_profit": "0.4", "operating_income": "(nk % 7 - 2) / 20.0",
    "net_income": "(nk % 6 - 1) / 25.0", "operating_cash_flow": "(nk % 5) / 20.0", "capital_expenditure": "0.03",
}


def filed_facts(v: Views):
    """Four reporting styles by nation: quarters, year-to-date, three quarters + year, halves + year."""
    base = v.facts.withColumns({"year_start": F.trunc("start_d", "year"), "lag": F.datediff("filed", "end_d")})
    ytd = F.sum("val").over(Window.partitionBy("company", "year_start", "lag").orderBy("start_d"))
    order = F.quarter("start_d")
    cumulative = base.withColumns({"ytd": half_even(ytd, 2), "mode": F.col("nk") % 4, "quarter": order})
    direct = (F.col("mode") == 0) | ((F.col("mode") == 2) & (F.col("quarter") < 4)) | (F.col("quarter") == 1)
    kept = cumulative.where(~((F.col("mode") == 3) & (F.col("quarter") % 2 == 1)))
    shaped = kept.select(
        "company", "nk", F.when(direct, F.col("start_d")).otherwise(F.col("year_start")).alias("start_d"),
        "end_d", "filed", F.when(direct, F.col("val")).otherwise(F.col("ytd")).alias("val"),
    )
    # Every eighth nation restates a quarter by -10 % in the filing one year later.
    later = cumulative.where((F.col("nk") % 8 == 0) & (F.col("lag") == 30)).select(
        "company", "nk", "start_d", "end_d", F.date_add(F.last_day(F.add_months("end_d", 12)), 30).alias("filed"),
        half_even(F.col("val") * 0.9, 2).alias("val"))
    shaped = shaped.unionByName(later)
    concepts = F.explode(F.array(*[
        F.struct(F.lit(name).alias("concept"), F.expr(factor).cast("double").alias("factor"))
        for name, factor in CONCEPT_FACTORS.items()
    ]))
    return shaped.withColumn("c", concepts).select(
        "company", "nk", "c.concept", "start_d", "end_d", "filed",
        half_even(F.col("val") * F.col("c.factor"), 2).alias("val"), F.lit(0).alias("priority"),
        (F.datediff("filed", F.lit("1990-01-01").cast("date")).cast("bigint") * 100000
         + F.datediff("start_d", F.lit("1990-01-01").cast("date"))).alias("seq"),
    )


FACTS_SQL = f"""fb AS (SELECT *, CAST(date_trunc('year', start_d) AS DATE) AS ys, filed - end_d AS lg, nk % 4 AS mode, quarter(start_d) AS qn FROM facts),
  fy AS (SELECT *, {r('sum(val) OVER (PARTITION BY company, ys, lg ORDER BY start_d)', 2)} AS ytd FROM fb),
  fs AS (SELECT company, nk, start_d, ys, end_d, filed, val, ytd, dir FROM (SELECT *, mode = 0 OR (mode = 2 AND qn < 4) OR qn = 1 AS dir FROM fy WHERE NOT (mode = 3 AND qn % 2 = 1))
    UNION ALL SELECT company, nk, start_d, ys, end_d, CAST(last_day(CAST(end_d + INTERVAL 12 MONTH AS DATE)) + 30 AS DATE), {r('val * 0.9', 2)}, NULL, TRUE FROM fy WHERE nk % 8 = 0 AND lg = 30),
  ff AS ({" UNION ALL ".join(f"SELECT company, nk, '{c}' AS concept, CASE WHEN dir THEN start_d ELSE ys END AS start_d, end_d, filed, " + r(f"CASE WHEN dir THEN val ELSE ytd END * CAST({f} AS DOUBLE)", 2) + " AS val, 0 AS priority FROM fs" for c, f in CONCEPT_FACTORS.items())}),
  fd AS MATERIALIZED (SELECT *, date_diff('day', start_d, end_d) AS days, CAST(date_diff('day', DATE '1990-01-01', filed) AS BIGINT) * 100000 + date_diff('day', DATE '1990-01-01', start_d) AS seq FROM ff)"""

QUARTER_SQL = FACTS_SQL + f""", dq AS (SELECT company, concept, start_d, end_d, filed, val, priority, 0 AS kind, seq AS a, 0 AS b FROM fd WHERE days BETWEEN 75 AND 105),
  de AS (SELECT DISTINCT company, concept, end_d FROM dq),
  nd AS (SELECT fd.* FROM fd ANTI JOIN de USING (company, concept, end_d)),
  j6 AS (SELECT l.company, l.concept, s.end_d AS start_d, l.end_d, greatest(l.filed, s.filed) AS filed, {r('l.val - s.val', 6)} AS val, l.priority, 1 AS kind, l.seq AS a, s.seq AS b
    FROM nd l JOIN fd s ON s.company = l.company AND s.concept = l.concept AND s.start_d = l.start_d AND s.priority = l.priority AND abs(l.end_d - s.end_d - 91) <= 12),
  kq AS (SELECT * FROM dq UNION ALL SELECT * FROM j6),
  yr AS (SELECT nd.*, row_number() OVER () AS rid FROM nd WHERE days BETWEEN 340 AND 380
    AND NOT EXISTS (SELECT 1 FROM kq WHERE kq.company = nd.company AND kq.concept = nd.concept AND kq.end_d = nd.end_d AND kq.start_d = nd.start_d)),
  yc AS (SELECT yr.rid, k.end_d, COALESCE(max_by(k, CASE WHEN k.filed <= yr.filed THEN row(k.filed, k.kind, k.a, k.b) END), min_by(k, row(k.kind, k.a, k.b))) AS q
    FROM yr JOIN kq k ON k.company = yr.company AND k.concept = yr.concept AND k.end_d > yr.start_d AND k.end_d < yr.end_d - 63 GROUP BY 1, 2),
  ys3 AS (SELECT rid, count(*) AS n, max(yc.end_d) AS le, max(q.filed) AS lf, sum(q.val) AS three FROM yc JOIN yr USING (rid)
    WHERE q.start_d >= yr.start_d - 12 AND q.priority = yr.priority GROUP BY 1),
  j7 AS (SELECT company, concept, le AS start_d, end_d, greatest(filed, lf) AS filed, {r('val - three', 6)} AS val, priority, 2 AS kind, seq AS a, 0 AS b
    FROM yr JOIN ys3 USING (rid) WHERE n = 3 AND abs(le - yr.start_d - 273) <= 24),
  qa AS (SELECT company, concept, end_d, filed, val, priority, min_by(start_d, row(kind, a, b)) AS start_d, min(row(kind, a, b)) AS seq
    FROM (SELECT * FROM kq UNION ALL SELECT * FROM j7) GROUP BY 1, 2, 3, 4, 5, 6),
  qt AS MATERIALIZED (SELECT * FROM qa QUALIFY priority = min(priority) OVER (PARTITION BY company, concept, end_d))"""

VERSION_SQL = QUARTER_SQL + """, q1 AS (SELECT company, concept, end_d, filed, max_by(val, seq) AS val, max_by(priority, seq) AS priority FROM qt GROUP BY 1, 2, 3, 4),
  qv AS MATERIALIZED (SELECT *, lead(filed) OVER w AS valid_to, lag(val) OVER w AS previous_val FROM q1 WINDOW w AS (PARTITION BY company, concept, end_d ORDER BY filed)),
  gr AS MATERIALIZED (SELECT DISTINCT company, CAST(end_d + 45 AS DATE) AS as_of FROM facts)"""


def grid(v: Views):
    return v.facts.select("company", F.date_add("end_d", 45).alias("as_of")).distinct()


def durations(v: Views):
    return cut(fx.duration_facts(filed_facts(v)))


def text(frame, *names):
    return frame.withColumns({name: F.col(name).cast("string") for name in names})


@register("j01_as_known", "facts", """WITH s AS (SELECT company, end_d, filed, val, lead(filed) OVER (PARTITION BY company, end_d ORDER BY filed) AS vt FROM facts),
  g AS (SELECT DISTINCT company, CAST(end_d + 45 AS DATE) AS as_of FROM facts)
  SELECT g.company, CAST(as_of AS VARCHAR) AS as_of, count(*) AS known_quarters, CAST(max(end_d) AS VARCHAR) AS latest_end, max_by(val, end_d) AS latest_val
  FROM g JOIN s ON s.company = g.company AND filed <= as_of AND (vt IS NULL OR as_of < vt) GROUP BY 1, 2""")
def _(v: Views):
    versions = known_versions(v.facts.select("company", "end_d", "filed", "val"), ["company", "end_d"])
    known = as_known(grid(v), versions, ["company"], "as_of").groupBy("company", "as_of").agg(
        F.count(F.lit(1)).alias("known_quarters"), F.max("end_d").alias("latest_end"), F.max_by("val", "end_d").alias("latest_val"))
    return text(known, "as_of", "latest_end")


@register("j06_quarter_differencing", "facts", "WITH " + QUARTER_SQL + """ SELECT company, concept, CAST(start_d AS VARCHAR) AS start_d, CAST(end_d AS VARCHAR) AS end_d,
    CAST(filed AS VARCHAR) AS filed, val FROM j6""")
def _(v: Views):
    rows = durations(v)
    ends = rows.where(F.col("days").between(75, 105)).select("company", "concept", "end_d").distinct()
    return text(fx.differenced_quarters(rows, ends), "start_d", "end_d", "filed").select(
        "company", "concept", "start_d", "end_d", "filed", "val")


@register("j07_annual_minus_three", "facts", "WITH " + QUARTER_SQL + """ SELECT company, concept, CAST(start_d AS VARCHAR) AS start_d, CAST(end_d AS VARCHAR) AS end_d,
    CAST(filed AS VARCHAR) AS filed, round(val, 2) AS val FROM j7""")
def _(v: Views):
    rows = durations(v)
    low, high = fx.RULES["quarter_days"]
    direct = rows.where(F.col("days").between(low, high))
    ends = direct.select("company", "concept", "end_d").distinct()
    known = direct.select("company", "concept", "start_d", "end_d", "filed", "val", "priority", F.struct(
        F.lit(0).alias("kind"), F.col("seq").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("seq")).unionByName(
        fx.differenced_quarters(rows, ends))
    return text(fx.annual_minus_three(rows, known, ends), "start_d", "end_d", "filed").select(
        "company", "concept", "start_d", "end_d", "filed", F.round("val", 2).alias("val"))


@register("w26_quarterly_values", "facts", "WITH " + QUARTER_SQL + """ SELECT company, concept, CAST(end_d AS VARCHAR) AS end_d, CAST(filed AS VARCHAR) AS filed,
    round(val, 2) AS val, seq[1] AS kind FROM qt""")
def _(v: Views):
    return text(fx.quarterly_values(durations(v)), "end_d", "filed").select(
        "company", "concept", "end_d", "filed", F.round("val", 2).alias("val"), F.col("seq.kind").alias("kind"))


@register("w27_annual_and_half_years", "facts", "WITH " + FACTS_SQL + f""" SELECT company, concept, CASE WHEN days >= 340 THEN 'annual' ELSE 'half' END AS kind,
    count(*) AS versions, count(DISTINCT end_d) AS ends, {r('sum(val)', 2)} AS total FROM fd WHERE days BETWEEN 340 AND 380 OR days BETWEEN 170 AND 195 GROUP BY 1, 2, 3""")
def _(v: Views):
    rows = durations(v)
    both = fx.period_values(rows, fx.RULES["annual_days"]).withColumn("kind", F.lit("annual")).unionByName(
        fx.period_values(rows, fx.RULES["half_year_days"]).withColumn("kind", F.lit("half")))
    return both.groupBy("company", "concept", "kind").agg(
        F.count(F.lit(1)).alias("versions"), F.countDistinct("end_d").alias("ends"), half_even(F.sum("val"), 2).alias("total"))


ARRAY_SQL = VERSION_SQL + f""", qk AS MATERIALIZED (SELECT g.company, concept, as_of, list({{'e': end_d, 'f': filed, 'v': val, 'p': priority, 'pv': previous_val}} ORDER BY end_d DESC)[1:8] AS q
    FROM gr g JOIN qv ON qv.company = g.company AND filed <= as_of AND (valid_to IS NULL OR as_of < valid_to) AND end_d <= as_of GROUP BY 1, 2, 3),
  pv AS MATERIALIZED (SELECT company, concept, kind, start_d, end_d, filed, val, priority, lead(filed) OVER (PARTITION BY company, concept, kind, end_d ORDER BY filed) AS vt
    FROM (SELECT *, CASE WHEN days >= 340 THEN 'a' ELSE 'h' END AS kind FROM fd WHERE days BETWEEN 340 AND 380 OR days BETWEEN 170 AND 195)),
  pk AS MATERIALIZED (SELECT g.company, concept, as_of, list({{'e': end_d, 's': start_d, 'v': val, 'p': priority}} ORDER BY end_d DESC) FILTER (kind = 'a') AS a,
      list({{'e': end_d, 's': start_d, 'v': val, 'p': priority}} ORDER BY end_d) FILTER (kind = 'h') AS h
    FROM gr g JOIN pv ON pv.company = g.company AND filed <= as_of AND (vt IS NULL OR as_of < vt) AND end_d <= as_of GROUP BY 1, 2, 3),
  ar AS MATERIALIZED (SELECT company, concept, as_of, COALESCE(q, []) AS q, COALESCE(a, []) AS a, COALESCE(h, []) AS h FROM qk FULL JOIN pk USING (company, concept, as_of)),
  hb AS MATERIALIZED (SELECT company, concept, as_of, list({{'e': he, 'v': yv + hv - ov}} ORDER BY he) AS b FROM (
      SELECT company, concept, as_of, hh.e AS he, hh.v AS hv, list_filter(a, lambda y: abs(hh.s - y.e - 1) <= 12)[1].v AS yv,
        list_filter(h, lambda o: abs(hh.e - o.e - 365) <= 12 AND abs(hh.s - o.s - 365) <= 12)[1].v AS ov
      FROM (SELECT *, unnest(h) AS hh FROM ar) x) z WHERE yv IS NOT NULL AND ov IS NOT NULL GROUP BY 1, 2, 3),
  rr AS MATERIALIZED (SELECT ar.*, COALESCE(b, []) AS b, CASE WHEN concept = 'revenue' AND len(q) >= 5 AND q[5].f = q[1].f AND q[5].pv > 0 AND q[5].v > 0
      AND (q[1].e - q[2].e) BETWEEN 63 AND 117 AND (q[2].e - q[3].e) BETWEEN 63 AND 117 AND (q[3].e - q[4].e) BETWEEN 63 AND 117 AND (q[4].e - q[5].e) BETWEEN 63 AND 117
      AND abs(q[5].v / q[5].pv - 1) > 0.05 THEN q[5].v / q[5].pv END AS ratio FROM ar LEFT JOIN hb USING (company, concept, as_of)),
  tt AS MATERIALIZED (SELECT company, concept, as_of, q, a, h, b, ratio,
    {", ".join(f'''CASE WHEN len(q) >= {o + 4} AND (q[{o+1}].e - q[{o+2}].e) BETWEEN 63 AND 117 AND (q[{o+2}].e - q[{o+3}].e) BETWEEN 63 AND 117 AND (q[{o+3}].e - q[{o+4}].e) BETWEEN 63 AND 117
      AND q[{o+1}].p = q[{o+2}].p AND q[{o+1}].p = q[{o+3}].p AND q[{o+1}].p = q[{o+4}].p
      THEN {" + ".join(f"q[{o+i}].v * CASE WHEN ratio IS NOT NULL AND q[{o+i}].f < q[1].f THEN ratio ELSE 1 END" for i in (4, 3, 2, 1))} END AS q{o}''' for o in (0, 4))},
    {", ".join(f"list_filter(b, lambda x: abs(x.e - (b[len(b)].e - {365 * y})) <= 12)[-1] AS hb{y}" for y in (0, 1))} FROM rr),
  tm AS MATERIALIZED (SELECT *, {", ".join(f'''CASE WHEN greatest(CASE WHEN q{o} IS NOT NULL THEN q[{o+1}].e END, a[{y+1}].e, hb{y}.e) IS NULL THEN NULL
      WHEN q{o} IS NOT NULL AND q[{o+1}].e = greatest(CASE WHEN q{o} IS NOT NULL THEN q[{o+1}].e END, a[{y+1}].e, hb{y}.e) THEN 'quarters'
      WHEN a[{y+1}].e = greatest(CASE WHEN q{o} IS NOT NULL THEN q[{o+1}].e END, a[{y+1}].e, hb{y}.e) THEN 'annual' ELSE 'half' END AS kind{o}''' for o, y in ((0, 0), (4, 1)))} FROM tt),
  ty AS MATERIALIZED (SELECT *, {", ".join(f"CASE kind{o} WHEN 'quarters' THEN q{o} WHEN 'annual' THEN a[{y+1}].v WHEN 'half' THEN hb{y}.v END AS ttm{o}, CASE kind{o} WHEN 'quarters' THEN [q[{o+4}].e, q[{o+3}].e, q[{o+2}].e, q[{o+1}].e] WHEN 'annual' THEN [a[{y+1}].e] WHEN 'half' THEN [hb{y}.e] END AS ends{o}" for o, y in ((0, 0), (4, 1)))} FROM tm)"""


def trailing(v: Views):
    return fx.trailing_years(grid(v), filed_facts(v))


@register("w25_consecutive_quarters", "facts", "WITH " + ARRAY_SQL + """ SELECT company, concept, CAST(as_of AS VARCHAR) AS as_of, len(q) AS quarters,
    COALESCE(len(q) >= 4 AND (q[1].e - q[2].e) BETWEEN 63 AND 117 AND (q[2].e - q[3].e) BETWEEN 63 AND 117 AND (q[3].e - q[4].e) BETWEEN 63 AND 117, FALSE) AS consecutive FROM qk""")
def _(v: Views):
    known = fx.quarters_as_of(grid(v), fx.quarterly_values(durations(v)))
    return text(known, "as_of").select("company", "concept", "as_of", F.size("q").alias("quarters"),
                                       fx.consecutive("q", 0, 4).alias("consecutive"))


@register("w28_trailing_twelve_months", "facts", "WITH " + ARRAY_SQL + f""" SELECT company, concept, CAST(as_of AS VARCHAR) AS as_of, {r('ttm0', 3)} AS ttm, {r('ttm4', 3)} AS ttm_prior,
    len(ends0) AS parts, CAST(ends0[-1] AS VARCHAR) AS last_end FROM ty""")
def _(v: Views):
    out = trailing(v)
    return text(out, "as_of").select(
        "company", "concept", "as_of", half_even("ttm0.val", 3).alias("ttm"), half_even("ttm4.val", 3).alias("ttm_prior"),
        F.when(F.col("ttm0").isNotNull(), F.size("ttm0.ends")).alias("parts"),
        F.element_at("ttm0.ends", -1).cast("string").alias("last_end"))


@register("w29_half_year_ttm", "facts", "WITH " + ARRAY_SQL + f""" SELECT company, concept, CAST(as_of AS VARCHAR) AS as_of, {r('hb0.v', 2)} AS ttm, {r('hb1.v', 2)} AS ttm_prior FROM tt WHERE hb0 IS NOT NULL""")
def _(v: Views):
    built = trailing(v).where(F.col("half0").isNotNull())
    return text(built, "as_of").select("company", "concept", "as_of", half_even("half0.val", 2).alias("ttm"),
                                       half_even("half4.val", 2).alias("ttm_prior"))


@register("w30_restatement_ratio", "facts", "WITH " + ARRAY_SQL + f""" SELECT company, CAST(as_of AS VARCHAR) AS as_of, {r('ratio', 6)} AS restatement_ratio FROM rr WHERE concept = 'revenue' AND ratio IS NOT NULL""")
def _(v: Views):
    out = trailing(v).where((F.col("concept") == "revenue") & F.col("restatement_ratio").isNotNull())
    return text(out, "as_of").select("company", "as_of", half_even("restatement_ratio", 6).alias("restatement_ratio"))


@register("w31_revenue_acceleration", "facts", "WITH " + ARRAY_SQL + f""" SELECT company, CAST(as_of AS VARCHAR) AS as_of, CASE WHEN len(q) >= 6 AND q[5].v > 0 AND q[6].v > 0
    AND {" AND ".join(f"(q[{i}].e - q[{i+1}].e) BETWEEN 63 AND 117" for i in range(1, 6))} THEN {r('q[1].v / q[5].v - q[2].v / q[6].v', 6)} END AS acceleration FROM qk WHERE concept = 'revenue'""")
def _(v: Views):
    known = fx.quarters_as_of(grid(v), fx.quarterly_values(durations(v).where(F.col("concept") == "revenue")))
    return text(known, "as_of").select("company", "as_of", half_even(fx.revenue_acceleration(), 6).alias("acceleration"))


LIMIT_SQL = ARRAY_SQL + """, la AS (SELECT company, as_of, max(a[1].e) AS ye FROM ar GROUP BY 1, 2),
  lm AS (SELECT la.company, la.as_of, CASE WHEN ye IS NULL OR EXISTS (SELECT 1 FROM (SELECT company, as_of, unnest(q) AS e FROM ar) x WHERE x.company = la.company AND x.as_of = la.as_of
    AND x.e.e > ye - 380 AND x.e.e <= ye) THEN 400 ELSE 550 END AS age_limit FROM la)"""


@register("w34_report_age_limit", "facts", "WITH " + LIMIT_SQL + " SELECT company, CAST(as_of AS VARCHAR) AS as_of, age_limit FROM lm")
def _(v: Views):
    return text(fx.report_age_limit(trailing(v)), "as_of")


@register("w37_latest_period_end", "facts", "WITH " + LIMIT_SQL + """, le AS (SELECT company, as_of, greatest(max(q[1].e), max(a[1].e)) AS latest_end FROM ar GROUP BY 1, 2)
  SELECT company, CAST(as_of AS VARCHAR) AS as_of, CAST(latest_end AS VARCHAR) AS latest_end, as_of + 300 - latest_end > age_limit AS is_stale FROM le JOIN lm USING (company, as_of) WHERE latest_end IS NOT NULL""")
def _(v: Views):
    rows = durations(v)
    quarters = known_versions(fx.quarterly_values(rows), ["company", "concept", "end_d"], sequence="seq")
    annuals = known_versions(fx.period_values(rows, fx.RULES["annual_days"]), ["company", "concept", "end_d"], sequence="seq")
    latest = fx.latest_period_end(grid(v), quarters, annuals)
    # Staleness is judged 300 days later, so that some companies pass the limit.
    joined = latest.join(fx.report_age_limit(trailing(v)), ["company", "as_of"])
    stale = F.datediff(F.date_add("as_of", 300), "latest_end") > F.col("age_limit")
    return text(joined.withColumn("is_stale", stale), "as_of", "latest_end").drop("age_limit")


SIGNAL_SQL = LIMIT_SQL + f""", wd AS (SELECT company, as_of, {", ".join(f"max(CASE WHEN concept = '{c}' THEN ttm{o} END) AS {s}{o}, max(CASE WHEN concept = '{c}' THEN ends{o} END) AS {s}e{o}" for c, s in (("revenue", "rv"), ("gross_profit", "gp"), ("operating_income", "oi"), ("net_income", "ni"), ("operating_cash_flow", "oc"), ("capital_expenditure", "cx")) for o in (0, 4))} FROM ty GROUP BY 1, 2),
  wl AS (SELECT wd.*, age_limit, CASE WHEN as_of - rve0[-1] <= age_limit THEN rv0 END AS rev, CASE WHEN as_of - nie0[-1] <= age_limit THEN ni0 END AS inc,
    CASE WHEN as_of - oce0[-1] <= age_limit THEN oc0 END AS ocf FROM wd JOIN lm USING (company, as_of)),
  wf AS (SELECT *, ocf - CASE WHEN cxe0 = oce0 THEN COALESCE(cx0, 0) ELSE 0 END AS fcf,
    CASE WHEN ocf IS NOT NULL AND oce0[-1] - oce4[-1] BETWEEN 330 AND 400 THEN oc4 - CASE WHEN cxe4 = oce4 THEN COALESCE(cx4, 0) ELSE 0 END END AS pf FROM wl),
  wm AS (SELECT *, CASE WHEN rve0 = oce0 AND rv0 > 0 THEN fcf / rv0 END AS fm, CASE WHEN pf IS NOT NULL AND rve4 = oce4 THEN rv4 END AS ps FROM wf)"""


@register("x11_statement_signals", "facts", "WITH " + SIGNAL_SQL + f""" SELECT company, CAST(as_of AS VARCHAR) AS as_of, {r('rev', 4)} AS pit_revenue_ttm,
    {r('CASE WHEN rev IS NOT NULL AND rv4 > 0 THEN rev / rv4 - 1 END', 6)} AS pit_revenue_growth_ttm, {r('CASE WHEN rev > 0 AND gpe0 = rve0 THEN gp0 / rev END', 6)} AS pit_gross_margin_ttm,
    {r('CASE WHEN rev > 0 AND oie0 = rve0 THEN oi0 / rev END', 6)} AS pit_operating_margin_ttm, {r('inc', 4)} AS pit_net_income_ttm, {r('fcf', 4)} AS pit_free_cash_flow_ttm,
    {r('CASE WHEN rve0 = oce0 AND rev > 0 THEN fcf / rev END', 6)} AS pit_fcf_margin_ttm, {r('CASE WHEN nie0 = oce0 AND ni0 > 0 THEN ocf / ni0 END', 6)} AS pit_cash_conversion FROM wm""")
def _(v: Views):
    out = cut(trailing(v))
    signals = fx.statement_signals(out, fx.report_age_limit(out))
    return text(signals, "as_of").select("company", "as_of", *[half_even(f"pit_{c}", d).alias(f"pit_{c}") for c, d in (
        ("revenue_ttm", 4), ("revenue_growth_ttm", 6), ("gross_margin_ttm", 6), ("operating_margin_ttm", 6), ("net_income_ttm", 4),
        ("free_cash_flow_ttm", 4), ("fcf_margin_ttm", 6), ("cash_conversion", 6))])


@register("x13_two_year_cash_flow", "facts", "WITH " + SIGNAL_SQL + f""" SELECT company, CAST(as_of AS VARCHAR) AS as_of, {r('pf', 2)} AS pit_free_cash_flow_prior_ttm,
    {r('CASE WHEN pf IS NOT NULL AND ps > 0 AND fm IS NOT NULL THEN (fcf + pf) / (rv0 + ps) ELSE fm END', 6)} AS pit_fcf_margin_2y,
    {r('CASE WHEN pf IS NOT NULL AND ps > 0 AND fm IS NOT NULL THEN least(fm, pf / ps) ELSE fm END', 6)} AS pit_fcf_margin_low FROM wm""")
def _(v: Views):
    out = cut(trailing(v))
    signals = fx.statement_signals(out, fx.report_age_limit(out))
    return text(signals, "as_of").select("company", "as_of", *[half_even(f"pit_{c}", d).alias(f"pit_{c}") for c, d in (
        ("free_cash_flow_prior_ttm", 2), ("fcf_margin_2y", 6), ("fcf_margin_low", 6))])


# Balance-sheet facts: quarter-end values scaled from revenue; debt tags and
# share counts appear by nation so that every branch is used.
INSTANTS = (
    # concept, priority, factor, condition, days before the quarter end
    ("cash", 0, "0.30", "nk % 11 <> 0", 0), ("debt_total_reported", 0, "0.50", "nk % 6 = 0", 0),
    ("debt_broad", 0, "0.20", "nk % 3 = 1", 3), ("debt_broad", 1, "0.35", "nk % 3 = 1", 0),
    ("long_term_debt", 0, "0.25", "nk % 3 = 2", 5), ("debt_noncurrent_parts", 0, "0.10", "nk % 3 = 2", 0),
    ("debt_noncurrent_parts", 1, "0.20", "nk % 3 = 2", 0), ("short_term_debt", 0, "0.05", "nk % 4 = 2", 0),
    ("debt_credit_lines", 0, "0.15", "nk % 5 = 3", 0), ("debt_notes", 0, "0.08", "nk % 5 = 3", 9),
    ("shares_outstanding", 0, "0.01", "nk % 4 <> 3", 0),
)
INSTANT_SQL = "ins AS (" + " UNION ALL ".join(
    f"SELECT company, nk, '{c}' AS concept, CAST(end_d - {b} AS DATE) AS end_d, filed, {r(f'val * {f}', 2)} AS val, {p} AS priority FROM facts WHERE {w}"
    for c, p, f, w, b in INSTANTS) + ")"


def instants(v: Views):
    entries = F.array_compact(F.array(*[
        F.when(F.expr(where.replace("<>", "!=")), F.struct(
            F.lit(concept).alias("concept"), F.lit(priority).alias("priority"), F.lit(float(factor)).alias("factor"), F.lit(back).alias("back")))
        for concept, priority, factor, where, back in INSTANTS
    ]))
    return v.facts.withColumn("i", F.explode(entries)).select(
        "company", "nk", "i.concept", F.lit(None).cast("date").alias("start_d"), F.date_sub("end_d", F.col("i.back")).alias("end_d"), "filed",
        half_even(F.col("val") * F.col("i.factor"), 2).alias("val"), "i.priority",
        F.datediff("filed", F.lit("1990-01-01").cast("date")).cast("bigint").alias("seq"))


def cash_versions(v: Views):
    rows = fx.best_tag(fx.instant_facts(instants(v), ["cash"]), ["company", "concept", "end_d"])
    return known_versions(rows, ["company", "concept", "end_d"], sequence="seq")


@register("j04_instant_as_of", "facts", "WITH " + INSTANT_SQL + """, g AS (SELECT DISTINCT company, CAST(end_d + 45 AS DATE) AS as_of, CAST(end_d - 320 AS DATE) AS cap FROM facts),
  k AS (SELECT g.company, as_of, cap, end_d, max_by(val, filed) AS val, max(filed) AS filed FROM g JOIN ins ON ins.company = g.company AND concept = 'cash' AND filed <= as_of AND end_d <= as_of GROUP BY 1, 2, 3, 4)
  SELECT company, CAST(as_of AS VARCHAR) AS as_of, max_by(val, end_d) AS latest, max_by(val, CASE WHEN end_d <= cap THEN end_d END) AS year_ago FROM k GROUP BY 1, 2""")
def _(v: Views):
    asked = grid(v).withColumn("cap", F.date_sub("as_of", 365))
    versions = cash_versions(v)
    now = fx.instant_as_of(asked, versions, prefix="n_").select("company", "as_of", F.col("n_val").alias("latest"))
    then = fx.instant_as_of(asked, versions, cap="cap", prefix="y_").select("company", "as_of", F.col("y_val").alias("year_ago"))
    return text(now.join(then, ["company", "as_of"], "left"), "as_of")


DEBT_SQL = INSTANT_SQL + """, gr AS MATERIALIZED (SELECT DISTINCT company, CAST(end_d + 45 AS DATE) AS as_of FROM facts),
  cb AS (SELECT g.company, as_of, max(end_d) AS be FROM gr g JOIN ins ON ins.company = g.company AND concept = 'cash' AND filed <= as_of AND end_d <= as_of GROUP BY 1, 2),
  tg AS (SELECT cb.company, as_of, be, concept, priority, max_by(val, row(end_d, filed)) AS val FROM cb JOIN ins ON ins.company = cb.company AND concept NOT IN ('cash', 'shares_outstanding')
    AND end_d BETWEEN be - 7 AND be AND filed <= as_of GROUP BY 1, 2, 3, 4, 5),
  dc AS (SELECT company, as_of, be, concept, CASE WHEN concept IN ('debt_noncurrent_parts', 'debt_current_parts', 'debt_credit_lines', 'debt_notes') THEN sum(val)
    WHEN concept = 'debt_broad' THEN max(val) ELSE min_by(val, priority) END AS val FROM tg GROUP BY 1, 2, 3, 4)"""


def balances(v: Views):
    return fx.instant_as_of(grid(v), cash_versions(v), prefix="c_").select("company", "as_of", F.col("c_end").alias("balance_end"))


@register("j05_debt_components", "facts", "WITH " + DEBT_SQL + f" SELECT company, CAST(as_of AS VARCHAR) AS as_of, CAST(be AS VARCHAR) AS balance_end, concept, {r('val', 2)} AS val FROM dc")
def _(v: Views):
    out = fx.debt_components(balances(v), fx.instant_facts(instants(v)))
    return text(out.withColumn("val", half_even("val", 2)), "as_of", "balance_end")


@register("x12_total_debt", "facts", "WITH " + DEBT_SQL + f""", w AS (SELECT company, as_of, {", ".join(f"max(CASE WHEN concept = '{c}' THEN val END) AS {c}" for c in fx.DEBT_COMBINE)} FROM dc GROUP BY 1, 2),
  x AS (SELECT *, greatest(long_term_debt, debt_noncurrent_parts) AS nc, greatest(short_term_debt, debt_current_parts) AS cu FROM w),
  y AS (SELECT *, greatest(debt_broad, CASE WHEN nc IS NOT NULL OR cu IS NOT NULL THEN COALESCE(nc, 0) + COALESCE(cu, 0) END,
    CASE WHEN debt_credit_lines IS NOT NULL OR debt_notes IS NOT NULL THEN COALESCE(debt_credit_lines, 0) + COALESCE(debt_notes, 0) END) AS rd FROM x)
  SELECT cb.company, CAST(cb.as_of AS VARCHAR) AS as_of, {r('COALESCE(debt_total_reported, rd, 0)', 2)} AS total_debt,
    CASE WHEN debt_total_reported IS NOT NULL THEN 'reported_total' WHEN rd IS NOT NULL THEN 'components' ELSE 'none_found' END AS debt_coverage
  FROM cb LEFT JOIN y ON y.company = cb.company AND y.as_of = cb.as_of""")
def _(v: Views):
    held = balances(v)
    out = held.join(fx.total_debt(fx.debt_components(held, fx.instant_facts(instants(v)))), ["company", "as_of", "balance_end"], "left")
    return text(out, "as_of").select(
        "company", "as_of", half_even(F.coalesce("total_debt", F.lit(0.0)), 2).alias("total_debt"),
        F.coalesce("debt_coverage", F.lit("none_found")).alias("debt_coverage"))


# Weighted averages: quarter, year-to-date and annual rows from the duration fixture.
def weighted(v: Views):
    return filed_facts(v).where(F.col("concept") == "revenue").withColumns({
        "concept": F.lit("weighted_average_shares"),
        "val": half_even(F.col("val") * F.when(F.col("nk") % 3 == 0, 0.02).when(F.col("nk") % 7 == 1, 0.5).otherwise(0.0101), 2)})


WEIGHTED_SQL = FACTS_SQL + f""", wa AS (SELECT company, end_d, filed, seq, days, {r('val * CASE WHEN nk % 3 = 0 THEN 0.02 WHEN nk % 7 = 1 THEN 0.5 ELSE 0.0101 END', 2)} AS val FROM fd WHERE concept = 'revenue' AND days <= 380),
  wc AS (SELECT * FROM wa QUALIFY (days BETWEEN 75 AND 105) = bool_or(days BETWEEN 75 AND 105) OVER (PARTITION BY company, end_d))"""


@register("w32_weighted_shares", "facts", "WITH " + WEIGHTED_SQL + " SELECT company, CAST(end_d AS VARCHAR) AS end_d, CAST(filed AS VARCHAR) AS filed, val FROM wc")
def _(v: Views):
    return text(fx.weighted_shares(weighted(v)), "end_d", "filed").select("company", "end_d", "filed", "val")


@register("w33_share_count", "facts", "WITH " + WEIGHTED_SQL + ", " + INSTANT_SQL + f""", gr AS MATERIALIZED (SELECT DISTINCT company, CAST(end_d + 45 AS DATE) AS as_of FROM facts),
  pe AS (SELECT company, as_of, max_by(val, end_d) AS val, max(end_d) AS e FROM (SELECT g.company, as_of, end_d, max_by(val, filed) AS val FROM gr g JOIN ins ON ins.company = g.company AND concept = 'shares_outstanding'
    AND filed <= as_of AND end_d <= as_of GROUP BY 1, 2, 3) GROUP BY 1, 2),
  wv AS (SELECT company, as_of, max_by(val, end_d) AS val, max(end_d) AS e FROM (SELECT g.company, as_of, end_d, max_by(val, row(filed, seq)) AS val FROM gr g JOIN wc ON wc.company = g.company
    AND filed <= as_of AND end_d <= as_of GROUP BY 1, 2, 3) GROUP BY 1, 2),
  b AS (SELECT gr.company, gr.as_of, CASE WHEN gr.as_of - pe.e <= 400 AND pe.val > 0 THEN pe.val END AS p, CASE WHEN gr.as_of - wv.e <= 400 AND wv.val > 0 THEN wv.val END AS w
    FROM gr LEFT JOIN pe USING (company, as_of) LEFT JOIN wv USING (company, as_of)),
  c AS (SELECT company, as_of, p, CASE WHEN p IS NOT NULL AND w > p * 10 THEN NULL ELSE w END AS w FROM b)
  SELECT company, CAST(as_of AS VARCHAR) AS as_of, {r('CASE WHEN p IS NOT NULL AND NOT COALESCE(p * 1.2 < w, FALSE) THEN p ELSE w END', 2)} AS shares,
    CASE WHEN p IS NOT NULL AND NOT COALESCE(p * 1.2 < w, FALSE) THEN 'period_end' WHEN w IS NOT NULL THEN 'weighted_average' END AS shares_basis FROM c""")
def _(v: Views):
    periods = known_versions(fx.best_tag(fx.instant_facts(instants(v), ["shares_outstanding"]), ["company", "concept", "end_d"]),
                             ["company", "concept", "end_d"], sequence="seq")
    averages = known_versions(fx.weighted_shares(weighted(v)), ["company", "concept", "end_d"], sequence="seq")
    out = fx.share_counts(grid(v).withColumn("age_limit", F.lit(400)), periods, averages)
    return text(out, "as_of").select("company", "as_of", half_even("shares.val", 2).alias("shares"), "shares_basis")


@register("x14_market_cap_reconciliation", "xs", f"""WITH d AS (SELECT ticker, s3 * 1000 AS shares, CASE WHEN s1 > 0 THEN s1 END AS price, CASE WHEN ticker % 4 <> 0 THEN s2 * 30 END AS sup FROM xs)
  SELECT ticker, {r('''CASE WHEN price IS NULL OR shares <= 0 THEN NULL WHEN sup IS NULL THEN shares * price WHEN shares * price / sup >= 2 OR shares * price / sup <= 0.5 THEN sup ELSE shares * price END''', 2)} AS market_cap,
    CASE WHEN price IS NULL OR shares <= 0 THEN NULL WHEN sup IS NOT NULL AND (shares * price / sup >= 2 OR shares * price / sup <= 0.5) THEN 'reported_shares_unreconciled' ELSE 'reported_shares' END AS basis FROM d""")
def _(v: Views):
    cap, basis = fx.reconciled_market_cap(
        F.col("s3") * 1000, F.when(F.col("s1") > 0, F.col("s1")), F.when(F.col("ticker") % 4 != 0, F.col("s2") * 30))
    return v.xs.select("ticker", half_even(cap, 2).alias("market_cap"), basis.alias("basis"))


@register("x15_share_unit_factor", "xs", f"""SELECT ticker, {r("CASE WHEN s2 > 0 AND s1 > 0 AND (s2 / (s1 * 50) >= 2 OR s2 / (s1 * 50) <= 0.5) THEN s2 / (s1 * 50) ELSE 1 END", 6)} AS factor FROM xs""")
def _(v: Views):
    return v.xs.select("ticker", half_even(fx.share_unit_factor(F.col("s2"), F.col("s1") * 50), 6).alias("factor"))


# Forms and units for F6 and F7 come from order priority and status.
@register("f06_proxy_forms", "", """SELECT form, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'DEF 14A' WHEN '2-HIGH' THEN 'PRER14C/A' WHEN '3-MEDIUM' THEN '10-K' WHEN '5-LOW' THEN '10-Q/A' END AS form
    FROM orders) q WHERE COALESCE(NOT regexp_matches(regexp_replace(upper(trim(COALESCE(form, ''))), '/A$', ''), '(14A|14C)$'), TRUE) GROUP BY 1""")
def _(v: Views):
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "DEF 14A").when(F.col("o_orderpriority") == "2-HIGH", "PRER14C/A") \
        .when(F.col("o_orderpriority") == "3-MEDIUM", "10-K").when(F.col("o_orderpriority") == "5-LOW", "10-Q/A")
    return fx.without_proxies(v.table("orders").withColumn("form", form)).groupBy("form").agg(F.count(F.lit(1)).alias("n"))


@register("f07_dominant_currency", "", """WITH f AS (SELECT o_custkey AS company, CASE WHEN o_orderstatus = 'P' THEN 'shares_outstanding' ELSE 'revenue' END AS concept,
      CASE WHEN o_orderpriority < '2' THEN 'CAD' WHEN o_orderpriority < '4' THEN 'USD' WHEN o_custkey % 2 = 0 THEN 'EUR' END AS unit FROM orders),
  c AS (SELECT company, unit, count(*) AS n FROM f WHERE concept = 'revenue' AND unit IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT company, min_by(unit, row(-n, unit)) AS currency FROM c GROUP BY 1)
  SELECT f.company, currency, CAST(sum(CASE WHEN concept = 'shares_outstanding' OR currency IS NULL OR unit IS NULL OR unit = currency THEN 1 ELSE 0 END) AS BIGINT) AS kept
  FROM f LEFT JOIN b ON b.company = f.company GROUP BY 1, 2 HAVING kept > 0""")
def _(v: Views):
    unit = F.when(F.col("o_orderpriority") < "2", "CAD").when(F.col("o_orderpriority") < "4", "USD").when(F.col("o_custkey") % 2 == 0, "EUR")
    facts = v.table("orders").select(
        F.col("o_custkey").alias("company"), F.when(F.col("o_orderstatus") == "P", "shares_outstanding").otherwise("revenue").alias("concept"),
        unit.alias("unit"), F.lit("ifrs-full:Revenue").alias("tag"))
    currency = fx.dominant_currency(facts)
    return fx.single_currency(facts, currency).groupBy("company").agg(F.count(F.lit(1)).alias("kept")).join(
        currency, "company").select("company", "currency", "kept")
